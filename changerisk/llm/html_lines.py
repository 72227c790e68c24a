"""Text lines of an HTML page, each marked as article, boilerplate or undecided.

A tolerant reader for one page: it knows which elements are blocks, which close each other, and
which hold no text to read; everything else is inline. Comments, markup and the content of
scripts, styles and forms give no lines.
"""

from __future__ import annotations

import html
import re
from collections import Counter

#: Marks of a line.
BOILERPLATE, UNDECIDED, ARTICLE = 0, 1, 2
#: States of a reader only. Names hint at boilerplate, by a word of them or as a whole; an article may
#: still stand inside. An article in an element of the latter kind is spare: it counts if the page has no other.
_HINTED, _NAMED, _SPARE = 3, 4, 5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][A-Za-z0-9:-]*)(?P<rest2>[^<>]*+)>"
    r"|<[!?/][^>]*+>?"
    r"|(?P<text>[^<]++|<)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_CAMEL = re.compile(r"[a-z]+(?:[A-Z][a-z]*)+")
#: Class names that say what an element has or lacks, not what it is.
_STATE = re.compile(r"(?:has|no|not|with|without)[-_]", re.IGNORECASE)

#: Elements that start and end a line.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never the article's.
_NEVER = frozenset(
    "head nav footer aside form menu dialog search button select option datalist label legend fieldset noscript template "
    "iframe object svg math canvas audio video map".split()
)
#: Elements that are not markup inside: they end at their own end tag only.
_RAW = frozenset("script style textarea xmp noembed noframes".split())
_IN_HEAD = frozenset("title meta link style script base noscript template head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a following one of the second set closes.
_CLOSED_BY = {
    "p": _BLOCKS - {"body", "html", "head"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}),
    "tr": frozenset({"tr"}),
    "option": frozenset({"option"}),
}
#: Words of class names and ids, and roles, that mark boilerplate.
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "notification outbrain overlay pager pagination paywall popup promo promoted promotion recommended related "
    "replies reply respond share sharing sidebar signin signup skip social sponsor sponsored subscribe taboola toolbar "
    "widget".split()
)
#: Names of containers, as classes and ids write them, that are boilerplate also inside an article: a word of
#: readers' comments, and words of adverts, notices and tools with a word for a box. Other hyphenated names
#: that hold such words ("related-work", "has-comments") are the author's.
_CONTAINERS = re.compile(
    r"(?:comments?|repl(?:y|ies)|respond)(?:[-_](?:area|body|block|box|container|form|items?|list|section|threads?|wrap|wrapper))*"
    r"|disqus(?:[-_][a-z]+)*"
    r"|(?:ads?|adverts?|advertisements?|outbrain|promo|sponsored|sponsor|taboola)"
    r"(?:[-_](?:banner|block|bottom|box|container|content|inner|label|side|slot|space|top|unit|wrap|wrapper|[0-9]+))+"
    r"|(?:[a-z]+[-_])+(?:ads?|adverts?|advertisements?)"
    r"|(?:consent|cookies?|gdpr|newsletter|paywall|signup|subscribe)"
    r"[-_](?:banner|bar|block|box|consent|form|message|modal|notice|overlay|popup|prompt|signup|subscribe|wall|widget)"
    r"|(?:share|sharing|social)[-_](?:bar|box|buttons?|icons?|links?|media|tools|widget)"
    r"|related[-_](?:articles?|content|items|links?|news|posts?|stories)"
)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: Words that mark boilerplate outside an article; inside they name the head of the article itself.
_OUTSIDE = frozenset("header topbar".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())


def _kind(tag: str, rest: str, inside_article: bool) -> int:
    """What an element makes of the text in it; undecided if nothing speaks for either."""
    if tag in _NEVER or (tag == "header" and not inside_article):
        return BOILERPLATE
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if "=" in rest else {}
    role = found.get("role", "").lower()
    if inside_article and found and tag not in ("html", "body", "main"):
        # Ids of headings are made from their words.
        names = [*found.get("class", "").split(), *([] if tag in _HEADINGS else [found.get("id", "")])]
        if any(_CONTAINERS.fullmatch(name.lower()) for name in names):
            return BOILERPLATE
    if tag in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
        return ARTICLE
    if found and tag not in ("html", "body"):
        tokens, name = found.get("class", "").split(), found.get("id", "")
        whole = {token.lower() for token in tokens} & _HINTS
        if role in _ROLES:
            return BOILERPLATE
        if inside_article:
            # Ids are often made from headings, but not those in camel case.
            camel = _CAMEL.fullmatch(name) and {word.lower() for word in _NAME.findall(name)} & _HINTS
            return BOILERPLATE if whole or camel else UNDECIDED
        if whole or name.lower() in _HINTS:
            return _NAMED
        parts = [token for token in [*tokens, name] if not _STATE.match(token)]
        if {word.lower() for word in _NAME.findall(" ".join(parts))} & (_HINTS | _OUTSIDE):
            return _HINTED
    return UNDECIDED


def _within(state: int, kind: int) -> int:
    """What holds in an element of a kind that opens where ``state`` holds."""
    if state == BOILERPLATE or kind == UNDECIDED:
        return state
    if kind == ARTICLE:
        return _SPARE if state in (_NAMED, _SPARE) else ARTICLE
    return _NAMED if state == _NAMED and kind == _HINTED else kind


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """Lines of a page in order, with their marks. White space is one space; empty lines are left out."""
    lines: list[tuple[str, int]] = []
    buffer: list[str] = []
    open_elements: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    state = UNDECIDED
    page = page or ""

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                lines.append((text, state))

    def close(at: int) -> int:
        """Close elements from position ``at``; returns what then holds."""
        opened.subtract(tag for tag, _ in open_elements[at:])
        del open_elements[at:]
        return open_elements[-1][1] if open_elements else UNDECIDED

    position, scan = 0, _TOKEN.match
    while position < len(page):
        match = scan(page, position)
        position = match.end()
        text = match["text"]
        if text is not None:
            buffer.append(html.unescape(text) if "&" in text else text)
            continue
        tag = match["tag"] or match["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if match["end"] or match["end2"]:
            if tag in _BLOCKS or opened[tag]:
                flush()
            if opened[tag]:
                state = close(next(i for i in range(len(open_elements) - 1, -1, -1) if open_elements[i][0] == tag))
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, position)
            position = end.start() if end else len(page)
            continue
        if tag == "br":
            buffer.append(" ")
        block = tag in _BLOCKS
        if block:
            flush()
        while open_elements and (
            tag in _CLOSED_BY.get(open_elements[-1][0], ()) or (open_elements[-1][0] == "head" and tag not in _IN_HEAD)
        ):
            flush()
            state = close(len(open_elements) - 1)
        if tag in _VOID:
            continue
        if block or tag in _NEVER or "=" in (match["rest"] or match["rest2"] or ""):
            kind = _kind(tag, match["rest"] or match["rest2"] or "", state in (ARTICLE, _SPARE))
            if block or kind not in (UNDECIDED, ARTICLE):
                if not block:
                    flush()
                state = _within(state, kind)
                open_elements.append((tag, state))
                opened[tag] += 1
    flush()
    spare = BOILERPLATE if any(mark == ARTICLE for _, mark in lines) else ARTICLE
    marks = {_HINTED: BOILERPLATE, _NAMED: BOILERPLATE, _SPARE: spare}
    return [(text, marks.get(mark, mark)) for text, mark in lines]
