"""Pages, licenses and conversations against brute force and exact round trips."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from changerisk.llm.chat import conversation_digests, format_conversations, read_conversation
from changerisk.llm.html_lines import ARTICLE, BOILERPLATE, UNDECIDED, lines_of
from changerisk.llm.licenses import BASE_PHRASES, TEMPLATES, license_report, license_scan
from changerisk.llm.page_diff import common_lines, page_texts

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head>
<body class="news ad"><header>Site</header><nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- <article>no</article> -->
<div class="cookie-notice">We use cookies</div><aside>Side</aside><div id="ad-1">Buy</div>
<article><header><h1>A &amp; B</h1></header><p><b>One
  two<br>three <i>four</i>.<p title="a > b">Fünf &copy; &#x41;&nbsp;&lt;b&gt;<form><input><label>Name</label></form>
<ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table><section class="comments"><p>nice!</p></section><div>tail</article>
<footer>&copy; me</footer>"""


def test_article_lines():
    lines = lines_of(PAGE)
    assert [t for t, m in lines if m == ARTICLE] == [
        "A & B", "One two three four.", "Fünf © A <b>", "x", "y", "c1", "c2", "tail",
    ]
    assert {t for t, m in lines if m == BOILERPLATE} >= {"T", "Site", "Home", "We use cookies", "Side", "Buy", "Name", "nice!", "© me"}


def test_names_of_classes_and_roles():
    page = """<body><div class="siteHeader">Top</div><div class="cookieBanner">C</div><div role="main"><div class="entry-header">Title</div>
    <p class="byline">By me<p id="readerComments">nice<p class="shadow adapter">Kept<p class="ad">buy</div><div class="other">Rest</div>"""
    assert [t for t, m in lines_of(page) if m == ARTICLE] == ["Title", "By me", "Kept"]
    assert [t for t, m in lines_of(page) if m == UNDECIDED] == ["Rest"]


@pytest.mark.parametrize(
    "page",
    [
        '<article class="post has-sidebar comments-open"><p>Text</article>',
        '<main class="with-sidebar"><p>Text</main>',
        '<div class="page no-sidebar"><article><p>Text</article></div>',
        '<div class="sidebar"><div><article><p>Text</article>Side</div></div>',
        '<div class="layout-sidebar"><article><p>Text</article>Side</div>',
        '<div class="related"><article>Teaser</article></div><article>Text</article>',
    ],
)
def test_names_do_not_void_articles(page):
    assert [t for t, m in lines_of(page) if m == ARTICLE] == ["Text"]


def test_ids_made_from_headings_stay():
    page = """<article><section id="related-work"><p>One</section><h2 id="social-impact">Two</h2><h2 id="copyright-law">Three</h2>
    <div class="share">f</div><div class="my-comments-on-it">Four</div></article>"""
    assert [t for t, m in lines_of(page) if m == ARTICLE] == ["One", "Two", "Three", "Four"]


@pytest.mark.parametrize(
    "part",
    [
        '<section id="comments"><p>Gone</section>',
        '<div id="disqus_thread">Gone</div>',
        '<div class="comments-area">Gone</div>',
        '<div class="wide ad-slot">Gone</div>',
        '<aside-x class="x in-article-ad">Gone</aside-x>',
        '<div class="newsletter-signup">Gone</div>',
        '<div class="share-buttons">Gone</div>',
        '<ul class="related-posts"><li>Gone</ul>',
        '<div id="cookie-banner">Gone</div>',
        '<article class="comment"><p>Gone</article>',
        '<ol class="comment-list"><li><article><p>Gone</article></ol>',
    ],
)
@pytest.mark.parametrize("tag", ["article", "main"])
def test_containers_inside_articles_go(part, tag):
    page = f"<{tag}><p>Text</p>{part}<p>End</p></{tag}>"
    assert [t for t, m in lines_of(page) if m == ARTICLE] == ["Text", "End"]


def test_words_of_the_author_stay_inside_articles():
    parts = ['<section id="related-work">', '<section id="social-impact">', '<div class="ad-hoc">', '<p id="cookie-law">', '<div class="newsletter-history">',
             '<div class="has-comments">', '<section id="comments-on-method">', '<h2 id="comments">', '<h3 id="share-buttons">', '<div class="shared-links-2">']
    page = "<article>" + "".join(f"{part}{i}</{part[1:].split()[0]}>" for i, part in enumerate(parts)) + "</article>"
    assert [t for t, m in lines_of(page) if m == ARTICLE] == [str(i) for i in range(len(parts))]


@pytest.mark.parametrize(
    "page", [None, "", "<", "<p", "<!--", "<script>x", "a<b", "</p></div>", "<div" * 50, "&#xD800; &am &amp", "<p title='x>y<p>z", "\x00"]
)
def test_broken_pages_give_lines(page):
    assert all(mark in (BOILERPLATE, UNDECIDED, ARTICLE) and text for text, mark in lines_of(page))


@pytest.mark.parametrize("part", ["<a ", "<div>", "<div></p>", "<a '", '<p "x"', "<script>", "<!--", "&amp", "</", "<td><p>", "<a b='>"])
def test_long_broken_pages_take_no_more_than_their_length(part):
    start = time.perf_counter()
    lines_of(part * 100_000)
    assert time.perf_counter() - start < 10


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_are_longest():
    dice = random.Random(1)
    for _ in range(300):
        a, b = ([dice.randrange(6) for _ in range(dice.randrange(14))] for _ in range(2))
        places = common_lines(np.array(a, "int64"), np.array(b, "int64"))
        assert places == sorted(set(places)) and len(places) == brute_lcs(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in places)


def test_differencing_decides_where_markup_does_not(spark):
    frame = "<body><div>Menu one</div><div>Menu two</div>{}<div>Imprint</div>"
    rows = [(i, f"http://a.org/news/{i}", frame.format(f"<p>Story {i}</p><p>Only in {i}</p>")) for i in range(4)]
    rows += [(10, "http://b.org/1", frame.format("<p>Alone</p>"))]
    rows += [(11, "http://c.org/x?a", frame.format("<p>Copy</p>")), (12, "http://c.org/x?b", frame.format("<p>Copy</p>"))]
    rows += [(13, "http://d.org/1", "<article><p>Quoted</p></article>"), (14, "http://d.org/2", "<article><p>Quoted</p><p>x</p></article>")]
    rows += [(20, None, None), (21, "not a url", ""), (None, "http://e.org", "<p>no id"), (10, "http://f.org", "<p>again")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS row", "'x' AS lines")
    found = {(r["page_id"], r["url"]): r for r in page_texts(df).collect()}
    text = lambda i: next(r["text"] for (k, _), r in found.items() if k == i)
    assert len(found) == len(rows)
    assert [text(i) for i in range(4)] == [f"Story {i}\nOnly in {i}" for i in range(4)]
    assert found[(10, "http://b.org/1")]["text"] == "Menu one\nMenu two\nAlone\nImprint"
    assert text(11) == text(12) == "Menu one\nMenu two\nCopy\nImprint"
    assert (text(13), text(14), text(20), text(21), text(None)) == ("Quoted", "Quoted\nx", "", "", "no id")
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_a_large_template_is_no_copy(spark):
    frame = "<body><div>Menu one</div><div>Menu two</div>{}<div>Imprint</div>"
    rows = [(i, f"http://a.org/news/{i}", frame.format(f"<p>Hi{i}</p>")) for i in range(4)]
    rows += [(i, f"http://b.org/{i}", frame.format("<p>Copied three times</p>")) for i in (10, 11, 12)]
    rows += [(i, f"http://c.org/{i // 2}/{i}", frame.format(f"<p>Copy {i // 2}</p>")) for i in range(20, 26)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    text = {r["page_id"]: r["text"] for r in page_texts(df).collect()}
    assert [text[i] for i in range(4)] == [f"Hi{i}" for i in range(4)]
    assert {text[i] for i in (10, 11, 12)} == {"Menu one\nMenu two\nCopied three times\nImprint"}
    assert [text[i] for i in range(20, 26)] == [f"Copy {i // 2}" for i in range(20, 26)]


def test_pages_of_an_empty_table(spark):
    assert page_texts(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_licenses(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = sorted(
        (i, label)
        for phrase, label in BASE_PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    )
    return len(words), places


def test_base_phrases(spark, docs):
    dice = random.Random(2)
    vocabulary = ["MIT", "License", "apache", "general", "Public", "license", "the", "x1", "É", "K"]
    rows = [(100 + i, dice.choice(" .-/").join(dice.choices(vocabulary, k=dice.randrange(40)))) for i in range(150)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = sorted(((r["doc_id"], r["n_words"], [tuple(p) for p in r["places"]]) for r in license_scan(df).collect()), key=str)
    assert found == sorted(((r["doc_id"], *brute_licenses(r["text"])) for r in df.collect()), key=str)


def test_spans_survive_changed_words_and_make_labels(spark):
    rows = [
        (1, "Code is free: permission is hereby granted, free of any charge, to any person obtaining a copy of the software"),
        (2, "Licensed under CC BY-NC 4.0."),
        (3, "software copy a obtaining person any to charge of free granted hereby is permission"),
        (4, "Released under the MIT License. " * 500),
        (5, None),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in license_report(df).collect()}
    assert (found[1]["labels"], found[1]["base_labels"]) == ("mit", "") and 0.7 <= found[1]["score"] < 1
    assert found[2]["labels"] == "cc-by-nc" and found[2]["first_word"] is None
    assert found[3]["labels"] == "" and found[3]["score"] == 0
    assert (found[4]["n_base"], found[4]["first_word"], found[4]["last_word"], found[4]["labels"]) == (500, 3, 2498, "mit")
    assert (found[5]["n_words"], found[5]["n_base"], found[5]["score"]) == (0, 0, 0.0)


def test_notices_of_further_licenses(spark):
    """Each template as a notice among other words, with a word missing, and its nearest relative not in the labels."""
    texts, expected = [], {}
    for number, (phrase, label) in enumerate(TEMPLATES.items()):
        words = phrase.split()
        near = words[:3] + words[4:] if len(words) > 9 else words
        texts += [(2 * number, f"Foo, bar: {phrase.upper()}. Baz"), (2 * number + 1, " ".join(["a", *near, "b"]))]
        expected[2 * number] = expected[2 * number + 1] = label
    found = {r["doc_id"]: set(r["labels"].split(",")) - set(r["base_labels"].split(",")) or set(r["labels"].split(","))
             for r in license_report(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert {i: labels for i, labels in found.items() if expected[i] not in labels} == {}
    assert found[2 * list(TEMPLATES.values()).index("lgpl")] == {"lgpl"}
    assert found[2 * list(TEMPLATES.values()).index("agpl")] == {"agpl"}


def test_licenses_of_an_empty_table(none):
    assert license_report(none).collect() == []


PIECES = ["\\", "###", " </turn>\n", "</turn>", "### Assistant: ", "\n", " ", "x", ":", "\\\\", "#", "$1", "é", "\\###", "\\</turn>"]


def conversations():
    dice = random.Random(4)
    rows = []
    for conversation in range(120):
        for turn in range(dice.randrange(1, 6)):
            role = dice.choice(["user", "assistant", "system", "a:b\\", ""])
            rows.append((conversation, turn, role, "".join(dice.choices(PIECES, k=dice.randrange(7)))))
    rows += [(500, 0, None, None), (500, 1, "assistant", None), (501, None, "assistant", "n"), (None, 0, "user", "id"), (502, 1, "user", "b")]
    return rows + [(502, 0, "user", "a"), (502, 1, "user", "b"), (503, 0, "assistant", "y" * 300_000)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_conversations_come_back(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS t", "'x' AS plain")
    formatted = format_conversations(df)
    found = {r["conv_id"]: r for r in conversation_digests(formatted).collect()}
    whole = {r["conv_id"]: r for r in formatted.withColumn("turns", read_conversation(formatted["formatted"])).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conversation, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        turns = [(role or "", text or "") for _, _, role, text in sorted(group, key=key)]
        assert [tuple(t) for t in whole[conversation]["turns"]] == turns
        loss = "".join(text for role, text in turns if role == "assistant")
        row = found[conversation]
        assert row["turns_sha256"] == digest("".join(f"{role}\n{text}\n" for role, text in turns))
        assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (len(turns), len(loss), digest(loss))
        assert row["formatted_chars"] == len(whole[conversation]["formatted"])
    assert len(found) == len({r[0] for r in rows})


def test_plain_texts_are_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a\\b # c")], "conv_id bigint, turn bigint, role string, text string")
    assert format_conversations(df).first()["formatted"] == "### user: a\\b # c </turn>\n"


def test_long_and_odd_roles(spark):
    """Roles as long as texts, also of characters that are escaped, and such as look like the template."""
    roles = ["r" * 300_000, ":" * 20_000, "\\" * 20_001, "\\:" * 5_000, "### a: b", ": ", "a\\", "", "\n</turn>"]
    rows = [(i, j, role, text) for i, role in enumerate(roles) for j, text in enumerate(["hi: there", ":", "\\: x"])]
    found = format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"))
    read = found.select("conv_id", read_conversation(F.col("formatted")).alias("turns")).collect()
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in read} == {
        i: [(role, text) for _, _, role, text in rows[3 * i : 3 * i + 3]] for i, role in enumerate(roles)
    }


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversation_digests(format_conversations(df)).collect() == []
