r"""Chat formatting that is proved by reading it back, with DataFrame functions only.

Grammar of a formatted conversation::

    conversation = turn*
    turn         = "### " role ": " text " </turn>" newline
    role         = characters, with ":" written "\:" and "\" written "\\"
    text         = characters; "\#", "\</turn>" and "\\" stand for "#", "</turn>" and "\"

A text with "###" or "</turn>" without a backslash before it is no text of this grammar; where
more than three "#" follow each other, each that has two more after it gets one. A turn is first written as it
is, then read back by the grammar and compared with its source; only if the two differ is it
written again with its control strings and backslashes escaped. At last whole conversations are
read back and compared turn by turn; one that differs anywhere has all its turns escaped.

A conversation is one cell, as its format and digests need it: Spark limits it to 2 GB. Turns are
rendered, checked and measured as rows before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parts of the template (fixed values of this format).
OPEN, SEPARATOR, CLOSE = "### ", ": ", " </turn>\n"
_CONTROL = r"###|</turn>"
_MARKED = r"\\|#(?=##)|</turn>"


def escape(text: Column) -> Column:
    """A text with backslashes and control strings escaped."""
    return F.regexp_replace(text, f"({_MARKED})", r"\\$1")


def unescape(text: Column) -> Column:
    """The text that an escaped one stands for."""
    return F.regexp_replace(text, r"\\(\\|#|</turn>)", "$1")


def _role(role: Column) -> Column:
    return F.regexp_replace(role, r"([\\:])", r"\\$1")


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), _role(role), F.lit(SEPARATOR), text, F.lit(CLOSE))


def _read_turn(turn: Column) -> Column:
    """Role and text of one turn without its closing mark; null if it does not follow the grammar.

    The role ends at the first ":" that no backslash escapes. Escapes are blanked by a replacement,
    which takes a role of any length; a pattern for whole roles would go as deep as they are long.
    """
    blank = F.regexp_replace(turn, r"\\[\\:]", "__")
    colon = F.locate(":", blank)
    role, text = F.substring(turn, F.lit(len(OPEN) + 1), colon - len(OPEN) - 1), F.substring(turn, colon + 2, F.length(turn))
    valid = (
        F.startswith(turn, F.lit(OPEN))
        & (F.substring(blank, colon, F.lit(2)) == SEPARATOR)
        & ~F.contains(F.substring(blank, F.lit(1), colon), F.lit("\\"))
        & ~F.regexp_like(text, F.lit(rf"(?<!\\)(?:{_CONTROL})"))
    )
    read = F.struct(F.regexp_replace(role, r"\\([\\:])", "$1").alias("role"), unescape(text).alias("text"))
    return F.when(valid, read)


def read_conversation(formatted: Column) -> Column:
    """Turns of a formatted conversation, in order: ``array<struct<role, text>>``.

    The closing mark cannot stand in a text, so splitting at it is the whole parse; a turn that
    does not follow the grammar is null.
    """
    turns = F.split(formatted, CLOSE.replace("\n", r"\n"))
    return F.transform(F.slice(turns, 1, F.size(turns) - 1), _read_turn)


def format_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss`` from rows ``conv_id, turn, role, text``.

    ``loss`` lists the spans of ``formatted`` (start from 0, length, in code points) that hold an
    assistant's text as written. Turns are ordered by turn, then role and text; repeated turns are
    all kept. Roles and texts may be of any length; null ones are empty; null turns come first; a null id is one more
    conversation. An empty table gives no rows.
    """
    turns = rows.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    source = F.struct("role", "text")
    plain = F.concat(F.lit(OPEN), _role(F.col("role")), F.lit(SEPARATOR), F.col("text"))
    same = F.coalesce(_read_turn(plain) == source, F.lit(False)) & ~F.contains("text", F.lit(CLOSE))
    written = F.when(same, F.col("text")).otherwise(escape(F.col("text")))
    turns = turns.withColumn("written", written).withColumn("escaped", escape(F.col("text")))

    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    for name in ("written", "escaped"):
        before = F.coalesce(F.sum(F.length(_turn(F.col("role"), F.col(name)))).over(order), F.lit(0))
        head = F.length(F.concat(F.lit(OPEN), _role(F.col("role")), F.lit(SEPARATOR)))
        span = F.struct((before + head).alias("start"), F.length(name).cast("bigint").alias("length"))
        turns = turns.withColumn(f"{name}_span", F.when(F.col("role") == "assistant", span))
    fields = ("turn", "role", "text", "written", "escaped", "written_span", "escaped_span")
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("t"))

    def whole(name: str) -> tuple[Column, Column]:
        text = F.array_join(F.transform("t", lambda t: _turn(t["role"], t[name])), "")
        return text, F.filter(F.transform("t", lambda t: t[f"{name}_span"]), lambda span: span.isNotNull())

    source = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    plain, plain_loss = whole("written")
    safe, safe_loss = whole("escaped")
    tried = listed.select("conv_id", "t", plain.alias("plain"))
    same = F.coalesce(read_conversation(F.col("plain")) == source, F.lit(False))
    return tried.withColumn("same", same).select(
        "conv_id",
        F.when(F.col("same"), F.col("plain")).otherwise(safe).alias("formatted"),
        F.when(F.col("same"), plain_loss).otherwise(safe_loss).alias("loss"),
    )


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digests of what reading formatted conversations back gives.

    ``n_turns``; ``turns_sha256`` of role, newline, text, newline of each turn; ``loss_chars`` and
    ``loss_sha256`` of the unescaped text under the loss spans; ``formatted_chars``.
    """
    read = formatted.select("conv_id", "formatted", "loss", read_conversation(F.col("formatted")).alias("turns"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.transform(
        "loss", lambda span: unescape(F.substring(F.col("formatted"), span["start"].cast("int") + 1, span["length"].cast("int")))
    )
    read = read.withColumn("under", F.array_join(under, ""))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("under").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("under").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
