"""Mix sources by temperature: tempered token shares, an exponent found by bisection, and budgets
realised as seeded block permutations.

A source with token share p gets the weight p**a / sum(p**a). At a = 1 the mixture is the corpus,
at a = 0 all sources weigh the same. The exponent is the largest at which the mixture meets a
target entropy, or the smallest at which no source repeats more than allowed; both change
monotonically with a, so bisection finds it. It runs on one number per source.

The budget is the smallest at which every source is used whole at least once, so mixing repeats
documents of small sources and drops none. A source's budget is a number of whole passes and a
part of one. The part is the beginning of a permutation of its documents: their seeded digests in
order. The permutation is never sorted as a whole. Its first digits are 4,096 blocks; block totals
say in which block the budget ends, totals of that block's own 4,096 blocks narrow it down again,
and only documents of one block of a block, a 16-millionth of the source, are ranked one by one.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changerisk.llm.common import ASCII_SPACE, text_or_empty
from changerisk.runtime import freeze

#: No document is used more often than this.
REPETITIONS = 4.0

SEED = 42

#: Hex digits of a block: 4,096 blocks in a source, and as many in a block.
_DIGITS = 3

_STEPS = 60


def token_count(text: Column) -> Column:
    """Tokens of a text for the shares: its words between ASCII white space."""
    return F.size(F.filter(F.split(text, f"{ASCII_SPACE}+"), lambda word: word != "")).cast("bigint")


def tempered(tokens: Mapping[object, int], exponent: float) -> dict[object, float]:
    """Normalised weights of the sources; a source without tokens has none."""
    total = sum(tokens.values())
    powers = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()}
    whole = sum(powers.values())
    return {s: p / whole for s, p in powers.items()} if whole else dict.fromkeys(tokens, 0.0)


def entropy(weights: Mapping[object, float]) -> float:
    """Entropy of weights, in nats."""
    return -sum(w * math.log(w) for w in weights.values() if w)


def repetitions(tokens: Mapping[object, int], weights: Mapping[object, float]) -> dict[object, float]:
    """Passes over each source at the smallest budget that uses each source whole."""
    passes = {s: weights[s] / n for s, n in tokens.items() if n}
    least = min(passes.values(), default=1.0)
    return {s: passes[s] / least if s in passes else 1.0 for s in tokens}


def find_exponent(
    tokens: Mapping[object, int], *, target_entropy: float | None = None, most: float | None = REPETITIONS
) -> float:
    """The exponent in [0, 1] for a target entropy, a limit of repetitions, or both.

    With a target the exponent is the largest whose mixture has that entropy, 0 if none has. The
    limit then raises it as far as needed. Without either it is 0.
    """

    def bisect(enough) -> float:
        """Largest exponent with ``enough``, which holds at 0 and ends somewhere."""
        low, high = 0.0, 1.0
        if enough(high):
            return high
        for _ in range(_STEPS):
            middle = (low + high) / 2
            low, high = (middle, high) if enough(middle) else (low, middle)
        return low

    exponent = 0.0
    if target_entropy is not None:
        exponent = bisect(lambda a: entropy(tempered(tokens, a)) >= target_entropy)
    if most is not None:
        within = lambda a: max(repetitions(tokens, tempered(tokens, a)).values(), default=1.0) <= most
        if not within(exponent):
            low, high = exponent, 1.0
            for _ in range(_STEPS):
                middle = (low + high) / 2
                low, high = (low, middle) if within(middle) else (middle, high)
            exponent = high
    return exponent


def _digest(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_id").cast("string")))


def _boundary(cells: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """Per key the cell in which the budget ``rest`` ends, and what is left of it there."""
    upto = F.sum("tokens").over(Window.partitionBy(*keys).orderBy(cell))
    ranked = cells.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("tokens"))
    hit = ranked.filter((F.col("upto") > F.col("rest")) & (F.col("before") <= F.col("rest")))
    return hit.select(*keys, cell, (F.col("rest") - F.col("before")).alias("rest"))


def mixture(
    docs: DataFrame,
    *,
    target_entropy: float | None = None,
    most: float | None = REPETITIONS,
    seed: int = SEED,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """How often each row is used, and a report per source.

    The first table is ``key, source, tokens, copies`` for every row: ``copies`` is the number of
    whole passes over its source, and one more if the row is in the begun one, that is, if the
    tokens of the source's rows up to and with it, in the order of (md5 of seed and id, id), are
    within the rest of the budget. The second is ``source, docs, tokens, weight, budget``.

    A null source is a source of its own. Texts that are null or empty have no tokens; they are
    used in every whole pass, and in the begun one if the tokens before them are within the
    budget. Rows that repeat an id have the same place and share their fate. An empty table gives
    empty results. The driver holds one number per source.
    """
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("_id"), F.col(source).alias("source"), token_count(text_or_empty(text)).alias("tokens"))
    rows = rows.withColumn("digest", _digest(seed))
    rows = rows.withColumn("block", F.substring("digest", 1, _DIGITS)).withColumn("part", F.substring("digest", _DIGITS + 1, _DIGITS))
    rows = freeze(rows)
    blocks = freeze(rows.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    facts = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")).collect()
    tokens = {r["source"]: r["tokens"] for r in facts}
    weights = tempered(tokens, find_exponent(tokens, target_entropy=target_entropy, most=most))
    passes = repetitions(tokens, weights)
    report = []
    for row in facts:
        budget = int(passes[row["source"]] * row["tokens"] + 1e-6)
        whole = budget // row["tokens"] if row["tokens"] else 1
        rest = budget - whole * row["tokens"]
        report.append((row["source"], row["docs"], row["tokens"], weights[row["source"]], budget, whole, rest))
    name = docs.schema[source].dataType.simpleString()
    schema = f"source {name}, docs bigint, tokens bigint, weight double, budget bigint, whole bigint, rest bigint"
    plan = docs.sparkSession.createDataFrame(report, schema)

    same = F.col("p.source").eqNullSafe(F.col("c.source"))
    limits = F.broadcast(plan.select("source", "whole", "rest")).alias("p")  # one row per source
    cells = blocks.alias("c").join(limits, same).select("p.source", "c.block", "c.tokens", "p.rest")
    first = freeze(_boundary(cells, ["source"], "block"))
    inside = rows.alias("c").join(
        F.broadcast(first).alias("f"), F.col("f.source").eqNullSafe(F.col("c.source")) & (F.col("f.block") == F.col("c.block"))
    )
    parts = inside.groupBy("f.source", "f.block", "c.part", "f.rest").agg(F.sum("c.tokens").alias("tokens"))
    second = freeze(_boundary(parts, ["source", "block"], "part"))
    deep = rows.alias("c").join(
        F.broadcast(second).alias("f"),
        F.col("f.source").eqNullSafe(F.col("c.source")) & (F.col("f.block") == F.col("c.block")) & (F.col("f.part") == F.col("c.part")),
    )
    order = Window.partitionBy("f.source").orderBy("c.digest", "c._id").rangeBetween(Window.unboundedPreceding, 0)
    ranked = deep.select("f.source", "f.block", "f.part", "c.digest", "f.rest", F.sum("c.tokens").over(order).alias("upto"))
    last = ranked.filter("upto <= rest").groupBy("source").agg(F.max("digest").alias("last"))
    ends = second.alias("s").join(last.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source")), "left")
    # Where no document of the last part fits, the part's own digits lie before all its digests.
    ends = freeze(ends.select("s.source", F.coalesce("l.last", F.concat("s.block", "s.part")).alias("last")))

    used = rows.alias("c").join(limits, same)
    used = used.join(F.broadcast(ends).alias("e"), F.col("e.source").eqNullSafe(F.col("c.source")), "left")
    begun = (F.col("p.rest") > 0) & (F.col("c.digest") <= F.col("e.last"))
    copies = F.col("p.whole") + F.coalesce(begun, F.lit(False)).cast("bigint")
    used = used.select(F.col("c._id").cast(kind).alias(key), F.col("c.source").alias(source), "c.tokens", copies.alias("copies"))
    return used, plan.drop("whole", "rest").withColumnRenamed("source", source)


def mixed_documents(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options
) -> DataFrame:
    """``docs`` with every row repeated as often as the mixture uses it; the columns stay, whatever their names.

    Copies are made by an array of their numbers, after one join of the counts by id, source and
    tokens: rows that share an id keep the counts of their own source.
    """
    used, _ = mixture(docs, key=key, source=source, text=text, **options)
    counts = used.select(F.struct(key, source, "tokens").alias("place"), "copies").distinct()
    place = F.struct(F.col(key), F.col(source), token_count(text_or_empty(text)).alias("tokens"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), place.alias("own"))
    joined = rows.join(counts, F.col("own").eqNullSafe(F.col("place")))
    return joined.select("row", F.explode(F.expr("sequence(1, copies)"))).select("row.*")
