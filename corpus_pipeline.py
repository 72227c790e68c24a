"""From raw documents to token counts: quality, exact copies, near copies, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; ``run`` writes every
result and reads it again as the next stage's documents, so a lost executor costs one stage at
most. Stages that leave rows out decide on small columns first and then keep the rows of the ids
that stay. Ids are expected to be unique; rows that repeat an id share its fate. Documents may have
more columns, of any names; they are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changerisk.llm.byte_bpe import ByteBpe
from changerisk.llm.common import read_table
from changerisk.llm.components import components
from changerisk.llm.exact_dedup import duplicate_groups
from changerisk.llm.mixing import mixed_documents
from changerisk.llm.near_copies import near_copy_groups
from changerisk.llm.rule_ensemble import fit_quality, score_quality
from changerisk.llm.simhash import near_duplicate_groups
from changerisk.runtime import freeze, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents with a lower score are rejected.
GOOD = 0.7


def _packed(docs: DataFrame, *beside: str) -> DataFrame:
    """Whole rows as one column ``row``, beside copies of some columns: no other names can clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *beside)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is not among ``ids``; a null id is an id like any other."""
    gone = ids.select(F.col("doc_id").alias("gone")).distinct()
    rows = _packed(docs, "doc_id")
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti").select("row.*")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labels of this folder, predicts to be good."""
    ensemble = fit_quality(docs.select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    scored = score_quality(_packed(docs, "text"), ensemble)
    return scored.filter(F.col("score") >= GOOD).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the longest."""
    return _without(docs, duplicate_groups(docs).filter("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Links are those of SimHash, at two or fewer bits, and those of similar sets of five-word shingles;
    groups are the components of both together.
    """
    parts = [near_duplicate_groups(docs), near_copy_groups(docs)]
    links = freeze(reduce(DataFrame.union, [part.select("doc_id", "component_id") for part in parts]))
    groups = components(links.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
    later = groups.filter("node <> root").select(F.col("node").alias("doc_id"))
    unnamed = links.filter("doc_id is null and component_id is not null").select("doc_id")
    return _without(docs, later.union(unnamed))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, as often as the tempered mixture of sources uses it."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every row: number of tokens, digests of ids and of the decoded text."""
    codec = ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return codec.digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", reject_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixture", mix_sources),
    ("encode", encode),
]

#: The classifier is trained and the encoder is a library's, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
