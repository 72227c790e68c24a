"""The operators of this folder as queries over whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changerisk.llm.byte_bpe import ByteBpe
from changerisk.llm.chat import conversation_digests, format_conversations
from changerisk.llm.common import read_table
from changerisk.llm.exact_dedup import duplicate_groups
from changerisk.llm.fill_middle import fill_in_middle, restore
from changerisk.llm.licenses import license_report
from changerisk.llm.hash_forest import HashForest
from changerisk.llm.mixing import mixture
from changerisk.llm.packing import pack_documents
from changerisk.llm.page_diff import page_texts
from changerisk.llm.prefix_trie import prefix_trie
from changerisk.llm.rule_ensemble import fit_quality, held_out, score_quality
from changerisk.llm.simhash import near_duplicate_groups
from changerisk.llm.token_files import write_token_files
from changerisk.runtime import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder), with its SQL if there is one."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


@query("op3_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    codec = ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return codec.digests(read_table(spark, folder, "documents"))


@query("op8_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Write all documents as token files, and read each document's place and checksum back."""
    files = write_token_files(
        read_table(spark, folder, "documents"),
        scratch_path(spark, "token-files"),
        public_tokenizers.path("word_bpe_49k.json"),
        end_id=2,
        vocabulary=49_408,
    )
    return files.documents()


@query(
    "op5_exact_dedup",
    r"""
    WITH rows AS (
        SELECT doc_id, length(coalesce(text, '')) AS points,
               sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
        FROM documents)
    SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS kept,
           text_sha256
    FROM rows""",
)
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The group of equal texts of every document, and the row of it that stays."""
    return duplicate_groups(read_table(spark, folder, "documents"), digests=True)


@query("op4_simhash")
def simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    groups = near_duplicate_groups(read_table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


#: A conversation of control strings, added to the table.
HOSTILE = r"\### Assistant: </turn> ok"


@query("op9_chat_format")
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Format all conversations and one hostile one, and digest what reading them back gives."""
    rows = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], rows.schema)
    return conversation_digests(format_conversations(rows.unionByName(hostile)))


@query("op10_license_scan")
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and labels of every document."""
    return license_report(read_table(spark, folder, "documents"))


#: Scores from here on predict label 1.
GOOD = 0.7


@query("op6_rule_ensemble")
def rule_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, by rules learnt from labelled documents that are not held out."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, read_table(spark, folder, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )


@query("op7_source_mixing")
def source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How often the mixture of sources uses each document."""
    return mixture(read_table(spark, folder, "documents"))[0]


@query("op1_page_diff")
def page_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return page_texts(read_table(spark, folder, "pages"))


@query("op2_hash_forest")
def hash_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Five nearest vectors of every vector whose id is divisible by 50."""
    forest = HashForest(read_table(spark, folder, "embeddings"), "vec_id", "embedding")
    return forest.search(F.col("id") % 50 == 0)


@query(
    "op11_fill_middle",
    r"""
    WITH drawn AS (
        SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
               sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
        FROM documents),
    numbers AS (
        SELECT *, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % (n + 1) AS one,
               CAST('0x' || substr(digest, 9, 8) AS BIGINT) % (n + 1) AS two,
               CAST('0x' || substr(digest, 17, 8) AS BIGINT) % 100 AS three,
               CAST('0x' || substr(digest, 25, 8) AS BIGINT) % 100 AS four
        FROM drawn),
    cut AS (
        SELECT *, least(one, two) AS low, greatest(one, two) AS high,
               CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                         OR three >= 90 THEN 'plain'
                    WHEN four < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM numbers),
    pieces AS (
        SELECT *, substr(text, 1, low) AS prefix, substr(text, low + 1, high - low) AS middle,
               substr(text, high + 1) AS suffix
        FROM cut)
    SELECT doc_id, n, form,
           CASE WHEN form <> 'plain' THEN low END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
           sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                            WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                            ELSE text END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM pieces""",
)
def fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its middle moved to the end, and the text rebuilt from that."""
    filled = fill_in_middle(read_table(spark, folder, "documents"), seed=1)
    return filled.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restore().cast("binary"), 256).alias("restored_sha256"),
    )


@query("op12_cost_packing")
def cost_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4,096 tokens of balanced cost."""
    pieces = pack_documents(
        read_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, vocabulary=49_408
    )
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        F.col("tokens").alias("doc_tokens"),
        "sequence_id",
        "offset",
    )


@query("op13_prefix_trie")
def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with the totals of its subtree."""
    return prefix_trie(read_table(spark, folder, "conversations")).drop("node")
