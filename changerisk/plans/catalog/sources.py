"""Sources and sinks."""

from uuid import uuid4

from pyspark.sql import functions as F

from changerisk.functions.vectors import fold
from changerisk.plans.catalog.registry import query
from changerisk.plans.catalog.roles import LABELLED_ORDERS, labelled_orders
from changerisk.runtime import scratch_path
from changerisk.operators.profile import label_distribution
from changerisk.sources import sinks, tables


@query("load_commits", f"SELECT commit_id, project, buggy, CAST(epoch(author_date) AS BIGINT) AS epoch FROM ({LABELLED_ORDERS})")
def load_commits(t):
    named = {
        "commit_id": F.col("o_orderkey"),
        "project": F.col("o_orderpriority"),
        "author_date": F.col("o_orderdate"),
        "buggy": (F.col("o_orderstatus") == "F").cast("int"),
    }
    df = tables.load_commits(t.spark, t.path("orders"), source_format="parquet", rename=named)
    return df.select("commit_id", "project", "buggy", F.unix_timestamp("author_date").alias("epoch"))


@query("parse_epoch", "SELECT event_id, epoch_us(ts) // 1000 AS epoch_ms FROM events")
def parse_epoch(t):
    millis = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    raw = t.events.select("event_id", millis.alias("author_date"))
    return tables.parse_dates(raw).select("event_id", F.unix_millis("author_date").alias("epoch_ms"))


@query(
    "parse_datetime_string",
    "SELECT event_id, CASE WHEN event_type <> 'view' THEN epoch_us(ts) END AS epoch_us FROM events",
)
def parse_datetime_string(t):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    raw = t.events.select("event_id", F.when(F.col("event_type") == "view", "not a date").otherwise(text).alias("author_date"))
    return tables.parse_dates(raw).select("event_id", F.unix_micros("author_date").alias("epoch_us"))


@query("validate_schema", "SELECT quality, count(*) AS rows FROM labels GROUP BY quality")
def validate_schema(t):
    checked = tables.validate_schema(t.labels, ("doc_id", "quality", "toxic"))
    return checked.groupBy("quality").agg(F.count("*").alias("rows"))


@query("load_optional", "SELECT o_orderpriority AS project, count(*) AS rows, TRUE AS absent_is_none FROM orders GROUP BY ALL")
def load_optional(t):
    absent = tables.load_optional(t.spark, f"{t.folder}/no_such_table.parquet", source_format="parquet")
    found = tables.load_optional(t.spark, t.path("orders"), source_format="parquet", required=["o_orderkey"])
    counts = found.groupBy(F.col("o_orderpriority").alias("project")).agg(F.count("*").alias("rows"))
    return counts.withColumn("absent_is_none", F.lit(absent is None))


_CELL_SUMS = """
    SELECT vec_id, label, len(embedding) AS size,
           round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total
    FROM embeddings"""


@query("read_embeddings", _CELL_SUMS)
def read_embeddings(t):
    path = scratch_path(t.spark, "embeddings")
    sinks.write_embeddings(t.embeddings, path)
    df = tables.read_embeddings(t.spark, path, schema="vec_id bigint, embedding string, label int")
    total = fold(F.col("embedding"), lambda x: x)
    return df.select("vec_id", "label", F.size("embedding").cast("bigint").alias("size"), F.round(total, 4).alias("total"))


@query("write_embeddings", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[-1]::DOUBLE, 6) AS last FROM embeddings")
def write_embeddings(t):
    path = scratch_path(t.spark, "embeddings")
    sinks.write_embeddings(t.embeddings.select("vec_id", "embedding"), path)
    cells = t.spark.read.options(header=True, escape='"').schema("vec_id bigint, embedding string").csv(path)
    numbers = F.split(F.translate("embedding", "[]", ""), ",")
    return cells.select(
        "vec_id",
        F.round(numbers[0].cast("double"), 6).alias("first"),
        F.round(F.element_at(numbers, -1).cast("double"), 6).alias("last"),
    )


@query("write_csv_quoted", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def write_csv_quoted(t):
    path = scratch_path(t.spark, "quoted")
    users = F.col("role") == "user"
    sinks.write_csv_quoted(t.conversations.filter(users), path)
    sinks.write_csv_quoted(t.conversations.filter(~users), path)
    schema = "conv_id bigint, turn bigint, role string, text string"
    df = t.spark.read.options(header=True, multiLine=True, escape="\\").schema(schema).csv(path)
    return df.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("write_dataset", "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents")
def write_dataset(t):
    path = scratch_path(t.spark, "dataset")
    sinks.write_dataset(t.documents.select("doc_id", "lang", "text"), path)
    exact = {"lineSep": "\n", "charToEscapeQuoteEscaping": '"', "nullValue": uuid4().hex}  # no text is equal to it
    reader = t.spark.read.options(header=True, multiLine=True, escape='"', **exact)
    df = reader.schema("doc_id bigint, lang string, text string").csv(path)
    return df.select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("write_report", f"SELECT buggy, count(*) AS count FROM ({LABELLED_ORDERS}) GROUP BY buggy")
def write_report(t):
    path = scratch_path(t.spark, "report")
    sinks.write_report(label_distribution(labelled_orders(t)), path)
    return t.spark.read.schema("buggy int, count bigint").json(path)


# Cells with line breaks and quotes, read in splits.
@query("load_commits_csv", "SELECT doc_id, lang, md5(text) AS text_md5, n_chars FROM documents")
def load_commits_csv(t):
    path = scratch_path(t.spark, "dataset")
    sinks.write_dataset(t.documents.select("doc_id", "lang", "text", "n_chars"), path)
    schema = "doc_id bigint, lang string, text string, n_chars bigint"
    df = tables.load_commits(t.spark, path, schema=schema, required=["doc_id"], date_columns=(), empty_texts=True)
    return df.select("doc_id", "lang", F.md5("text").alias("text_md5"), "n_chars")
