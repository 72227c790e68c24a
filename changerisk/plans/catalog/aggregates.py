"""Cleaning, counts and profiles."""

from pyspark.sql import functions as F

from changerisk.operators import clean, profile, sampling
from changerisk.plans.catalog.registry import query
from changerisk.plans.catalog.roles import LABELLED_ORDERS, labelled_orders


def lines_with_gaps(t):
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    gaps = [F.nullif(F.col(c), F.lit(0.0)).alias(c) for c in ("l_tax", "l_discount")]
    return t.lineitem.select(*keys, *gaps)


_GAPS = """
    WITH gaps AS (
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
               nullif(l_tax, 0) AS l_tax, nullif(l_discount, 0) AS l_discount FROM lineitem)"""


@query("missing_counts", _GAPS + """
    SELECT 'l_tax' AS column_name, count(*) - count(l_tax) AS missing FROM gaps
    UNION ALL SELECT 'l_discount', count(*) - count(l_discount) FROM gaps
    UNION ALL SELECT 'l_quantity', count(*) - count(l_quantity) FROM gaps""")
def missing_counts(t):
    return clean.missing_counts(lines_with_gaps(t), ["l_tax", "l_discount", "l_quantity"])


def _filled(value_sql):
    return _GAPS + f"""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
           round(coalesce(l_tax, (SELECT {value_sql.format(c='l_tax')} FROM gaps)), 6) AS l_tax,
           round(coalesce(l_discount, (SELECT {value_sql.format(c='l_discount')} FROM gaps)), 6) AS l_discount
    FROM gaps"""


for _name, _strategy, _value in (
    ("impute", "median", "quantile_cont({c}, 0.5)"),
    ("impute_mean", "mean", "avg({c})"),
    ("impute_mode", "mode", "(SELECT {c} FROM gaps WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"),
    ("impute_zero", "zero", "0"),
):

    @query(_name, _filled(_value).replace("(SELECT (SELECT", "(SELECT DISTINCT (SELECT").replace("(SELECT 0 FROM gaps)", "0"))
    def impute(t, strategy=_strategy):
        filled = clean.impute(lines_with_gaps(t), ["l_tax", "l_discount", "l_quantity"], strategy)
        return filled.withColumns({c: F.round(c, 6) for c in ("l_tax", "l_discount")})


def doubled_documents(t):
    """Documents twice, with partial labels and a score that some languages lack."""
    documents = t.documents.select("doc_id", "lang", F.when(F.col("lang") != "fr", F.col("n_chars")).alias("score"))
    return documents.unionByName(documents).join(t.labels.select("doc_id", "quality"), "doc_id", "left")


_KNOWN = """
    WITH known AS (
        SELECT doc_id, lang, CASE WHEN lang <> 'fr' THEN n_chars END AS score, quality
        FROM documents JOIN labels USING (doc_id))"""


@query("clean_commits", _KNOWN + """
    SELECT doc_id, lang, quality, round(coalesce(score, (SELECT quantile_cont(score, 0.5) FROM known)), 4) AS score FROM known""")
def clean_commits(t):
    cleaned, _ = clean.clean_commits(doubled_documents(t), ["score"], target="quality", key="doc_id")
    return cleaned.select("doc_id", "lang", "quality", F.round(F.col("score").cast("double"), 4).alias("score"))


@query("cleaning_report", _KNOWN + """
    SELECT (SELECT 2 * count(*) FROM documents) AS initial_rows, (SELECT count(*) FROM documents) AS duplicates_removed,
           (SELECT count(*) FROM documents) - count(*) AS rows_removed_missing_target,
           count(*) - count(score) AS missing_before, 0::BIGINT AS missing_after,
           round(quantile_cont(score, 0.5), 4) AS imputed_value, count(*) AS final_rows
    FROM known""")
def cleaning_report(t):
    _, report = clean.clean_commits(doubled_documents(t), ["score"], target="quality", key="doc_id")
    return report.select(
        "initial_rows",
        "duplicates_removed",
        "rows_removed_missing_target",
        F.col("missing_before")["score"].alias("missing_before"),
        F.col("missing_after")["score"].alias("missing_after"),
        F.round(F.col("imputed_values")["score"], 4).alias("imputed_value"),
        "final_rows",
    )


@query("label_distribution", f"SELECT buggy, count(*) AS count FROM ({LABELLED_ORDERS}) GROUP BY buggy")
def label_distribution(t):
    return profile.label_distribution(labelled_orders(t))


@query("stratum_counts", f"SELECT project, buggy, count(*) AS count FROM ({LABELLED_ORDERS}) GROUP BY ALL")
def stratum_counts(t):
    return sampling.stratum_counts(labelled_orders(t))


@query("top_projects", "SELECT o_custkey AS project, count(*) AS count FROM orders GROUP BY ALL ORDER BY count DESC, project LIMIT 10")
def top_projects(t):
    return sampling.top_projects(t.orders.select(F.col("o_custkey").alias("project")))


def labelled_documents(t):
    return t.documents.join(t.labels, "doc_id", "left")


@query("dataset_overview", """
    WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))
    SELECT 'size' AS section, 'rows' AS name, count(*)::DOUBLE AS value FROM d
    UNION ALL SELECT 'size', 'columns', 7
    UNION ALL SELECT 'type', 'bigint', 2
    UNION ALL SELECT 'type', 'string', 3
    UNION ALL SELECT 'type', 'int', 2
    UNION ALL SELECT 'missing', 'quality', count(*) - count(quality) FROM d
    UNION ALL SELECT 'missing', 'toxic', count(*) - count(toxic) FROM d""")
def dataset_overview(t):
    return profile.dataset_overview(labelled_documents(t))


@query("text_length_stats", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, round(avg(length({c})), 4) AS mean_length,
               max(length({c})) AS max_length, min(length({c})) AS min_length FROM documents"""
    for c in ("text", "lang", "source")))
def text_length_stats(t):
    stats = profile.text_length_stats(t.documents)
    return stats.select(
        "column_name",
        F.round("mean_length", 4).alias("mean_length"),
        F.col("max_length").cast("bigint").alias("max_length"),
        F.col("min_length").cast("bigint").alias("min_length"),
    )


@query("text_length_histogram", """
    WITH lengths AS (
        SELECT unnest(['text', 'lang', 'source']) AS column_name, unnest([length(text), length(lang), length(source)])::DOUBLE AS n
        FROM documents),
    spans AS (SELECT column_name, min(n) AS least_n, max(n) AS most_n FROM lengths GROUP BY column_name),
    edges AS (
        SELECT column_name, CASE WHEN least_n = most_n THEN least_n - 0.5 ELSE least_n END AS low,
               CASE WHEN least_n = most_n THEN most_n + 0.5 ELSE most_n END AS high FROM spans)
    SELECT column_name, least(floor((n - low) / (high - low) * 50), 49)::INTEGER AS bin, count(*) AS count
    FROM lengths JOIN edges USING (column_name) GROUP BY ALL""")
def text_length_histogram(t):
    return profile.text_length_histograms(t.documents).filter("count > 0").select("column_name", "bin", "count")


@query("summary_report", """
    WITH d AS (SELECT vec_id, label, embedding, text, lang FROM embeddings JOIN documents ON vec_id = doc_id),
    x AS (SELECT unnest(embedding)::DOUBLE AS x FROM d),
    n AS (SELECT sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM d),
    report AS (
        SELECT 'shape' AS section, 'rows' AS name, count(*)::DOUBLE AS value FROM d
        UNION ALL SELECT 'shape', 'columns', 5
        UNION ALL SELECT 'quality', 'missing_values', 0
        UNION ALL SELECT 'quality', 'duplicate_rows', count(*) - (SELECT count(*) FROM (SELECT DISTINCT vec_id, label, text, lang FROM d)) FROM d
        UNION ALL SELECT 'embedding', 'min_value', min(x) FROM x
        UNION ALL SELECT 'embedding', 'max_value', max(x) FROM x
        UNION ALL SELECT 'embedding', 'mean_value', avg(x) FROM x
        UNION ALL SELECT 'embedding', 'std_value', stddev_pop(x) FROM x
        UNION ALL SELECT 'embedding', 'mean_abs', avg(abs(x)) FROM x
        UNION ALL SELECT 'embedding', 'mean_norm', avg(norm) FROM n
        UNION ALL SELECT 'embedding', 'near_zero_percent', 100.0 * count(*) FILTER (abs(x) < 0.01) / count(*) FROM x
        UNION ALL SELECT 'text', 'text.mean_length', avg(length(text)) FROM d
        UNION ALL SELECT 'text', 'text.max_length', max(length(text)) FROM d
        UNION ALL SELECT 'text', 'text.min_length', min(length(text)) FROM d
        UNION ALL SELECT 'text', 'lang.mean_length', avg(length(lang)) FROM d
        UNION ALL SELECT 'text', 'lang.max_length', max(length(lang)) FROM d
        UNION ALL SELECT 'text', 'lang.min_length', min(length(lang)) FROM d)
    SELECT section, name, round(value, 4) AS value FROM report""")
def summary_report(t):
    table = t.embeddings.join(t.documents, F.col("vec_id") == F.col("doc_id")).select("vec_id", "label", "embedding", "text", "lang")
    return profile.summary_report(table).select("section", "name", F.round("value", 4).alias("value"))
