"""How the test tables stand in for commits, file changes, vectors and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changerisk.fixed_values import CPP_SUFFIXES, PYTHON_SUFFIXES
from changerisk.operators.history import ChangeHistory
from changerisk.plans.catalog.registry import Tables

SUFFIXES = (*PYTHON_SUFFIXES, *CPP_SUFFIXES)


def labelled_orders(t: Tables) -> DataFrame:
    """Orders as labelled commits: project is the priority, the label status 'F'."""
    return t.orders.select(
        F.col("o_orderkey").alias("commit_id"),
        F.col("o_orderpriority").alias("project"),
        F.col("o_orderdate").alias("author_date"),
        (F.col("o_orderstatus") == "F").cast("int").alias("buggy"),
    )


LABELLED_ORDERS = """
    SELECT o_orderkey AS commit_id, o_orderpriority AS project, o_orderdate AS author_date,
           CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS buggy
    FROM orders"""


def commits(t: Tables) -> DataFrame:
    """Orders as a commit log: one project per market segment, customers as authors."""
    message = (
        F.when(F.col("o_orderstatus") == "F", "Fix order").when(F.col("o_orderstatus") == "P", "prefix").otherwise("new")
    )
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("project"),
        F.col("o_orderkey").alias("commit_id"),
        F.col("o_custkey").cast("string").alias("author"),
        F.col("o_orderdate").cast("timestamp").alias("author_date"),
        message.alias("message"),
    )


def file_changes(t: Tables) -> DataFrame:
    """Line items as changed files, the part being the file; some are renamed to a text file."""
    part = F.col("l_partkey").cast("string")
    stem = F.concat(
        F.lit("Sub"), (F.col("l_partkey") % 10).cast("string"), F.lit("/dir"), (F.col("l_partkey") % 100).cast("string"),
        F.lit("/Part"), part,
    )
    kind = F.col("l_partkey") % 4
    suffix = F.when(kind == 0, ".md").when(kind == 1, ".CPP").otherwise(".py")
    changes = t.lineitem.select(
        F.col("l_orderkey").alias("commit_id"),
        F.col("l_linenumber").alias("ordinal"),
        F.when((kind == 0) & (F.col("l_linenumber") == 1), F.concat(stem, F.lit(".h"))).alias("old_path"),
        F.concat(stem, suffix).alias("new_path"),
        F.col("l_quantity").cast("bigint").alias("added_lines"),
        F.col("l_linenumber").cast("bigint").alias("deleted_lines"),
        F.concat(F.lit("+supplier "), F.col("l_suppkey").cast("string")).alias("patch"),
        F.lit(None).cast("string").alias("source_code"),
    )
    return changes


def change_history(t: Tables, asked: DataFrame | None = None) -> ChangeHistory:
    """The commit log with its file changes."""
    return ChangeHistory(commits(t), file_changes(t), SUFFIXES, asked=asked)


# The same log in SQL, with one window per feature.
HISTORY = """
    WITH commits AS (
        SELECT c_mktsegment AS project, o_orderkey AS commit_id, CAST(o_custkey AS VARCHAR) AS author,
               CAST(epoch(o_orderdate) AS BIGINT) AS epoch, o_orderdate AS author_date, o_orderstatus AS status,
               CASE o_orderstatus WHEN 'F' THEN 'Fix order' WHEN 'P' THEN 'prefix' ELSE 'new' END AS message,
               row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos
        FROM orders JOIN customer ON o_custkey = c_custkey),
    stems AS (
        SELECT l_orderkey AS commit_id, l_linenumber AS ordinal, l_partkey % 4 AS kind,
               CAST(l_quantity AS BIGINT) AS added, CAST(l_linenumber AS BIGINT) AS deleted,
               '+supplier ' || CAST(l_suppkey AS VARCHAR) AS patch,
               'Sub' || CAST(l_partkey % 10 AS VARCHAR) || '/dir' || CAST(l_partkey % 100 AS VARCHAR)
                   || '/Part' || CAST(l_partkey AS VARCHAR) AS stem
        FROM lineitem),
    paths AS (
        SELECT *, stem || CASE kind WHEN 0 THEN '.md' WHEN 1 THEN '.CPP' ELSE '.py' END AS changed,
               CASE WHEN kind = 1 THEN stem || '.CPP' WHEN kind > 1 THEN stem || '.py'
                    WHEN ordinal = 1 THEN stem || '.h' END AS relevant,
               kind > 0 AS counted
        FROM stems JOIN commits USING (commit_id)),
    churn AS (
        SELECT commit_id, (added + deleted) / sum(added + deleted) OVER (PARTITION BY commit_id) AS p
        FROM paths WHERE counted),
    entropy AS (SELECT commit_id, -sum(p * log2(p)) AS ent FROM churn GROUP BY commit_id),
    size AS (
        SELECT commit_id, CAST(coalesce(sum(added) FILTER (counted), 0) AS BIGINT) AS la,
               CAST(coalesce(sum(deleted) FILTER (counted), 0) AS BIGINT) AS ld,
               count(DISTINCT relevant) AS nf,
               count(DISTINCT regexp_extract(relevant, '^(.*)/[^/]+$', 1)) AS nd,
               count(DISTINCT split_part(relevant, '/', 1)) AS ns
        FROM paths GROUP BY commit_id HAVING count(relevant) > 0),
    entries AS (
        SELECT project, commit_id, author, epoch, pos, file, sum(touch) AS touches, count(DISTINCT path) AS lookups
        FROM (SELECT project, commit_id, author, epoch, pos, lower(changed) AS file, 1 AS touch, NULL AS path FROM paths
              UNION ALL
              SELECT project, commit_id, author, epoch, pos, lower(relevant), 0, relevant FROM paths
              WHERE relevant IS NOT NULL)
        GROUP BY ALL),
    file_facts AS (
        SELECT *, coalesce(sum(touches) OVER before, 0) AS earlier,
               last_value(CASE WHEN touches > 0 THEN epoch END IGNORE NULLS) OVER before AS last_touch
        FROM entries
        WINDOW before AS (PARTITION BY project, file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    file_history AS (
        SELECT commit_id, sum(lookups * coalesce(epoch - last_touch, 0)) / sum(lookups) AS age,
               CAST(sum(lookups * earlier) AS BIGINT) AS nuc
        FROM file_facts WHERE lookups > 0 GROUP BY commit_id),
    first_touch AS (
        SELECT project, file, author, min(pos) AS since FROM entries WHERE touches > 0 GROUP BY ALL),
    developers AS (
        SELECT e.commit_id, count(DISTINCT f.author) AS ndev
        FROM entries e LEFT JOIN first_touch f ON e.project = f.project AND e.file = f.file AND f.since < e.pos
        WHERE e.lookups > 0 GROUP BY e.commit_id),
    author_history AS (
        SELECT commit_id, row_number() OVER (PARTITION BY project, author ORDER BY pos) - 1 AS aexp,
               count(*) OVER (PARTITION BY project, author ORDER BY epoch
                              RANGE BETWEEN UNBOUNDED PRECEDING AND 31536001 PRECEDING) AS expired
        FROM commits),
    areas AS (
        SELECT project, commit_id, author, pos, area, max(touch) AS touched, max(1 - touch) AS asked
        FROM (SELECT project, commit_id, author, pos, split_part(lower(changed), '/', 1) AS area, 1 AS touch FROM paths
              UNION ALL
              SELECT project, commit_id, author, pos, split_part(lower(relevant), '/', 1), 0 FROM paths
              WHERE relevant IS NOT NULL)
        GROUP BY ALL),
    area_facts AS (
        SELECT *, coalesce(sum(touched) OVER (PARTITION BY project, author, area ORDER BY pos
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
        FROM areas),
    area_history AS (
        SELECT commit_id, CAST(sum(earlier) AS BIGINT) AS asexp FROM area_facts WHERE asked = 1 GROUP BY commit_id)
"""


def scored_orders(t: Tables) -> DataFrame:
    """Orders as model output: label status 'F', score from the price, prediction at one half."""
    score = F.col("o_totalprice") / 500000.0
    return t.orders.select(
        F.col("o_orderkey").alias("commit_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        (score >= 0.5).cast("int").alias("prediction"),
        score.alias("score"),
    )


SCORED_ORDERS = """
    scored AS (
        SELECT o_orderkey AS commit_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
               CASE WHEN o_totalprice / 500000.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS prediction,
               o_totalprice / 500000.0::DOUBLE AS score
        FROM orders)"""


def labelled_vectors(t: Tables) -> DataFrame:
    """Vectors with a binary label."""
    return t.embeddings.select(
        F.col("vec_id").alias("commit_id"), "embedding", (F.col("label") % 5 == 0).cast("int").alias("buggy")
    )
