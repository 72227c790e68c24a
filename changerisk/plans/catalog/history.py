"""Change-history features."""

from pyspark.sql import functions as F

from changerisk.functions import text
from changerisk.operators.history import ChangeHistory, commit_time
from changerisk.plans.catalog.registry import query
from changerisk.plans.catalog.roles import HISTORY, SUFFIXES, change_history, commits, file_changes

for _name in ("la", "ld", "nf", "nd", "ns"):

    @query(_name, HISTORY + f"SELECT commit_id, {_name} FROM size")
    def size_metric(t, name=_name):
        return change_history(t).change_metrics().select("commit_id", name)


@query("ent", HISTORY + "SELECT commit_id, round(coalesce(ent, 0), 4) AS ent FROM size LEFT JOIN entropy USING (commit_id)")
def ent(t):
    return change_history(t).change_metrics().select("commit_id", F.round("ent", 4).alias("ent"))


@query("ndev", HISTORY + "SELECT commit_id, ndev FROM developers")
def ndev(t):
    return change_history(t).developer_count().select("commit_id", "ndev")


@query("age", HISTORY + "SELECT commit_id, round(age, 4) AS age FROM file_history")
def age(t):
    return change_history(t).file_history().select("commit_id", F.round("age", 4).alias("age"))


@query("nuc", HISTORY + "SELECT commit_id, nuc FROM file_history")
def nuc(t):
    return change_history(t).file_history().select("commit_id", "nuc")


@query("aexp", HISTORY + "SELECT commit_id, aexp FROM author_history")
def aexp(t):
    return change_history(t).author_experience().select("commit_id", "aexp")


@query("arexp", HISTORY + "SELECT commit_id, aexp - expired AS arexp FROM author_history")
def arexp(t):
    return change_history(t).author_history().select("commit_id", "arexp")


@query("asexp", HISTORY + "SELECT commit_id, asexp FROM area_history")
def asexp(t):
    return change_history(t).subsystem_experience().select("commit_id", "asexp")


# The same log run through in another order: by priority, then by date, so that dates go backwards.
_IN_ORDER = HISTORY.replace(
    "row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos",
    "row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS pos",
) + """,
    mine AS (SELECT project, commit_id, author, epoch, pos FROM commits),
    recent AS (
        SELECT a.commit_id, count(b.commit_id) AS aexp, count(b.commit_id) FILTER (b.epoch >= a.epoch - 31536000) AS arexp
        FROM mine a LEFT JOIN mine b ON a.project = b.project AND a.author = b.author AND b.pos < a.pos GROUP BY ALL),
    idle AS (
        SELECT commit_id, sum(lookups * greatest(coalesce(epoch - last_touch, 0), 0)) / sum(lookups) AS age
        FROM file_facts WHERE lookups > 0 GROUP BY commit_id)
    SELECT commit_id, round(age, 4) AS age, nuc, ndev, aexp, arexp, asexp
    FROM idle JOIN file_history USING (commit_id) JOIN developers USING (commit_id) JOIN recent USING (commit_id)
         JOIN area_history USING (commit_id)"""


@query("history_in_order", _IN_ORDER.replace("SELECT commit_id, round(age, 4)", "SELECT commit_id, round(idle.age, 4)"))
def history_in_order(t):
    priority = t.orders.select(F.col("o_orderkey").alias("commit_id"), "o_orderpriority")
    seq = F.struct("o_orderpriority", "author_date", "commit_id")
    log = commits(t).join(priority, "commit_id").withColumn("place", seq)
    history = ChangeHistory(log, file_changes(t), SUFFIXES, seq="place")
    return history.metrics().select("commit_id", F.round("age", 4).alias("age"), "nuc", "ndev", "aexp", "arexp", "asexp")


@query(
    "author_key",
    """SELECT o_orderkey AS commit_id, CASE WHEN o_orderstatus = 'F' THEN c_name WHEN o_orderstatus = 'P'
              THEN c_mktsegment ELSE 'unknown' END AS author
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def author(t):
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    status = F.col("o_orderstatus")
    name = F.when(status == "F", F.col("c_name")).when(status == "P", "")
    email = F.when(status == "P", F.col("c_mktsegment"))
    return joined.select(F.col("o_orderkey").alias("commit_id"), text.author_key(name, email).alias("author"))


@query("commit_time", HISTORY + "SELECT commit_id, year(author_date) AS year, epoch FROM commits")
def times(t):
    return commit_time(commits(t)).select("commit_id", F.col("year").cast("bigint").alias("year"), "epoch")


@query("commit_row", HISTORY + """,
    diffs AS (
        SELECT commit_id, string_agg('--- ' || changed || chr(10) || patch, chr(10) || chr(10) ORDER BY ordinal, changed, patch) AS diff
        FROM paths WHERE counted GROUP BY commit_id)
    SELECT commit_id, project, CASE WHEN message = 'new' THEN 0 ELSE 1 END AS buggy,
           CASE WHEN message = 'new' THEN 0 ELSE 1 END AS fix, year(author_date) AS year, epoch AS author_date,
           la, ld, nf, nd, ns, round(coalesce(ent, 0), 4) AS ent, ndev, round(age, 4) AS age, nuc,
           aexp, aexp - expired AS arexp, asexp, message, coalesce(diff, '') AS diff
    FROM size JOIN commits USING (commit_id) LEFT JOIN entropy USING (commit_id) JOIN developers USING (commit_id)
    JOIN file_history USING (commit_id) JOIN author_history USING (commit_id) JOIN area_history USING (commit_id)
    LEFT JOIN diffs USING (commit_id)""")
def commit_row(t):
    rows = change_history(t).commit_rows()
    return rows.withColumns({"year": F.col("year").cast("bigint"), "ent": F.round("ent", 4), "age": F.round("age", 4)})
