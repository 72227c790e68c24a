"""Metrics, curves, weights and encodings."""

from pyspark.sql import functions as F

from changerisk.operators import fusion, metrics, models
from changerisk.plans.catalog.registry import query
from changerisk.plans.catalog.roles import LABELLED_ORDERS, SCORED_ORDERS, labelled_orders, scored_orders

_CURVE = f"""
    WITH {SCORED_ORDERS},
    levels AS (
        SELECT score AS threshold, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
        FROM scored GROUP BY score),
    curve AS (
        SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
        FROM levels WINDOW w AS (ORDER BY threshold DESC)),
    cells AS (
        SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
               count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp
        FROM scored),
    auc AS (SELECT sum(neg * (tp - pos / 2.0)) / max(p * n)::DOUBLE AS roc_auc FROM curve),
    ap AS (SELECT sum(pos / p::DOUBLE * tp / (tp + fp)) AS average_precision FROM curve)"""


@query("classification_metrics", _CURVE + """
    SELECT round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, round(tp / (tp + fp), 4) AS precision,
           round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1,
           (SELECT round(roc_auc, 4) FROM auc) AS roc_auc, (SELECT round(average_precision, 4) FROM ap) AS pr_auc,
           round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 4) AS mcc,
           tn, fp, fn, tp
    FROM cells""")
def classification_metrics(t):
    row = metrics.classification_metrics(scored_orders(t))
    return row.select(*[F.round(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in row.dtypes])


@query("roc_auc", _CURVE + "SELECT round(roc_auc, 6) AS roc_auc FROM auc")
def roc_auc(t):
    return metrics.roc_auc(scored_orders(t)).select(F.round("roc_auc", 6).alias("roc_auc"))


@query("average_precision", _CURVE + "SELECT round(average_precision, 6) AS average_precision FROM ap")
def average_precision(t):
    return metrics.average_precision(scored_orders(t)).select(F.round("average_precision", 6).alias("average_precision"))


@query("confusion_matrix", _CURVE + "SELECT tn, fp, fn, tp FROM cells")
def confusion_matrix(t):
    return metrics.confusion_matrix(scored_orders(t))


@query("roc_points", _CURVE + """
    SELECT threshold, round(fp / n::DOUBLE, 6) AS fpr, round(tp / p::DOUBLE, 6) AS tpr FROM curve
    UNION ALL SELECT NULL, 0, 0""")
def roc_points(t):
    points = metrics.roc_points(scored_orders(t))
    return points.select("threshold", *[F.round(c, 6).alias(c) for c in points.columns[1:]])


@query("pr_points", _CURVE + """
    SELECT threshold, round(tp / p::DOUBLE, 6) AS recall, round(tp / (tp + fp)::DOUBLE, 6) AS precision FROM curve
    UNION ALL SELECT NULL, 0, 1""")
def pr_points(t):
    points = metrics.pr_points(scored_orders(t))
    return points.select("threshold", *[F.round(c, 6).alias(c) for c in points.columns[1:]])


@query("pr_trapezoid", _CURVE + """,
    line AS (SELECT tp / p::DOUBLE AS r, tp / (tp + fp)::DOUBLE AS q, threshold FROM curve),
    steps AS (SELECT r, q, lag(r, 1, 0.0) OVER (ORDER BY threshold DESC) AS r0, lag(q, 1, 1.0) OVER (ORDER BY threshold DESC) AS q0 FROM line)
    SELECT round(sum((r - r0) * (q + q0) / 2), 6) AS pr_trapezoid FROM steps""")
def pr_trapezoid(t):
    return metrics.pr_trapezoid(scored_orders(t)).select(F.round("pr_trapezoid", 6).alias("pr_trapezoid"))


@query("class_weights", f"""
    WITH base AS ({LABELLED_ORDERS})
    SELECT buggy, count(*) AS rows, round((SELECT count(*) FROM base) / (2.0 * count(*)), 6) AS weight,
           (SELECT round(count(*) FILTER (buggy = 0) / count(*) FILTER (buggy = 1)::DOUBLE, 6) FROM base) AS scale_pos_weight
    FROM base GROUP BY buggy""")
def class_weights(t):
    base = labelled_orders(t)
    weights = models.class_weights(base).withColumn("weight", F.round("weight", 6))
    return weights.withColumn("scale_pos_weight", F.round(F.lit(models.scale_pos_weight(base)), 6))


_PRIORITIES = ("5-low", "4-not specified", "3-medium", "2-high", "1-urgent")
_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("encode_reasoning", """
    SELECT o_orderkey AS commit_id,
           CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2
                                WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 END AS risk_level, """
    + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS \"intent_{s}\"" for s in _SEGMENTS)
    + """, round(least(o_totalprice / 400000.0::DOUBLE, 1), 4) AS confidence_score
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def encode_reasoning(t):
    raw = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("commit_id"),
        F.col("o_orderpriority").alias("risk_level"),
        F.col("c_mktsegment").alias("intent"),
        (F.col("o_totalprice") / 400000.0).alias("confidence_score"),
    )
    encoded = fusion.encode_reasoning(raw, vocabulary={"intent": _SEGMENTS}, risk_levels=_PRIORITIES)
    return encoded.withColumn("confidence_score", F.round("confidence_score", 4))
