"""Binary classification metrics, exact for any number of distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.operators.ordering import running_sums


def _safe(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction", positive: int = 1) -> DataFrame:
    """tn, fp, fn, tp in one row."""
    truth, guess = F.col(label) == positive, F.col(prediction) == positive
    return df.agg(
        F.count_if(~truth & ~guess).alias("tn"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
        F.count_if(truth & guess).alias("tp"),
    )


def confusion_metrics(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 and mcc from tn, fp, fn, tp; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.withColumns(
        {
            "accuracy": _safe(tp + tn, tp + tn + fp + fn),
            "precision": _safe(tp, tp + fp),
            "recall": _safe(tp, tp + fn),
            "f1": _safe(2 * tp, 2 * tp + fp + fn),
            "mcc": _safe(tp * tn - fp * fn, spread),
        }
    )


def _curve(df: DataFrame, label: str, score: str, positive: int, extra: dict[str, Column] | None = None) -> DataFrame:
    """Per distinct score, highest first: positives and negatives at it, and down to it."""
    truth = F.col(label) == positive
    counts = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(truth).alias("pos"),
        F.count_if(~truth).alias("neg"),
        *[value.alias(name) for name, value in (extra or {}).items()],
    )
    return running_sums(counts, [F.desc("threshold")], {"pos_upto": "pos", "neg_upto": "neg"})


def _auc() -> Column:
    """Area under the ROC curve: one trapezoid per distinct score, so ties count half."""
    area = F.sum(F.col("neg") * (F.col("pos_upto") - F.col("pos") / 2))
    cells = F.sum("pos").cast("double") * F.sum("neg")
    return F.when(cells > 0, area / cells)


def _precision() -> Column:
    return F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto"))


def _average_precision() -> Column:
    """Precision at each distinct score, weighted by the recall gained there."""
    return F.when(F.sum("pos") > 0, F.sum(F.col("pos") * _precision()) / F.sum("pos"))


def _trapezoid_precision() -> Column:
    """Area under the precision-recall line that starts at recall 0, precision 1."""
    before = F.col("pos_upto") - F.col("pos")
    seen = before + F.col("neg_upto") - F.col("neg")
    previous = F.when(seen > 0, before / seen).otherwise(1.0)
    return F.when(F.sum("pos") > 0, F.sum(F.col("pos") * (_precision() + previous) / 2) / F.sum("pos"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", positive: int = 1) -> DataFrame:
    """Area under the ROC curve; null if a class is absent."""
    return _curve(df, label, score, positive).agg(_auc().alias("roc_auc"))


def average_precision(df: DataFrame, label: str = "label", score: str = "score", positive: int = 1) -> DataFrame:
    """Average precision (a step sum, not a trapezoid)."""
    return _curve(df, label, score, positive).agg(_average_precision().alias("average_precision"))


def classification_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", score: str = "score", positive: int = 1
) -> DataFrame:
    """accuracy, precision, recall, f1, roc_auc, pr_auc, mcc, tn, fp, fn, tp in one row.

    The table is read once: rows are counted per distinct score, everything else follows from
    these counts.
    """
    truth, guess = F.col(label) == positive, F.col(prediction) == positive
    cells = {"n_fp": F.count_if(~truth & guess), "n_tp": F.count_if(truth & guess)}
    curve = _curve(df, label, score, positive, cells)
    counts = curve.agg(
        (F.sum("neg") - F.sum("n_fp")).alias("tn"),
        F.sum("n_fp").alias("fp"),
        (F.sum("pos") - F.sum("n_tp")).alias("fn"),
        F.sum("n_tp").alias("tp"),
        _auc().alias("roc_auc"),
        _average_precision().alias("pr_auc"),
    )
    columns = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "mcc", "tn", "fp", "fn", "tp"]
    return confusion_metrics(counts).select(*columns)


def roc_points(df: DataFrame, label: str = "label", score: str = "score", positive: int = 1) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score; the origin has no threshold."""
    curve = _curve(df, label, score, positive)
    totals = curve.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    points = curve.select(
        "threshold",
        F.try_divide(F.col("neg_upto"), F.lit(totals["neg"])).alias("fpr"),
        F.try_divide(F.col("pos_upto"), F.lit(totals["pos"])).alias("tpr"),
    )
    origin = df.sparkSession.range(1).selectExpr("cast(null as double) threshold", "0D fpr", "0D tpr")
    return points.union(origin)


def pr_points(df: DataFrame, label: str = "label", score: str = "score", positive: int = 1) -> DataFrame:
    """(threshold, recall, precision) per distinct score; the end point has no threshold."""
    curve = _curve(df, label, score, positive)
    total = curve.agg(F.sum("pos").alias("pos")).first()["pos"]
    points = curve.select("threshold", F.try_divide(F.col("pos_upto"), F.lit(total)).alias("recall"), _precision().alias("precision"))
    end = df.sparkSession.range(1).selectExpr("cast(null as double) threshold", "0D recall", "1D precision")
    return points.union(end)


def pr_trapezoid(df: DataFrame, label: str = "label", score: str = "score", positive: int = 1) -> DataFrame:
    """Area under the straight-line precision-recall curve, as plots label it."""
    return _curve(df, label, score, positive).agg(_trapezoid_precision().alias("pr_trapezoid"))
