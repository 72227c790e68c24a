"""Change-risk analytics on Spark: history features, labels, splits, reduction, models."""
