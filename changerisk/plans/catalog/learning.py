"""Training, scoring and whole experiments.

SQL cannot grow trees, but it knows what they must find: the label follows from thresholds of three
features, so full-size models predict it exactly, and every metric and the order of the features
follow. The fourth feature says nothing.
"""

from pyspark.sql import functions as F

from changerisk.fixed_values import CHANGE_METRICS, EXPERIMENTS, SAMPLE_ROWS
from changerisk.operators import models, split
from changerisk.operators.leafwise import Growth, LeafwiseBoosting
from changerisk.plans.catalog.registry import query
from changerisk.plans.catalog.roles import HISTORY, change_history, labelled_orders
from changerisk.plans.experiment import run_experiment
from changerisk.runtime import freeze

FEATURES = ["quantity", "discount", "tax", "line"]
BINS = {"maxBins": 64}  # a bin for each of the 50 quantities


def changed_lines(t):
    """Order lines as commits: large ones are faulty, and those of high discount and high tax."""
    rows = t.lineitem.groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("commit_id")).agg(
        F.max("l_quantity").alias("quantity"),
        F.max(F.round(F.col("l_discount") * 100)).alias("discount"),
        F.max(F.round(F.col("l_tax") * 100)).alias("tax"),
        F.max("l_linenumber").alias("line"),
    )
    return rows.withColumn("buggy", F.expr("quantity > 30 or (discount >= 4 and tax >= 7)").cast("int"))


def line_sides(t):
    lines = freeze(changed_lines(t).withColumn("draw", split.random_draw("commit_id")))
    return split.random_holdout(lines, "commit_id", draw=F.col("draw"))


_LINES = """
    WITH lines AS (
        SELECT l_orderkey * 8 + l_linenumber AS commit_id, max(l_quantity) AS quantity,
               max(round(l_discount * 100)) AS discount, max(round(l_tax * 100)) AS tax, max(l_linenumber) AS line
        FROM lineitem GROUP BY 1),
    labelled AS (
        SELECT *, CASE WHEN quantity > 30 OR (discount >= 4 AND tax >= 7) THEN 1 ELSE 0 END AS y FROM lines)"""
_TEST = _LINES + """,
    test AS (
        SELECT commit_id, y FROM labelled
        QUALIFY row_number() OVER (ORDER BY md5(CAST(commit_id AS VARCHAR) || ':42'), commit_id)
                > floor((SELECT count(*) FROM labelled) * 0.8::DOUBLE))"""
_PREDICTED = _TEST + "SELECT commit_id, y AS y_true, y AS y_pred, y AS likely FROM test"


def fitted(t, name):
    """A full-size model and its predictions on the held-out lines."""
    train, test = line_sides(t)
    if name == "random_forest":
        model = models.train_random_forest(train, FEATURES, **BINS)
    elif name == "boosted_trees":
        model = models.train_boosted_trees(train, FEATURES, positive_weight=models.scale_pos_weight(train), **BINS)
    else:
        model = models.train_boosted_trees_fine(train, FEATURES)
    return model, models.predictions(model, test, FEATURES, ["commit_id"])


def checked(scored):
    return scored.select("commit_id", "y_true", "y_pred", (F.col("y_score") >= 0.5).cast("int").alias("likely"))


@query("train_random_forest", _PREDICTED)
def train_random_forest(t):
    return checked(fitted(t, "random_forest")[1])


@query("train_boosted_trees", _PREDICTED)
def train_boosted_trees(t):
    return checked(fitted(t, "boosted_trees")[1])


@query("train_lightgbm", _PREDICTED)
def train_boosted_trees_fine(t):
    return checked(fitted(t, "boosted_trees_fine")[1])


# The first split of all lines: the sums of gradients and hessians at each value of each feature.
@query("leafwise_first_split", _LINES + """,
    cells AS (
        SELECT unnest([0, 1, 2, 3]) AS feature, unnest([quantity, discount, tax, line::DOUBLE]) AS x, y,
               (SELECT avg(y) FROM labelled) AS p
        FROM labelled),
    bins AS (
        SELECT feature, x, sum(p - y) AS g, sum(p * (1 - p)) AS h, count(*) AS n FROM cells GROUP BY feature, x),
    sides AS (
        SELECT feature, x, sum(g) OVER upto AS gl, sum(h) OVER upto AS hl, sum(n) OVER upto AS nl,
               sum(g) OVER every AS ga, sum(h) OVER every AS ha, sum(n) OVER every AS na,
               lead(x) OVER (PARTITION BY feature ORDER BY x) AS threshold
        FROM bins WINDOW upto AS (PARTITION BY feature ORDER BY x), every AS (PARTITION BY feature))
    SELECT (['quantity', 'discount', 'tax', 'line'])[feature + 1] AS feature, threshold,
           round((gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1)) / 2, 3) AS gain,
           nl::BIGINT AS rows_left, round(-gl / (hl + 1), 6) AS left_value, round(-(ga - gl) / (ha - hl + 1), 6) AS right_value
    FROM sides WHERE threshold IS NOT NULL
    ORDER BY round((gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1)) / 2, 6) DESC, feature, x LIMIT 1""")
def leafwise_first_split(t):
    rows = models.assemble(freeze(changed_lines(t)), FEATURES).withColumnRenamed("buggy", "label")
    growth = Growth(rounds=1, learning_rate=1.0, leaves=2, penalty=1.0)
    tree = LeafwiseBoosting(**growth.__dict__).fit(rows).trees[0]
    name, threshold = FEATURES[tree.feature[0]], tree.threshold[0]
    left = rows.agg(F.count_if(F.col(name) < threshold).alias("rows_left"))
    return left.select(
        F.lit(name).alias("feature"),
        F.lit(threshold).alias("threshold"),
        F.lit(round(tree.gain[0], 3)).alias("gain"),
        "rows_left",
        F.lit(round(tree.value[1], 6)).alias("left_value"),
        F.lit(round(tree.value[2], 6)).alias("right_value"),
    )


@query("predictions", _PREDICTED)
def predictions(t):
    train, test = line_sides(t)
    model = models.train("random_forest", train, FEATURES, **BINS)
    return checked(models.predictions(model, test, FEATURES, ["commit_id"]))


def both(t):
    train, test = line_sides(t)
    return {
        name: models.predictions(models.train(name, train, FEATURES, **BINS), test, FEATURES, ["commit_id"])
        for name in ("random_forest", "boosted_trees")
    }


@query("model_factory", _TEST + """
    SELECT commit_id, y AS y_true, y AS random_forest_pred, y AS boosted_trees_pred, TRUE AS scores_agree FROM test""")
def model_factory(t):
    wide = models.wide_predictions(both(t))
    agree = (F.col("random_forest_score") >= 0.5) == (F.col("boosted_trees_score") >= 0.5)
    return wide.select("commit_id", "y_true", "random_forest_pred", "boosted_trees_pred", agree.alias("scores_agree"))


# In the order of how much of the label's variance a feature explains alone.
@query("feature_importance", _LINES + """,
    cells AS (
        SELECT unnest(['quantity', 'discount', 'tax', 'line']) AS feature, unnest([quantity, discount, tax, line::DOUBLE]) AS x, y
        FROM labelled),
    means AS (SELECT feature, x, avg(y) AS mean, count(*) AS n FROM cells GROUP BY feature, x),
    explained AS (
        SELECT feature, sum(n * (mean - (SELECT avg(y) FROM labelled)) * (mean - (SELECT avg(y) FROM labelled))) AS strength
        FROM means GROUP BY feature)
    SELECT string_agg(feature, ',' ORDER BY strength DESC) AS ranking, 1.0::DOUBLE AS total FROM explained""")
def feature_importance(t):
    model, _ = fitted(t, "random_forest")
    importance = models.feature_importance(model, FEATURES, t.spark)
    names = F.transform(F.sort_array(F.collect_list(F.struct("importance", "feature")), asc=False), lambda row: row["feature"])
    return importance.agg(F.array_join(names, ",").alias("ranking"), F.round(F.sum("importance"), 6).alias("total"))


@query("model_comparison", _TEST + """
    SELECT unnest(['random_forest', 'boosted_trees']) AS model, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS roc_auc, 1.0::DOUBLE AS f1,
           count(*) FILTER (y = 0) AS tn, 0::BIGINT AS fp, 0::BIGINT AS fn, count(*) FILTER (y = 1) AS tp
    FROM test""")
def model_comparison(t):
    return models.model_comparison(both(t)).select("model", "accuracy", "roc_auc", "f1", "tn", "fp", "fn", "tp")


def _sources(t):
    segment = F.col("o_orderpriority")
    reasoning = t.orders.select(
        F.col("o_orderkey").alias("commit_id"),
        F.substring(segment, 1, 1).cast("int").alias("risk_level"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") / 500000.0).alias("confidence_score"),
    )
    vectors = t.embeddings.select(F.col("vec_id").alias("commit_id"), "embedding")
    return {
        "metrics": (lambda asked: change_history(t, asked).metrics(), list(CHANGE_METRICS)),
        "vectors": (vectors, ["embedding"]),
        "reasoning": (reasoning, ["risk_level", "confidence_score"]),
    }


def experiment(t, number):
    params = {"boosted_trees_fine": {"rounds": 5}}
    years = {"first_year": 1995, "last_year": 2001}
    return run_experiment(number, labelled_orders(t), _sources(t), **years, target_rows=SAMPLE_ROWS, params=params)


def tested(outcome):
    """Per model: rows and positives it was tested on, and whether its accuracy follows from its counts."""
    comparison = outcome.comparison
    rows = F.expr("tn + fp + fn + tp")
    return comparison.select(
        "model",
        rows.alias("rows"),
        F.expr("fn + tp").alias("positives"),
        (F.abs(F.col("accuracy") - F.expr("tn + tp") / rows) < 1e-9).alias("consistent"),
        F.lit(outcome.wide.count()).cast("bigint").alias("wide_rows"),
    )


# Orders that every source has; the last fifth of all orders by time is the test side.
_TESTED = HISTORY + """,
    placed AS (
        SELECT o_orderkey AS commit_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
               row_number() OVER (ORDER BY o_orderdate, o_orderkey) > floor((SELECT count(*) FROM orders) * 0.8) AS test
        FROM orders)
    SELECT unnest([MODELS]) AS model, count(*) AS rows, count(*) FILTER (y = 1) AS positives, TRUE AS consistent,
           count(*) AS wide_rows
    FROM placed WHERE test AND commit_id IN (SELECT commit_id FROM size)"""


@query("experiment", _TESTED.replace("MODELS", "'random_forest', 'boosted_trees'"))
def experiment_metrics(t):
    return tested(experiment(t, 1))


# Experiments whose label follows from one of their sources: from the risk level where there is one,
# else from the first number of the vector. SQL knows the label, and that it must have been learnt.
RISK = "cast(substring(o_orderpriority, 1, 1) as int) >= 3"


def told(t, number):
    orders = labelled_orders(t)
    if "reasoning" in EXPERIMENTS[number][0]:
        return orders.withColumn("buggy", F.expr(RISK.replace("o_orderpriority", "project")).cast("int"))
    first = t.embeddings.select(F.col("vec_id").alias("commit_id"), F.col("embedding")[0].alias("x"))
    joined = orders.drop("buggy").join(first, "commit_id", "left")
    return joined.withColumn("buggy", F.coalesce(F.col("x") > 0, F.lit(False)).cast("int")).drop("x")


def told_sql(number):
    """Orders that every source has, of the last fifth by time; cells of both models if the label is all learnt."""
    wanted = EXPERIMENTS[number][0]
    told_by = "y" if "reasoning" in wanted else "coalesce(x > 0, FALSE)::INTEGER"
    with_ = HISTORY + "," if "metrics" in wanted else "WITH"
    inside = ["test"]
    inside += ["commit_id IN (SELECT commit_id FROM size)"] if "metrics" in wanted else []
    inside += ["x IS NOT NULL"] if "vectors" in wanted else []
    return with_ + f"""
    placed AS (
        SELECT o_orderkey AS commit_id, ({RISK})::INTEGER AS y, embedding[1] AS x,
               row_number() OVER (ORDER BY o_orderdate, o_orderkey) > floor((SELECT count(*) FROM orders) * 0.8) AS test
        FROM orders LEFT JOIN embeddings ON o_orderkey = vec_id)
    SELECT unnest(['random_forest', 'boosted_trees']) AS model, count(*) AS rows,
           count(*) FILTER ({told_by} = 1) AS positives, TRUE AS consistent, count(*) AS wide_rows, TRUE AS learnt
    FROM placed WHERE {' AND '.join(inside)}"""


def experiment_told(t, number):
    outcome = run_experiment(number, told(t, number), _sources(t), first_year=1995, last_year=2001)
    learnt = outcome.comparison.select("model", (F.col("accuracy") >= 0.8).alias("learnt"))
    return tested(outcome).join(learnt, "model")


@query("experiment_vectors", told_sql(2))
def experiment_vectors(t):
    return experiment_told(t, 2)


@query("experiment_reasoning", told_sql(3))
def experiment_reasoning(t):
    return experiment_told(t, 3)


@query("experiment_metrics_vectors", told_sql(4))
def experiment_metrics_vectors(t):
    return experiment_told(t, 4)


@query("experiment_metrics_reasoning", told_sql(5))
def experiment_metrics_reasoning(t):
    return experiment_told(t, 5)


@query("experiment_vectors_reasoning", told_sql(6))
def experiment_vectors_reasoning(t):
    return experiment_told(t, 6)


@query(
    "experiment_fused",
    _TESTED.replace("MODELS", "'random_forest', 'boosted_trees', 'boosted_trees_fine'")
    + " AND commit_id IN (SELECT vec_id FROM embeddings)",
)
def experiment_fused(t):
    return tested(experiment(t, 7))
