"""Embedding statistics."""

from pyspark.sql import functions as F

from changerisk.operators import vectors
from changerisk.plans.catalog.registry import query

_CELLS = """
    WITH cells AS (
        SELECT vec_id, unnest(generate_series(0, len(embedding) - 1))::INTEGER AS dimension, unnest(embedding)::DOUBLE AS x
        FROM embeddings),
    norms AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM cells GROUP BY vec_id),
    stats AS (SELECT dimension, avg(x) AS mean, stddev_pop(x) AS std, var_pop(x) AS variance FROM cells GROUP BY dimension),
    ranked AS (
        SELECT dimension, variance, variance / sum(variance) OVER () AS variance_share,
               row_number() OVER (ORDER BY variance DESC, dimension)::INTEGER AS rank FROM stats),
    shares AS (SELECT *, sum(variance_share) OVER (ORDER BY rank) AS cumulative_share FROM ranked)"""
_PAIRS = _CELLS + """,
    pairs AS (
        SELECT a.dimension AS dimension_a, b.dimension AS dimension_b, corr(a.x, b.x) AS correlation,
               abs(corr(a.x, b.x)) AS abs_correlation
        FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND a.dimension < b.dimension GROUP BY ALL)"""


def rounded(df, digits=4):
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def stats(t):
    return vectors.dimension_stats(t.embeddings)


def shares(t):
    return vectors.variance_share(stats(t))


def pairs(t):
    return vectors.correlation_pairs(t.embeddings, key="vec_id")


@query("embedding_summary", _CELLS + """
    SELECT round(min(x), 4) AS min_value, round(max(x), 4) AS max_value, round(avg(x), 4) AS mean_value,
           round(stddev_pop(x), 4) AS std_value, round(avg(abs(x)), 4) AS mean_abs,
           (SELECT round(avg(norm), 4) FROM norms) AS mean_norm,
           round(100.0 * count(*) FILTER (abs(x) < 0.01) / count(*), 4) AS near_zero_percent
    FROM cells""")
def embedding_summary(t):
    return rounded(vectors.embedding_summary(t.embeddings))


@query("dimension_stats", _CELLS + "SELECT dimension, round(mean, 6) AS mean, round(std, 6) AS std, round(variance, 6) AS variance FROM stats")
def dimension_stats(t):
    return rounded(stats(t), 6)


def _histogram(value, source):
    return _CELLS + f""",
    edges AS (SELECT min({value}) AS low, max({value}) AS high FROM {source})
    SELECT least(floor(({value} - low) / (high - low) * 50), 49)::INTEGER AS bin, count(*) AS count
    FROM {source}, edges GROUP BY bin"""


for _name, _what, _value, _source in (
    ("dimension_histogram", "norm", "norm", "norms"),
    ("dimension_histogram_mean", "mean", "mean", "stats"),
    ("dimension_histogram_std", "std", "std", "stats"),
    ("dimension_histogram_variance", "variance", "variance", "stats"),
):

    @query(_name, _histogram(_value, _source))
    def dimension_histogram(t, what=_what):
        return vectors.dimension_histogram(t.embeddings, what, key="vec_id").filter("count > 0").select("bin", "count")


@query("dimension_histogram_correlation", _PAIRS + """,
    edges AS (SELECT min(abs_correlation) AS low, max(abs_correlation) AS high FROM pairs)
    SELECT least(floor((abs_correlation - low) / (high - low) * 50), 49)::INTEGER AS bin, count(*) AS count
    FROM pairs, edges GROUP BY bin""")
def correlation_histogram(t):
    bins = vectors.dimension_histogram(t.embeddings, "correlation", key="vec_id")
    return bins.filter("count > 0").select("bin", "count")


_SHARES = """
    SELECT dimension, rank, round(variance, 6) AS variance, round(variance_share, 6) AS variance_share,
           round(cumulative_share, 6) AS cumulative_share FROM shares"""


@query("variance_share", _CELLS + _SHARES)
def variance_share(t):
    return rounded(shares(t), 6)


@query("top_variance_dims", _CELLS + _SHARES + " WHERE rank <= 10")
def top_variance_dims(t):
    return rounded(vectors.top_variance_dims(shares(t)), 6)


@query("dims_to_reach", _CELLS + """
    SELECT share, coalesce(min(rank) FILTER (cumulative_share >= share), count(*))::INTEGER AS dimensions
    FROM shares, (SELECT unnest([0.5, 0.8, 0.9, 0.95, 0.99])::DOUBLE AS share) GROUP BY share""")
def dims_to_reach(t):
    return vectors.dims_to_reach(shares(t))


@query("effective_rank", _CELLS + """
    SELECT round(exp(-sum(variance_share * ln(variance_share))), 4) AS effective_rank FROM shares WHERE variance_share > 0""")
def effective_rank(t):
    return rounded(vectors.effective_rank(shares(t)))


_SPREAD = """
    SELECT round(avg(variance), 6) AS mean_variance, round(stddev_pop(variance), 6) AS std_variance,
           round(min(variance), 6) AS min_variance, round(max(variance), 6) AS max_variance,
           round(max(variance) / min(variance), 6) AS max_min_ratio,
           round(sum(variance_share) FILTER (rank <= 1), 6) AS top_1_share,
           round(sum(variance_share) FILTER (rank <= 5), 6) AS top_5_share,
           round(sum(variance_share) FILTER (rank <= 10), 6) AS top_10_share,
           round(sum(variance_share) FILTER (rank <= 25), 6) AS top_25_share
    FROM shares"""


@query("variance_spread", _CELLS + _SPREAD)
def variance_spread(t):
    return rounded(vectors.variance_spread(shares(t)), 6)


@query("correlation_pairs", _PAIRS + """
    SELECT dimension_a, dimension_b, round(correlation, 4) AS correlation, round(abs_correlation, 4) AS abs_correlation FROM pairs""")
def correlation_pairs(t):
    return rounded(pairs(t))


@query("top_correlated_pairs", _PAIRS + """
    SELECT dimension_a, dimension_b, round(correlation, 4) AS correlation, round(abs_correlation, 4) AS abs_correlation,
           row_number() OVER (ORDER BY abs_correlation DESC, dimension_a, dimension_b)::INTEGER AS rank
    FROM pairs QUALIFY row_number() OVER (ORDER BY pairs.abs_correlation DESC, dimension_a, dimension_b) <= 10""")
def top_correlated_pairs(t):
    return rounded(vectors.top_correlated_pairs(pairs(t)))


_CORRELATION = """
    SELECT round(avg(abs_correlation), 4) AS mean_abs, round(quantile_cont(abs_correlation, 0.5), 4) AS median_abs,
           round(quantile_cont(abs_correlation, 0.95), 4) AS p95_abs, round(max(abs_correlation), 4) AS max_abs,
           count(*) FILTER (abs_correlation >= 0.3) AS pairs_30, count(*) FILTER (abs_correlation >= 0.5) AS pairs_50,
           count(*) FILTER (abs_correlation >= 0.7) AS pairs_70
    FROM pairs"""


@query("correlation_summary", _PAIRS + _CORRELATION)
def correlation_summary(t):
    return rounded(vectors.correlation_summary(pairs(t)))


@query("pca_readiness", _PAIRS + f""",
    spread AS ({_SPREAD}), correlation AS ({_CORRELATION}),
    report AS (
        SELECT 'variance' AS section, name, value FROM (UNPIVOT spread ON COLUMNS(*) INTO NAME name VALUE value)
        UNION ALL SELECT 'variance', 'effective_rank', exp(-sum(variance_share * ln(variance_share))) FROM shares WHERE variance_share > 0
        UNION ALL SELECT 'reach', 'share_' || CAST(p AS VARCHAR), coalesce(min(rank) FILTER (cumulative_share >= p / 100.0::DOUBLE), count(*))
                  FROM shares, (SELECT unnest([50, 80, 90, 95, 99]) AS p) GROUP BY p
        UNION ALL SELECT 'correlation', name, value FROM (
            UNPIVOT (SELECT mean_abs, median_abs, p95_abs, max_abs, pairs_30::DOUBLE AS pairs_30, pairs_50::DOUBLE AS pairs_50,
                            pairs_70::DOUBLE AS pairs_70 FROM correlation) ON COLUMNS(*) INTO NAME name VALUE value))
    SELECT section, name, round(value, 4) AS value FROM report""")
def pca_readiness(t):
    return rounded(vectors.pca_readiness(t.embeddings, key="vec_id"))
