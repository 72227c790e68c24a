"""Principal components and text vectors.

Components have arbitrary signs, so the comparable facts are checked: at full size the
components carry each dimension's variance, scores keep lengths, and the inverse gives the
vectors back.
"""

from pyspark.sql import functions as F

from changerisk.functions.vectors import fold, vector_norm
from changerisk.operators import pca, split, vectors
from changerisk.operators.embedding import HashingEncoder
from changerisk.operators.embedding import embed_text as embed
from changerisk.plans.catalog.registry import query
from changerisk.runtime import scratch_path

SIZE = 64

_CENTRED = """
    WITH cells AS (
        SELECT vec_id, unnest(generate_series(0, len(embedding) - 1))::INTEGER AS dimension, unnest(embedding)::DOUBLE AS x
        FROM embeddings),
    stats AS (SELECT dimension, avg(x) AS mean, var_samp(x) AS variance FROM cells GROUP BY dimension),
    lengths AS (
        SELECT vec_id, sqrt(sum((x - mean) * (x - mean))) AS length FROM cells JOIN stats USING (dimension) GROUP BY vec_id)"""
_LENGTHS = _CENTRED + "SELECT vec_id, round(length, 4) AS length FROM lengths"


def full_model(t):
    return pca.pca_fit(t.embeddings, k=SIZE, key="vec_id")


def lengths(df):
    return df.select("vec_id", F.round(vector_norm(F.col("embedding")), 4).alias("length"))


@query("pca_fit", _CENTRED + "SELECT dimension, round(mean, 6) AS mean, round(variance / (SELECT sum(variance) FROM stats), 6) AS captured FROM stats")
def pca_fit(t):
    mean, components, shares = pca.pca_parts(full_model(t))
    captured = (components**2) @ shares
    rows = [(i, float(mean[i]), float(captured[i])) for i in range(SIZE)]
    df = t.spark.createDataFrame(rows, "dimension int, mean double, captured double")
    return df.select("dimension", F.round("mean", 6).alias("mean"), F.round("captured", 6).alias("captured"))


@query("pca_transform", _LENGTHS)
def pca_transform(t):
    return lengths(pca.pca_transform(t.embeddings, full_model(t)))


@query("pca_save", _LENGTHS)
def pca_save(t):
    path = scratch_path(t.spark, "pca")
    pca.pca_save(full_model(t), path)
    return lengths(pca.pca_transform(t.embeddings, pca.pca_load(path)))


@query("pca_load", _LENGTHS)
def pca_load(t):
    path = scratch_path(t.spark, "pca")
    for _ in range(2):  # fitted and written first, then reused
        model = pca.pca_fit_or_load(t.embeddings, path, k=SIZE, key="vec_id")
    return lengths(pca.pca_transform(t.embeddings, model))


@query("pca_inverse", "SELECT vec_id, " + ", ".join(
    f"round(embedding[{i}]::DOUBLE, 4) AS x{i}" for i in range(1, SIZE + 1)) + " FROM embeddings")
def pca_inverse(t):
    model = full_model(t)
    restored = pca.pca_inverse(pca.pca_transform(t.embeddings, model), model)
    return restored.select("vec_id", *[F.round(F.col("embedding")[i - 1], 4).alias(f"x{i}") for i in range(1, SIZE + 1)])


# What components explain and what reconstruction loses add up to the variance of the train side.
_TRAIN = """
    WITH train AS (
        SELECT embedding FROM embeddings
        QUALIFY row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), vec_id)
                <= floor((SELECT count(*) FROM embeddings) * 0.8::DOUBLE)),
    cells AS (
        SELECT unnest(generate_series(0, len(embedding) - 1)) AS dimension, unnest(embedding)::DOUBLE AS x FROM train),
    stats AS (SELECT dimension, var_samp(x) AS variance FROM cells GROUP BY dimension),
    total AS (SELECT sum(variance) AS variance, count(*)::INTEGER AS size FROM stats)"""


def accounted(t, results):
    """Explained plus lost variance of each size, in place of its two parts."""
    train, _ = split.random_holdout(t.embeddings.select("vec_id", "embedding"), "vec_id")
    shares = vectors.variance_share(vectors.dimension_stats(train))
    n = train.count()
    population = shares.agg(F.sum("variance")).first()[0]
    lost = F.col("train_reconstruction_mse") * SIZE
    explained = F.col("explained_variance_ratio") * F.lit(population)
    total = F.round((explained + lost) * n / (n - 1), 4)
    kept = F.round(F.when(F.col("n_components") == SIZE, F.col("test_reconstruction_mse")), 6)
    return results.select(
        "n_components", total.alias("variance"), kept.alias("test_mse"), F.round("compression_ratio", 6).alias("compression"),
        F.substring("status", 1, 7).alias("status"),
    )


@query("pca_evaluate", _TRAIN + """
    SELECT 32 AS n_components, round(variance, 4) AS variance, CAST(NULL AS DOUBLE) AS test_mse,
           round(size / 32.0::DOUBLE, 6) AS compression, 'ok' AS status FROM total""")
def pca_evaluate(t):
    return accounted(t, pca.pca_evaluate(t.embeddings, SIZE // 2, key="vec_id"))


@query("pca_evaluate_full", """
    SELECT len(embedding)::INTEGER AS n_components, 1.0::DOUBLE AS explained_variance_ratio, 0.0::DOUBLE AS train_reconstruction_mse,
           0.0::DOUBLE AS test_reconstruction_mse, 1.0::DOUBLE AS compression_ratio, 'ok' AS status
    FROM embeddings GROUP BY ALL""")
def pca_evaluate_full(t):
    row = pca.pca_evaluate(t.embeddings, SIZE, key="vec_id")
    return row.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in row.dtypes])


def sweep(t):
    return pca.pca_sweep(t.embeddings, components=(768, 64, 48, 32, 16), key="vec_id")


@query("pca_sweep", _TRAIN + """
    SELECT k AS n_components, CASE WHEN k <= size THEN round(variance, 4) END AS variance,
           CASE WHEN k = size THEN 0.0::DOUBLE END AS test_mse, CASE WHEN k <= size THEN round(size / k::DOUBLE, 6) END AS compression,
           CASE WHEN k <= size THEN 'ok' ELSE 'skipped' END AS status
    FROM total, (SELECT unnest([768, 64, 48, 32, 16])::INTEGER AS k)""")
def pca_sweep(t):
    return accounted(t, sweep(t))


@query("pca_recommend", """
    WITH cells AS (
        SELECT unnest(generate_series(0, len(embedding) - 1)) AS dimension, unnest(embedding)::DOUBLE AS x FROM embeddings),
    stats AS (SELECT dimension, var_pop(x) AS variance FROM cells GROUP BY dimension),
    reached AS (
        SELECT row_number() OVER (ORDER BY variance DESC, dimension) AS rank,
               sum(variance) OVER (ORDER BY variance DESC, dimension) / sum(variance) OVER () AS share FROM stats)
    SELECT min(rank)::INTEGER AS n_components, round(min(share), 6) AS explained_variance_ratio,
           'smallest size that keeps enough variance' AS recommendation
    FROM reached WHERE share >= 0.9""")
def pca_recommend(t):
    shares = vectors.variance_share(vectors.dimension_stats(t.embeddings))  # dimensions as components of their own
    sizes = shares.select(
        F.col("rank").alias("n_components"), F.col("cumulative_share").alias("explained_variance_ratio"), F.lit("ok").alias("status")
    )
    chosen = pca.pca_recommend(sizes, keep=0.9)
    return chosen.withColumn("explained_variance_ratio", F.round("explained_variance_ratio", 6))


# The squares of a component's scores sum up to its share of the whole sum of squares.
@query("pca_projection_2d", _CENTRED + """
    SELECT (SELECT count(*) FROM embeddings) AS rows, round(sum(variance) * ((SELECT count(*) FROM embeddings) - 1), 3) AS pc1_squares,
           round(sum(variance) * ((SELECT count(*) FROM embeddings) - 1), 3) AS pc2_squares, TRUE AS in_order
    FROM stats""")
def pca_projection_2d(t):
    placed = pca.pca_projection_2d(t.embeddings, key="vec_id")
    squares = [F.round(F.sum(F.col(c) * F.col(c) / F.col(f"{c}_share")), 3).alias(f"{c}_squares") for c in ("pc1", "pc2")]
    return placed.agg(F.count("*").alias("rows"), *squares, F.every(F.col("pc1_share") >= F.col("pc2_share")).alias("in_order"))


# What the encoder counts at each place, recomputed from whole texts, and the length of its vectors.
PLACES = 768

_TOKENS = """
    WITH words AS (
        SELECT doc_id, md5(unnest(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'))) AS digest
        FROM documents),
    places AS (
        SELECT doc_id, CAST('0x' || left(digest, 8) AS BIGINT) % 768 AS place,
               sum(CASE WHEN CAST('0x' || substr(digest, 9, 1) AS BIGINT) % 2 = 1 THEN -1 ELSE 1 END)::BIGINT AS n
        FROM words WHERE digest <> md5('') GROUP BY ALL HAVING n <> 0),
    listed AS (
        SELECT doc_id, string_agg(place || ':' || n, ',' ORDER BY place) AS counts, round(sqrt(sum(n * n)), 4) AS length
        FROM places GROUP BY doc_id)
    SELECT doc_id, 768 AS size, coalesce(counts, '') AS counts, coalesce(length, 0.0)::DOUBLE AS length,
           CASE WHEN length IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS norm, TRUE AS scaled
    FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN listed USING (doc_id)"""


def counted(embedded):
    """Counts by place of the texts of vectors, and whether the vectors are those, scaled."""
    texts = embedded.select("doc_id", "embedding", F.lower("text").alias("text"))
    vectors = embed(texts, "text", "raw", encoder=HashingEncoder(PLACES, scaled=False))
    vectors = vectors.withColumn("length", F.explode(F.array(vector_norm(F.col("raw")))))  # a generator: computed once a row
    entry = F.transform("raw", lambda n, i: F.when(n != 0, F.concat_ws(":", i, n.cast("bigint"))))
    off = F.zip_with("raw", "embedding", lambda n, x: F.abs(n - x * F.col("length")) > 1e-4 * F.col("length"))
    return vectors.select(
        "doc_id",
        F.size("embedding").alias("size"),
        F.array_join(entry, ",").alias("counts"),
        F.round("length", 4).alias("length"),
        F.round(vector_norm(F.col("embedding")), 4).alias("norm"),
        (~F.exists(off, lambda x: x)).alias("scaled"),
    )


@query("embed_text", _TOKENS)
def embed_text(t):
    return counted(embed(t.documents, "text", size=PLACES))
