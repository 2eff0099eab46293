"""Queries over vector tables: array math, similarity, profiles, reliability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.common import Query, r, rounded, table
from tidemark.functions import arrays
from tidemark.functions.hashing import random_projection as projection
from tidemark.operators import near, profile, reliability, scoring, similarity, vectors

# every plane has 22 values: 64 values and two zeros of padding
PLANE = 22

VECTORS_SQL = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
VALUES_SQL = f"""
SELECT vec_id, label, CAST(i AS INTEGER) AS i, v[i] AS x
FROM (SELECT vec_id, label, v, unnest(range(1, len(v) + 1)) AS i FROM ({VECTORS_SQL}))"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", "label", arrays.doubles("embedding").alias("v"))


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    halves = [F.slice("v", 1, 32), F.slice("v", 33, 32)]
    found = rows.select(
        "vec_id",
        arrays.vector_mean("v").alias("mean_value"),
        arrays.norm("v").alias("norm"),
        arrays.frobenius_sum(*halves).alias("frobenius"),
    )
    return found.select("vec_id", *rounded("mean_value", "norm", "frobenius"))


VECTOR_NORMS_SQL = f"""
SELECT vec_id, {r('avg(x)', 'mean_value')}, {r('sqrt(sum(x * x))', 'norm')},
       {r('sqrt(sum(x * x) FILTER (i <= 32)) + sqrt(sum(x * x) FILTER (i > 32))', 'frobenius')}
FROM ({VALUES_SQL}) GROUP BY vec_id"""


def _unfold(df: DataFrame, vector: str) -> DataFrame:
    rows = df.select("vec_id", F.posexplode(vector).alias("i", "x"))
    return rows.select("vec_id", "i", *rounded("x"))


def concat_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    joined = arrays.concat_vectors(F.slice("v", 33, 32), F.slice("v", 1, 32), F.array(F.col("label")))
    return _unfold(rows.withColumn("w", joined), "w")


CONCAT_VECTORS_SQL = f"""
SELECT vec_id, CAST((i + 31) % 64 AS INTEGER) AS i, {r('x', 'x')} FROM ({VALUES_SQL})
UNION ALL SELECT vec_id, 64, {r('CAST(label AS DOUBLE)', 'x')} FROM embeddings"""


def fit_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    longer = _unfold(rows.withColumn("w", arrays.fit_length("v", 80)), "w")
    shorter = _unfold(rows.withColumn("w", arrays.fit_length("v", 48)), "w")
    return longer.withColumn("length", F.lit(80)).unionByName(shorter.withColumn("length", F.lit(48)))


FIT_LENGTH_SQL = f"""
SELECT vec_id, i - 1 AS i, {r('x', 'x')}, 80 AS length FROM ({VALUES_SQL})
UNION ALL
SELECT vec_id, CAST(i AS INTEGER), {r('0.0', 'x')}, 80 FROM embeddings, range(64, 80) t(i)
UNION ALL
SELECT vec_id, i - 1, {r('x', 'x')}, 48 FROM ({VALUES_SQL}) WHERE i <= 48"""


def reshape_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row sums of each vector seen as an 8 x 9 matrix padded with zeros."""
    rows = embeddings(spark, sf_dir).withColumn("m", arrays.to_rows("v", 8, 9))
    rows = rows.select("vec_id", F.posexplode("m").alias("matrix_row", "w"))
    found = rows.select("vec_id", "matrix_row", arrays.total("w").alias("row_sum"), F.size("w").alias("width"))
    return found.select("vec_id", "matrix_row", "width", *rounded("row_sum"))


RESHAPE_ROWS_SQL = f"""
SELECT vec_id, CAST((i - 1) // 9 AS INTEGER) AS matrix_row, 9 AS width, {r('sum(x)', 'row_sum')}
FROM ({VALUES_SQL}) GROUP BY ALL"""


def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unfold(embeddings(spark, sf_dir).withColumn("w", arrays.softmax("v")), "w")


SOFTMAX_SQL = f"""
SELECT vec_id, i - 1 AS i, {r('exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id)', 'x')} FROM ({VALUES_SQL})"""

_P_SQL = f"SELECT vec_id, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM ({VALUES_SQL})"


def prediction_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.prediction_stability(embeddings(spark, sf_dir), "v")
    return found.select("vec_id", "is_stable", *rounded("entropy", "renyi_entropy"))


PREDICTION_STABILITY_SQL = f"""
SELECT vec_id, -sum(p * log2(p)) <= 4.0 AS is_stable, {r('-sum(p * log2(p))', 'entropy')},
       {r('-log2(sum(p * p))', 'renyi_entropy')}
FROM ({_P_SQL}) GROUP BY vec_id"""


def shannon_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the squared entries, which sum to one for unit vectors."""
    rows = embeddings(spark, sf_dir).withColumn("p", F.transform("v", lambda x: x * x))
    found = rows.select("vec_id", arrays.shannon_entropy("p").alias("entropy"))
    return found.select("vec_id", *rounded("entropy"))


_SQUARES_SQL = f"""
SELECT vec_id, p / sum(p) OVER (PARTITION BY vec_id) AS p
FROM (SELECT vec_id, x * x AS p FROM ({VALUES_SQL})) WHERE p > 1e-12"""
SHANNON_ENTROPY_SQL = f"""
SELECT vec_id, {r('-sum(p * log2(p))', 'entropy')} FROM ({_SQUARES_SQL}) GROUP BY vec_id"""


def renyi_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).withColumn("p", F.transform("v", lambda x: x * x))
    found = rows.select(
        "vec_id",
        arrays.renyi_entropy("p", 2.0).alias("order_2"),
        arrays.renyi_entropy("p", 0.5).alias("order_half"),
        arrays.renyi_entropy("p", 1.0).alias("order_1"),
    )
    return found.select("vec_id", *rounded("order_2", "order_half", "order_1"))


RENYI_ENTROPY_SQL = f"""
SELECT vec_id, {r('-log2(sum(p * p))', 'order_2')}, {r('2.0 * log2(sum(sqrt(p)))', 'order_half')},
       {r('-sum(p * log2(p))', 'order_1')}
FROM ({_SQUARES_SQL}) GROUP BY vec_id"""


def _planes(df: DataFrame) -> tuple[DataFrame, dict]:
    whole = arrays.fit_length("v", 3 * PLANE)
    rows = df.select("vec_id", *[F.slice(whole, 1 + PLANE * i, PLANE).alias(f"p{i}") for i in range(3)])
    return rows, arrays.plane_covariance(["p0", "p1", "p2"])


def plane_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = _planes(embeddings(spark, sf_dir))
    return rows.select("vec_id", *[F.round(x + 1e-9, 6).alias(n) for n, x in c.items()])


_PLANES_SQL = f"""
SELECT a.vec_id, i, coalesce(p0, 0.0) AS p0, coalesce(p1, 0.0) AS p1, coalesce(p2, 0.0) AS p2
FROM (SELECT vec_id, (i - 1) % {PLANE} AS i, max(x) FILTER (i <= {PLANE}) AS p0,
             max(x) FILTER (i > {PLANE} AND i <= 2 * {PLANE}) AS p1, max(x) FILTER (i > 2 * {PLANE}) AS p2
      FROM ({VALUES_SQL}) GROUP BY ALL) a"""
_COVARIANCE_SQL = f"""
SELECT vec_id, var_samp(p0) AS c00, covar_samp(p0, p1) AS c01, covar_samp(p0, p2) AS c02,
       var_samp(p1) AS c11, covar_samp(p1, p2) AS c12, var_samp(p2) AS c22
FROM ({_PLANES_SQL}) GROUP BY vec_id"""
PLANE_COVARIANCE_SQL = f"""
SELECT vec_id, {', '.join(r(c, c) for c in ('c00', 'c01', 'c02', 'c11', 'c12', 'c22'))},
       {r('c00 + c11 + c22', 'trace')} FROM ({_COVARIANCE_SQL})"""


def plane_eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = _planes(embeddings(spark, sf_dir))
    rows = rows.select("vec_id", *[x.alias(n) for n, x in c.items()])
    low, mid, high = arrays.symmetric_eigenvalues({n: F.col(n) for n in c})
    found = rows.select("vec_id", low.alias("low"), mid.alias("mid"), high.alias("high"))
    return found.select("vec_id", *rounded("low", "mid", "high"))


# the roots of the characteristic polynomial, by the trigonometric cubic formula
PLANE_EIGENVALUES_SQL = f"""
WITH c AS ({_COVARIANCE_SQL}),
k AS (
  SELECT vec_id, c00 + c11 + c22 AS t,
         c00 * c11 + c00 * c22 + c11 * c22 - c01 * c01 - c02 * c02 - c12 * c12 AS s,
         c00 * c11 * c22 + 2 * c01 * c02 * c12 - c00 * c12 * c12 - c11 * c02 * c02 - c22 * c01 * c01 AS d
  FROM c),
q AS (SELECT *, t * t / 3 - s AS p, 2 * t * t * t / 27 - t * s / 3 + d AS w FROM k),
a AS (
  SELECT *, 2 * sqrt(p / 3) AS m, acos(least(greatest(1.5 * w / p * sqrt(3 / p), -1.0), 1.0)) / 3 AS phi FROM q)
SELECT vec_id, {r('t / 3 + m * cos(phi + 2 * pi() / 3)', 'low')},
       {r('t / 3 + m * cos(phi - 2 * pi() / 3)', 'mid')}, {r('t / 3 + m * cos(phi)', 'high')}
FROM a"""


def random_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    return _unfold(rows.withColumn("w", projection(64, 8)(F.col("v"))), "w")


def _weights_sql(label: str, scale: float) -> str:
    """Normal weights from md5 of ``label:i:j``."""
    text = f"md5('{label}:' || i || ':' || j)"
    u = [f"(CAST('0x' || substr({text}, {1 + 8 * n}, 8) AS BIGINT) + 0.5) / 4294967296.0" for n in (0, 1)]
    return f"{scale} * sqrt(-2.0 * ln({u[0]})) * cos(2.0 * pi() * ({u[1]}))"


RANDOM_PROJECTION_SQL = f"""
WITH k AS (SELECT i, j, {_weights_sql('syntax-kernel', 0.01)} AS w FROM range(64) a(i), range(8) b(j)),
b AS (SELECT j, {_weights_sql('syntax-bias', 0.001)} AS w FROM range(1) a(i), range(8) b(j)),
s AS (SELECT vec_id, j, sum(x * w) AS y FROM ({VALUES_SQL}) v JOIN k ON k.i = v.i - 1 GROUP BY vec_id, j)
SELECT vec_id, CAST(s.j AS INTEGER) AS i, {r('tanh(y + w)', 'x')} FROM s JOIN b USING (j)"""


def vector_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.vector_centroid(embeddings(spark, sf_dir), ["label"], "v")
    rows = found.select("label", F.posexplode("centroid").alias("i", "x"))
    return rows.select("label", "i", *rounded("x"))


_CENTROID_SQL = f"SELECT label, i - 1 AS i, avg(x) AS x FROM ({VALUES_SQL}) GROUP BY label, i"
VECTOR_CENTROID_SQL = f"SELECT label, i, {r('x', 'x')} FROM ({_CENTROID_SQL})"


def step_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.step_divergence(embeddings(spark, sf_dir), ["label"], ["vec_id"], "v")
    return found.select("vec_id", *rounded("divergence"))


STEP_DIVERGENCE_SQL = f"""
SELECT vec_id, {r('coalesce(list_distance(v, before), 0.0)', 'divergence')}
FROM (SELECT vec_id, v, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM ({VECTORS_SQL}))"""


def pairwise_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.group_divergence(embeddings(spark, sf_dir), ["label"], "vec_id", "v")
    return found.select("vec_id", *rounded("rms_divergence"))


PAIRWISE_DIVERGENCE_SQL = f"""
WITH e AS ({VECTORS_SQL})
SELECT a.vec_id, {r('sqrt(avg(list_distance(a.v, b.v) * list_distance(a.v, b.v)))', 'rms_divergence')}
FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id"""


def similarity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors closest to the centroid of each label."""
    rows = embeddings(spark, sf_dir)
    asked = vectors.vector_centroid(rows, ["label"], "v")
    found = similarity.similarity_search(
        rows, asked, id_column="vec_id", vector="v", query_id="label", query_vector="centroid", k=5
    )
    return found.select("label", "vec_id", "rank", *rounded("similarity"))


SIMILARITY_SEARCH_SQL = f"""
WITH c AS (SELECT label, list(x ORDER BY i) AS q FROM ({_CENTROID_SQL}) GROUP BY label),
s AS (
  SELECT c.label, vec_id, round(list_cosine_similarity(q, v), 12) AS s FROM c, ({VECTORS_SQL}) e),
k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT label, vec_id, rank, {r('s', 'similarity')} FROM k WHERE rank <= 5"""


#: The distance of the registered pairs: unit vectors at random are 1.41 apart.
NEAR = 1.15


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different vectors at most ``NEAR`` apart."""
    found = near.near_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", NEAR)
    return found.select("first_id", "second_id", *rounded("divergence"))


def near_vectors_of_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within each label."""
    found = near.near_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", NEAR, keys=["label"])
    return found.select("label", "first_id", "second_id", *rounded("divergence"))


def _near_sql(keys: str) -> str:
    same, named = ("AND a.label = b.label", "a.label, ") if keys else ("", "")
    return f"""
WITH e AS (SELECT {keys} v, min(vec_id) AS vec_id FROM ({VECTORS_SQL}) GROUP BY {keys} v)
SELECT {named} a.vec_id AS first_id, b.vec_id AS second_id, {r('list_distance(a.v, b.v)', 'divergence')}
FROM e a JOIN e b ON a.vec_id < b.vec_id {same} WHERE list_distance(a.v, b.v) <= {NEAR}"""


def _twentieth(rows: DataFrame) -> DataFrame:
    """The query set of a search: every vector whose id 20 divides."""
    return rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "v")


def similarity_of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors closest to each query, all vectors searched."""
    rows = embeddings(spark, sf_dir)
    found = similarity.similarity_search(
        rows, _twentieth(rows), id_column="vec_id", vector="v", query_id="query_id", query_vector="v", k=5
    )
    return found.select("query_id", "vec_id", "rank", *rounded("similarity"))


def similarity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answer from the index."""
    rows = embeddings(spark, sf_dir)
    index = similarity.build_index(rows, id_column="vec_id", vector="v")
    found = similarity.search_index(index, _twentieth(rows), query_id="query_id", query_vector="v", k=5)
    return found.nearest.select("query_id", "vec_id", "rank", *rounded("similarity"))


def similarity_index_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells of the index each query looked into, of how many."""
    rows = embeddings(spark, sf_dir)
    index = similarity.build_index(rows, id_column="vec_id", vector="v")
    looked = similarity.search_index(index, _twentieth(rows), query_id="query_id", query_vector="v", k=5).looked
    return looked.withColumn("share", F.round(F.col("looked") / F.col("cells"), 6))


SIMILARITY_OF_VECTORS_SQL = f"""
WITH s AS (
  SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 12) AS s
  FROM ({VECTORS_SQL}) q, ({VECTORS_SQL}) e WHERE q.vec_id % 20 = 0),
k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, vec_id, rank, {r('s', 'similarity')} FROM k WHERE rank <= 5"""


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors with the most even distribution of squared entries."""
    return similarity.top_k(shannon_entropy(spark, sf_dir), "entropy", "vec_id", 10)


TOP_K_SQL = f"SELECT vec_id, entropy FROM ({SHANNON_ENTROPY_SQL}) ORDER BY entropy DESC, vec_id LIMIT 10"


def load_vectors_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.reports import record_count

    return record_count(table(spark, sf_dir, "embeddings"))


def fit_profile_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    found = profile.pair_profile(rows, ["l_returnflag"], "l_quantity", "l_discount")
    return found.select("l_returnflag", "n", *rounded("mean_x", "mean_y", "var_x", "var_y", "cov_xy"))


FIT_PROFILE_SQL = f"""
SELECT l_returnflag, count(*) AS n, {r('avg(l_quantity)', 'mean_x')}, {r('avg(l_discount)', 'mean_y')},
       {r('var_pop(l_quantity) + 1e-6', 'var_x')}, {r('var_pop(l_discount) + 1e-6', 'var_y')},
       {r('covar_pop(l_quantity, l_discount)', 'cov_xy')}
FROM lineitem GROUP BY l_returnflag"""


def fit_profile_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted covariance matrix of all 64 dimensions, one row per entry."""
    fitted = profile.fit_profile(embeddings(spark, sf_dir), "v")
    d = len(fitted.mean)
    entries = [(i, j, float(fitted.covariance[i, j])) for i in range(d) for j in range(d)]
    found = spark.createDataFrame(entries, "i INT, j INT, covariance DOUBLE")
    return found.select("i", "j", *rounded("covariance"))


FIT_PROFILE_WIDE_SQL = f"""
WITH x AS MATERIALIZED ({VALUES_SQL})
SELECT a.i - 1 AS i, b.i - 1 AS j,
       {r('covar_pop(a.x, b.x) + CASE WHEN a.i = b.i THEN 1e-6 ELSE 0.0 END', 'covariance')}
FROM x a JOIN x b USING (vec_id) GROUP BY a.i, b.i"""


def profile_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_discount")
    found = profile.pair_profile(rows, ["l_suppkey"], "l_quantity", "l_discount")
    return found.select("l_suppkey", *rounded("eig_min", "eig_max"), *rounded("profile_condition", digits=2))


PROFILE_CONDITION_SQL = f"""
WITH c AS (
  SELECT l_suppkey, var_pop(l_quantity) + 1e-6 AS a, var_pop(l_discount) + 1e-6 AS b,
         covar_pop(l_quantity, l_discount) AS c FROM lineitem GROUP BY l_suppkey),
e AS (
  SELECT l_suppkey, (a + b) / 2 - sqrt((a - b) * (a - b) / 4 + c * c) AS lo,
         (a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c) AS hi FROM c)
SELECT l_suppkey, {r('lo', 'eig_min')}, {r('hi', 'eig_max')}, {r('hi / (lo + 1e-12)', 'profile_condition', 2)}
FROM e"""


def score_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array("l_quantity", "l_discount").alias("v")
    )
    fitted = profile.fit_profile(rows, "v")
    found = profile.score_profile(rows, "v", fitted)
    return found.select(
        "l_orderkey", "l_linenumber", "is_ood",
        *rounded("mahalanobis_distance"), *rounded("profile_condition", digits=2),
    )


SCORE_PROFILE_SQL = f"""
WITH p AS (
  SELECT avg(l_quantity) AS mx, avg(l_discount) AS my, var_pop(l_quantity) + 1e-6 AS a,
         var_pop(l_discount) + 1e-6 AS b, covar_pop(l_quantity, l_discount) AS c FROM lineitem),
d AS (
  SELECT l_orderkey, l_linenumber, l_quantity - mx AS x, l_discount - my AS y, a, b, c FROM lineitem, p),
s AS (
  SELECT *, sqrt(greatest((b * x * x - 2.0 * c * x * y + a * y * y) / (a * b - c * c), 0.0)) AS dist,
         ((a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c))
           / ((a + b) / 2 - sqrt((a - b) * (a - b) / 4 + c * c) + 1e-12) AS cond FROM d)
SELECT l_orderkey, l_linenumber, dist > 3.0 AS is_ood, {r('dist', 'mahalanobis_distance')},
       {r('cond', 'profile_condition', 2)} FROM s"""


def score_profile_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64 dimensions; checked against numpy in the tests."""
    rows = embeddings(spark, sf_dir)
    found = profile.score_profile(rows, "v", profile.fit_profile(rows, "v"))
    return found.select("vec_id", "is_ood", *rounded("mahalanobis_distance"))


def latent_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = profile.latent_factors(embeddings(spark, sf_dir), "v", 4)
    rows = found.select("vec_id", F.posexplode("factors").alias("factor", "x"))
    return rows.select("vec_id", "factor", *rounded("x"))


def latent_orthogonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the columns of U.S, divided by their singular values: the identity."""
    found, singular = profile.latent_factors(embeddings(spark, sf_dir), "v", 8)
    pairs = [(i, j) for i in range(8) for j in range(i, 8)]
    sums = found.agg(
        *[F.sum(F.col("factors")[i] * F.col("factors")[j] / float(singular[i] * singular[j])).alias(f"p{i}_{j}") for i, j in pairs]
    )
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"p{i}_{j}").alias("product")) for i, j in pairs])
    rows = sums.select(F.explode(each).alias("e")).select("e.*")
    # no negative zeros
    return rows.select("i", "j", (F.round("product", 6) + 0.0).alias("product"))


LATENT_ORTHOGONALITY_SQL = """
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS product
FROM range(8) a(i), range(8) b(j) WHERE i <= j AND (SELECT count(*) FROM embeddings) >= 8"""


def latent_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of all 64 factors of a vector: rebuilt from them, it keeps its length."""
    found, _ = profile.latent_factors(embeddings(spark, sf_dir), "v", 64)
    return found.select("vec_id", arrays.norm("factors").alias("length")).select("vec_id", *rounded("length"))


LATENT_ENERGY_SQL = f"SELECT vec_id, {r('sqrt(sum(x * x))', 'length')} FROM ({VALUES_SQL}) GROUP BY vec_id"


def reliability_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels per language: score, variance and a 95% interval."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = labels.join(langs, ["doc_id"])
    scored = reliability.reliability(rows, ["lang"], F.col("quality") == 1)
    found = reliability.credible_interval(scored)
    return found.select("lang", "alpha", "beta", *rounded("score", "variance", "lower", "upper"))


_BETA_SQL = """
SELECT lang, 1.0 + sum(quality) AS alpha, 1.0 + sum(1 - quality) AS beta
FROM labels JOIN documents USING (doc_id) GROUP BY lang"""


# Quantiles of whole counts as sums of binomial terms, each halved into place.
RELIABILITY_SQL = f"""
WITH RECURSIVE b AS ({_BETA_SQL}),
s AS (
  SELECT lang, CAST(alpha AS DOUBLE) AS alpha, CAST(beta AS DOUBLE) AS beta, alpha / (alpha + beta) AS score,
         alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1.0)) AS variance,
         CAST(alpha AS BIGINT) AS a, CAST(alpha + beta AS BIGINT) - 1 AS n FROM b),
h AS (
  SELECT lang, a, n, level, 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  FROM s, (VALUES (0.025::DOUBLE), (0.975::DOUBLE)) t(level)
  UNION ALL
  SELECT lang, a, n, level, step + 1, CASE WHEN mass < level THEN (low + high) / 2 ELSE low END,
         CASE WHEN mass < level THEN high ELSE (low + high) / 2 END
  FROM (
    SELECT *, list_sum(list_transform(range(a, n + 1), lambda j: exp(
      lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((low + high) / 2) + (n - j) * ln(1 - (low + high) / 2)
    ))) AS mass
    FROM h WHERE step < 45)),
q AS (
  SELECT lang, max(low) FILTER (level < 0.5) AS lower, max(low) FILTER (level > 0.5) AS upper FROM h WHERE step = 45 GROUP BY lang)
SELECT lang, alpha, beta, {r('score', 'score')}, {r('variance', 'variance')}, {r('lower', 'lower')}, {r('upper', 'upper')}
FROM s JOIN q USING (lang)"""


def beta_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type")
    found = reliability.reliability(rows, ["user_id"], F.col("event_type") != "error")
    return found.select("user_id", "alpha", "beta", *rounded("score", "variance", digits=9))


BETA_SCORE_SQL = f"""
WITH c AS (
  SELECT user_id, 1.0 + count(*) FILTER (event_type <> 'error') AS a, 1.0 + count(*) FILTER (event_type = 'error') AS b
  FROM events GROUP BY user_id),
d AS (SELECT user_id, CAST(a AS DOUBLE) AS alpha, CAST(b AS DOUBLE) AS beta FROM c)
SELECT user_id, alpha, beta, {r('alpha / (alpha + beta)', 'score', 9)},
       {r('alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))', 'variance', 9)} FROM d"""


def beta_score_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type")
    found = reliability.reliability(rows, [], F.col("event_type") != "error")
    return found.select("alpha", "beta", *rounded("score", "variance", digits=9))


BETA_SCORE_OVERALL_SQL = f"""
WITH d AS (
  SELECT CAST(1 + count(*) FILTER (event_type <> 'error') AS DOUBLE) AS alpha,
         CAST(1 + count(*) FILTER (event_type = 'error') AS DOUBLE) AS beta FROM events)
SELECT alpha, beta, {r('alpha / (alpha + beta)', 'score', 9)},
       {r('alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))', 'variance', 9)} FROM d"""


def _running_reliability(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    ok = F.col("event_type") != "error"
    found = reliability.running_reliability(rows, keys, ["ts", "event_id"], ok)
    return found.select("event_id", *rounded("old_score", "new_score", digits=9))


def running_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _running_reliability(spark, sf_dir, ["user_id"])


def running_reliability_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _running_reliability(spark, sf_dir, [])


def _running_sql(part: str) -> str:
    return f"""
WITH s AS (
  SELECT *, (1.0 + count(*) FILTER (event_type <> 'error') OVER w) / CAST(2 + count(*) OVER w AS DOUBLE) AS score
  FROM events WINDOW w AS ({part} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, {r(f'coalesce(lag(score) OVER ({part} ORDER BY ts, event_id), 0.5)', 'old_score', 9)},
       {r('score', 'new_score', 9)} FROM s"""


QUERIES = {
    "vector_norms": Query(vector_norms, VECTOR_NORMS_SQL),
    "concat_vectors": Query(concat_vectors, CONCAT_VECTORS_SQL),
    "fit_length": Query(fit_length, FIT_LENGTH_SQL),
    "reshape_rows": Query(reshape_rows, RESHAPE_ROWS_SQL),
    "softmax": Query(softmax, SOFTMAX_SQL),
    "shannon_entropy": Query(shannon_entropy, SHANNON_ENTROPY_SQL),
    "renyi_entropy": Query(renyi_entropy, RENYI_ENTROPY_SQL),
    "prediction_stability": Query(prediction_stability, PREDICTION_STABILITY_SQL),
    "plane_covariance": Query(plane_covariance, PLANE_COVARIANCE_SQL),
    "plane_eigenvalues": Query(plane_eigenvalues, PLANE_EIGENVALUES_SQL),
    "random_projection": Query(random_projection, RANDOM_PROJECTION_SQL),
    "vector_centroid": Query(vector_centroid, VECTOR_CENTROID_SQL),
    "step_divergence": Query(step_divergence, STEP_DIVERGENCE_SQL),
    "pairwise_divergence": Query(pairwise_divergence, PAIRWISE_DIVERGENCE_SQL),
    "near_vectors": Query(near_vectors, _near_sql("")),
    "near_vectors_of_label": Query(near_vectors_of_label, _near_sql("label, ")),
    "similarity_search": Query(similarity_search, SIMILARITY_SEARCH_SQL),
    "similarity_of_vectors": Query(similarity_of_vectors, SIMILARITY_OF_VECTORS_SQL),
    "similarity_index": Query(similarity_index, SIMILARITY_OF_VECTORS_SQL),
    "similarity_index_share": Query(similarity_index_share),
    "top_k": Query(top_k, TOP_K_SQL),
    "record_count": Query(load_vectors_count, "SELECT count(*) AS record_count FROM embeddings"),
    "fit_profile": Query(fit_profile_pairs, FIT_PROFILE_SQL),
    "fit_profile_wide": Query(fit_profile_wide, FIT_PROFILE_WIDE_SQL),
    "profile_condition": Query(profile_condition, PROFILE_CONDITION_SQL),
    "score_profile": Query(score_profile, SCORE_PROFILE_SQL),
    "score_profile_wide": Query(score_profile_wide),
    "latent_factors": Query(latent_factors),
    "latent_orthogonality": Query(latent_orthogonality, LATENT_ORTHOGONALITY_SQL),
    "latent_energy": Query(latent_energy, LATENT_ENERGY_SQL),
    "credible_interval": Query(reliability_by_lang, RELIABILITY_SQL),
    "beta_score": Query(beta_score, BETA_SCORE_SQL),
    "beta_score_overall": Query(beta_score_overall, BETA_SCORE_OVERALL_SQL),
    "running_reliability": Query(running_reliability, _running_sql("PARTITION BY user_id")),
    "running_reliability_overall": Query(running_reliability_overall, _running_sql("")),
}
