"""Queries on vectors: scaling, reduction, clustering and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import cluster
from tessella.plans.views import VECTORS, query, vectors

EPS = 0.9


def _long(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select("vec_id", F.posexplode("v").alias("pos", "x")).withColumn("x", F.round("x", places))


def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(cluster.minmax_scale(vectors(spark, sf_dir)))


def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(cluster.standard_scale(vectors(spark, sf_dir)))


def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared scores, so that the components' signs do not matter."""
    return _long(cluster.pca_scores(vectors(spark, sf_dir)).withColumn("v", F.transform("v", lambda x: x * x)))


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps from the vectors 0 to 9 as centres."""
    v = vectors(spark, sf_dir)
    centres = v.where("vec_id < 10").select(F.col("vec_id").alias("cid"), F.col("v").alias("c"))
    return cluster.kmeans_from(v, centres, 3).select("vec_id", "cluster")


def v_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against whether the first three components are positive."""
    v = vectors(spark, sf_dir).withColumn("octant", sum(F.when(F.col("v")[i] > 0, 1 << i).otherwise(0) for i in range(3)))
    found = cluster.v_measure(v, "label", "octant")
    return found.select(*[F.round(c, 9).alias(c) for c in ("homogeneity", "completeness", "v")])


def kmeans_lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step from the vectors 0 to 7 as centres."""
    v = vectors(spark, sf_dir)
    centres = v.where("vec_id < 8").select(F.col("vec_id").alias("cid"), F.col("v").alias("c"))
    step = cluster.lloyd_step(v, centres)
    return step.select("cluster", "n", F.posexplode("c").alias("pos", "x")).withColumn("x", F.round("x", 6))


def dbscan_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.degrees(vectors(spark, sf_dir), "vec_id", EPS).withColumn("is_core", F.col("n") >= 3)


def eps_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within 1, each once."""
    pairs = cluster.neighbours(vectors(spark, sf_dir), "vec_id", 1.0).where("a < b")
    return pairs.select("a", "b", F.round("d2", 6).alias("d2"))


def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.dbscan_labels(vectors(spark, sf_dir), "vec_id", EPS, 3)


def agglomerative_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.agglomerative_labels(vectors(spark, sf_dir), "vec_id", 10)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).withColumnRenamed("label", "cluster")


def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.silhouette(_labelled(spark, sf_dir), "vec_id").select("vec_id", F.round("s", 6).alias("s"))


def calinski_harabasz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.calinski_harabasz(_labelled(spark, sf_dir)).select(F.round("score", 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        minmax_scale, standard_scale, v_measure, pca_scores, kmeans_assign, kmeans_lloyd_step, dbscan_neighbors, eps_pairs, dbscan_labels, agglomerative_labels, silhouette,
        calinski_harabasz,
    )
}

_PAIRS = "pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, b.label AS lb, sum((a.x - b.x) * (a.x - b.x)) AS d2 FROM vectors a JOIN vectors b USING (pos) GROUP BY ALL)"
_POS = "CAST(pos AS INTEGER) AS pos"

_LLOYD = ["c0 AS (SELECT vec_id AS cid, pos, x AS c FROM vectors WHERE vec_id < 10)"]
for _i in range(4):
    _LLOYD.append(f"""a{_i} AS (SELECT vec_id, min_by(cid, d2 * 1e6 + cid * 1e-9) AS cluster FROM
        (SELECT vec_id, cid, sum((x - c) * (x - c)) AS d2 FROM vectors JOIN c{_i} USING (pos) GROUP BY ALL) GROUP BY vec_id)""")
    _LLOYD.append(f"c{_i + 1} AS (SELECT cluster AS cid, pos, avg(x) AS c FROM vectors JOIN a{_i} USING (vec_id) GROUP BY cluster, pos)")

SQL = {
    "kmeans_assign": query("SELECT vec_id, cluster FROM a3", VECTORS, *_LLOYD[:-1]),
    "v_measure": query(
        """SELECT round(1 - tf / t, 9) AS homogeneity, round(1 - ft / f, 9) AS completeness, round(2 * (1 - tf / t) * (1 - ft / f) / (2 - tf / t - ft / f), 9) AS v FROM
        (SELECT -sum(n / total * ln(n / nf)) AS tf, -sum(n / total * ln(n / nt)) AS ft FROM cells),
        (SELECT -sum(nt / total * ln(nt / total)) AS t FROM (SELECT DISTINCT label, nt, total FROM cells)),
        (SELECT -sum(nf / total * ln(nf / total)) AS f FROM (SELECT DISTINCT octant, nf, total FROM cells))""", VECTORS,
        "o AS (SELECT vec_id, label, sum(CASE WHEN pos < 3 AND x > 0 THEN 1 << pos ELSE 0 END) AS octant FROM vectors GROUP BY ALL)",
        """cells AS (SELECT label, octant, n, sum(n) OVER (PARTITION BY label) AS nt, sum(n) OVER (PARTITION BY octant) AS nf, sum(n) OVER () AS total
                 FROM (SELECT label, octant, count(*)::DOUBLE AS n FROM o GROUP BY ALL))"""),
    "minmax_scale": query(
        f"SELECT vec_id, {_POS}, round(CASE WHEN max(x) OVER p > min(x) OVER p THEN (x - min(x) OVER p) / (max(x) OVER p - min(x) OVER p) ELSE 0e0 END, 6) AS x FROM vectors WINDOW p AS (PARTITION BY pos)", VECTORS),
    "standard_scale": query(
        f"SELECT vec_id, {_POS}, round(CASE WHEN stddev_pop(x) OVER p > 0 THEN (x - avg(x) OVER p) / stddev_pop(x) OVER p ELSE 0e0 END, 6) AS x FROM vectors WINDOW p AS (PARTITION BY pos)", VECTORS),
    "kmeans_lloyd_step": query(
        f"""SELECT cluster, count(*) AS n, {_POS}, round(avg(x), 6) AS x FROM vectors JOIN
        (SELECT a AS vec_id, min_by(b, d2 * 1e6 + b * 1e-9) AS cluster FROM pairs WHERE b < 8 GROUP BY a) USING (vec_id) GROUP BY cluster, pos""", VECTORS, _PAIRS),
    "dbscan_neighbors": query(f"SELECT a AS vec_id, count(*) AS n, count(*) >= 3 AS is_core FROM pairs WHERE d2 <= {EPS}e0 * {EPS}e0 GROUP BY a", VECTORS, _PAIRS),
    "eps_pairs": query("SELECT a, b, round(d2, 6) AS d2 FROM pairs WHERE a < b AND d2 <= 1e0", VECTORS, _PAIRS),
    "dbscan_labels": query(
        f"""SELECT v.vec_id, coalesce(own.l, min(near.l), -1) AS cluster FROM (SELECT DISTINCT vec_id FROM vectors) v
        LEFT JOIN labels own ON own.p = v.vec_id LEFT JOIN near_pairs n ON n.a = v.vec_id LEFT JOIN labels near ON near.p = n.b GROUP BY v.vec_id, own.l""",
        VECTORS, _PAIRS, f"near_pairs AS (SELECT a, b FROM pairs WHERE d2 <= {EPS}e0 * {EPS}e0)",
        "core AS (SELECT a AS p FROM near_pairs GROUP BY a HAVING count(*) >= 3)",
        "links AS (SELECT a, b FROM near_pairs WHERE a IN (SELECT p FROM core) AND b IN (SELECT p FROM core))",
        "reach AS (SELECT p, p AS l FROM core UNION SELECT links.b, reach.l FROM reach JOIN links ON links.a = reach.p)",
        "labels AS (SELECT p, min(l) AS l FROM reach GROUP BY p)"),
    "silhouette": query(
        """SELECT vec_id, round(coalesce((b - a) / greatest(a, b), 0e0), 6) AS s FROM
        (SELECT a AS vec_id, max(CASE WHEN lb = own AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN lb <> own THEN total / n END) AS b
         FROM (SELECT a, lb, sum(sqrt(d2)) AS total, count(*) AS n FROM pairs GROUP BY a, lb), (SELECT DISTINCT vec_id, label AS own FROM vectors) o
         WHERE o.vec_id = a GROUP BY a)""", VECTORS, _PAIRS),
    "calinski_harabasz": query(
        """SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS score FROM
        (SELECT sum(n * (c - m) * (c - m)) AS b, count(DISTINCT label) AS k, sum(n) / 64 AS n FROM
          (SELECT label, pos, avg(x) AS c, count(*) AS n FROM vectors GROUP BY label, pos) JOIN (SELECT pos, avg(x) AS m FROM vectors GROUP BY pos) USING (pos)),
        (SELECT sum((x - c) * (x - c)) AS w FROM (SELECT x, avg(x) OVER (PARTITION BY label, pos) AS c FROM vectors))""", VECTORS),
}
