"""Plain Lloyd clustering of integer vectors, exact and repeatable.

A round sends the centroids to the tasks (k times the width in numbers, whatever
the input's size), numpy finds each vector's nearest one, and every task returns
one row of integer sums per centroid; those rows meet in a groupBy. Integers make
sums independent of order, so reruns and any split of the rows agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release_memory

#: Components are integers of floor(SCALE * x).
SCALE = 64
#: Integers beyond this are held at it: with 64 components a squared distance then stays below 2**62, and fits a long.
LARGEST = 2**27
#: Vectors compared at once in a task, which bounds its arrays.
BLOCK = 2048


def whole_vector(vector: Column, width: int) -> Column:
    """True where the vector has exactly `width` components, none null or non-finite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce((F.size(vector) == width) & ~F.exists(vector, bad), F.lit(False))


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, width: int) -> DataFrame:
    """(vec_id, q) of the whole vectors, q the integers floor(64 * x), x as double, held within LARGEST on both sides."""
    held = lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(2.0**62)), F.lit(-(2.0**62)))), F.lit(LARGEST)), F.lit(-LARGEST))
    kept = df.filter(whole_vector(F.col(vector_col), width))
    return kept.select(F.col(id_col).alias("vec_id"), F.transform(vector_col, lambda x: held(x).cast("long")).alias("q"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order; ties go by components. A null id counts as no digits."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return [list(r.q) for r in vectors.select("q", F.sha2(name, 256).alias("h")).orderBy("h", "q").limit(k).collect()]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its nearest centroid, the lowest index in a tie, and the squared distance."""
    d = np.empty((len(x), len(centroids)), np.int64)
    for c, center in enumerate(centroids):
        diff = x - center
        d[:, c] = np.einsum("ij,ij->i", diff, diff)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best]


def _blocks(batches, width: int):
    for frame in batches:
        for a in range(0, len(frame), BLOCK):
            part = frame.iloc[a : a + BLOCK]
            yield part, np.concatenate(part["q"].to_numpy()).reshape(-1, width).astype(np.int64, copy=False)


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    schema = T.StructType([vectors.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    held = np.array(centroids, np.int64)

    def run(batches):
        for part, x in _blocks(batches, held.shape[1]):
            best, d = nearest(x, held)
            yield part[["vec_id"]].assign(cluster=best.astype(np.int32), distance=d)
        release_memory()

    return vectors.mapInPandas(run, schema)


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: the floor of the mean of each one's vectors; one without vectors stays."""
    import pandas as pd

    held = np.array(centroids, np.int64)
    k, width = held.shape

    def run(batches):
        sums, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for _, x in _blocks(batches, width):
            best, _ = nearest(x, held)
            np.add.at(sums, best, x)
            n += np.bincount(best, minlength=k)
        some = np.flatnonzero(n)
        if len(some):
            yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "sums": list(sums[some])})
        release_memory()

    parts = vectors.select("q").mapInPandas(run, "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(width)]).alias("sums"))
    out = [list(c) for c in centroids]
    for r in total.collect():  # k rows at the most
        out[r.cluster] = [int(s) // r.n for s in r.sums]
    return out


def lloyd(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 64, k: int = 16, rounds: int = 3, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """Assignments (vec_id, cluster, distance) of every whole vector after `rounds` rounds, and the final centroids.

    Null vectors, those of another width and those with null or non-finite
    components are left out. Fewer vectors than k give that many centroids;
    none gives an empty table. Rows that repeat an id or a vector are vectors
    of their own; equal ones get equal results. Other columns are not looked at.
    """
    vectors = materialize(integer_vectors(df, id_col, vector_col, width))
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        schema = T.StructType([vectors.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
        return df.sparkSession.createDataFrame([], schema), []
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    return assign(vectors, centroids), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The assignments with cluster_inertia, inertia and the sha256 of each cluster's centroid; one small row a cluster is broadcast."""
    spark = assigned.sparkSession
    names = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    digests = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    held = materialize(assigned)
    sums = held.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    per_cluster = sums.join(digests, "cluster").withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0))))
    return held.join(F.broadcast(per_cluster), "cluster")


def op12_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = with_inertia(*lloyd(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql(rounds: int) -> str:
    """CTEs a1, c1, ... : assignments by the centroids before, and the centroids after them."""
    out = []
    for r in range(1, rounds + 2):
        out.append(f"""d{r} AS (
  SELECT q.r, c.cluster, CAST(sum((q.x - c.x) * (q.x - c.x)) AS BIGINT) AS distance FROM q JOIN c{r - 1} c ON q.i = c.i GROUP BY q.r, c.cluster
), a{r} AS (
  SELECT r, arg_min(cluster, distance * 1000 + cluster) AS cluster, min(distance) AS distance FROM d{r} GROUP BY r
)""")
        if r <= rounds:
            out.append(f"""n{r} AS (
  SELECT a.cluster, q.i, CAST(sum(q.x) AS BIGINT) AS s, count(*) AS n FROM q JOIN a{r} a ON q.r = a.r GROUP BY a.cluster, q.i
), c{r} AS (
  SELECT c.cluster, c.i, coalesce((s - ((s % n) + n) % n) // n, c.x) AS x FROM c{r - 1} c LEFT JOIN n{r} m ON c.cluster = m.cluster AND c.i = m.i
)""")
    return ", ".join(out)


OP12_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), q AS (
  SELECT r, generate_subscripts(embedding, 1) AS i, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 64) AS BIGINT) AS x FROM v
), f AS (
  SELECT r, CAST(row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS INTEGER) AS cluster FROM v
), c0 AS (
  SELECT f.cluster, q.i, q.x FROM q JOIN f ON q.r = f.r WHERE f.cluster < 16
), {_rounds_sql(3)}, s AS (
  SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a4 GROUP BY cluster
), h AS (
  SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY cluster
)
SELECT v.vec_id, a4.cluster, a4.distance, s.cluster_inertia, (SELECT CAST(sum(distance) AS BIGINT) FROM a4) AS inertia, h.centroid_sha256
FROM a4 JOIN v ON v.r = a4.r JOIN s ON s.cluster = a4.cluster JOIN h ON h.cluster = a4.cluster
"""
