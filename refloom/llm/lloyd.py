"""Centroid clustering by plain Lloyd rounds over integers.

Vectors are floored to integers once and written. In each round the centroids (CENTROIDS times
DIMENSIONS numbers) travel with the function, tasks compare their vectors with every centroid
in NumPy, and a partition hands on one integer sum for each centroid and component, which
``groupBy`` merges. All arithmetic is exact, so results don't depend on the partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from refloom.llm.common import fresh, small_batches, stage, table

DIMENSIONS, CENTROIDS, ROUNDS = 64, 40, 5
#: Integers of a component for each unit of the input, seed of the first centroids' choice.
SCALE, SEED = 256, 2
#: Components beyond this many are refused: squared distances would leave a long.
MOST = 1 << 27
#: Below this, sums of squared differences fit 32 bits.
NARROW = 1 << 11


def integers(vectors: DataFrame, id_col: str, vec_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """id, v: the vectors of exactly ``dimensions`` finite components, each floor(SCALE * x)."""
    x = F.col("v")
    whole = x.isNotNull() & (F.size(x) == dimensions)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(whole & finite)

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False) * float(SCALE))
            if len(v) and max(v.max(), -v.min()) > MOST:
                raise ValueError(f"components beyond {MOST // SCALE} are not supported: squared distances would leave a long")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) + 1, dimensions), pa.int32()), pa.array(v.astype(np.int32)))
            yield pa.record_batch([batch.column(0), lists], names=["id", "v"])

    return rows.mapInArrow(floored, "id long, v array<int>")


def first_centroids(rows: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The ``k`` vectors of smallest SHA-256 of ``SEED:<id>`` (equal ones by components; a null id is written as nothing)."""
    key = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in rows.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()], np.int64)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroid of least squared distance of each row (the lowest index among equals) and that distance."""
    narrow = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0))) < NARROW
    kind = np.int32 if narrow else np.int64
    v, centroids = v.astype(kind), centroids.astype(kind)
    squares = np.empty((len(centroids), len(v)), kind)
    for i, centroid in enumerate(centroids):
        away = v - centroid
        np.einsum("ij,ij->i", away, away, out=squares[i])
    best = squares.argmin(axis=0)
    return best, squares[best, np.arange(len(v))].astype(np.int64)


def _matrix(column: pd.Series, dimensions: int) -> np.ndarray:
    return np.concatenate(column.to_list()).reshape(-1, dimensions) if len(column) else np.zeros((0, dimensions), np.int32)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floors of their vectors' means; those without vectors stay."""
    k, dimensions = centroids.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v = _matrix(batch["v"], dimensions)
            which, _ = nearest(v, centroids)
            count += np.bincount(which, minlength=k)
            for i in np.unique(which).tolist():
                total[i] += v[which == i].sum(axis=0, dtype=np.int64)
        met = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": np.repeat(met, dimensions), "component": np.tile(np.arange(dimensions), len(met)), "total": total[met].ravel(), "n": np.repeat(count[met], dimensions)})

    partial = rows.select("v").mapInPandas(sums, "cluster int, component int, total long, n long")
    out = centroids.copy()
    # k times dimensions rows at most
    for r in partial.groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r["cluster"], r["component"]] = r["total"] // r["n"]
    return out


def centroid_clusters(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS
) -> tuple[DataFrame, DataFrame]:
    """Returns (assigned, clusters).

    assigned: ``id_col``, cluster (int), distance (long, squared) per vector that takes part;
    clusters: cluster, centroid (array of long), size, inertia of each centroid, in order.

    Defined cases: vectors null, of another length, or with a null, NaN or infinite component
    take no part; repeated rows and repeated ids are vectors of their own; a null id takes part
    and stays null; with fewer than ``k`` vectors there are as many centroids as vectors; equal
    distances go to the smaller number; an empty table gives empty tables; other columns are
    not carried. Components beyond ``MOST / SCALE`` raise an error, for their squared distances
    would not fit the result.
    """
    spark = vectors.sparkSession
    with small_batches(spark):
        rows = stage(integers(vectors, id_col, vec_col, dimensions))
        centroids = first_centroids(rows, k)
        for _ in range(rounds if len(centroids) else 0):
            centroids = moved(rows, centroids)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in filter(len, batches):  # without vectors there are no centroids
                which, distance = nearest(_matrix(batch["v"], dimensions), centroids)
                yield pd.DataFrame({"id": batch["id"], "cluster": which.astype(np.int32), "distance": distance})

        assigned = stage(rows.mapInPandas(assign, "id long, cluster int, distance long"))
    counted = {r["cluster"]: r for r in assigned.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("distance").alias("inertia")).collect()}
    listed = [(i, [int(x) for x in c], *((counted[i]["size"], counted[i]["inertia"]) if i in counted else (0, 0))) for i, c in enumerate(centroids)]
    clusters = spark.createDataFrame(listed, "cluster int, centroid array<long>, size long, inertia long")
    name = id_col if id_col.lower() not in ("cluster", "distance") else fresh(assigned, id_col)
    return assigned.withColumnRenamed("id", name), clusters


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, clusters = centroid_clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    found = clusters.collect()  # CENTROIDS rows
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    total = sum(r["inertia"] for r in found)
    schema = StructType([StructField("cluster", IntegerType()), StructField("cluster_inertia", LongType()), StructField("inertia", LongType()), StructField("centroid_sha256", StringType())])
    named = spark.createDataFrame([(r["cluster"], r["inertia"], total, digest(r["centroid"])) for r in found], schema)
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """Rounds as common table expressions, each vector met with each centroid by component."""
    steps = [
        f"""
vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
parts AS (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM vectors),
chosen AS (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM vectors
  QUALIFY c < {CENTROIDS}),
c0 AS (SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS j FROM chosen)"""
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""
d{i} AS MATERIALIZED (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM parts JOIN c{i} USING (j) GROUP BY r, c),
a{i} AS MATERIALIZED (SELECT r, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        )
        if i < ROUNDS:
            # an integer quotient rounds to zero, so the floor of a negative one is corrected
            steps.append(
                f"""
m{i} AS (SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN parts USING (r) GROUP BY c, j),
c{i + 1} AS MATERIALIZED (
  SELECT c, j, CASE WHEN n IS NULL THEN y ELSE s // n - CAST(s < 0 AND s % n <> 0 AS BIGINT) END AS y FROM c{i} LEFT JOIN m{i} USING (c, j))"""
            )
    last = ROUNDS
    return (
        "WITH "
        + ",".join(steps)
        + f""",
named AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{last} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{last} JOIN vectors USING (r) JOIN named USING (c)
"""
    )


ORACLE = _oracle()
