"""K-means over (id, v ARRAY<DOUBLE>); centroids are a small broadcast table (cluster, c)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _checked(k: int) -> int:
    if not 1 <= k <= 10_000:
        raise ValueError("between 1 and 10,000 clusters: the centroids are broadcast")
    return k


def first_centroids(vectors: DataFrame, k: int) -> DataFrame:
    """V4: the k vectors with the smallest ids."""
    w = Window.orderBy("id")  # over k rows
    return vectors.orderBy("id").limit(_checked(k)).select((F.row_number().over(w) - 1).alias("cluster"), F.col("v").alias("c"))


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """V5: vectors with the cluster of the nearest centroid by squared distance (9 digits), the lowest of ties. The centroids are
    one broadcast row, so vectors aren't shuffled."""
    table = centroids.agg(F.array_sort(F.collect_list(F.struct("cluster", "c"))).alias("_c"))
    d = lambda c: F.round(F.aggregate(F.zip_with("v", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x), 9)
    near = F.array_min(F.transform("_c", lambda x: F.struct(d(x["c"]).alias("d"), x["cluster"].alias("cluster"))))
    return vectors.crossJoin(F.broadcast(table)).select(*vectors.columns, near["cluster"].alias("cluster"))


def k_means(vectors: DataFrame, k: int, iterations: int = 50) -> DataFrame:
    """V4: id, cluster. Centroids come to the driver (k rows) each round; an empty cluster gets the vector it began with. It ends
    when no centroid moves."""
    spark = vectors.sparkSession
    first = {r.cluster: r.c for r in first_centroids(vectors, k).collect()}
    if len(first) < k:
        raise ValueError("more clusters than vectors")
    centres, dim = dict(first), len(first[0])
    for _ in range(iterations):
        placed = assign(vectors, spark.createDataFrame(sorted(centres.items()), "cluster int, c array<double>"))
        means = placed.groupBy("cluster").agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(dim)]).alias("c")).collect()
        new = first | {r.cluster: r.c for r in means}
        same = all(max(abs(a - b) for a, b in zip(new[i], centres[i])) < 1e-9 for i in centres)
        centres = new
        if same:
            break
    return assign(vectors, spark.createDataFrame(sorted(centres.items()), "cluster int, c array<double>")).select("id", "cluster")


def centroids(assigned: DataFrame, dim: int) -> DataFrame:
    """V5: cluster, c, n of vectors (v, cluster)."""
    return assigned.groupBy("cluster").agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(dim)]).alias("c"), F.count(F.lit(1)).alias("n"))


def cosine(a: Column, b: Column) -> Column:
    """L3 re-export: cosine of two arrays; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def euclidean(a: Column, b: Column) -> Column:
    """L3 re-export."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, v: acc + v))
