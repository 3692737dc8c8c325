"""Clusters around centroids, by JVM expressions only: whole-number distances to literal centroids, column sums for new ones."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.llm._shared import quoted, written

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: A scaled component beyond this counts as this (squares of 64 differences then fit into a long).
WIDEST = 1 << 27


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (longs: floor(scale * x)) and square (the sum of squares) of the vectors with exactly `dimensions` components, all finite."""
    x = quoted(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    scaled = F.transform(x, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-float(WIDEST))), F.lit(float(WIDEST)))))
    kept = vectors.filter((F.size(x) == dimensions) & finite).select(quoted(id_col).alias("vec_id"), scaled.alias("v"))
    return kept.withColumn("square", F.aggregate("v", F.lit(0).cast("long"), lambda n, c: n + c * c))


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the least SHA-256 of `seed:vec_id`, in that order; equal ids go by their components."""
    drawn = kept.select(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return [list(r["v"]) for r in drawn.orderBy("h", "v").limit(clusters).collect()]  # `clusters` rows


def nearest(centroids: list[list[int]]) -> Column:
    """distance (squared Euclidean) and cluster of the nearest of these centroids; the smaller number of equally near ones.

    |v - c|^2 = |v|^2 - 2 v c + |c|^2, in whole numbers: one zip_with and one aggregate for each centroid.
    """

    def away(c: list[int]) -> str:
        product = f"aggregate(zip_with(v, array({', '.join(f'{x}L' for x in c)}), (a, b) -> a * b), 0L, (n, p) -> n + p)"
        return f"square - 2L * {product} + {sum(x * x for x in c)}L"

    # as text: a call for each of the numbers would take the driver longer than the work on small tables
    return F.expr(f"array_min(array({', '.join(f'struct({away(c)} AS distance, {k} AS cluster)' for k, c in enumerate(centroids))}))")


def moved(kept: DataFrame, centroids: list[list[int]], dimensions: int = DIMENSIONS) -> list[list[int]]:
    """Each centroid as the floor of its vectors' mean; one without vectors stays.

    The sums are columns of one hash aggregate, combined before the shuffle: at most one row a cluster leaves a task, and
    the driver gets one row a cluster."""
    each = kept.select(nearest(centroids)["cluster"].alias("cluster"), *(F.col("v")[i].alias(f"x{i}") for i in range(dimensions)))
    sums = each.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"x{i}") for i in range(dimensions)))
    out = [list(c) for c in centroids]
    for r in sums.collect():
        out[r["cluster"]] = [r[f"x{i}"] // r["n"] for i in range(dimensions)]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector of whole_vectors, after `rounds` moves.

    Vectors that are null, of another length, or with a null or non-finite component are left out; fewer vectors than
    clusters make fewer clusters, and none no rows. Repeated rows each count and are each told; a null id is a vector
    like others. Components beyond WIDEST / scale count as that; an inertia beyond a long is null. Other columns are
    not looked at. Only centroids and their sums (clusters x dimensions numbers) pass through the driver.
    """
    kept = written(whole_vectors(vectors, id_col, vector_col, dimensions, scale), "vectors")
    centroids = first_centroids(kept, clusters, seed)
    if not centroids:
        kinds = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return kept.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in kinds.items()))
    for _ in range(rounds):
        centroids = moved(kept, centroids, dimensions)
    found = written(kept.select("vec_id", nearest(centroids).alias("to")).select("vec_id", "to.cluster", "to.distance"), "clusters")
    inertia = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.try_sum("distance").alias("n")).collect()}
    total = None if None in inertia.values() else sum(inertia.values())
    total = None if total is not None and total >= 1 << 63 else total
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def told(values: dict, kind: str) -> Column:
        return reduce(lambda w, k: w.when(F.col("cluster") == k, F.lit(values.get(k)).cast(kind)), range(1, len(centroids)), F.when(F.col("cluster") == 0, F.lit(values.get(0)).cast(kind)))

    return found.select("vec_id", "cluster", "distance", told(inertia, "long").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), told(dict(enumerate(digests)), "string").alias("centroid_sha256"))
