"""Centroid clustering by delta Lloyd, in whole numbers throughout.

Two tables are kept in the shared folder: the vectors with owner and squared distance, and the sums of
each cluster's vectors. When centroids have moved, a vector whose own centroid stayed is compared
with the moved ones only, as it was nearest to its own among those that stayed; a vector whose centroid
moved is compared with all. Vectors that change their cluster give signed transfers (minus their
components to the old cluster, plus them to the new one), summed inside each task first: a task gives a
row for each cluster and component. The sums follow from the old ones and the transfers, so
no round adds up all vectors again. If no centroid moves, the rounds end early with the same result.

The driver holds centroids and sums: clusters x dimensions numbers, whatever the input. Nothing is
shuffled but transfers, so neither a hot cluster nor copies of one vector fill a task.

Defined cases: vectors of another length, without a value, or with null, NaN or infinite components have no
result; components are limited to plus or minus 2 ** 26 after scaling, so that distances fit a long (sums
of distances end at the largest long); repeated rows are separate vectors, and as seeds come in the order
of their components; a null vec_id is a seed only if others are too few; of fewer vectors than clusters
each is a centroid; an empty table gives an empty result; only vec_id and embedding are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import discard, materialise, small_batches, trimmed

DIMENSIONS, CLUSTERS, ROUNDS = 64, 16, 3
#: Components are floor(SCALE * x); seeds come in the order of sha256("SEED:vec_id").
SCALE, SEED = 64, 1
#: Largest component, so that a distance of 64 components fits a long.
LIMIT = 1 << 26
LONGEST = (1 << 63) - 1
STATE = "vec_id long, q array<int>, owner int, was int, distance long"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the components in whole numbers, of the vectors that count."""
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(e, lambda x: F.least(F.greatest(F.floor(x.cast("double") * float(scale)), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    return vectors.where((F.size(e) == dimensions) & sound).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("q"))


def seeds(whole: DataFrame, clusters: int, seed: int = SEED) -> np.ndarray:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = whole.select(digest.alias("h"), "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(clusters).collect()
    return np.array([r.q for r in rows], np.int64)


def squared(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact: by a product of floats where all sums stay below 2 ** 53."""
    most = max((int(np.abs(x).max()) for x in (q, centroids) if x.size), default=0)
    if 4 * q.shape[1] * most * most < 1 << 53:
        f, g = q.astype(np.float64), centroids.astype(np.float64)
        return ((f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)).astype(np.int64)
    return np.stack([((q - c) ** 2).sum(1) for c in centroids], 1)


def reassigned(q: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances once the ``moved`` centroids have moved. Ties go to the smaller number."""
    owner, distance = owner.copy(), distance.copy()
    lost = moved[owner] | (owner < 0)
    if lost.any():
        all_of = squared(q[lost], centroids)
        owner[lost], distance[lost] = all_of.argmin(1), all_of.min(1)
    numbers, stayed = np.flatnonzero(moved), np.flatnonzero(~lost)
    if len(numbers) and len(stayed):
        near = squared(q[stayed], centroids[numbers])
        number, least = numbers[near.argmin(1)], near.min(1)
        better = (least < distance[stayed]) | ((least == distance[stayed]) & (number < owner[stayed]))
        owner[stayed[better]], distance[stayed[better]] = number[better], least[better]
    return owner, distance


def _components(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def assign(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    """``state`` with new owners and distances; ``was`` is the owner before. An owner of -1 is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            was = b.column(2).to_numpy()
            owner, distance = reassigned(_components(b.column(1), centroids.shape[1]), was.astype(np.int64), b.column(4).to_numpy(), centroids, moved)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(owner, pa.int32()), b.column(2), pa.array(distance, pa.int64())], names=["vec_id", "q", "owner", "was", "distance"])

    return state.mapInArrow(trimmed(run), STATE)


def transfers(state: DataFrame, clusters: int, dimensions: int) -> DataFrame:
    """cluster, part (a component; after the last one the number of vectors) and total: what the vectors that
    changed their cluster add and take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((clusters, dimensions + 1), np.int64)
        for b in batches:
            q = np.concatenate([_components(b.column(0), dimensions), np.ones((b.num_rows, 1), np.int64)], axis=1)
            owner, was = b.column(1).to_numpy(), b.column(2).to_numpy()
            np.add.at(sums, owner, q)
            np.subtract.at(sums, was[was >= 0], q[was >= 0])
        cluster, part = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(part, pa.int32()), pa.array(sums[cluster, part])], names=["cluster", "part", "total"])

    gone = state.where("owner <> was").select("q", "owner", "was")
    return gone.mapInArrow(trimmed(run), "cluster int, part int, total long")


def means(sums: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The componentwise floors of the clusters' means; of an empty cluster the centroid it has."""
    table = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
    for r in sums.collect():  # clusters x dimensions rows
        table[r.cluster, r.part] = r.total
    n = table[:, -1:]
    return np.where(n > 0, table[:, :-1] // np.maximum(n, 1), centroids)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """The last state (vec_id, q, owner, was, distance) and the centroids."""
    spark = vectors.sparkSession
    small_batches(spark)
    whole = whole_vectors(vectors, dimensions)
    centroids = seeds(whole, clusters)
    if not len(centroids):
        return spark.createDataFrame([], STATE), centroids
    none = whole.select("vec_id", "q", F.lit(-1).alias("owner"), F.lit(-1).alias("was"), F.lit(0).cast("long").alias("distance"))
    state = materialise(assign(none, centroids, np.ones(len(centroids), bool)), "assignments")
    sums = None
    for _ in range(rounds):
        moves = transfers(state, len(centroids), dimensions)
        both = moves if sums is None else sums.unionByName(moves)
        before, sums = sums, materialise(both.groupBy("cluster", "part").agg(F.sum("total").alias("total")), "sums")
        new = means(sums, centroids)
        moved, centroids = (new != centroids).any(axis=1), new
        if not moved.any():
            break
        old, state = state, materialise(assign(state, centroids, moved), "assignments")
        for df in (old, before):
            if df is not None:
                discard(df)
    if sums is not None:
        discard(sums)
    return state, centroids


def cluster_report(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that counts."""
    spark = vectors.sparkSession
    state, centroids = cluster(vectors, clusters, rounds, dimensions)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    inertia = {r.owner: int(r.total) for r in state.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("total")).collect()}  # a row a cluster
    total = min(sum(inertia.values()), LONGEST)
    told = [(i, min(x, LONGEST), total, hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, x in inertia.items()]
    told = spark.createDataFrame(told, "owner int, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = state.join(F.broadcast(told), "owner")  # as many rows as clusters
    return rows.select("vec_id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(i: int) -> str:
    """Assignment i, and the centroids after it."""
    return f"""
a{i} AS (SELECT rid, vec_id, q, (arg_min(n, (d, n)))::INTEGER AS cluster, min(d) AS distance FROM (
  SELECT v.*, c.n, list_sum(list_transform(list_zip(v.q, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i} c) GROUP BY rid, vec_id, q),
c{i + 1} AS (SELECT c.n, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (SELECT cluster, list(((s - ((s % k) + k) % k) // k)::BIGINT ORDER BY j) AS c FROM (
  SELECT cluster, j, sum(x)::BIGINT AS s, count(*) AS k FROM (SELECT cluster, unnest(q) AS x, unnest(range(0, {DIMENSIONS})) AS j FROM a{i}) GROUP BY cluster, j) GROUP BY cluster) m ON m.cluster = c.n)"""


#: Every round over all vectors, with no deltas.
CLUSTER_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1)::INTEGER AS n, q AS c FROM v QUALIFY n < {CLUSTERS}),
{",".join(_round_sql(i) for i in range(ROUNDS + 1))}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
sha256(array_to_string(c{ROUNDS}.c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.n = cluster
"""
