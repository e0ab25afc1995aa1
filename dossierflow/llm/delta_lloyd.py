"""Centroid clustering (operator 13): Lloyd's rounds that only work on what has changed.

The vectors are a table with the cluster of each and its distance. A round replaces it by the next one:

* A vector whose own centroid stayed is compared with the changed centroids alone; its old distance stands for the rest,
  which were no nearer before and have not moved. A vector whose own centroid changed is compared with all.
* Vectors that change owner are transfers: each takes its components from one cluster and adds them to another. Tasks add
  the signed integers up by cluster and dimension, an aggregation merges them, and the sums of all clusters, kept from
  round to round, take clusters x (dimensions + 1) integers on the driver whatever the number of vectors.

All numbers are integers, so the clusters equal those of plain rounds. A round in which no centroid changed is not run.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are dropped. Components
beyond +-LARGEST count as +-LARGEST. Rows with one id are vectors of their own, in order of their components where both
are among the first; rows without an id come last in that order. With fewer vectors than clusters each is a centroid; of
equal centroids the first owns all. Other columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.llm.durable import cut, drop
from dossierflow.session import read_table

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Components (after scaling) of greater size count as this, so that squared distances fit in a long.
LARGEST = 1 << 27
#: Vectors worked on at a time.
ROWS = 4096
_STATE = "vec_id long, x binary, was int, cluster int, distance long"


def kept(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id and x, the scaled components as little-endian 32-bit integers."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            x = np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype("<i4").reshape(-1, dimensions)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in x], pa.binary())], ["vec_id", "x"])

    return whole.where(F.col("v").isNotNull() & (F.size("v") == dimensions) & finite).mapInArrow(run, "vec_id long, x binary")


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dimensions).astype(np.int64)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact: by a matrix product where doubles hold all integers that occur."""
    most = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if x.shape[1] * 4 * float(most) ** 2 < 2.0**52:
        a, b = x.astype(float), centroids.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _round(centroids: np.ndarray, changed: np.ndarray):
    """Assigns vectors anew. `changed` flags centroids that differ from those of the vectors' present distances."""
    far = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x = _matrix(part.column(1), centroids.shape[1])
                owner, distance = (part.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
                table = np.full((len(x), len(centroids)), far)
                if changed.any():
                    table[:, changed] = _distances(x, centroids[changed])
                moved = changed[owner] | (owner < 0)
                stayed = np.flatnonzero(~moved)
                table[stayed, owner[stayed]] = distance[stayed]
                if moved.any() and not changed.all():
                    rest = np.flatnonzero(~changed)
                    table[np.ix_(np.flatnonzero(moved), rest)] = _distances(x[moved], centroids[rest])
                nearest = table.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), pa.array(nearest.astype(np.int32)), pa.array(table[np.arange(len(x)), nearest])],
                    ["vec_id", "x", "was", "cluster", "distance"],
                )

    return run


def _transfers(clusters: int, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((clusters, dimensions + 1), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dimensions)
            x = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
            was, now = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            np.subtract.at(total, was[was >= 0], x[was >= 0])
            np.add.at(total, now, x)
        cluster, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[cluster, place])], ["cluster", "place", "moved"])

    return run


def lloyd(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 after `rounds` rounds and a last assignment."""
    spark = vectors.sparkSession
    state = kept(vectors, dimensions).select("vec_id", "x", F.lit(-1).alias("was"), F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    state = cut(state, "lloyd-vectors")
    first = state.select("x", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"))
    chosen = first.orderBy(F.col("h").asc_nulls_last(), "x").limit(clusters).collect()
    centroids = np.array([np.frombuffer(r.x, "<i4") for r in chosen], np.int64).reshape(-1, dimensions)
    changed = np.ones(len(centroids), bool)
    sums = [[0] * (dimensions + 1) for _ in centroids]
    for k in range(rounds + 1):
        if not changed.any():
            break
        after = cut(state.mapInArrow(_round(centroids, changed), _STATE), f"lloyd-{k}")
        drop(state)
        state = after
        if k == rounds:
            break
        moved = state.where("was <> cluster").select("x", "was", "cluster").mapInArrow(_transfers(len(centroids), dimensions), "cluster int, place int, moved long")
        for r in moved.groupBy("cluster", "place").agg(F.sum("moved").alias("moved")).collect():
            sums[r.cluster][r.place] += r.moved
        following = np.array([[s // own[-1] for s in own[:-1]] if own[-1] else c for own, c in zip(sums, centroids.tolist(), strict=True)], np.int64).reshape(centroids.shape)
        changed = (following != centroids).any(axis=1)
        centroids = following
    inertia = {r.cluster: r.d for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    named = [(c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in sorted(inertia)]
    # One row a cluster.
    digest = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(digest), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd(read_table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Plain rounds: all vectors against all centroids each time."""
    parts = [
        "kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64)",
        "numbers AS (SELECT vec_id, i, floor(64 * embedding[i]::DOUBLE)::BIGINT AS x FROM kept, range(1, 65) AS r(i))",
        "seeds AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cl FROM kept QUALIFY cl < 16)",
        "c0 AS (SELECT cl, i, x FROM seeds JOIN numbers USING (vec_id))",
    ]
    for k in range(ROUNDS + 1):
        parts.append(f"d{k} AS (SELECT vec_id, cl, sum((n.x - c.x) * (n.x - c.x)) AS d FROM numbers n JOIN c{k} c USING (i) GROUP BY ALL)")
        parts.append(f"a{k} AS MATERIALIZED (SELECT vec_id, min(d * 16 + cl) % 16 AS cl, min(d * 16 + cl) // 16 AS d FROM d{k} GROUP BY vec_id)")
        if k < ROUNDS:
            parts.append(f"s{k} AS (SELECT cl, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{k} JOIN numbers USING (vec_id) GROUP BY ALL)")
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT cl, i, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM c{k} LEFT JOIN s{k} USING (cl, i))")
    parts.append(f"digests AS (SELECT cl, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cl)")
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, cl::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY cl))::BIGINT AS cluster_inertia,"
        f" (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{ROUNDS} JOIN digests USING (cl)"
    )


ORACLE = _sql()
