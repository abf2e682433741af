"""Centroid clustering with heap-ordered bounds.

Vectors lie in blocks of bounded size, one row each, that never move: a round is one pass over the blocks. A block keeps a heap per cluster. Its entries are
gaps: how much farther a vector's second centroid is than its own, plus the drift that the cluster had gathered when the gap was measured. Each round adds
to a cluster's drift how far its own centroid has moved and the farthest that another has, which is the most that a gap can have shrunk. Only vectors
whose entry is not above the drift are popped and compared with all centroids again; the others can't have another nearest centroid, and
aren't looked at. Blocks report sums of the vectors that have changed cluster, so the driver sees a row per cluster and round. Distances are exact whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.shared import Steps, arrow_map

BLOCK = 4096
SCALE = 256
#: Whole components stop here, so that every squared distance of 64 components fits a long.
LARGEST = 1 << 26
#: Gaps are taken smaller and drifts larger by this share, far more than their rounding errors.
MARGIN = 1e-9
STATE = "ids array<{kind}>, vectors binary, cluster binary, sizes binary, gaps binary, members binary, popped long, moves array<struct<cluster:int,sums:array<bigint>>>"


def whole_components(vector: Column) -> Column:
    """floor(256 * x) of every component as a double, within LARGEST."""
    scaled = lambda x: F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    return F.transform(vector, lambda x: F.floor(scaled(x)).cast("int"))


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has `dims` components, none null or not finite."""
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids; in doubles where every sum stays below 2^53, which is where they are whole."""
    reach = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * reach * reach * vectors.shape[1] < 1 << 53 else np.int64
    v, c = vectors.astype(kind), centroids.astype(kind)
    return ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


class Heaps:
    """The heaps of one block: an entry is (gap plus drift, row of the block)."""

    def __init__(self, clusters: int) -> None:
        self.of: list[list[tuple[float, int]]] = [[] for _ in range(clusters)]

    @classmethod
    def load(cls, sizes: bytes, gaps: bytes, members: bytes) -> Heaps:
        sizes, gaps, members = np.frombuffer(sizes, np.int32), np.frombuffer(gaps, np.float64).tolist(), np.frombuffer(members, np.int32).tolist()
        out, at = cls(len(sizes)), 0
        for c, n in enumerate(sizes.tolist()):
            out.of[c] = list(zip(gaps[at : at + n], members[at : at + n], strict=True))  # kept in heap order
            at += n
        return out

    def save(self) -> tuple[bytes, bytes, bytes]:
        flat = [entry for heap in self.of for entry in heap]
        return np.array([len(h) for h in self.of], np.int32).tobytes(), np.array([g for g, _ in flat], np.float64).tobytes(), np.array([m for _, m in flat], np.int32).tobytes()

    def pop_expired(self, drift: np.ndarray) -> np.ndarray:
        """Rows whose gap may have closed."""
        out = []
        for heap, limit in zip(self.of, drift.tolist(), strict=True):
            while heap and heap[0][0] <= limit:
                out.append(heappop(heap)[1])
        return np.array(sorted(out), np.int64)

    def push(self, rows: np.ndarray, clusters: np.ndarray, entries: np.ndarray) -> None:
        for row, cluster, entry in zip(rows.tolist(), clusters.tolist(), entries.tolist(), strict=True):
            heappush(self.of[cluster], (entry, row))


def rescan(vectors: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number) and heap entry of each vector."""
    squares = squared_distances(vectors, centroids)
    nearest = squares.argmin(axis=1)
    rows = np.arange(len(vectors))
    near = np.sqrt(squares[rows, nearest].astype(np.float64))
    squares[rows, nearest] = np.iinfo(np.int64).max
    second = np.sqrt(squares.min(axis=1).astype(np.float64)) if len(centroids) > 1 else np.full(len(vectors), np.inf)
    gap = np.where(np.isinf(second), np.inf, second - near - MARGIN * (second + near))
    return nearest, gap + drift[nearest]


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Most that the gap of a vector of each cluster shrinks when centroids move from `old` to `new`."""
    moved = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1)) * (1 + MARGIN)
    if len(moved) == 1:
        return moved
    top = np.argsort(moved)[-2:]
    others = np.where(np.arange(len(moved)) == top[1], moved[top[0]], moved[top[1]])
    return (moved + others) * (1 + MARGIN)


def _matrix(vectors: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(vectors, np.int32).reshape(-1, dims).astype(np.int64)


def _row(ids: pa.Array, vectors: bytes, cluster: np.ndarray, heaps: Heaps, popped: int, moves: list[dict]) -> dict:
    sizes, gaps, members = heaps.save()
    return {"ids": ids, "vectors": vectors, "cluster": cluster.astype(np.int32).tobytes(), "sizes": sizes, "gaps": gaps, "members": members, "popped": popped, "moves": moves}


def _moves(vectors: np.ndarray, before: np.ndarray, after: np.ndarray, clusters: int) -> list[dict]:
    """Number and sum of the vectors that each cluster has gained, less those it has lost; `before` is -1 for vectors that had none."""
    change = np.zeros((clusters, vectors.shape[1] + 1), np.int64)
    counted = np.concatenate([np.ones((len(vectors), 1), np.int64), vectors], axis=1)
    moved = before != after
    np.add.at(change, after[moved], counted[moved])
    left = moved & (before >= 0)
    np.subtract.at(change, before[left], counted[left])
    return [{"cluster": c, "sums": change[c].tolist()} for c in range(clusters) if change[c].any()]


def _first_blocks(rows: DataFrame, kind: str, dims: int, clusters: int, block: int) -> DataFrame:
    """Rows (id, vector) as blocks whose vectors have no cluster yet: all of them are popped in the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                schema = schema or pa.schema([("ids", pa.list_(part.schema.field("id").type))] + SCHEMA_REST)
                vectors = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                heaps = Heaps(clusters)
                heaps.of[0] = [(-np.inf, k) for k in range(part.num_rows)]
                heapify(heaps.of[0])
                out = _row(part.column("id").to_pylist(), vectors.tobytes(), np.full(part.num_rows, -1), heaps, 0, [])
                yield pa.RecordBatch.from_pylist([out], schema=schema)

    return arrow_map(rows, run, STATE.format(kind=kind))


SCHEMA_REST = [
    ("vectors", pa.binary()), ("cluster", pa.binary()), ("sizes", pa.binary()), ("gaps", pa.binary()), ("members", pa.binary()), ("popped", pa.int64()),
    ("moves", pa.list_(pa.struct([("cluster", pa.int32()), ("sums", pa.list_(pa.int64()))]))),
]


def _assigned(state: DataFrame, kind: str, dims: int, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """One round: pops what has expired, compares it with all centroids, and puts it back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                old = {c: batch.column(c)[k].as_py() for c in ("vectors", "cluster", "sizes", "gaps", "members")}
                vectors, cluster = _matrix(old["vectors"], dims), np.frombuffer(old["cluster"], np.int32).astype(np.int64)
                heaps = Heaps.load(old["sizes"], old["gaps"], old["members"])
                rows = heaps.pop_expired(drift)
                nearest, entries = rescan(vectors[rows], centroids, drift)
                heaps.push(rows, nearest, entries)
                after = cluster.copy()
                after[rows] = nearest
                out = _row(batch.column("ids")[k].as_py(), old["vectors"], after, heaps, len(rows), _moves(vectors, cluster, after, len(centroids)))
                yield pa.RecordBatch.from_pylist([out], schema=pa.schema([("ids", batch.schema.field("ids").type)] + SCHEMA_REST))

    return arrow_map(state, run, STATE.format(kind=kind))


def _members(state: DataFrame, kind: str, dims: int, centroids: np.ndarray) -> DataFrame:
    """id, cluster and exact squared distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                vectors = _matrix(batch.column("vectors")[k].as_py(), dims)
                cluster = np.frombuffer(batch.column("cluster")[k].as_py(), np.int32)
                apart = vectors - centroids[cluster]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, pa.array(cluster), pa.array((apart * apart).sum(axis=1))], ["id", "cluster", "distance"])

    return arrow_map(state.select("ids", "vectors", "cluster"), run, f"id {kind}, cluster int, distance long")


def cluster_vectors(
    table: DataFrame, clusters: int, rounds: int, id_column: str = "vec_id", vector_column: str = "embedding", dims: int = 64, seed: str = "2:", block: int = BLOCK,
) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Clusters the usable vectors of `table`: a table (id, cluster, distance), the final centroids, and how many vectors each round has compared with all centroids.

    Vectors without exactly `dims` components, or with one that is null or not finite, are left out. Components become floor(256 * x), held within 2^26 so that distances
    fit a long. The first centroids are the vectors with the smallest sha256 of `seed` and their id (a null id counts as empty text; ties: by their components), as many as there
    are where the table has fewer. Each round assigns every vector to its nearest centroid (ties: smaller number) and moves every centroid that has vectors to their componentwise floor of the
    mean; then all are assigned once more. Repeated rows stay repeated, a null id stays null, further columns are neither read nor returned, an empty table gives no rows.
    """
    spark, steps = table.sparkSession, Steps(table.sparkSession, "centroids")
    kind = table.schema[id_column].dataType.simpleString()
    rows = table.where(usable(F.col(vector_column), dims)).select(F.col(id_column).alias("id"), whole_components(F.col(vector_column)).alias("vector"))
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select("vector", key.alias("key")).orderBy("key", "vector").limit(clusters).collect()  # `clusters` rows
    if not first:
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long").withColumnRenamed("id", id_column), np.zeros((0, dims), np.int64), []
    centroids = np.array([r.vector for r in first], np.int64)
    total = np.zeros((len(centroids), dims + 1), object)  # whole numbers of any size
    drift, popped = np.zeros(len(centroids)), []
    state = steps.write("state-0", _first_blocks(rows, kind, dims, len(centroids), block))
    for r in range(rounds + 1):
        state = steps.write(f"state-{r + 1}", _assigned(state, kind, dims, centroids, drift))
        steps.drop(f"state-{r}")
        popped.append(state.agg(F.sum("popped")).head()[0])
        if r < rounds:
            changes = state.select(F.inline("moves")).groupBy("cluster").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(dims + 1)])
            for c, *sums in changes.collect():  # a row per cluster at most
                total[c] += np.array(sums, object)
            moved = centroids.copy()
            for c in np.flatnonzero(total[:, 0] > 0):
                moved[c] = [s // total[c, 0] for s in total[c, 1:]]
            drift = (drift + drifts(centroids, moved)) * (1 + MARGIN)
            centroids = moved
    return _members(state, kind, dims, centroids).withColumnRenamed("id", id_column), centroids, popped


def cluster_report(members: DataFrame, centroids: np.ndarray, id_column: str = "vec_id") -> DataFrame:
    """id, cluster, distance, cluster_inertia and inertia (summed distances; null beyond a long), centroid_sha256."""
    spark = members.sparkSession
    found = members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row per cluster
    sums = {r.cluster: int(r.s) for r in found}
    fits = lambda n: n if n < 1 << 63 else None
    every = sum(sums.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = spark.createDataFrame([(c, fits(s), fits(every), names[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(table), "cluster").select(id_column, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
