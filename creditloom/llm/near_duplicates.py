"""Near-duplicate groups: MinHash bands, sequential Bayesian verification of signatures, exact check of the survivors.

Texts with the same shingle set are folded to one node first. Nodes meet where all hashes of a band agree. A bucket is first
compared with its leader only, then each block of its members with itself, which joins groups of copies in linear work. What is left are
buckets that still hold more than one component: there, members outside the largest one are compared with all of other components, in blocks of bounded size,
and every pair of components puts forward its best pairs; their number grows each round until no surviving pair is untested, so no link is
lost and no bucket is expanded into its pairs. Signatures are compared a batch of hashes at a time; a pair is dropped once the posterior chance that its similarity
reaches the threshold is below the chosen miss probability. Survivors are confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.shared import Steps, arrow_map
from creditloom.llm.words import NOT_BLANK, lower, mix, pieces, run_hashes, span_hashes, text_bytes, word_bounds

SHINGLE = 5
PERCENT = 75
HASHES = 128
BAND = 4
#: Hashes in all, for the nodes that meet another one; 16 bits are kept of those beyond HASHES.
MARK_HASHES = 512
BATCHES = (32, 64, 128, 256, 512)
MISS = 1e-5
BLOCK = 256
#: Best partners of a member in each round that compares blocks with themselves; then best pairs of two components, and how that number grows.
LINEAR_PARTNERS = (1, 2)
WHOLE_PAIRS = 512
MORE_PAIRS = 8


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """Ascending distinct 64-bit shingle hashes of each text; texts with fewer words have one shingle, those without words none."""
    data, offsets = text_bytes(column)
    data = lower(data)
    starts, ends, bounds = word_bounds(data, offsets, NOT_BLANK)
    words = span_hashes(data, starts, ends)
    hashes, at = run_hashes(words, bounds, width)
    out = []
    for r in range(len(column)):
        n = bounds[r + 1] - bounds[r]
        if n >= width:
            out.append(np.unique(hashes[at[r] : at[r + 1]]))
        elif n:
            short = run_hashes(words[bounds[r] : bounds[r + 1]], np.array([0, n]), int(n))[0]
            out.append(mix(short + np.uint64(n)))  # a short text never equals a shingle of a longer one
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@lru_cache(maxsize=4)
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of `n` hash functions; a longer family begins with the shorter one."""
    draw = np.random.RandomState(20240607).randint(0, 1 << 32, (n, 2), dtype=np.uint64).astype(np.uint32)
    return draw[:, 0] | np.uint32(1), draw[:, 1]


def signature(shingles: np.ndarray, n: int = HASHES, chunk: int = 1024) -> np.ndarray:
    """Smallest value of each of `n` hash functions over a set that is not empty."""
    factor, shift = _family(n)
    out = np.full(n, np.uint32(0xFFFFFFFF))
    high, low = (shingles >> np.uint64(32)).astype(np.uint32), shingles.astype(np.uint32)
    for at in range(0, len(shingles), chunk):
        values = (low[at : at + chunk, None] ^ shift) * factor
        values ^= high[at : at + chunk, None]
        values *= factor
        np.minimum(out, values.min(axis=0), out=out)
    return out


def keep_from(n: int, percent: int, miss: float) -> int:
    """Fewest equal hashes of `n` with which a pair is kept: with a uniform prior, the posterior chance that the similarity is at least
    percent/100 is P(Binomial(n + 1, percent/100) <= equal)."""
    t, upto = percent / 100, 0.0
    for equal in range(n + 1):
        upto += comb(n + 1, equal) * t**equal * (1 - t) ** (n + 1 - equal)
        if upto >= miss:
            return equal
    return n


def may_link(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can share percent/100 of their union: at most the smaller one is shared, at least the larger one is the union."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


class Marks:
    """Signatures of many nodes: the first HASHES values in 32 bits, the others in 16."""

    def __init__(self, column: pa.Array) -> None:
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), HASHES + MARK_HASHES)
        self.first = np.ascontiguousarray(raw[:, : 2 * HASHES]).view(np.uint32)
        self.rest = raw[:, 2 * HASHES :]

    @staticmethod
    def of(values: np.ndarray) -> bytes:
        return values[:HASHES].tobytes() + values[HASHES:].astype(np.uint16).tobytes()

    def equal(self, mine: np.ndarray, other: "Marks", theirs: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Equal values of hashes `start` to `stop` of row pairs."""
        if stop <= HASHES:
            return (self.first[mine, start:stop] == other.first[theirs, start:stop]).sum(axis=1)
        return (self.rest[mine, start - HASHES : stop - HASHES] == other.rest[theirs, start - HASHES : stop - HASHES]).sum(axis=1)


def alike(left: Marks, i: np.ndarray, right: Marks, j: np.ndarray, percent: int = PERCENT, miss: float = MISS) -> np.ndarray:
    """Equal hashes of each row pair (i, j), -1 for pairs that a batch has dropped."""
    equal = np.zeros(len(i), np.int64)
    alive = np.arange(len(i))
    done = 0
    for upto in BATCHES:
        equal[alive] += left.equal(i[alive], right, j[alive], done, upto)
        kept = equal[alive] >= keep_from(upto, percent, miss)
        equal[alive[~kept]] = -1
        alive, done = alive[kept], upto
    return equal


def best_partners(
    left: Marks, right: Marks, sizes: tuple[np.ndarray, np.ndarray], of_left: np.ndarray, of_right: np.ndarray, band: int, most: int, same: bool, percent: int, miss: float, by_components: bool,
) -> tuple[np.ndarray, np.ndarray, bool]:
    """Surviving pairs of two blocks whose components differ and whose first common band is `band`, at most the `most` best per member, or per pair of components; and whether there are more."""
    first = BATCHES[0]
    need = keep_from(first, percent, miss)
    n, m = len(of_left), len(of_right)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, n, 64):
        equal = (left.first[a : a + 64, None, :first] == right.first[None, :, :first]).sum(axis=2)
        open_pair = (equal >= need) & (of_left[a : a + 64, None] != of_right[None, :])
        if same:
            open_pair &= np.arange(a, min(a + 64, n))[:, None] < np.arange(m)[None, :]
        i, j = np.nonzero(open_pair)
        i += a
        may = may_link(sizes[0][i], sizes[1][j], percent)
        i, j = i[may], j[may]
        # Two nodes may meet in many bands; the pair belongs to the first.
        shared = (left.first[i] == right.first[j]).reshape(len(i), HASHES // BAND, BAND).all(axis=2)
        own = shared.argmax(axis=1) == band
        i, j = i[own], j[own]
        score = alike(left, i, right, j, percent, miss)
        found.append((i[score >= 0], j[score >= 0], score[score >= 0]))
    i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
    chosen = np.zeros(len(i), bool)
    if not len(i):
        return i, j, False
    if by_components:
        roots = np.sort(np.stack([of_left[i], of_right[j]]), axis=0)
        sides = [np.unique(roots, axis=1, return_inverse=True)[1].ravel()]
    else:
        sides = [np.concatenate([i, j])] if same else [i, j]
    for side in sides:
        pair = np.arange(len(side)) % len(i)
        order = np.lexsort((pair, -score[pair], side))
        ranked = side[order]
        place = np.arange(len(order)) - np.searchsorted(ranked, ranked)
        chosen[pair[order[place < most]]] = True
    return i[chosen], j[chosen], bool((~chosen).any())


def sketch(docs: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """id, text_key, n_shingles, digest of the shingle set and its signature (both null without words)."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            sets = shingle_sets(part.column("text"), width)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            signatures = [signature(s).tobytes() if len(s) else None for s in sets]
            columns = [part.column("id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_key", "n_shingles", "digest", "signature"])

    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_key"), F.col(text_column).alias("text"))
    return arrow_map(rows, run, f"id {kind}, text_key long, n_shingles long, digest binary, signature binary")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), HASHES)


def _bands(nodes: DataFrame) -> DataFrame:
    """One row per node and band: the band's number and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = _signatures(batch.column("signature")).reshape(batch.num_rows, -1, BAND).astype(np.uint64)
                key = np.tile(np.arange(parts.shape[1], dtype=np.uint64), (batch.num_rows, 1))
                for k in range(BAND):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C55) + parts[:, :, k])
                band = np.tile(np.arange(parts.shape[1], dtype=np.int32), batch.num_rows)
                columns = [pa.array(key.ravel().view(np.int64)), pa.array(band), pa.array(np.repeat(batch.column("node").to_numpy(), parts.shape[1]))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "band", "node"])

    return arrow_map(nodes.select("node", "signature"), run, "key long, band int, node long")


def _marked(texts: DataFrame, width: int) -> DataFrame:
    """node, marks, size: the long signature of each text and the size of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            sets = shingle_sets(part.column("text"), width)
            columns = [part.column("node"), pa.array([Marks.of(signature(s, MARK_HASHES)) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "marks", "size"])

    return arrow_map(texts.select("node", "text"), run, "node long, marks binary, size long")


def _pruned(pairs: DataFrame, marks: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b) whose signatures survive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                every = np.arange(batch.num_rows)
                kept = alike(Marks(batch.column("sa")), every, Marks(batch.column("sb")), every, percent, miss) >= 0
                kept &= may_link(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
                yield batch.select(["a", "b"]).filter(pa.array(kept))

    sa, sb = (marks.select(F.col("node").alias(x), F.col("marks").alias(f"s{x}"), F.col("size").alias(f"n{x}")) for x in "ab")
    return arrow_map(pairs.join(sb, "b").join(sa, "a").select("a", "b", "sa", "sb", "na", "nb"), run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint64))  # rows come by a, so a leader's set is made once
        for part in pieces(batches, "tb"):
            kept = []
            for a, b, ta in zip(part.column("a").to_pylist(), shingle_sets(part.column("tb"), width), part.column("ta"), strict=True):
                if held[0] != a:
                    held = (a, shingle_sets(pa.array([ta.as_py()], pa.string()), width)[0])
                both = len(np.intersect1d(held[1], b, assume_unique=True))
                kept.append(100 * both >= percent * (len(held[1]) + len(b) - both))
            yield part.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    ta, tb = (texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    return arrow_map(pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb"), run, "a long, b long").distinct()


def components(steps: Steps, name: str, links: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node of `links` (a, b), by alternating large and small stars."""

    def both_ways(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        # (a, b): b is a neighbour of a; small stars look at smaller neighbours only.
        near = both_ways(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = near.join(least, "a")
        if large:
            moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return moved.where("a != b")

    links, k = links.where("a != b"), 0
    while True:
        written = steps.write(f"{name}-{k}", star(star(links, True), False).distinct())
        if k:
            steps.drop(f"{name}-{k - 1}")
        # Done when every node has one root and no root has a root of its own.
        ends = written.select(F.col("a").alias("v"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
            written.select(F.col("b").alias("v"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if ends.groupBy("v").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 OR below = 1 AND above = 1").isEmpty():
            break
        links, k = written, k + 1
    return written.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _cells(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, each in the cells where it is compared: (key, kind, i, j).

    The largest component of a bucket is linked already, so its members are compared with the others only. Both sides are dealt into blocks of about BLOCK members:
    kind 0 cells compare two blocks of the others (i = j: one with itself), kind 1 cells block i of the others with block j of the largest component. A bucket of one block is one cell.
    """
    by_root = members.groupBy("key", "root").agg(F.count("*").alias("c"))
    mixed = by_root.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("n_main"), F.sum("c").alias("n")).where("n > n_main")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    shapes = mixed.select("key", "main", "n", blocks(F.col("n_main")).alias("blocks_main"), blocks(F.col("n") - F.col("n_main")).alias("blocks_other"))
    mine = members.join(shapes, "key").withColumn("is_main", F.col("root") == F.col("main"))
    own = F.when(F.col("is_main"), F.col("blocks_main")).otherwise(F.col("blocks_other"))
    mine = mine.withColumn("block", F.when(F.col("n") <= BLOCK, 0).otherwise(F.pmod(F.xxhash64("node", "key"), own).cast("int")))

    def cell(kind: int, i: F.Column, j: F.Column) -> F.Column:
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))

    others, mains = F.sequence(F.lit(0), F.col("blocks_other") - 1), F.sequence(F.lit(0), F.col("blocks_main") - 1)
    across = F.transform(others, lambda o: cell(0, F.least("block", o), F.greatest("block", o)))
    to_main = F.transform(mains, lambda m: cell(1, F.col("block"), m))
    from_main = F.transform(others, lambda o: cell(1, o, F.col("block")))
    cells = F.when(F.col("n") <= BLOCK, F.array(cell(0, F.lit(0), F.lit(0)))).when(F.col("is_main"), from_main).otherwise(F.concat(across, to_main))
    return mine.select("key", "band", "node", "root", "block", "is_main", F.inline(cells))


def _blocks(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, each in one cell: a block of the bucket, compared with itself."""
    mixed = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low != high")
    block = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / BLOCK).cast("int")).cast("int")
    mine = members.join(mixed.select("key", "n"), "key").withColumn("block", block)
    return mine.select("key", "band", "node", "root", "block", F.lit(False).alias("is_main"), F.lit(0).alias("kind"), F.col("block").alias("i"), F.col("block").alias("j"))


def _untested(cells: DataFrame, marks: DataFrame, most: int, percent: int, miss: float, by_components: bool) -> DataFrame:
    """(a, b, key, more): pairs put forward in the cells of _cells or _blocks, their bucket, and whether their cell has held back others."""
    spread = cells.join(marks, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
            node, root, block = (t.column(c).to_numpy() for c in ("node", "root", "block"))
            main = t.column("is_main").to_numpy()
            i, j, band, kind = (t.column(c)[0].as_py() for c in ("i", "j", "band", "kind"))
            sides = (~main, main) if kind else (block == i, block == j)
            left, right = (np.flatnonzero(x) for x in sides)
            if not len(left) or not len(right):
                return
            all_marks = t.column("marks").combine_chunks()
            mine, theirs = (Marks(all_marks.take(pa.array(x))) for x in (left, right))
            size = t.column("size").to_numpy()
            a, b, more = best_partners(mine, theirs, (size[left], size[right]), root[left], root[right], band, most, not kind and i == j, percent, miss, by_components)
            a, b = node[left[a]], node[right[b]]
            key = np.full(len(a), t.column("key")[0].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(key, pa.int64()), pa.array(np.full(len(a), more))], ["a", "b", "key", "more"])

        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*rest, batch])
            group = np.stack([t.column(c).to_numpy() for c in ("key", "kind", "i", "j")])
            cuts = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
            edges = [0, *cuts.tolist()]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                yield from compare(t.slice(x, y - x))
            rest = t.slice(edges[-1]).combine_chunks().to_batches()
        if rest:
            yield from compare(pa.Table.from_batches(rest))

    grouped = spread.repartition("key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j")
    return arrow_map(grouped, run, "a long, b long, key long, more boolean")


def group_near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = SHINGLE, percent: int = PERCENT, miss: float = MISS,
) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (smallest id that links reach, its own included) and kept (id = component_id).

    Texts are linked if their shingle sets share percent/100 of their union. Null, empty and blank texts have no shingle and no link. Repeated
    rows stay repeated and share their id's component; rows of one id with different texts are one node of the graph. A row without an id has
    no component and is kept. Further columns are neither read nor returned. Bands miss a pair at the threshold with a chance of
    about (1 - 0.75^4)^32 = 5e-6; `miss` adds at most that much per pair.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "near-duplicates")
    sketches = steps.write("sketches", sketch(docs, id_column, text_column, width))
    folded = sketches.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("id", "text_key", "signature")).alias("f"))
    nodes = steps.write("nodes", folded.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("f.id").alias("id"), F.col("f.text_key").alias("text_key"), F.col("f.signature").alias("signature")))
    rows = steps.write("rows", sketches.select("id", "n_shingles", "digest").join(nodes.select("digest", "node"), "digest", "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("node")).alias("node")))
    steps.drop("sketches")

    bands = _bands(nodes)
    leaders = bands.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    members = steps.write("members", bands.join(leaders, "key"))
    needed = members.select("node").distinct().join(nodes.select("node", "id", "text_key"), "node")
    plain = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_key"), F.col(text_column).alias("text"))
    texts = steps.write("texts", plain.join(needed, ["id", "text_key"]).select("node", "text"))

    # One id with several texts: its nodes belong together.
    several = rows.where("node IS NOT NULL").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z").select("id", "a")
    links = steps.write("links-0", rows.join(several, "id").select("a", F.col("node").alias("b")).where("a != b").distinct())
    marks = steps.write("marks", _marked(texts, width))
    pairs = steps.write("pairs-0", members.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    links = links.unionByName(steps.write("links-1", _confirmed(_pruned(pairs, marks, percent, miss), texts, width, percent)))
    roots = components(steps, "roots-1", links)
    others = members.where("node != leader").select("key", "band", "node")
    # Two rounds compare each block of a bucket with itself, linear work, after which most of a bucket of copies is one component. Then whole buckets: once no cell
    # has held back a surviving pair of two components, every pair that may be a link has been confirmed or lies within one component. A cell that holds nothing back
    # has put forward all it ever can, so a bucket whose cells all did is done; one of several blocks is first compared as a whole, though.
    # Members that are no copies are components of their own; so that each pair of them is put forward in one round only, whole buckets are limited per pair of components.
    k, left = 1, others
    while True:
        whole = k > len(LINEAR_PARTNERS)
        most = WHOLE_PAIRS * MORE_PAIRS ** (k - len(LINEAR_PARTNERS) - 1) if whole else LINEAR_PARTNERS[k - 1]
        rooted = left.join(roots, "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("root"))
        put = steps.write(f"put-{k}", _untested(_cells(rooted) if whole else _blocks(rooted), marks, most, percent, miss, whole))
        fresh = steps.write(f"pairs-{k}", put.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"))
        if not fresh.isEmpty():
            pairs = pairs.unionByName(fresh)
            found = steps.write(f"links-{k + 1}", _confirmed(fresh, texts, width, percent))
            if not found.isEmpty():
                links = links.unionByName(found)
                roots = components(steps, f"roots-{k + 1}", roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
        undone = put.where("more").select("key").distinct()
        if whole and undone.isEmpty():
            break
        if k == len(LINEAR_PARTNERS):
            undone = undone.unionByName(others.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key")).distinct()
        left = others.join(undone, "key", "left_semi")
        k += 1

    rooted = rows.join(roots, "node", "left").select("id", "n_shingles", F.coalesce("root", "node").alias("root"))
    smallest = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component"), F.count("*").alias("size")).where("size > 1").select("root", "component")
    out = rooted.join(smallest, "root", "left").withColumn("component", F.coalesce("component", "id"))
    out = steps.write("out", out.select("id", "n_shingles", "component", F.col("id").eqNullSafe(F.col("component")).alias("kept")))
    steps.drop("members", "nodes", "texts", "marks", "rows")
    return out.select(F.col("id").alias(id_column), "n_shingles", F.col("component").alias("component_id"), "kept")


def keep_representatives(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of `docs` with one of each group of near-duplicates, all columns: the one with the smallest id, null ids last.

    Rows are grouped and kept by a written number of their own, not by id: of repeated rows one stays, of several texts under one id each is judged by
    itself, and rows without an id are grouped like others. Rows without a word are linked with nothing and all stay. An empty table gives no rows.
    """
    steps = Steps(docs.sparkSession, "representatives")
    rows, key = steps.keyed("rows", docs)
    groups = group_near_duplicates(rows, key, text_column, **options).select(F.col(key).alias("__row"), F.col("component_id").alias("__group"))
    of_several = groups.groupBy("__group").agg(F.count("*").alias("n")).where("n > 1").select("__group")
    members = groups.join(of_several, "__group").join(rows.select(F.col(key).alias("__row"), F.col(id_column).alias("__id")), "__row")
    first = members.groupBy("__group").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__row"))["__row"].alias("__first"))
    gone = members.join(first, "__group").where("__row <> __first").select("__row")
    return rows.join(gone, rows[key] == gone["__row"], "left_anti").select(*[rows[c] for c in docs.columns])
