"""Benchmark decontamination with suffix arrays over the training texts.

Every piece of the training table is one shard. A shard's suffix array holds the word positions from which a benchmark
text could be matched, sorted by the words that follow; each benchmark suffix is looked up in it by binary search, which gives all places where
its words stand verbatim. Places that follow each other are joined to longest matches. The benchmark is bounded per pass:
a larger one is cut into blocks, and the passes follow each other inside one stage, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.shared import arrow_map
from creditloom.llm.words import ALNUM, lower, pieces, row_sums, span_hashes, text_bytes, word_bounds

WINDOW = 13
BLOCK_BYTES = 16 << 20
#: Windows of matches that are joined at a time; a text with more is joined by itself.
JOINED = 1 << 20


def _keys(codes: np.ndarray, at: np.ndarray, ahead: np.ndarray, width: int) -> np.ndarray:
    """The `width` codes from each position on, as one sortable byte string; codes past the run of known words are 0."""
    padded = np.concatenate([codes, np.zeros(width, codes.dtype)])
    out = np.zeros((len(at), width), dtype=">u4")
    for k in range(width):
        out[:, k] = np.where(ahead > k, padded[at + k], 0)
    return out.view(f"S{4 * width}").ravel()


def _ahead(known: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Known words from each position on, within its row."""
    n = len(known)
    stops = np.where(known, n, np.arange(n))
    ends = np.repeat(bounds[1:], np.diff(bounds))
    return np.minimum(np.minimum.accumulate(stops[::-1])[::-1], ends) - np.arange(n) if n else np.zeros(0, np.int64)


class Suffixes:
    """Words and suffixes of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.window = window
        self.items = [i for i, _ in items]
        data, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
        data = lower(data)
        starts, ends, bounds = word_bounds(data, offsets, ALNUM)
        hashes = span_hashes(data, starts, ends)
        self.vocabulary = np.unique(hashes)
        codes = np.searchsorted(self.vocabulary, hashes).astype(np.int64) + 1
        sizes = np.diff(bounds)
        row = np.repeat(np.arange(len(items)), sizes)
        left = np.repeat(bounds[1:], sizes) - np.arange(len(codes))
        keys = _keys(codes, np.arange(len(codes)), left, window)
        full = left >= window
        short = np.flatnonzero((np.repeat(sizes, sizes) < window) & (np.arange(len(codes)) == np.repeat(bounds[:-1], sizes)))
        self.tests, sample, which = np.unique(keys[full], return_index=True, return_inverse=True)
        self.test_firsts = codes[full][sample]
        # Places of each distinct test suffix: item and word position.
        order = np.argsort(which, kind="stable")
        self.place_row = row[full][order]
        self.place_at = (np.arange(len(codes)) - bounds[row])[full][order]
        self.place_bounds = np.searchsorted(which[order], np.arange(len(self.tests) + 1))
        # Items shorter than a window: all their words are one window.
        self.short_row = row[short]
        self.short_size = sizes[self.short_row]
        self.short_low = keys[short]
        self.short_firsts = np.unique(codes[short])

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def find(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All places of test suffixes in a shard: word position, length, and either the test's number or, for short items, the item's (else -1)."""
        codes = self.codes(hashes)
        ahead = _ahead(codes > 0, bounds)
        wanted = ahead >= self.window
        if len(self.short_row):
            wanted |= np.isin(codes, self.short_firsts) & (ahead >= self.short_size.min())
        at = np.flatnonzero(wanted)
        keys = _keys(codes, at, ahead[at], self.window)
        order = np.argsort(keys, kind="stable")
        suffixes, at = keys[order], at[order]
        # A test whose first word begins no suffix of the shard need not be looked up.
        begins = np.zeros(len(self.vocabulary) + 1, dtype=bool)
        begins[codes[at]] = True
        asked = np.flatnonzero(begins[self.test_firsts])
        low, high = np.searchsorted(suffixes, self.tests[asked]), np.searchsorted(suffixes, self.tests[asked], side="right")
        places, tests = [at[_ranges(low, high)]], [np.repeat(asked, high - low)]
        sizes, items = [np.full(len(places[0]), self.window)], [np.full(len(places[0]), -1)]
        for row, size, key in zip(self.short_row, self.short_size, self.short_low, strict=True):
            head = key.ljust(4 * self.window, b"\0")[: 4 * size]
            first = np.searchsorted(suffixes, head)
            last = np.searchsorted(suffixes, head + b"\xff" * (4 * (self.window - size)), side="right")
            places.append(at[first:last])
            sizes.append(np.full(last - first, size))
            tests.append(np.full(last - first, -1))
            items.append(np.full(last - first, row))
        return np.concatenate(places), np.concatenate(sizes), np.concatenate(tests), np.concatenate(items)

    def matches(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Longest verbatim matches as arrays: row, item, word position in the row, word position in the item, words.

        They come in groups of whole rows whose windows number at most JOINED, places in the benchmark counted each, or of one row.
        """
        places, sizes, tests, items = self.find(hashes, bounds)
        rows = np.searchsorted(bounds, places, side="right") - 1
        order = np.argsort(rows, kind="stable")
        places, sizes, tests, items, rows = (x[order] for x in (places, sizes, tests, items, rows))
        long = items < 0
        opened = np.ones(len(rows), np.int64)
        opened[long] = self.place_bounds[tests[long] + 1] - self.place_bounds[tests[long]]
        edges = np.append(np.flatnonzero(np.diff(rows, prepend=-1)), len(rows))
        upto = np.concatenate([[0], np.cumsum(opened)])[edges]
        k = 0
        while k < len(edges) - 1:
            end = max(k + 1, int(np.searchsorted(upto, upto[k] + JOINED, side="right")) - 1)
            part = slice(edges[k], edges[end])
            yield self._joined(places[part], sizes[part], tests[part], items[part], rows[part], bounds)
            k = end

    def _joined(self, places: np.ndarray, sizes: np.ndarray, tests: np.ndarray, items: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        long = items < 0
        low, high = self.place_bounds[tests[long]], self.place_bounds[tests[long] + 1]
        spots = _ranges(low, high)
        item = np.concatenate([self.place_row[spots], items[~long]])
        there = np.concatenate([self.place_at[spots], np.zeros((~long).sum(), np.int64)])
        row = np.concatenate([np.repeat(rows[long], high - low), rows[~long]])
        here = np.concatenate([np.repeat(places[long], high - low), places[~long]]) - bounds[row]
        size = np.concatenate([np.repeat(sizes[long], high - low), sizes[~long]])
        order = np.lexsort((here, here - there, item, row))
        row, item, here, there, size = (x[order] for x in (row, item, here, there, size))
        # A match goes on where the next place stands one word further in both texts.
        opens = np.ones(len(row), dtype=bool)
        opens[1:] = ~((np.diff(row) == 0) & (np.diff(item) == 0) & (np.diff(here) == 1) & (np.diff(there) == 1))
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(row)) - 1
        return row[first], item[first], here[first], there[first], here[last] + size[last] - here[first]


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    sizes = high - low
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes) if total else np.zeros(0, np.int64)


def _shard(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(part.column("text"))
    data = lower(data)
    starts, ends, bounds = word_bounds(data, offsets, ALNUM)
    return span_hashes(data, starts, ends), bounds


def benchmark_blocks(spark: SparkSession, benchmark: DataFrame, window: int, item_column: str, text_column: str, block_bytes: int) -> list:
    """Broadcasts of the benchmark's suffixes, each over items of about `block_bytes` bytes of text (a longer item is a block by itself)."""
    rows = benchmark.where(F.col(item_column).isNotNull()).select(F.col(item_column).cast("string").alias("item"), F.col(text_column).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(1, -(-total // block_bytes))
    found = []
    for k in range(n):
        mine = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        found.append(spark.sparkContext.broadcast(Suffixes(sorted((r.item, r.text or "") for r in mine.toLocalIterator()), window)))
    return found


def _scan(docs: DataFrame, row: Column, benchmark: DataFrame, window: int, share: int, text_column: str, item_column: str, item_text_column: str, block_bytes: int) -> DataFrame:
    """`row` beside the findings in each text of `docs`; one map per block of the benchmark, no shuffle."""
    blocks = benchmark_blocks(docs.sparkSession, benchmark, window, item_column, item_text_column, block_bytes)

    def look_up(block, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = block.value
            for part in pieces(batches):
                hashes, bounds = _shard(part)
                edges = np.zeros(len(hashes) + 1, np.int64)
                longest = part.column("longest").to_numpy(zero_copy_only=False).copy()
                pairs: set[tuple[int, int]] = set()
                for at, item, here, _, size in test.matches(hashes, bounds):
                    np.add.at(edges, bounds[at] + here, 1)
                    np.add.at(edges, bounds[at] + here + size, -1)
                    np.maximum.at(longest, at, size)
                    pairs.update(zip(at.tolist(), item.tolist(), strict=True))
                for r, spans in enumerate(part.column("covered").to_pylist()):  # word spans found by earlier blocks
                    for a, b in zip(spans[::2], spans[1::2], strict=True):
                        edges[bounds[r] + a] += 1
                        edges[bounds[r] + b] -= 1
                covered = np.cumsum(edges[:-1]) > 0
                names: list[set[str]] = [set(x) for x in part.column("items").to_pylist()]
                for r, i in pairs:
                    names[r].add(test.items[i])
                lists = pa.array([sorted(x) for x in names], pa.list_(pa.string()))
                if last:
                    words, hit = np.diff(bounds), row_sums(covered.astype(np.int64), bounds)
                    sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names]
                    columns = [part.column("row"), pa.array(words), pa.array(hit), pa.array([len(x) for x in names], pa.int64()), pa.array(sha, pa.string()),
                               pa.array((hit > 0) & (share * hit >= words)), pa.array(longest), lists]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "items"])
                else:
                    rows = [covered[bounds[r] : bounds[r + 1]] for r in range(part.num_rows)]
                    spans = [np.flatnonzero(np.diff(np.concatenate([[False], x, [False]]).astype(np.int8))).tolist() for x in rows]
                    columns = [part.column("row"), part.column("text"), pa.array(spans, pa.list_(pa.int64())), pa.array(longest), lists]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "text", "covered", "longest", "items"])

        return run

    rows = docs.select(row.alias("row"), F.col(text_column).alias("text"), F.array().cast("array<long>").alias("covered"), F.lit(0).cast("long").alias("longest"), F.array().cast("array<string>").alias("items"))
    kind = T.StructType([rows.schema["row"]])
    for block in blocks[:-1]:
        rows = arrow_map(rows, look_up(block, False), rows.schema)
    found = [("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean"), ("longest", "long")]
    for name, of in found:
        kind = kind.add(name, of)
    return arrow_map(rows, look_up(blocks[-1], True), kind.add("items", T.ArrayType(T.StringType())))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_hit (words inside an occurrence of a benchmark window), n_items, items_sha256, contaminated
    (n_hit > 0 and share * n_hit >= n_words), longest, the words of its longest verbatim match (0: none), and items, the sorted ids of the items found.
    All of them come from the longest matches of the suffixes.

    A window is `window` consecutive words of an item; an item with fewer words is one window. Null and empty texts have no words and are
    clean; items without words or with a null id find nothing; repeated items count once; repeated documents stay repeated; a null id is kept;
    further columns are neither read nor returned; an empty benchmark leaves every document clean. Texts of any length are read whole.
    """
    found = _scan(docs, F.struct(F.col(id_column).alias("id")), benchmark, window, share, text_column, item_column, item_text_column, block_bytes)
    return found.select(F.col("row.id").alias(id_column), "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "items")


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of `docs` that find_contamination calls clean, with all their columns. Each row is judged by itself, whatever its id."""
    found = _scan(docs, F.struct(*[docs[c] for c in docs.columns]), benchmark, window, share, text_column, item_column, item_text_column, block_bytes)
    return found.where(~F.col("contaminated")).select("row.*")


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per longest verbatim match of at least a window: id, item, doc_start and item_start (word positions from 0), n_words.

    Rows of `docs` and `benchmark` are treated as in find_contamination; a document without a match has no row.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    found = None
    for block in benchmark_blocks(docs.sparkSession, benchmark, window, item_column, item_text_column, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            test = block.value
            for part in pieces(batches):
                for at, item, *numbers in test.matches(*_shard(part)):
                    columns = [part.column("id").take(pa.array(at)), pa.array([test.items[i] for i in item], pa.string()), *[pa.array(x, pa.int64()) for x in numbers]]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "item", "doc_start", "item_start", "n_words"])

        part = arrow_map(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), run, f"id {kind}, item string, doc_start long, item_start long, n_words long")
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("id", id_column)
