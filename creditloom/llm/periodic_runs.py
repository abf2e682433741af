"""Periodic runs of words, found with a run-length grammar made by recompression.

The words of a piece of texts form one sequence. Rounds of block compression (a stretch of equal symbols becomes one symbol with its count) and pair
compression (symbols are dealt to a left and a right side; a left symbol followed by a right one becomes one symbol) shrink it until
each text is a few symbols. Equal stretches of words get equal symbols but for a few at their edges, so the longest common extension of two
places is read off the levels: up while both places begin a symbol, down where symbols differ. A run of period q and at least 4q words holds
3q places in a row whose word stands again q words on, so one of the places 0, 3q, 6q, ... of its text is among them: that harmonic grid
gives the candidates, and the extensions to both sides give each run's exact ends. Symbols are numbered by their parts, not hashed, so nothing is left to chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.shared import arrow_map
from creditloom.llm.words import mix, pieces

MIN_LENGTH = 6
MIN_REPEATS = 4
#: Symbols of a text at which compression stops, and candidates that are looked at together.
FEW = 4
CANDIDATES = 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Grammar:
    """Levels of a run-length grammar over `symbols`; the numbers below `marks` stand once each and are never compressed."""

    def __init__(self, symbols: np.ndarray, marks: int) -> None:
        self.marks, self.next = marks, int(symbols.max(initial=0)) + 1
        self.symbols, self.parent, self.first, self.blocks = [symbols], [], [], []
        step = 0
        while np.diff(np.flatnonzero(self.symbols[-1] < marks)).max(initial=0) > FEW + 1:
            below = self.symbols[-1]
            heads = self._block_heads(below) if step % 2 == 0 else self._pair_heads(below, step)
            step += 1
            if not heads.all():
                self._add(below, heads, blocks=step % 2 == 1)

    @staticmethod
    def _block_heads(below: np.ndarray) -> np.ndarray:
        return np.concatenate([[True], below[1:] != below[:-1]])

    def _pair_heads(self, below: np.ndarray, step: int) -> np.ndarray:
        left = (mix(below.astype(np.uint64) + np.uint64(step << 40)) & np.uint64(1)).astype(bool)
        free = below >= self.marks
        joined = left[:-1] & ~left[1:] & free[:-1] & free[1:]
        return np.concatenate([[True], ~joined])

    def _add(self, below: np.ndarray, heads: np.ndarray, blocks: bool) -> None:
        first = np.append(np.flatnonzero(heads), len(below))
        size = np.diff(first)
        above = below[first[:-1]].copy()
        many = np.flatnonzero(size > 1)
        second = size[many] if blocks else below[first[many] + 1]
        code, distinct = pd.factorize((above[many] << 32) | second)
        above[many] = self.next + code
        self.next += len(distinct)
        self.symbols.append(above)
        self.first.append(first)
        self.parent.append(np.cumsum(heads) - 1)
        self.blocks.append(blocks)

    def _shared(self, level: int, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        """How many symbols equal places can pass at once: all that is left of the shorter block, or one."""
        if level == len(self.first) or not self.blocks[level]:
            return np.ones(len(a), np.int64)
        first, parent = self.first[level], self.parent[level]
        left = [k - first[parent[k]] + 1 if back else first[parent[k] + 1] - k for k in (a, b)]
        return np.minimum(*left)

    def _edge(self, level: int, k: np.ndarray, back: bool) -> np.ndarray:
        first, up = self.first[level], self.parent[level][k]
        return first[up + 1] - 1 == k if back else first[up] == k

    def extend(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from `i` on and from `j` on agree; with `back`, how many words before `i` and before `j`. Both lie in one text, i < j."""
        at, sign = ([i - 1, j - 1], -1) if back else ([i.copy(), j.copy()], 1)
        a, b = at
        top = len(self.first)
        fell = np.zeros(len(i), np.int64)
        rising = np.arange(len(i))
        for level in range(top + 1):
            symbols, up, here = self.symbols[level], [], rising
            while len(here):
                same = symbols[a[here]] == symbols[b[here]]
                fell[here[~same]] = level
                here = here[same]
                if level < top and len(here):
                    edge = self._edge(level, a[here], back) & self._edge(level, b[here], back)
                    up.append(here[edge])
                    here = here[~edge]
                step = sign * self._shared(level, a[here], b[here], back)
                a[here] += step
                b[here] += step
            rising = np.concatenate(up) if up else np.zeros(0, np.int64)
            a[rising], b[rising] = (self.parent[level][x[rising]] for x in (a, b)) if level < top else (a[rising], b[rising])
        for level in range(top - 1, -1, -1):
            here, symbols, first = np.flatnonzero(fell > level), self.symbols[level], self.first[level]
            for x in (a, b):
                x[here] = first[x[here] + 1] - 1 if back else first[x[here]]
            while len(here):
                here = here[symbols[a[here]] == symbols[b[here]]]
                step = sign * self._shared(level, a[here], b[here], back)
                a[here] += step
                b[here] += step
        return (i - 1 - a) if back else a - i


def grid(sizes: np.ndarray, begins: np.ndarray, limit: int = CANDIDATES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods of the harmonic grid of each text, some `limit` at a time; a text of `sizes` words begins at `begins`."""
    most = np.where(sizes >= MIN_LENGTH, sizes // MIN_REPEATS, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = (MIN_REPEATS - 1) * period
    upto = np.cumsum((sizes[text] - period - 1) // step + 1)
    done = 0
    while done < len(text):
        before = upto[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(upto, before + limit, side="right")))
        counts = np.diff(upto[done:stop], prepend=before)
        nth = np.arange(upto[stop - 1] - before) - np.repeat(upto[done:stop] - counts - before, counts)
        yield np.repeat(begins[text[done:stop]], counts) + nth * np.repeat(step[done:stop], counts), np.repeat(period[done:stop], counts)
        done = stop


def runs_of(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start (word of the text), length and period of every run, by text, start and period. `codes`: word numbers of all texts, `sizes` words each."""
    marks = len(sizes) + 1
    begins = np.cumsum(sizes + 1) - sizes
    sequence = np.zeros(int(sizes.sum()) + marks, np.int64)
    is_word = np.ones(len(sequence), bool)
    is_word[np.append(begins - 1, len(sequence) - 1)] = False
    sequence[is_word] = codes + marks
    sequence[~is_word] = np.arange(marks)
    grammar = Grammar(sequence, marks)
    found = [np.zeros((3, 0), np.int64)]
    for i, q in grid(sizes, begins):
        again = sequence[i] == sequence[i + q]
        i, q = i[again], q[again]
        after, before = grammar.extend(i, i + q), grammar.extend(i, i + q, back=True)
        length = before + after + q
        long = length >= np.maximum(MIN_LENGTH, MIN_REPEATS * q)
        found.append(np.unique(np.stack([i - before, length, q])[:, long], axis=1))
    # A run is found under multiples of its period too, with the same ends: its smallest period stays.
    start, length, period = np.unique(np.concatenate(found, axis=1), axis=1)
    smallest = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])])[: len(start)]
    start, length, period = start[smallest], length[smallest], period[smallest]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    text = np.searchsorted(begins, start, side="right") - 1
    return text, start - begins[text], length, period


def repeated_from(words: list[bytes], number: int) -> list[bytes]:
    """The words with all from place number % n on replaced by repeats of the first few of them."""
    n = len(words)
    a = number % n
    p = 1 + (n - a) // (3 + number % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def find_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", repeat_column: Column | None = None) -> DataFrame:
    """One row per row of `docs`: id, n_words, runs (start, length and period in words, by start, then period) and collapsed, the words that are kept.

    A run is a stretch of at least MIN_LENGTH words and MIN_REPEATS times its smallest period that no neighbouring word extends. `collapsed` drops each word that
    any run holds after its first period, the rest joined by one blank. Words are what blanks and the controls 9 to 13 leave. Null, empty and blank texts have no
    words, no runs and an empty `collapsed`. Repeated rows stay repeated, a null id is kept, further columns are neither read nor returned. Texts are taken whole:
    memory grows with the longest one. `repeat_column` is for trials: where it holds a number, the words are first made periodic (repeated_from).
    """
    kind = docs.schema[id_column].dataType.simpleString()
    number = F.lit(None) if repeat_column is None else repeat_column

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            texts = [(t or "").encode().split() for t in part.column("text").to_pylist()]
            texts = [repeated_from(w, g) if g is not None and w else w for w, g in zip(texts, part.column("number").to_pylist(), strict=True)]
            sizes = np.array([len(w) for w in texts], np.int64)
            words = pa.array([x for w in texts for x in w], pa.large_binary()).dictionary_encode()
            codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            text, start, length, period = runs_of(codes, sizes)
            bounds = np.searchsorted(text, np.arange(len(texts) + 1))
            collapsed = []
            for r, w in enumerate(texts):
                lo, hi = bounds[r], bounds[r + 1]
                if hi > lo:
                    depth = np.zeros(len(w) + 1, np.int64)
                    np.add.at(depth, start[lo:hi] + period[lo:hi], 1)
                    np.add.at(depth, start[lo:hi] + length[lo:hi], -1)
                    w = [w[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
                collapsed.append(b" ".join(w))
            runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
            columns = [part.column("id"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), number.cast("long").alias("number"))
    found = arrow_map(rows, run, f"id {kind}, n_words long, runs {RUNS}, collapsed string")
    return found.withColumnRenamed("id", id_column)


def run_digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, n_runs, the run with the greatest length/period (ties: smallest start, then period) and hashes of the runs and of the kept words."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # Runs come by start and period, so only a truly greater ratio takes the place.
    best = F.aggregate("runs", none, lambda top, r: F.when(top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    top = found.select(id_column, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exact = F.expr("(1000 * best.length) div best.period")
    return top.select(id_column, "n_runs", "best.start", "best.length", "best.period", exact.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
