"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens; the distinct pre-tokens of a batch that were not seen yet lie one behind the other in one
array of symbols. Each round finds every sequence's lowest-rank pair and merges all its places at once, in all sequences
together; the symbols that survive are the tokens. Counts of short pre-tokens are kept per worker process, up to a fixed number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.shared import arrow_map
from creditloom.llm.words import pieces

# The pre-token pattern of the byte-level vocabulary, with white space named by its Unicode property.
PRE_TOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
KEPT_PRE_TOKENS = 200_000
KEPT_LENGTH = 48
NEVER = np.iinfo(np.int64).max


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: visible Latin-1 ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Merges:
    """Merge table of one vocabulary file (`tokenizers` JSON)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        vocab = content["model"]["vocab"]
        pairs = [tuple(p) if isinstance(p, list) else tuple(p.split(" ")) for p in content["model"]["merges"]]
        self.special = [t["content"] for t in content["added_tokens"]]
        self.width = 1 + max(vocab.values())
        self.first = np.array([vocab[s] for _, s in sorted(byte_symbols().items())], dtype=np.int64)
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.seen: dict[str, int] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def surviving(self, sequences: list[bytes]) -> np.ndarray:
        """Number of symbols that each byte sequence is merged to."""
        lengths = np.array([len(s) for s in sequences], dtype=np.int64)
        out = lengths.copy()
        symbols = self.first[np.frombuffer(b"".join(sequences), dtype=np.uint8)]
        rows = np.flatnonzero(lengths > 0)
        lengths = lengths[rows]
        while len(rows):
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            rank = np.full(len(symbols), NEVER)
            rank[:-1] = self.rank_of(symbols[:-1], symbols[1:])
            rank[starts + lengths - 1] = NEVER  # a row's last symbol has no right neighbour
            lowest = np.minimum.reduceat(rank, starts)
            chosen = np.flatnonzero((rank == np.repeat(lowest, lengths)) & (rank != NEVER))
            # Of equal pairs that overlap (a a a), every second one from the left is merged.
            opens = np.ones(len(chosen), dtype=bool)
            opens[1:] = np.diff(chosen) != 1
            run_start = np.maximum.accumulate(np.where(opens, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - run_start) % 2 == 0]
            symbols[chosen] = self.made[rank[chosen]]
            stays = np.ones(len(symbols), dtype=bool)
            stays[chosen + 1] = False
            open_rows = lowest != NEVER
            out[rows[~open_rows]] = lengths[~open_rows]
            stays &= np.repeat(open_rows, lengths)
            lengths = (lengths - np.bincount(np.searchsorted(starts, chosen, side="right") - 1, minlength=len(rows)))[open_rows]
            symbols, rows = symbols[stays], rows[open_rows]
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        if len(self.seen) > KEPT_PRE_TOKENS:
            self.seen.clear()
        parts: list[list[str]] = []
        added: list[int] = []
        for text in texts:
            segments = [text or ""]
            for mark in self.special:
                segments = [s for x in segments for s in x.split(mark)]
            added.append(len(segments) - 1)
            parts.append([t for s in segments for t in PRE_TOKEN.findall(s)] if len(segments) > 1 else PRE_TOKEN.findall(segments[0]))
        distinct: set[str] = set()
        for p in parts:
            distinct.update(p)
        fresh = [t for t in distinct if t not in self.seen]
        counts = dict(zip(fresh, self.surviving([t.encode("utf-8") for t in fresh]).tolist(), strict=True))
        long = {t: n for t, n in counts.items() if len(t) > KEPT_LENGTH}
        self.seen.update((t, n) for t, n in counts.items() if len(t) <= KEPT_LENGTH)
        look = self.seen.__getitem__ if not long else lambda t: self.seen[t] if t in self.seen else long[t]
        return [n + sum(map(look, p)) for n, p in zip(added, parts, strict=True)]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    `vocabulary` is the path of a byte-level BPE file that every executor can open. Begin and end tokens are not counted;
    a special token's string inside a text is that one token. Null and empty texts have 0 tokens; repeated rows stay
    repeated; a null id is kept; further columns of `docs` are neither read nor returned; an empty table gives no rows.
    Texts of any length are read whole.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(vocabulary)
        for part in pieces(batches):
            counts = np.array(table.count(part.column("text").to_pylist()), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("n_bytes"), pa.array(counts), pa.array(counts > limit)], ["id", "n_bytes", "n_tokens", "over_limit"]
            )

    text = F.col(text_column)
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return arrow_map(rows, run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_column)
