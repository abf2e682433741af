"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language inside tasks and sums the counts; only the count matrix, languages times buckets, reaches the
driver. Scoring gathers the rows of the broadcast log-probability matrix for the n-grams that a text has, and sums them per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.shared import arrow_map
from creditloom.llm.words import pieces, row_sums

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
HELD_LANGUAGES = 64
_STEP = np.uint32(0x9E3779B1)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Flags of the code points that are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(texts: list[str | None], buckets: int = BUCKETS) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per n-gram length the bucket of every n-gram and the n+1 row positions; and whether each text has a letter.

    Texts are lower-cased and each stretch of other characters counts as one blank, so marks, digits and layout don't matter.
    """
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), dtype=np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in lowered])])
    letter = letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    keep[firsts] = letter[firsts]
    codes = np.where(letter, points, np.uint32(32))[keep]
    upto = np.concatenate([[0], np.cumsum(keep)])
    bounds = upto[offsets]
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    hashed, rows = [], []
    running = np.zeros(len(codes), np.uint32)
    for k in range(max(ORDERS)):
        n = max(len(codes) - k, 0)
        running = (running[:n] ^ codes[k : k + n]) * _STEP
        if k + 1 in ORDERS:
            # The first n-gram of a row is at its first code; those that would reach into the next row are left out.
            inside = np.ones(n, dtype=bool)
            for back in range(1, k + 1):
                at = bounds[1:-1] - back
                at = at[(at >= bounds[:-2]) & (at < n)]
                inside[at] = False
            hashed.append(((running ^ (running >> np.uint32(15)) ^ np.uint32(k * 0x5BD1)) * _STEP)[inside] >> shift)
            rows.append(np.concatenate([[0], np.cumsum(np.maximum(np.diff(bounds) - k, 0))]))
    return hashed, rows, row_sums(letter.astype(np.int64), offsets) > 0


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    log_prob: np.ndarray  # languages x buckets, float32

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior probability; `und` and 0 without a letter or without any learned language."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        hashed, rows, has_letter = grams(texts, self.log_prob.shape[1])
        total = np.tile(self.prior, (len(texts), 1))
        for h, bounds in zip(hashed, rows, strict=True):
            for k in range(len(self.languages)):
                total[:, k] += row_sums(self.log_prob[k][h].astype(np.float64), bounds)
        best = total.argmax(axis=1)
        score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), has_letter.tolist(), strict=True)], np.where(has_letter, score, 0.0)


def train(docs: DataFrame, text_column: str = "text", language_column: str = "lang", buckets: int = BUCKETS, smoothing: float = 0.5) -> Model:
    """Fits the model on all rows that have a text and a language. The matrix holds one row per distinct language value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "n"])
            held.clear()

        for part in pieces(batches):
            texts = part.column("text").to_pylist()
            hashed, rows, _ = grams(texts, buckets)
            names, which = np.unique(np.array(part.column("lang").to_pylist(), dtype=object), return_inverse=True)
            for k, name in enumerate(names):
                counts = held.setdefault(name, np.zeros(buckets + 1, np.int64))
                mine = which == k
                counts[buckets] += mine.sum()  # documents, beside the n-gram buckets
                for h, bounds in zip(hashed, rows, strict=True):
                    counts[:buckets] += np.bincount(h[np.repeat(mine, np.diff(bounds))], minlength=buckets)
            if len(held) > HELD_LANGUAGES:
                yield from flush()
        yield from flush()

    known = docs.select(F.col(text_column).alias("text"), F.col(language_column).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sums = arrow_map(known, run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for name, bucket, n in sums.toLocalIterator():
        found.setdefault(name, np.zeros(buckets + 1))[bucket] = n
    names = sorted(found)
    if not names:
        return Model([], np.zeros(0), np.zeros((0, buckets), np.float32))
    counts = np.stack([found[n] for n in names])
    seen = counts[:, :buckets] + smoothing
    return Model(names, np.log(counts[:, buckets] / counts[:, buckets].sum()), np.log(seen / seen.sum(axis=1, keepdims=True)).astype(np.float32))


def identify(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang") -> DataFrame:
    """One row per row of `docs`: id, held_out, lang_pred and score (posterior, 0 to 1), learned from the rows where `held_out` is false.

    The prediction reads the text alone. Null, empty and letterless texts are `und` with score 0, and so is all where no row
    teaches a language; equal posteriors go to the first language by code point. Repeated rows stay repeated; a null id is kept (its
    row is held out); further columns are neither read nor returned. Texts are read whole.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    out = F.coalesce(held_out, F.lit(True))
    rows = docs.select(F.col(id_column).alias("id"), out.alias("held_out"), F.col(text_column).alias("text"), F.col(language_column).alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(train(rows.where(~F.col("held_out"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            names, score = model.value.score(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    found = arrow_map(rows.select("id", "held_out", "text"), run, f"id {kind}, held_out boolean, lang_pred string, score double")
    return found.withColumnRenamed("id", id_column)
