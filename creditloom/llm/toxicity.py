"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positive class; a sample of all texts, whatever their labels, is the unlabelled class. The risk of a linear
numpy classifier over words and word heads is pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)]), with l the sigmoid loss and pi the
class prior; where the corrected negative part falls below zero the step goes the other way, so the model can't gain by overfitting it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.shared import arrow_map
from creditloom.llm.words import ALNUM, lower, pieces, row_sums, span_hashes, text_bytes, word_bounds

MAX_POSITIVE = 4_000
MAX_UNLABELLED = 12_000
FEATURES = 4_096
MIN_PRECISION = 0.75
MIN_Z = 5.0
HEADS = (4, 5, 6)
DEFAULT_PRIOR = 0.1


def _features(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every word and of its heads of 4, 5 and 6 bytes, so that the forms of one stem share a feature; and the row of each."""
    data, offsets = text_bytes(part.column("text"))
    data = lower(data)
    starts, ends, bounds = word_bounds(data, offsets, ALNUM)
    rows = np.repeat(np.arange(part.num_rows), np.diff(bounds))
    found = [(span_hashes(data, starts, ends), rows)]
    for size in HEADS:
        longer = ends - starts > size
        found.append((span_hashes(data, starts[longer], starts[longer] + size), rows[longer]))
    return np.concatenate([h for h, _ in found]), np.concatenate([r for _, r in found])


def _distinct(rows: np.ndarray, values: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values per row, how often each occurs there, and the n+1 row positions."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    at = np.flatnonzero(first)
    return values[at], np.diff(np.append(at, len(rows))), np.searchsorted(rows[at], np.arange(n_rows + 1))


@dataclass
class Model:
    hashes: np.ndarray  # ascending word hashes of the features
    weights: np.ndarray
    bias: float

    def features(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers and values (1 + log of the count) of all rows, and the n+1 row positions."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(part.num_rows + 1, np.int64)
        hashes, rows = _features(part)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        found, counts, ends = _distinct(rows[hit], at[hit], part.num_rows)
        return found, 1 + np.log(counts), ends

    def score(self, part: pa.RecordBatch) -> np.ndarray:
        at, values, bounds = self.features(part)
        return 1.0 / (1.0 + np.exp(-np.clip(row_sums(self.weights[at] * values, bounds) + self.bias, -30, 30)))


def fit_nnpu(at: np.ndarray, values: np.ndarray, bounds: np.ndarray, positive: np.ndarray, width: int, prior: float, steps: int = 200, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias from sparse rows (feature numbers `at`, their values, row positions `bounds`); rows that aren't positive are unlabelled.

    The bias is then moved to where the same corrected risk, with the 0-1 loss, is least on these rows.
    """
    sizes = np.diff(bounds)
    w, b = np.zeros(width), 0.0
    mean, spread = np.zeros(width + 1), np.zeros(width + 1)
    n_p, n_u = positive.sum(), (~positive).sum()
    for step in range(1, steps + 1):
        g = row_sums(w[at] * values, bounds) + b
        s = 1.0 / (1.0 + np.exp(-np.clip(g, -30, 30)))
        slope = s * (1 - s)
        # Sigmoid loss: l(g) = 1 - s(g), l(-g) = s(g).
        negative_part = s[~positive].sum() / n_u - prior * s[positive].sum() / n_p
        pull = np.where(positive, -prior * slope / n_p, 0.0)
        push = np.where(positive, -prior * slope / n_p, slope / n_u)
        d = pull + push if negative_part >= 0 else -push
        grad = np.append(np.bincount(at, weights=np.repeat(d, sizes) * values, minlength=width) + decay * w / width, d.sum())
        mean, spread = 0.9 * mean + 0.1 * grad, 0.99 * spread + 0.01 * grad**2
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    g = row_sums(w[at] * values, bounds) + b
    cuts = np.unique(g)
    cuts = np.append((cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1)
    caught = 1 - np.searchsorted(np.sort(g[positive]), cuts) / n_p
    flagged = 1 - np.searchsorted(np.sort(g[~positive]), cuts) / n_u
    risk = prior * (1 - caught) + np.maximum(0, flagged - prior * caught)
    return w, float(b - cuts[len(cuts) - 1 - np.argmin(risk[::-1])])  # of equal risks, the highest cut


def train(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
    prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, n_features: int = FEATURES,
    min_precision: float = MIN_PRECISION, min_z: float = MIN_Z,
) -> Model:
    """Fits on at most `max_positive` toxic rows and `max_unlabelled` other rows, both taken by the hash of the id from rows that aren't held out.

    Without `prior` it is the toxic share of the labelled rows (DEFAULT_PRIOR if all of those are toxic). Copies of a text count once. Features are the
    `n_features` words and heads with the clearest excess in toxic texts: `min_z` standard errors, and at least
    `min_precision` of the texts that hold the word are toxic by the class prior, however few of the toxic texts that is. An id that is labelled more than once counts as toxic if
    any of its rows says so. Without a toxic row, or a word that marks toxic ones, every score is near 0.
    """
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    rows = docs.where(F.coalesce(~held_out, F.lit(False))).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    seen = rows.select("id").distinct().join(known, "id", "left")
    n_known, n_toxic = seen.where("y IS NOT NULL").agg(F.count("y"), F.coalesce(F.sum((F.col("y") > 0).cast("int")), F.lit(0))).head()
    if not n_toxic:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    pi = prior if prior is not None else (n_toxic / n_known if n_toxic < n_known else DEFAULT_PRIOR)
    by_hash = F.xxhash64(F.col("id"), F.lit("toxicity"))
    positive = seen.where("y > 0").orderBy(by_hash, "id").limit(max_positive).select("id", F.lit(True).alias("positive"))
    unlabelled = seen.orderBy(F.xxhash64(F.col("id"), F.lit("unlabelled")), "id").limit(max_unlabelled).select("id", F.lit(False).alias("positive"))
    chosen = positive.unionByName(unlabelled)
    sample = rows.join(F.broadcast(chosen), "id").select("text", "positive").distinct()  # the sample's size is bounded by its two limits
    sizes = {r.positive: r["count"] for r in sample.groupBy("positive").count().collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            hashes, rows = _features(part)
            values, _, ends = _distinct(rows, hashes, part.num_rows)
            flags = np.repeat(part.column("positive").to_numpy(zero_copy_only=False), np.diff(ends))
            found, where = np.unique(values, return_inverse=True)
            n_p = np.bincount(where, weights=flags, minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n_p), pa.array(np.bincount(where, minlength=len(found)) - n_p)], ["word", "n_p", "n_u"])

    size_p, size_u = sizes[True], sizes[False]
    share_p, share_u = F.col("n_p") / size_p, F.col("n_u") / size_u
    share = (F.col("n_p") + F.col("n_u")) / (size_p + size_u)
    ranked = arrow_map(sample, count, "word long, n_p long, n_u long").groupBy("word").agg(F.sum("n_p").alias("n_p"), F.sum("n_u").alias("n_u")).where("n_p + n_u >= 3")
    ranked = ranked.withColumn("gap", (share_p - share_u) / F.sqrt(share * (F.lit(1.0001) - share) * (1 / size_p + 1 / size_u)))
    best = ranked.where((F.col("gap") >= min_z) & (pi * share_p >= min_precision * share_u)).orderBy(F.desc("gap"), "word").limit(n_features).select("word").collect()
    model = Model(np.sort(np.array([r.word for r in best], np.int64).view(np.uint64)), np.zeros(len(best)), 0.0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            at, values, ends = model.features(part)
            lists = [pa.array([x[a:b].astype(np.float32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) for x in (at, values)]
            yield pa.RecordBatch.from_arrays([part.column("positive"), *lists], ["positive", "at", "x"])

    if not len(best):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    vectors = sorted(arrow_map(sample, project, "positive boolean, at binary, x binary").collect())
    lists = [np.frombuffer(bytes(v.at), np.float32).astype(np.int64) for v in vectors]
    values = np.concatenate([np.frombuffer(bytes(v.x), np.float32) for v in vectors])
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    model.weights, model.bias = fit_nnpu(np.concatenate(lists), values, bounds, np.array([v.positive for v in vectors], bool), len(best), pi)
    return model


def _scored(docs: DataFrame, row: Column, text_column: str, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(shared.value.score(part))], ["row", "score"])

    rows = docs.select(row.alias("row"), F.col(text_column).alias("text"))
    return arrow_map(rows, run, T.StructType([rows.schema["row"]]).add("score", "double"))


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", **options) -> DataFrame:
    """One row per row of `docs`: id, held_out, score (0 to 1) and predicted (1 if score >= 0.5), learned from rows that aren't held out.

    A score depends on the text alone. Null and empty texts get the score of a text without words; without a toxic row to learn
    from every score is near 0. Repeated rows stay repeated; a null id is kept (and held out); further columns are neither read nor returned.
    """
    model = train(docs, labels, held_out, id_column, text_column, label_column, **options)
    row = F.struct(F.col(id_column).alias("id"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    found = _scored(docs, row, text_column, model)
    return found.select(F.col("row.id").alias(id_column), "row.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", **options) -> DataFrame:
    """The rows of `docs` whose score is below 0.5, with all their columns."""
    model = train(docs, labels, held_out, id_column, text_column, label_column, **options)
    return _scored(docs, F.struct(*[docs[c] for c in docs.columns]), text_column, model).where("score < 0.5").select("row.*")
