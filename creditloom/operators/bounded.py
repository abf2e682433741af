"""Exact best k rows per query where blocks of rows have upper bounds.

Blocks are opened from the best bound down, and only while a row in them can still change the k-th place. The first rounds open a fixed number of blocks per
query, so a rank never holds more than that of one query; the last opens all that the k-th place found by then can't rule out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators.ledger import first_n
from creditloom.operators.scans import written

#: Blocks that a query opens in the rounds before the last.
ROUNDS = (2, 32)
PAIR = ["query_id", "company_id", "block"]


def _open(left: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Blocks that may hold one of the best k: fewer are known, the bound beats the k-th score, or equals it with a smaller id."""
    last = F.max_by("chunk_id", F.struct((-F.col("score")).alias("s"), "chunk_id"))
    kth = best.groupBy("query_id").agg(F.count("*").alias("n_best"), F.min("score").alias("kth"), last.alias("kth_id"))
    ties = (F.col("bound") == F.col("kth")) & (F.col("first_id") < F.col("kth_id"))
    may = F.col("n_best").isNull() | (F.col("n_best") < k) | (F.col("bound") > F.col("kth")) | ties
    return left.join(kth, "query_id", "left").where(may).select(left.columns)


def best_by_bounds(bounds: DataFrame, scores: Callable[[DataFrame], DataFrame], k: int, rounds: Sequence[int] = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The best k rows per query (query_id, company_id, chunk_id, score; ties: smaller id), and the pairs of query and block that were opened.

    `bounds`: query_id, company_id, block, bound (no score in the block is higher), first_id (no id in it is smaller). `scores` takes such pairs and
    gives the scored rows of their blocks; a score is never null. An empty table of bounds gives no rows.
    """
    left = written(bounds, "bounds")
    best, opened = None, None
    for n in (*rounds, None):
        picked = left
        if n is not None:
            picked = written(first_n(left, ["query_id"], [F.col("bound").desc(), F.col("first_id"), F.col("block")], n).select(left.columns), "opened")
        found = scores(picked.select(PAIR))
        every = found if best is None else best.unionByName(found)
        best = written(first_n(every, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k).select("query_id", "company_id", "chunk_id", "score"), "best")
        opened = picked.select(PAIR) if opened is None else opened.unionByName(picked.select(PAIR))
        if n is None:
            break
        left = written(_open(left.join(picked.select("query_id", "block"), ["query_id", "block"], "left_anti").select(left.columns), best, k), "bounds")
        if left.isEmpty():
            break
    return best, opened
