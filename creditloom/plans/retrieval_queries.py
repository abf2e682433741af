"""Registered queries: retrieval over chunks and vectors, answer context."""

from __future__ import annotations

from pyspark.sql import DataFrame

from creditloom.operators import findings as N
from creditloom.operators import retrieval as V
from creditloom.plans import decision_chain as C
from creditloom.sources.tables import Tables


def hits(t: Tables) -> DataFrame:
    own = t.staged("chunk_words", lambda: V.chunk_words(t.chunks))
    return t.staged("lexical_hits", lambda: V.lexical_topk(t.questions, own))


def _contexts(t: Tables) -> DataFrame:
    risks = C.blended(t).selectExpr("company_id", "final_score AS score", "risk_category AS category", "decision")
    # Written, as few rows that meet all chunks by id.
    ranked = t.staged("ranked_hits", lambda: V.with_fallback(hits(t), t.questions, t.chunks))
    return V.contexts(t.questions, ranked, t.chunks, N.narrative(t.company, t.findings), risks, N.latest(t.findings))


QUERIES = {
    "top_1_vector_topk": lambda t: V.vector_topk(V.theme_vectors(t.vectors), t.vectors),
    "top_2_lexical_topk": hits,
    "top_3_lexical_fallback": lambda t: V.with_fallback(hits(t), t.questions, t.chunks),
    "top_4_picked_lines": lambda t: V.picked_lines(_contexts(t)),
    "mem_4_contexts": _contexts,
}
