"""Vector and lexical top-k per question, the answer context, and the line pick."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer

from creditloom.functions.text import lines_of
from creditloom.functions.values import round_to
from creditloom.operators.bounded import ROUNDS, best_by_bounds
from creditloom.operators.ledger import first_n
from creditloom.operators.scans import AT, sliced, written

# Word shape, limits of the context and of the line pick.
BETWEEN_WORDS = "[^a-z0-9]+"

#: Chunks of a block, and blocks of a stretch, as powers of two.
BLOCK_BITS, STRETCH_BITS = 8, 10
#: Pivots and hash parts of a company; room for rounded scores; the score of what has no cosine.
PIVOTS, SALTS = 8, 64
#: Companies of more chunks are searched by blocks.
CHUNKS_TOGETHER = 1 << 14
MARGIN, NO_COSINE = 2e-6, -2.0


def words(text: Column) -> Column:
    """Distinct words in the order of their first place. Cutting at what lies between is cheaper than extracting each."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), BETWEEN_WORDS)), "")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def theme_vectors(vectors: DataFrame) -> DataFrame:
    """Mean vector per company, the query for 'what is typical here'. Combined before the shuffle."""
    mean = vectors.groupBy("company_id").agg(Summarizer.mean(array_to_vector("embedding")).alias("m"))
    return mean.select("company_id", F.col("company_id").cast("bigint").alias("query_id"), vector_to_array("m").alias("query_vector"))


def _norm(a: str) -> Column:
    return F.sqrt(_dot(a, a))


def _is_direction(norm: Column) -> Column:
    """Whether a vector of this norm points anywhere: not null, zero or beyond all numbers."""
    return F.coalesce((norm > 0) & (norm < float("inf")) & ~F.isnan(norm), F.lit(False))


def _angles(pivots: str, vector: str, norm: str) -> Column:
    """Angles between a vector and each pivot (a unit vector); null for what is no direction."""
    cosine = lambda p: F.aggregate(F.zip_with(p, vector, lambda x, y: x * y.cast("double")), F.lit(0.0), lambda s, v: s + v) / F.col(norm)
    between = F.transform(pivots, lambda p: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(p)))))
    return F.when(_is_direction(F.col(norm)), between)


def _cosine() -> Column:
    """Rounded cosine of `embedding` and `query_vector`, whose norms are at hand; NO_COSINE where one is no direction."""
    is_known = _is_direction(F.col("norm")) & _is_direction(F.col("query_norm"))
    return F.coalesce(F.when(is_known, round_to(F.try_divide(_dot("embedding", "query_vector"), F.col("norm") * F.col("query_norm")), 6)), F.lit(NO_COSINE))


def pivot_directions(vectors: DataFrame, n: int = PIVOTS) -> DataFrame:
    """Up to n unit vectors per company: the direction of its mean, then vectors drawn by the hash of their ids. One row per company, of bounded size."""
    usable = vectors.withColumn("norm", _norm("embedding")).where(_is_direction(F.col("norm")))
    mean = theme_vectors(usable).select("company_id", F.col("query_vector").alias("p"), F.lit(0).alias("pos"))
    drawn = first_n(usable, ["company_id"], [F.xxhash64("chunk_id"), F.col("chunk_id")], n - 1, "pos")
    drawn = drawn.select("company_id", F.transform("embedding", lambda x: x.cast("double")).alias("p"), F.col("pos"))
    both = mean.unionByName(drawn).withColumn("norm", _norm("p")).where(_is_direction(F.col("norm")))
    unit = both.select("company_id", F.struct("pos", F.transform("p", lambda x: x / F.col("norm")).alias("p")).alias("s"))
    return unit.groupBy("company_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["p"]).alias("pivots"))


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 5, bits: int = BLOCK_BITS, rounds: Sequence[int] = ROUNDS, n_pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """Cosine top-k among the chunks of the query's company (query_id, company_id, chunk_id, score), and chunks and scored chunks per query.

    Chunks are sorted by their nearest pivot and the angle to it, and cut into blocks of 2^bits that keep the least and largest angle to every pivot. Angles obey
    the triangle inequality, so the query's own angles to the pivots bound the best cosine in a block. Hot companies are spread by hash
    for the angles and by stretches of blocks for the bounds. Scores are rounded to 6 digits, which MARGIN covers; NO_COSINE stands for none.
    """
    pivots = written(pivot_directions(vectors, n_pivots), "pivots")
    salted = vectors.select("company_id", "chunk_id", "embedding", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).alias("salt"))
    spread = pivots.join(salted.select("company_id", "salt").distinct(), "company_id")
    near = salted.join(spread, ["company_id", "salt"], "left").withColumn("norm", _norm("embedding")).withColumn("angles", _angles("pivots", "embedding", "norm"))
    near = near.withColumn("home", F.array_position("angles", F.array_min("angles"))).drop("pivots", "salt")
    ordered = sliced(near, [F.col("company_id"), F.col("home"), F.array_min("angles"), F.col("chunk_id")]).withColumn("block", F.shiftright(AT, bits))
    ends = [f(F.get("angles", F.lit(i))).alias(f"{name}_{i}") for i in range(n_pivots) for name, f in (("low", F.min), ("high", F.max))]
    blocks = ordered.groupBy("company_id", "block").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_id"), F.bool_or(_is_direction(F.col("norm"))).alias("usable"), *ends)
    blocks = written(blocks.withColumn("stretch", F.shiftright("block", STRETCH_BITS)), "blocks")
    asked = queries.select("query_id", "company_id", "query_vector").withColumn("query_norm", _norm("query_vector"))
    aimed = asked.join(pivots, "company_id", "left").select("query_id", "company_id", "query_norm", _angles("pivots", "query_vector", "query_norm").alias("angles"))
    met = aimed.join(blocks.select("company_id", "stretch").distinct(), "company_id").join(blocks, ["company_id", "stretch"])
    gaps = [x for i in range(n_pivots) for x in (F.get("angles", F.lit(i)) - F.col(f"high_{i}"), F.col(f"low_{i}") - F.get("angles", F.lit(i)))]
    some = _is_direction(F.col("query_norm")) & F.col("usable")
    bound = F.when(some, F.cos(F.greatest(F.lit(0.0), *gaps)) + MARGIN).otherwise(NO_COSINE)
    bounds = met.select("query_id", "company_id", "block", bound.alias("bound"), "first_id")

    def scores(pairs: DataFrame) -> DataFrame:
        met = ordered.select("company_id", "block", "chunk_id", "embedding", "norm").join(pairs, ["company_id", "block"]).join(asked, ["query_id", "company_id"])
        return met.select("query_id", "company_id", "chunk_id", _cosine().alias("score"))

    best, opened = best_by_bounds(bounds, scores, k, rounds)
    scored = opened.join(blocks.select("company_id", "block", "n"), ["company_id", "block"]).groupBy("query_id").agg(F.sum("n").alias("n_scored"))
    sizes = blocks.groupBy("company_id").agg(F.sum("n").alias("n_chunks"))
    return best, asked.select("query_id", "company_id").join(sizes, "company_id").join(scored, "query_id").select("query_id", "n_chunks", "n_scored")


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, limit: int = CHUNKS_TOGETHER, **options) -> DataFrame:
    """Cosine top-k among the chunks of the query's company, numbered (ties: smaller id).

    Companies of more than `limit` chunks go through `vector_search` (`options` are its own), whose written steps cost more than they save on the others: these
    meet their queries directly, and the rank filter before the shuffle sends k rows per query and task. Both ways give the same rows.
    Vectors of a company have one length and chunk ids are unique. A chunk or query whose vector is null, zero or not finite has a null score and comes last.
    """
    large = written(vectors.groupBy("company_id").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("company_id"), "large")
    some = not large.isEmpty()
    few = vectors.join(large, "company_id", "left_anti") if some else vectors
    met = few.withColumn("norm", _norm("embedding")).join(queries.withColumn("query_norm", _norm("query_vector")), "company_id")
    best = met.select("query_id", "company_id", "chunk_id", _cosine().alias("score"))
    if some:
        best = best.unionByName(vector_search(queries, vectors.join(large, "company_id", "left_semi"), k, **options)[0])
    return first_n(best, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k).select(
        "query_id", "company_id", F.col("rank_no").cast("bigint").alias("rank_no"), "chunk_id", F.nullif("score", F.lit(NO_COSINE)).alias("score"))


def chunk_words(chunks: DataFrame) -> DataFrame:
    """Distinct words per chunk. Worth writing once: the search below reads it several times."""
    return chunks.select("company_id", "chunk_id", words(F.col("chunk_text")).alias("c_words"))


def lexical_search(questions: DataFrame, own: DataFrame, k: int = 5, bits: int = BLOCK_BITS, rounds: Sequence[int] = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Best k chunks per question (query_id, company_id, chunk_id, score: words found), and the blocks that were opened for them.

    A company's chunks are cut into blocks of 2^bits in order of their ids. The words of a chunk that its company is asked for are written, a row each, so
    nothing is gathered. No chunk of a block can score more than the question's words that the block holds at all, and equal scores go to smaller ids, so a word
    of every chunk opens the first blocks and no others. Postings and questions meet per stretch of 2^STRETCH_BITS blocks, so no word or company is one group.
    """
    asked = questions.select(F.col("question_id").alias("query_id"), "company_id", F.explode(words(F.col("question"))).alias("word"))
    placed = sliced(own.select("company_id", "chunk_id", "c_words"), [F.col("company_id"), F.col("chunk_id")])
    blocks = placed.withColumn("block", F.shiftright(AT, bits)).withColumn("stretch", F.shiftright("block", STRETCH_BITS))
    stretches = blocks.select("company_id", "stretch").distinct()
    # Written, so that its size is known and it need not be sorted against every word of every chunk where it is small.
    needed = written(asked.select("company_id", "word").distinct().join(stretches, "company_id"), "needed")
    held = blocks.select("company_id", "stretch", "block", "chunk_id", F.explode("c_words").alias("word")).join(needed, ["company_id", "stretch", "word"], "left_semi")
    postings = written(held.where(F.col("chunk_id").isNotNull()), "postings")
    where = postings.select("company_id", "stretch", "word").distinct()
    spread = asked.join(where, ["company_id", "word"])
    firsts = postings.groupBy("company_id", "stretch", "block", "word").agg(F.min("chunk_id").alias("first"))
    bounds = spread.join(firsts, ["company_id", "stretch", "word"]).groupBy("query_id", "company_id", "block").agg(F.count("*").alias("bound"), F.min("first").alias("first_id"))

    def scores(pairs: DataFrame) -> DataFrame:
        wanted = pairs.join(asked, ["query_id", "company_id"])
        hits = wanted.join(postings.select("company_id", "block", "word", "chunk_id"), ["company_id", "block", "word"])
        return hits.groupBy("query_id", "company_id", "chunk_id").agg(F.count("*").alias("score"))

    return best_by_bounds(bounds, scores, k, rounds)


def lexical_topk(questions: DataFrame, own: DataFrame, k: int = 5, bits: int = BLOCK_BITS, rounds: Sequence[int] = ROUNDS) -> DataFrame:
    """Share of a question's words found in a chunk of its company, best k (ties: smaller id). `own` comes from `chunk_words`; chunk ids are unique.

    Exact whatever the size of the blocks. Questions and chunks without words have no rows.
    """
    n_words = questions.select("question_id", F.size(words(F.col("question"))).alias("n_words"))
    best = lexical_search(questions, own, k, bits, rounds)[0].withColumnRenamed("query_id", "question_id").withColumnRenamed("score", "found")
    ranked = best.join(n_words, "question_id").withColumn("score", round_to(F.col("found") / F.greatest("n_words", F.lit(1)), 6))
    return first_n(ranked, ["question_id"], [F.col("found").desc(), F.col("chunk_id")], k).select(
        "question_id", "company_id", F.col("rank_no").cast("bigint").alias("rank_no"), "chunk_id", "score")


def with_fallback(hits: DataFrame, questions: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Questions without any hit get their company's first chunks with score zero."""
    bare = questions.select("question_id", "company_id").join(hits.select("question_id").distinct(), "question_id", "left_anti")
    first = first_n(chunks.filter("chunk_text <> ''").select("company_id", "chunk_id"), ["company_id"], [F.col("chunk_id")], k)
    return hits.unionByName(bare.join(first, "company_id").select(
        "question_id", "company_id", F.col("rank_no").cast("bigint").alias("rank_no"), "chunk_id", F.lit(0.0).alias("score")))


def _joined_lines(df: DataFrame, key: str, line: Column, name: str) -> DataFrame:
    """Ranked lines per key as one text; the input holds only the few rows kept by a rank."""
    return df.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", line.alias("line")))), lambda s: s["line"]), "\n").alias(name))


def contexts(questions: DataFrame, hits: DataFrame, chunks: DataFrame, memos: DataFrame, risks: DataFrame, latest: DataFrame) -> DataFrame:
    """Context row per question: chunks, memo text, latest risk, five latest findings.

    `memos`: company_id, narrative; `risks`: company_id, score, category, decision, limit_cr; `latest`: ranked findings.
    """
    kind = F.coalesce(F.nullif("doc_type", F.lit("")), F.lit("DOCUMENT"))
    found = hits.join(chunks.select("company_id", "chunk_id", "doc_type", "chunk_text"), ["company_id", "chunk_id"])
    chunk_part = _joined_lines(found, "question_id", F.concat(F.lit("["), kind, F.lit("] "), "chunk_text"), "chunk_lines")
    finding_part = _joined_lines(
        latest, "company_id", F.concat(F.lit("- ["), "severity", F.lit("] "), "finding_type", F.lit(": "), "summary"), "finding_lines")
    risk_part = risks.select("company_id", F.concat(
        F.lit("Latest risk snapshot:\n- Final risk score: "), F.format_string("%.1f", F.col("score")), F.lit("\n- Risk category: "), "category",
        F.lit("\n- Decision: "), "decision").alias("risk_text"))
    rows = (
        questions.select("question_id", "company_id", "question").join(chunk_part, "question_id", "left")
        .join(memos.select("company_id", "narrative"), "company_id", "left").join(risk_part, "company_id", "left").join(finding_part, "company_id", "left"))
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Retrieved document context:\n"), "chunk_lines"),
        F.concat(F.lit("Latest CAM narrative:\n"), "narrative"),
        F.col("risk_text"),
        F.concat(F.lit("Recent research findings:\n"), "finding_lines"))
    return rows.select("question_id", "company_id", "question", F.trim(text).alias("context"))


def picked_lines(context_rows: DataFrame) -> DataFrame:
    """Context lines holding one of the question's longer words; without any, all lines."""
    keys = F.transform(F.filter(F.split("question", r"\s+"), lambda w: F.char_length(w) > 3), lambda w: F.lower(w))
    rows = context_rows.select("question_id", keys.alias("keys"), lines_of(F.col("context")).alias("lines"))
    matched = F.filter("lines", lambda s: F.exists("keys", lambda w: F.contains(F.lower(s), w)))
    chosen = rows.withColumn("matched", matched).select(
        "question_id", F.posexplode(F.when(F.size("matched") > 0, F.col("matched")).otherwise(F.col("lines"))).alias("pos", "line"))
    return chosen.select("question_id", F.col("pos").cast("bigint").alias("pos"), "line")
