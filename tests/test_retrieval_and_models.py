"""Retrieval and model helpers against brute force."""

import math
import random
import re

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from creditloom.operators import findings as N
from creditloom.operators import ml as K
from creditloom.operators import retrieval as V


def test_lexical_topk_is_exact_for_any_split(spark):
    rng = random.Random(11)
    vocab = ["the", "of", "and"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocab[:3]) if rng.random() < 0.5 else rng.choice(vocab) for _ in range(n))
    chunks = [(c, i, text(rng.randrange(1, 25))) for i, c in enumerate(rng.choices([1, 1, 1, 2], k=300))]
    asked = [(q, rng.choice([1, 2]), rng.choice([text(6), "the of and", "the w1", "zzz"])) for q in range(40)]
    own = V.chunk_words(spark.createDataFrame(chunks, "company_id long, chunk_id long, chunk_text string"))
    questions = spark.createDataFrame(asked, "question_id long, company_id long, question string")
    want = set()
    for q, company, question in asked:
        words = set(question.split())
        scored = sorted((-len(words & set(t.split())), i) for c, i, t in chunks if c == company and words & set(t.split()))
        want |= {(q, rank + 1, i) for rank, (_, i) in enumerate(scored[:5])}
    for bits, rounds in ((0, (1, 3)), (2, (2, 4)), (4, ()), (20, (2, 32))):
        got = {(r.question_id, r.rank_no, r.chunk_id) for r in V.lexical_topk(questions, own, 5, bits, rounds).collect()}
        assert got == want


def test_a_word_of_every_chunk_opens_the_first_blocks_only(spark):
    """A large company in which all chunks hold two words and few a third."""
    text = F.concat(F.lit("the of w"), (F.col("id") % 1000).cast("string"), F.when(F.col("id") % 4001 == 7, " zebra").otherwise(""))
    own = V.chunk_words(spark.range(20_000).select(F.lit(1).cast("long").alias("company_id"), F.col("id").alias("chunk_id"), text.alias("chunk_text")))
    questions = spark.createDataFrame([(1, 1, "the"), (2, 1, "of the"), (3, 1, "the zebra"), (4, 1, "nothing here"), (5, 1, None)], "question_id long, company_id long, question string")
    best, opened = V.lexical_search(questions, own, 5, 6)
    got = {q: [r.chunk_id for r in best.where(f"query_id = {q}").orderBy(F.col("score").desc(), "chunk_id").collect()] for q in (1, 2, 3, 4, 5)}
    assert got == {1: [0, 1, 2, 3, 4], 2: [0, 1, 2, 3, 4], 3: [7, 4008, 8009, 12010, 16011], 4: [], 5: []}
    blocks = {r.query_id: r.n for r in opened.groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert blocks[1] == blocks[2] == 2 and blocks[3] <= 34
    empty = V.lexical_topk(questions, own.limit(0))
    assert empty.count() == 0 and V.lexical_topk(questions.limit(0), own).count() == 0


def test_words_are_the_runs_of_letters_and_digits(spark):
    texts = ["", "  ", "Ab ab-7, x", ",,a", "ñu año 9z\n9Z", "\u212aelvin K", None]
    got = [r.w for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", V.words(F.col("t")).alias("w")).orderBy("i").collect()]
    want = [list(dict.fromkeys(re.findall("[a-z0-9]+", t.lower()))) if t is not None else None for t in texts]
    assert got == want


def test_words_that_nobody_asked_for_do_not_travel(spark, monkeypatch):
    """The asked words are written first, so their size is known, and every chunk's words meet them where they are read; postings are not gathered into lists."""
    plans, found = {}, {}
    real = V.written

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        found[name] = real(df, name)
        return found[name]

    monkeypatch.setattr(V, "written", seen)
    chunks = spark.range(2_000).selectExpr("id % 3 AS company_id", "if(id = 7, null, id) AS chunk_id", "concat('the of w', id % 50) AS chunk_text")
    questions = spark.createDataFrame([(1, 1, "the w4"), (2, 2, "w5 zebra")], "question_id long, company_id long, question string")
    V.lexical_search(questions, V.chunk_words(chunks), 5, 4)
    assert "Exchange hashpartitioning" not in plans["postings"] and "SortMergeJoin" not in plans["postings"]
    asked = {1: {"the", "w4"}, 2: {"w5"}}
    want = sorted((i % 3, i, w) for i in range(2_000) if i != 7 for w in ("the", "of", f"w{i % 50}") if w in asked.get(i % 3, ()))
    assert sorted((r.company_id, r.chunk_id, r.word) for r in found["postings"].collect()) == want


def test_lexical_fallback(spark):
    chunks = spark.createDataFrame([(1, 7, "alpha"), (1, 3, "beta"), (1, 9, "")], "company_id long, chunk_id long, chunk_text string")
    questions = spark.createDataFrame([(1, 1, "gamma"), (2, 1, "alpha")], "question_id long, company_id long, question string")
    got = V.with_fallback(V.lexical_topk(questions, V.chunk_words(chunks)), questions, chunks).collect()
    assert sorted((r.question_id, r.rank_no, r.chunk_id, r.score) for r in got) == [(1, 1, 3, 0.0), (1, 2, 7, 0.0), (2, 1, 7, 1.0)]


def _cosines(query, vectors, k):
    def score(v):
        if v is None or query is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        size = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in query))
        return sum(x * y for x, y in zip(v, query, strict=True)) / size if size else None

    scored = [(score(v), i) for i, v in vectors]
    return sorted(((None if s is None else math.floor(s * 1e6 + 0.5) / 1e6, i) for s, i in scored), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))[:k]


def test_vector_topk_equals_brute_force(spark):
    """Clustered and repeated vectors, one large company, vectors without a direction, a query of a company without any."""
    rng = random.Random(5)
    centre = {c: [rng.gauss(0, 1) for _ in range(6)] for c in (1, 2)}
    rows = [(i, 1 if i % 4 else 2, None) for i in range(600)]
    rows = [(i, c, [x + rng.gauss(0, 0.4) for x in centre[c]]) for i, c, _ in rows]
    rows += [(600 + j, 1, rows[1][2]) for j in range(8)] + [(700, 1, [0.0] * 6), (701, 1, None), (702, 1, [float("nan")] + [1.0] * 5), (703, 3, [0.0] * 6), (704, 3, None)]
    asked = [(q, rng.choice([1, 2]), [rng.gauss(0, 1) for _ in range(6)]) for q in range(6)]
    asked += [(10, 1, rows[1][2]), (11, 1, [0.0] * 6), (12, 3, centre[1]), (13, 9, centre[1])]
    vectors = spark.createDataFrame(rows, "chunk_id long, company_id long, embedding array<double>")
    queries = spark.createDataFrame(asked, "query_id long, company_id long, query_vector array<double>")
    want = {}
    for q, company, vector in asked:
        for rank, (score, i) in enumerate(_cosines(vector, [(i, v) for i, c, v in rows if c == company], 5)):
            want[q, rank + 1] = (i, score)
    for limit, options in ((0, {"bits": 0, "rounds": (1, 3), "n_pivots": 2}), (200, {"bits": 4, "rounds": ()}), (0, {"bits": 20}), (10**6, {})):
        got = {(r.query_id, r.rank_no): (r.chunk_id, r.score) for r in V.vector_topk(queries, vectors, 5, limit, **options).collect()}
        assert got.keys() == want.keys()
        for key, (i, score) in want.items():
            assert got[key][0] == i and (got[key][1] == score or abs(got[key][1] - score) < 2e-6), key
    assert V.vector_topk(queries, vectors.limit(0), limit=0).count() == 0


def test_vector_blocks_out_of_reach_are_skipped(spark):
    """A company of two far clusters: a query beside one of them leaves the other alone."""
    spot = F.when(F.col("id") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    noise = lambda n: (F.pmod(F.xxhash64("id", F.lit(n)), F.lit(1000)) / 5000.0).cast("double")
    vectors = spark.range(8000).select(F.col("id").alias("chunk_id"), F.lit(1).cast("long").alias("company_id"), F.array(spot, noise(1), noise(2), noise(3)).alias("embedding"))
    queries = spark.createDataFrame([(1, 1, [1.0, 0.1, 0.1, 0.1])], "query_id long, company_id long, query_vector array<double>")
    best, counts = V.vector_search(queries, vectors, 5, 6)
    row = counts.first()
    assert row.n_chunks == 8000 and row.n_scored < 4000
    want = _cosines([1.0, 0.1, 0.1, 0.1], [(r.chunk_id, r.embedding) for r in vectors.collect()], 5)
    assert [r.chunk_id for r in best.orderBy(F.col("score").desc(), "chunk_id").collect()] == [i for _, i in want]


def test_picked_lines(spark):
    rows = spark.createDataFrame([(1, "what about cash flow", "Cash is low\n\n other \nCASHFLOW"), (2, "to be", "a\nb")], "question_id long, question string, context string")
    got = sorted((r.question_id, r.pos, r.line) for r in V.picked_lines(rows).collect())
    assert got == [(1, 0, "Cash is low"), (1, 1, "CASHFLOW"), (2, 0, "a"), (2, 1, "b")]


def test_split_is_exact_per_label_and_repeatable(spark):
    rows = spark.range(997).select(F.col("id").alias("company_id"), (F.col("id") % 7 == 0).cast("double").alias("y"))
    counts = {(r.y, r.part): r.n for r in K.stratified_split(rows, "y", "company_id").groupBy("y", "part").agg(F.count("*").alias("n")).collect()}
    assert counts == {(1.0, "test"): 29, (1.0, "train"): 114, (0.0, "test"): 171, (0.0, "train"): 683}
    a, b = (sorted(map(tuple, K.stratified_split(rows.repartition(n), "y", "company_id").collect())) for n in (1, 9))
    assert a == b


def test_auc_matches_evaluator(spark):
    rng = random.Random(2)
    rows = [(float(rng.random() < 0.3), rng.choice([0.1, 0.5, 0.9, rng.random()])) for _ in range(800)]
    df = spark.createDataFrame(rows, "label double, score double")
    raw = df.withColumn("rawPrediction", array_to_vector(F.array(1 - F.col("score"), F.col("score"))))
    want = BinaryClassificationEvaluator(numBins=0).evaluate(raw)
    for limit in (1, 4, 4096):
        assert abs(K.auc(df, limit=limit).first().auc - want) < 1e-6


def test_training_learns_and_scores(spark):
    rows = spark.range(200).select(F.col("id").alias("company_id"), (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("z")).withColumn("y", (F.col("x") > 9).cast("double"))
    model = K.train_classifier(rows, ["x", "z"], "y", {"maxIter": 5, "maxDepth": 2})
    scored = K.stress_probability(model, rows).join(rows.select("company_id", F.col("y").alias("label")), "company_id").withColumnRenamed("stress_probability", "score")
    got = K.metrics(scored).first()
    assert got.accuracy == 1.0 and got.auc == 1.0
    assert K.importances(spark, model, ["x", "z"]).first().feature == "x"
    assert K.stress_probability(None, rows).select("stress_probability").distinct().collect() == [(0.5,)]


FINDING = "company_id long, seq long, finding_date date, finding_type string, severity string, source_url string, source_name string, summary string, raw_snippet string, confidence double, score_impact double"


def test_dedupe_keeps_first_and_folds_copies(spark):
    copies = [(1, i, None, "LITIGATION", "HIGH", "HTTP://A", "s", "Same", "", 0.5, -1.0) for i in range(500, 0, -1)]
    other = [(1, 900, None, "LITIGATION", "HIGH", "http://a", "s", "x" * 120 + "tail 1", "", 0.5, -1.0), (1, 901, None, "LITIGATION", "HIGH", "http://a", "s", "X" * 120 + "tail 2", "", 0.5, -1.0)]
    got = N.deduplicated(spark.createDataFrame(copies + other, FINDING)).orderBy("seq").collect()
    assert [r.seq for r in got] == [1, 900, 901]


def test_source_rules(spark):
    df = spark.createDataFrame([
        ("https://www.ecourts.gov.in/x", "LITIGATION"), ("https://a.ecourts.gov.in", "LITIGATION"), ("https://fakeecourts.gov.in", "LITIGATION"), ("https://rbi.org.in", "OTHER"),
        ("not a url", "OTHER"), ("https://thehindu.com/a", "MCA_FILING")], "url string, t string")
    assert [r[0] for r in df.select(N.is_allowed(F.col("url"), F.col("t"))).collect()] == [True, True, False, True, False, False]
    urls = spark.createDataFrame([("https://X.com/a",), ("https://a.b/c.PNG?x=1",), ("https://a.b/c.pdf",)], "url string")
    assert [r[0] for r in urls.select(N.is_excluded(F.col("url"))).collect()] == [True, True, False]
