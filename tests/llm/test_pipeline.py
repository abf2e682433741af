"""The pipeline: each stage against the plain rule for its own input, and the whole run."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import plain

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order_over_the_smallest_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, FOLDER).cache()
        rows = out.collect()
        if name == "token-files":
            break
        assert out.columns == columns
        kept = [r.doc_id for r in rows]
        assert set(kept) <= set(before) and all(r == before[r.doc_id] for r in rows)
        if name == "toxicity":
            assert len(kept) >= 0.8 * len(before)
        if name == "near-duplicates":
            groups = plain.near_groups([(i, r.text) for i, r in before.items()])
            assert sorted(kept) == sorted(i for i, (_, c) in groups.items() if c == i)
        if name == "decontamination":
            judged = {i: plain.contamination(r.text, items) for i, r in before.items()}
            assert sorted(kept) == sorted(i for i, (n, hit, _) in judged.items() if not (hit > 0 and 20 * hit >= n))
        if name == "mixing":
            sizes = {}
            for r in before.values():
                sizes[r.source] = sizes.get(r.source, 0) + len(plain.words(r.text))
            taken = dict.fromkeys(sizes, 0)
            for r in rows:
                taken[r.source] += len(plain.words(r.text))
            largest = max(len(plain.words(r.text)) for r in before.values())
            assert all(abs(taken[s] - t) <= 2 * largest for s, t in plain.targets(sizes).items())
            assert max(kept.count(i) for i in set(kept)) <= 2
        docs = out
    library, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    assert len(rows) == len(texts)
    for r, (doc_id, text) in zip(sorted(rows, key=lambda r: r.start), texts, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_run_over_odd_rows_and_an_empty_table(spark, tmp_path):
    for name, docs in (("odd", plain.odd(spark)), ("empty", plain.odd(spark).limit(0))):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "one two three four five")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame([(4, 1, 0)], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert (len(rows) == 0) == (name == "empty")
