"""Periodic runs, centroid clustering and web archives against plain versions, and over odd rows and empty tables."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from math import floor, inf, nan

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from creditloom.llm.centroids import Heaps, cluster_report, cluster_vectors, drifts, squared_distances
from creditloom.llm.periodic_runs import Grammar, find_runs, grid, run_digests, runs_of
from creditloom.llm.shared import Steps
from creditloom.llm.warc import LoserTree, members, merge_runs, parse_record, read_archives, read_captures, url_key, write_archives
from tests.llm import plain

# Periodic runs


def plain_runs(w):
    """(start, length, period) by start and period."""
    n, found = len(w), {}
    for q in range(n // 4, 0, -1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                found[i, j - i + q] = q
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_report(text, g=None):
    w = plain.words(text)
    n = len(w)
    if g is not None and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    top = None
    for r in runs:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], plain.sha(lines), plain.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def some_words(rng):
    n, letters = rng.choice([0, 1, 5, 6, 7, 8, 40, 120, 400]), rng.choice([1, 2, 3, 12])
    w = [rng.randrange(letters) for _ in range(n)]
    if n > 20 and rng.random() < 0.7:
        a, p = rng.randrange(n), rng.randrange(1, 12)
        stop = rng.randrange(a, n) + 1
        w = [w[a + (i - a) % p] if a <= i < stop else x for i, x in enumerate(w)]
    return w


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(150):
        texts = [some_words(rng) for _ in range(rng.randrange(1, 7))]
        found = runs_of(np.array([x for w in texts for x in w], np.int64), np.array([len(w) for w in texts]))
        got = defaultdict(list)
        for t, *r in zip(*(x.tolist() for x in found), strict=True):
            got[t].append(tuple(r))
        assert [got[t] for t in range(len(texts))] == [plain_runs(w) for w in texts]


def test_extensions_of_the_grammar():
    rng = random.Random(6)
    for _ in range(40):
        w = some_words(rng) * rng.choice([1, 3]) + some_words(rng)
        n = len(w)
        if n < 3:
            continue
        g = Grammar(np.array([0, *(x + 2 for x in w), 1], np.int64), 2)
        pairs = sorted(tuple(sorted(rng.sample(range(n), 2))) for _ in range(100))
        i, j = (np.array(x) for x in zip(*pairs, strict=True))
        ahead = [next((d for d in range(n - b) if w[a + d] != w[b + d]), n - b) for a, b in pairs]
        behind = [next((d for d in range(a) if w[a - 1 - d] != w[b - 1 - d]), a) for a, b in pairs]
        assert g.extend(i + 1, j + 1).tolist() == ahead
        assert g.extend(i + 1, j + 1, back=True).tolist() == behind


def test_grid_in_pieces_is_the_whole_grid():
    sizes, begins = np.array([0, 5, 6, 50, 7, 300]), np.array([1, 2, 8, 15, 66, 74])
    whole = np.concatenate([np.stack(x) for x in grid(sizes, begins)], axis=1)
    assert whole.tolist() == np.concatenate([np.stack(x) for x in grid(sizes, begins, 7)], axis=1).tolist()
    assert whole.shape[1] == sum(-(-(n - q) // (3 * q)) for n in (6, 50, 7, 300) for q in range(1, n // 4 + 1))


def test_runs_of_documents(spark):
    rng = random.Random(7)
    rows = [(i, " ".join("abcdefghijklmn"[x] * 2 for x in some_words(rng))) for i in range(300)] + [(1000, "é é " * 9), (1001, "x " * 5), (1002, "x\ty\v" * 40 + "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    h = F.crc32(F.col("doc_id").cast("string"))
    for repeat in (None, F.when(h % 10 == 0, F.floor(h / 10))):
        got = {r.doc_id: tuple(r)[1:] for r in run_digests(find_runs(docs, repeat_column=repeat)).collect()}
        for i, text in rows:
            c = zlib.crc32(str(i).encode())
            assert got[i] == plain_report(text, c // 10 if repeat is not None and c % 10 == 0 else None), i


def test_ties_take_the_first_run(spark):
    got = run_digests(find_runs(spark.createDataFrame([(1, "a b " * 4 + "c " + "d e " * 4)], "doc_id long, text string"))).head()
    assert (got.n_runs, got.start, got.length, got.period, got.exponent_milli) == (2, 0, 8, 2, 4000)


# Centroid clustering


def plain_clusters(rows, clusters, rounds):
    kept = [(i, [floor(256 * x) for x in v]) for i, v in rows]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        by = defaultdict(list)
        for _, v in kept:
            by[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(by[k]) for x in zip(*by[k], strict=True)] if by[k] else c for k, c in enumerate(centroids)]
    found = [(i, nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, (d, k) in found:
        inertia[k] += d
    return sorted((str(i), k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, (d, k) in found)


def clustered(spark, rows, clusters=5, rounds=4, **options):
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "vec_id long, embedding array<double>, cluster int, vector string, ids string").repartition(3)
    members, centroids, popped = cluster_vectors(table, clusters, rounds, dims=4, **options)
    return sorted((str(r[0]), *tuple(r)[1:]) for r in cluster_report(members, centroids).collect()), popped


def test_clusters_equal_plain_rounds(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(m, 0.5) for m in rng.choice([(0, 0, 0, 0), (1, 0, 2, 0), (-1, 3, 0, 1), (4, 4, 4, 4)])]) for i in range(400)]
    rows += [(k, [0.25, 0.5, -0.75, 1.0]) for k in (900, 901, 901, 902)] + [(None, [1.0, 1.0, 1.0, 1.0])] * 2  # ties, repeated rows, no id
    got, popped = clustered(spark, rows, block=64)
    assert got == plain_clusters(rows, 5, 4)
    assert popped[0] == len(rows) and sum(popped[2:]) < len(rows) * 3 / 2  # most gaps hold: those vectors aren't compared again


@pytest.mark.parametrize("clusters", [1, 2, 40])
def test_few_vectors_and_equal_vectors(spark, clusters):
    rows = [(i, [0.5, 0.5, 0.0, 0.0]) for i in range(6)] + [(7, [2.0, 0.0, 0.0, -1.0])]
    assert clustered(spark, rows, clusters)[0] == plain_clusters(rows, clusters, 4)


def test_unusable_vectors_are_left_out(spark):
    rows = [(1, None), (2, []), (3, [1.0] * 3), (4, [1.0, None, 1.0, 1.0]), (5, [1.0, nan, 1.0, 1.0]), (6, [1.0, -inf, 1.0, 1.0]), (7, [1.0] * 4), (8, [1e300] * 4), (9, [-1e300] * 4)]
    got, _ = clustered(spark, rows, 3)
    assert [r[0] for r in got] == ["7", "8", "9"]
    assert clustered(spark, rows[:6])[0] == []
    assert clustered(spark, [])[0] == []


def test_heaps_and_drifts():
    heaps = Heaps(2)
    heaps.push(np.arange(6), np.array([0, 0, 0, 1, 1, 1]), np.array([3.0, 1.0, 2.0, 1.0, 5.0, 0.5]))
    heaps = Heaps.load(*heaps.save())
    assert heaps.pop_expired(np.array([1.5, 0.5])).tolist() == [1, 5]
    assert heaps.pop_expired(np.array([9.0, 1.0])).tolist() == [0, 2, 3]
    old, new = np.array([[0, 0], [0, 0], [0, 0]]), np.array([[3, 4], [0, 1], [0, 0]])
    assert np.allclose(drifts(old, new), [6, 6, 5])
    big = np.array([[1 << 26, -(1 << 26)]], np.int64)
    assert squared_distances(big, -big).tolist() == [[2 << 54]]


# Web archives


def plain_pages(rows, least=0):
    last = {}
    for i, _, t in rows:
        if i is not None:
            last[t or ""] = max(i, last.get(t or "", i))
    out = []
    for i, _, t in rows:
        raw = (t or "").encode()
        refers = last.get(t or "") if len(raw) >= least and last.get(t or "") != i else None
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(map(str, out))


PAGES = [
    (1, "http://a.example.org/x?y=1", "same"), (2, "https://A.example.org/x?y=1#z", "same"), (3, None, "same"), (None, "http://b.example/", "same"), (4, "not a url", None), (5, "", ""),
    (6, "http://b.example", "\r\n\r\nWARC/1.1\r\n"), (6, "http://b.example", "\r\n\r\nWARC/1.1\r\n"), (7, "http://c.example/ä ö\r\nX: 1", "é𝄞" * 10), (None, "http://d.example/", "only without ids"),
    (None, "http://d.example/", "only without ids"), (8, "http://c.example/" + "a" * 5000, "long " * 300_000), (9, "ftp://[bad", "x\x00y"),
]


def pages_table(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash", 1, 2, "f") for r in rows], "page_id long, url string, html string, payload string, id long, last long, file string").repartition(3)


@pytest.mark.parametrize("least", [0, 5])
def test_archives_give_the_pages_back(spark, least):
    folder = Steps(spark, "test-warc").folder
    index = write_archives(pages_table(spark), folder, min_bytes=least, bytes_per_file=600, captured=F.col("page_id") * 1000, captures_per_shard=4)
    got = read_captures(spark, folder).collect()
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(str(tuple(r[n] for n in names)) for r in got) == plain_pages(PAGES, least)
    assert read_archives(spark, folder).count() == index.count() == len(PAGES)


def test_captures_are_in_one_order(spark):
    rng = random.Random(9)
    rows = [(i, f"http://{'hot' if rng.random() < 0.4 else rng.choice('abc')}.example/{rng.randrange(3)}", f"page {i % 150}") for i in range(500)]
    folder = Steps(spark, "test-warc").folder
    write_archives(pages_table(spark, rows), folder, captured=F.col("page_id") * 7919 % 1000, captures_per_shard=40)
    got = sorted(read_captures(spark, folder).collect(), key=lambda r: (r.shard, r.nth))
    order = [(r.url_key, r.captured, r.page_id) for r in got]
    assert order == sorted(order) and len({r.shard for r in got}) > 5
    assert sorted(r.page_id for r in got) == list(range(500))
    assert max(Counter(r.shard for r in got).values()) < 150  # the hot URL's history is spread


def test_records_follow_the_format(spark):
    folder = Steps(spark, "test-warc").folder
    write_archives(pages_table(spark).coalesce(1), folder)
    store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    seen, names = Counter(), {}
    for f in store.get_file_info(fs.FileSelector(f"{path}/archives")):
        with store.open_input_stream(f.path, compression=None) as stream:
            for _, content in members(stream, 100):
                fields, block = parse_record(content)
                seen[fields["WARC-Type"]] += 1
                if fields["WARC-Type"] == "response":
                    names[fields["WARC-Record-ID"]] = fields["WARC-Payload-Digest"]
                    assert block.startswith(b"HTTP/1.1 200 OK\r\n")
        with store.open_input_stream(f.path, compression=None) as stream:
            revisits = [x for x, _ in (parse_record(c) for _, c in members(stream)) if x["WARC-Type"] == "revisit"]
            assert all(names.get(x["WARC-Refers-To"], x["WARC-Payload-Digest"]) == x["WARC-Payload-Digest"] for x in revisits)
    assert seen["warcinfo"] and seen["response"] + seen["revisit"] == len(PAGES)


def test_a_changed_archive_is_an_error(spark):
    with pytest.raises(ValueError):
        parse_record(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n")
    with pytest.raises((ValueError, zlib.error)):
        list(members(__import__("io").BytesIO(zlib.compress(b"x" * 100)[:20])))


def test_loser_tree_merges_sorted_lists():
    rng = random.Random(10)
    for k in range(0, 12):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(8))) for _ in range(k)]
        assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_keys(spark):
    rows = [("http://WWW.Example.org/a/b?c=d#e",), ("https://example.org",), ("nothing",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "u string").select(url_key(F.col("u"))).collect()]
    assert got == ["org,example,www)/a/b?c=d", "org,example)/", "nothing", ""]


# All three


def vectors(docs):
    table = docs.select("*", F.array([F.col("row").cast("double")] * 64).alias("embedding"))
    members_, centroids, _ = cluster_vectors(table, 4, 2, "doc_id")
    return cluster_report(members_, centroids, "doc_id")


def archived(docs):
    folder = Steps(docs.sparkSession, "test-warc").folder
    write_archives(docs, folder, "doc_id", "source", "text")
    return read_captures(docs.sparkSession, folder).select(F.col("page_id").alias("doc_id"), "payload_digest", "record_type", "refers_to")


OPERATORS = {"runs": lambda d: run_digests(find_runs(d)), "clusters": vectors, "archives": archived}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_give_one_row_each(spark, name):
    got = OPERATORS[name](plain.odd(spark).repartition(3)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in plain.ODD)
    assert sorted(map(str, got)) == sorted(map(str, OPERATORS[name](plain.odd(spark)).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](plain.odd(spark).limit(0)).collect() == []


def test_merge_of_no_runs(spark):
    from creditloom.llm.warc import CAPTURE

    assert merge_runs(spark.createDataFrame([], CAPTURE)).collect() == []
