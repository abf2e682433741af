"""Lake tables: snapshots, buckets, merges, names in the catalog."""

import pytest
from pyspark.sql import functions as F

from creditloom.session import scratch_path
from creditloom.sources.lake import BUCKET, WRITE, Lake


def test_upsert_twice_is_once_and_null_keys_match(spark):
    lake = Lake(spark, scratch_path(spark, "lake-test"))
    first = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "id long, k string, v string")
    second = spark.createDataFrame([(1, None, "c"), (3, "y", "d")], "id long, k string, v string")
    lake.upsert(first, "t", ["id", "k"])
    for _ in range(2):
        lake.upsert(second, "t", ["id", "k"])
    assert sorted(map(tuple, lake.read("t").collect())) == [(1, None, "c"), (2, "x", "b"), (3, "y", "d")]
    with pytest.raises(ValueError):
        lake.upsert(second, "t", [])
    with pytest.raises(ValueError):
        lake.upsert(second.unionByName(second), "t", ["id", "k"])
    assert lake.read("t", "id > 2").count() == 1


def rows(spark, ids, v="a"):
    return spark.createDataFrame([(i, f"{v}{i}") for i in ids], "id long, v string")


def content(lake, table="t", **options):
    return sorted(map(tuple, lake.read(table, **options).collect()))


def test_failed_append_leaves_the_old_rows(spark):
    lake = Lake(spark, scratch_path(spark, "lake-test"))
    lake.write(rows(spark, range(3)), "t")
    # Some tasks write their files before another fails: no manifest, so no reader sees them.
    bad = spark.range(100, 200, 1, 10).select("id", F.when(F.col("id") == 195, F.raise_error(F.lit("lost")).cast("string")).otherwise("x").alias("v"))
    with pytest.raises(Exception, match="lost"):
        lake.write(bad, "t")
    assert content(lake) == [(0, "a0"), (1, "a1"), (2, "a2")]
    lake.write(rows(spark, [7]), "t")
    assert len(content(lake)) == 4 and len(content(lake, version=1)) == 3


def test_upsert_rewrites_the_buckets_that_it_hits(spark):
    lake = Lake(spark, scratch_path(spark, "lake-test"), buckets=8)
    lake.upsert(rows(spark, range(200)), "t", ["id"])
    before = {tuple(p) for p in lake.snapshot("t").parts}
    assert {b for _, b in before} == set(range(8))
    lake.upsert(rows(spark, [17], "b"), "t", ["id"])
    after = {tuple(p) for p in lake.snapshot("t").parts}
    assert len(before & after) == 7 and len(after) == 8
    assert content(lake) == sorted([(i, f"a{i}") for i in range(200) if i != 17] + [(17, "b17")])
    assert spark.read.parquet(f"{lake.root}/t/data/{WRITE}={(after - before).pop()[0]}").count() < 60
    assert content(lake, version=1) == sorted((i, f"a{i}") for i in range(200))


def test_updates_run_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    lake = Lake(spark, scratch_path(spark, "lake-test"))
    lake.upsert(rows(spark, range(10)), "t", ["id"])
    lake.upsert(rows(spark, range(5, 15), "b").mapInPandas(count, "id long, v string"), "t", ["id"])
    assert seen.value == 10
    assert len(content(lake)) == 15


def test_repeated_keys_fail_and_leave_the_table(spark):
    lake = Lake(spark, scratch_path(spark, "lake-test"))
    for first in (rows(spark, [1, 1]), rows(spark, [1, 2])):
        if first.distinct().count() < 2:
            with pytest.raises(ValueError, match="repeated"):
                lake.upsert(first, "t", ["id"])
            assert not lake.exists("t")
        else:
            lake.upsert(first, "t", ["id"])
    with pytest.raises(ValueError, match="repeated"):
        lake.upsert(rows(spark, [3, 3, 1], "b"), "t", ["id"])
    assert content(lake) == [(1, "a1"), (2, "a2")]


def test_appended_rows_and_other_keys(spark):
    lake = Lake(spark, scratch_path(spark, "lake-test"), buckets=4)
    lake.write(rows(spark, [1, 2]), "t", partition_by=["v"])
    lake.write(rows(spark, [1]).select("v", "id"), "t")  # the same row twice, columns in another order
    assert content(lake, where="v = 'a1'") == [(1, "a1")] * 2
    lake.upsert(rows(spark, [1, 5], "b"), "t", ["id"])  # dealt anew by the key; both copies are replaced
    assert content(lake) == [(1, "b1"), (2, "a2"), (5, "b5")]
    lake.write(rows(spark, [5]), "t")
    lake.upsert(rows(spark, [5], "c"), "t", ["id"])
    assert content(lake) == [(1, "b1"), (2, "a2"), (5, "c5")]
    with pytest.raises(ValueError, match="columns"):
        lake.write(spark.range(2), "t")
    with pytest.raises(ValueError, match="columns"):
        lake.upsert(spark.range(2), "t", ["id"])


def test_empty_writes_and_updates(spark):
    lake = Lake(spark, scratch_path(spark, "lake-test"))
    lake.write(rows(spark, []), "t")
    assert content(lake) == []
    lake.upsert(rows(spark, []), "t", ["id"])
    lake.upsert(rows(spark, [1]), "t", ["id"])
    lake.upsert(rows(spark, []), "t", ["id"])
    assert content(lake) == [(1, "a1")]
    lake.write(rows(spark, []), "t", mode="overwrite")
    assert content(lake) == []
    with pytest.raises(FileNotFoundError):
        lake.read("none")


def test_two_writers_of_one_version(spark):
    lake = Lake(spark, scratch_path(spark, "lake-test"))
    lake.write(rows(spark, [1]), "t")
    late = lake.snapshot("t")
    late.version += 1
    lake.write(rows(spark, [2]), "t")
    with pytest.raises(RuntimeError, match="another writer"):
        lake._commit("t", late)
    assert len(content(lake)) == 2


def test_names_in_the_catalog(spark):
    root = scratch_path(spark, "lake-test")
    schema = "lake_" + root.rsplit("-", 1)[1]
    lake = Lake(spark, root, buckets=4, schema=schema)
    lake.write(rows(spark, [1, 2]), "t", partition_by=["v"])
    assert spark.table(f"{schema}.t").count() == 2
    other = Lake.named(spark, schema, buckets=4)
    other.upsert(rows(spark, [2, 3], "b"), "t", ["id"])
    other.upsert(rows(spark, [3], "c"), "t", ["id"])
    assert sorted(map(tuple, spark.sql(f"SELECT id, v FROM {schema}.t").collect())) == content(lake) == [(1, "a1"), (2, "b2"), (3, "c3")]
    spark.sql(f"DROP VIEW {schema}.t")
    spark.sql(f"DROP DATABASE {schema}")


def test_remove_unused(spark):
    lake = Lake(spark, scratch_path(spark, "lake-test"), buckets=4)
    lake.upsert(rows(spark, range(40)), "t", ["id"])
    lake.upsert(rows(spark, [3], "b"), "t", ["id"])
    lake.upsert(rows(spark, [3], "c"), "t", ["id"])
    before = content(lake)
    lake.remove_unused("t")
    assert content(lake) == before
    held = {(w.removeprefix(f"{WRITE}="), int(b.removeprefix(f"{BUCKET}="))) for w in lake._names(f"{lake.root}/t/data") for b in lake._names(f"{lake.root}/t/data/{w}") if b.startswith(BUCKET)}
    assert held == {tuple(p) for p in lake.snapshot("t").parts}
    assert lake.snapshot("t", 1) is None
