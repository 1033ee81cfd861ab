"""Published versions, the merge table in buckets, streams that write them, and the order of lines."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from quire.operators import merge as MG
from quire.sources import documents as D
from quire.sources.versions import Part, Store, current_folder, publish
from quire.streaming import jobs as J
from quire.streaming.buckets import MergeTable

PUBS = "id string, doi string, ord long, title string"


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="quire-test-")


def files(path: str) -> dict[str, int]:
    """Data files under a folder with their times."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


# -- publishing --------------------------------------------------------------------------

def test_same_content_twice_makes_one_version(spark, folder):
    rows = spark.createDataFrame([(i, f"t{i}", None if i % 3 else 1.5) for i in range(50)], "i int, t string, d double")
    assert D.write_if_changed(rows, folder)
    before = files(folder)
    assert not D.write_if_changed(rows.repartition(5).orderBy(F.desc("i")), folder) and files(folder) == before
    assert D.write_if_changed(rows.withColumn("t", F.upper("t")), folder)
    assert D.read_version(spark, folder).filter("t = 'T7'").count() == 1
    # one row twice is another content, as is another type of the same values
    assert D.write_if_changed(rows.unionByName(rows.limit(1)), folder) and D.write_if_changed(rows.unionByName(rows.limit(1)).withColumn("i", F.col("i").cast("long")), folder)
    assert len(Store(spark, folder).numbers()) == 2 and len([n for n in os.listdir(folder) if n.startswith("v=")]) == 2


def test_content_is_computed_once(spark, folder):
    calls = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            calls.add(len(f))
            yield f

    rows = spark.range(40).mapInPandas(counted, "id long")
    assert D.write_if_changed(rows, folder) and calls.value == 40
    assert not D.write_if_changed(rows, folder) and calls.value == 80


def test_failed_write_leaves_the_version(spark, folder):
    rows = spark.range(10)
    assert D.write_if_changed(rows, folder)
    with pytest.raises(Exception):
        D.write_if_changed(rows.select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id")), folder)
    assert D.read_version(spark, folder).count() == 10
    assert D.write_if_changed(spark.range(11), folder) and D.read_version(spark, folder).count() == 11


def test_empty_table_need_not_replace(spark, folder):
    assert D.write_if_changed(spark.range(3), folder)
    assert not D.write_if_changed(spark.range(0), folder, allow_empty=False) and D.read_version(spark, folder).count() == 3
    assert D.write_if_changed(spark.range(0), folder) and D.read_version(spark, folder).count() == 0


def test_date_alone_makes_no_version(spark, folder):
    def write(n, day):
        meta = spark.createDataFrame([(day,)], "day string")
        return publish(spark, folder, {"rows": Part(spark.range(n), lambda df, to: df.write.parquet(to)), "about": Part(meta, lambda df, to: df.write.json(to), about=True)})
    assert [write(5, "a"), write(5, "b"), write(6, "b")] == [True, False, True]
    assert spark.read.json(f"{current_folder(spark, folder)}/about").first()["day"] == "b"


def test_second_writer_of_a_number_is_refused(spark, folder):
    Store(spark, folder).commit(0, {"folder": "a"})
    with pytest.raises(FileExistsError):
        Store(spark, folder).commit(0, {"folder": "b"})
    assert Store(spark, folder).current() == (0, {"folder": "a"})
    with pytest.raises(FileNotFoundError):
        current_folder(spark, folder + "/none")


# -- the merge table ---------------------------------------------------------------------

def titles(df):
    return sorted((r["id"], r["doi"] or "", r["title"]) for r in df.collect())


def test_batch_rewrites_its_own_buckets(spark, folder):
    base = spark.createDataFrame([(f"i{k}", f"10.1/{k}", k, f"t{k}") for k in range(400)], PUBS)
    table = MergeTable.create(spark, folder, base, buckets=32)
    before = files(f"{folder}/rows") | files(f"{folder}/keys")
    batch = spark.createDataFrame([("i7", "10.1/7", 0, "new title"), ("n", "10.1/9", 1, "by doi"), ("i11", "10.1/11", 2, "t11")], PUBS)
    assert table.merge_batch(batch, 0)
    new = (files(f"{folder}/rows") | files(f"{folder}/keys")).keys() - before.keys()
    assert 1 <= len(new) == len(table.written()["rows"]) <= 2 and table.written()["keys"] == []  # i11 holds its content already
    assert [r for r in titles(table.read()) if r[2] in ("new title", "by doi")] == [("i7", "10.1/7", "new title"), ("i9", "10.1/9", "by doi")]
    # the same batch again writes nothing
    seen, version = files(folder), Store(spark, folder).numbers()
    assert not table.merge_batch(batch, 0) and files(folder) == seen and Store(spark, folder).numbers() == version
    # another stream has its own numbers
    assert table.merge_batch(spark.createDataFrame([("i7", "10.1/7b", 0, "x")], PUBS), 0, "other") and len(table.written()["keys"]) in (1, 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_whole_table_merges(spark, folder, seed):
    rng = random.Random(seed)
    whole = spark.createDataFrame([(f"c{k}", rng.choice([None, f"10.1/{k}"]), k, f"o{k}") for k in range(12)], PUBS)
    table = MergeTable.create(spark, folder, whole, buckets=5)
    for n in range(3):
        batch = spark.createDataFrame([(rng.choice([f"c{k}" for k in range(12)] + [f"n{k}" for k in range(12)]), rng.choice([None, None] + [f"10.1/{k}" for k in range(20)]),
                                        k, f"t{n}.{k}") for k in range(8)], PUBS)
        whole = spark.createDataFrame(MG.merge(whole, batch)[0].select("id", "doi", "ord", "title").collect(), PUBS)
        assert table.merge_batch(batch, n)
        assert titles(table.read()) == titles(whole)
    assert len(Store(spark, folder).numbers()) == 2
    live = {f for m in Store(spark, folder).numbers() for f in [Store(spark, folder).manifest(m)]  # folders of the last two versions only
            for f in [f"{p}/v={v}/bucket={b}" for p in ("rows", "keys") for b, v in enumerate(f[p])]}
    assert set(table._folders()) <= live


def test_crash_before_the_commit(spark, folder, monkeypatch):
    table = MergeTable.create(spark, folder, spark.createDataFrame([("a", "10.1/a", 0, "A")], PUBS), buckets=2)
    batch = spark.createDataFrame([("a", "10.1/a", 0, "A2"), ("b", None, 1, "B")], PUBS)
    with monkeypatch.context() as m:
        m.setattr(Store, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.merge_batch(batch, 0)
    assert titles(table.read()) == [("a", "10.1/a", "A")]
    assert table.merge_batch(batch, 0) and titles(table.read()) == [("a", "10.1/a", "A2"), ("b", "", "B")]


def test_merge_stream_over_several_batches(spark, folder):
    base = spark.createDataFrame([(f"i{k}", f"10.1/{k}", k, "old") for k in range(20)], PUBS)
    for n in range(3):
        spark.createDataFrame([(f"i{k}", f"10.1/{k}", k, f"b{n}") for k in range(n, 20, 5)] + [(f"x{n}", None, 99, f"b{n}")], PUBS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(PUBS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for _ in range(2):  # the second run finds nothing new
        J.merge_stream(stream, base, f"{folder}/table", f"{folder}/ckpt", buckets=4).awaitTermination()
    got = {r["id"]: (r["title"], r["side"]) for r in J.latest_version(spark, f"{folder}/table").collect()}
    assert {i: t for i, (t, _) in got.items()} == {f"i{k}": f"b{k % 5}" if k % 5 < 3 else "old" for k in range(20)} | {f"x{n}": f"b{n}" for n in range(3)}
    assert {i: s for i, (_, s) in got.items() if s} == {"x0": 1, "x1": 2, "x2": 3}


# -- screening a stream ------------------------------------------------------------------

def test_late_rows_are_screened_and_kept(spark, folder):
    batches = [[("a", "2024-03-01", "good"), ("b", "2024-03-05", "bad")],
               [("c", "2024-01-01", "good"), ("a", "2024-03-06", "bad"), ("d", "2024-03-02", "x"), (None, None, "good")],
               [("c", "2024-03-09", "bad"), ("e", "2024-02-20", "bad"), ("k", "2024-01-01", "good")]]
    for rows in batches:
        df = spark.createDataFrame(rows, "doi string, ts string, text string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("doi string, ts timestamp, text string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    known = spark.createDataFrame([("k",)], "doi string")
    for _ in range(2):
        J.screen_into(stream, known, ["good"], ["bad"], f"{folder}/out", f"{folder}/ckpt", "10 days").awaitTermination()
    got = [sorted((r["doi"] or "-", r["outcome"], r["batch"]) for r in J.arrivals(spark, f"{folder}/out", late).collect()) for late in (False, True)]
    assert got == [[("-", "queued", 1), ("a", "queued", 0), ("b", "rejected", 0), ("d", "review", 1)], [("c", "queued", 1), ("e", "rejected", 2)]]


# -- order of lines ----------------------------------------------------------------------

@pytest.mark.parametrize("split", ["64", "1000", "100m"])
def test_first_line_is_kept_for_any_packing(spark, folder, split):
    rng, want, first = random.Random(4), [], set()
    for n in range(5):
        lines = [f"DOI:10.1/U{rng.randint(0, 60)}" + " " * rng.randint(0, 9) for _ in range(rng.choice([3, 200]))]
        with open(f"{folder}/f{n}.txt", "w") as out:
            out.write("\n".join(lines) + "\n")
        for k, line in enumerate(lines):
            key = line.strip()[4:].lower()
            if key not in first:
                first.add(key)
                want.append(key)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        got = [r["value"] for r in D.read_tokens(spark, folder, ["doi"], legacy=True)[0].orderBy("ord").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want
