"""Tables that are changed in place and logs that fold."""

import os

import pytest
from pyspark.sql import functions as F

from keelson.operators import maintenance as M
from keelson.sources import batchlog, filed
from keelson.sources.versions import Files, advance, current


def contents(df):
    return sorted(map(tuple, df.collect()), key=str)


def people(spark, n=200):
    return spark.range(n).selectExpr("id", "concat('n', id) AS name", "id % 3 AS owner", "'old' AS updated_at")


def files_of(spark, path, buckets=None):
    return {f.split(str(path))[1] for f in filed.read(spark, path, buckets).inputFiles()}


def test_a_patch_rewrites_only_the_buckets_it_touches(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    filed.create(people(spark), path, "id", buckets=16)
    before = files_of(spark, path)
    patches = rows([(3, 1, "x", True, None, False), (3, 2, None, True, 9, True), (7, 1, "y", True, 5, False), (999, 1, "z", True, 1, True)],
                   "id long, seq int, name string, set_name boolean, owner long, set_owner boolean")
    want = contents(M.apply_patches(people(spark), patches, "id", ["name", "owner"], "seq", F.lit("new")))
    touched = M.patch_in_place(spark, path, patches, ["name", "owner"], "seq", F.lit("new"), mark=5)
    assert contents(filed.read(spark, path)) == want
    assert 1 <= len(touched) <= 3
    now = files_of(spark, path)
    assert {f for f in now if "gen=1" in f} == files_of(spark, path, touched)
    assert now & before == before - {f for f in before if int(f.split("_bucket=")[1].split("/")[0]) in touched}
    # the plan reads the folders of the touched buckets and no other
    plan = filed.read(spark, path, touched)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    read = filed.read(spark, path, touched)._jdf.queryExecution().sparkPlan().collectLeaves().head().relation().location()
    assert sorted(int(str(p).split("_bucket=")[1]) for p in read.rootPaths().mkString(" ").split()) == touched
    # a batch is applied once
    assert M.patch_in_place(spark, path, patches, ["name", "owner"], "seq", F.lit("later"), mark=5) == []
    assert contents(filed.read(spark, path)) == want


def test_deletes_and_children(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    filed.create(people(spark), path, "id", buckets=8)
    M.delete_in_place(spark, path, rows([(1, 1), (2, 0), (None, 0)], "id long, owner long"), ["id", "owner"])
    assert {r[0] for r in contents(filed.read(spark, path))} == set(range(200)) - {1}
    gone = rows([(2,), (77,)], "k long")
    nulled = M.set_null_children(filed.read(spark, path), gone, "owner", "k")
    want = contents(nulled)
    M.set_null_in_place(spark, path, gone, "owner", "k")
    assert contents(filed.read(spark, path)) == want
    M.cascade_in_place(spark, path, rows([(0,)], "k long"), "owner", "k")
    assert contents(filed.read(spark, path)) == [r for r in want if r[2] != 0]
    assert M.cascade_in_place(spark, path, rows([(50,)], "k long"), "owner", "k") == []
    with pytest.raises(ValueError):
        M.set_null_in_place(spark, path, gone, "id", "k")


def test_generations_stay_bounded_and_a_dead_writer_leaves_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    filed.create(people(spark, 10), path, "id", buckets=4)
    for i in range(6):
        reader = filed.read(spark, path)
        filed.upsert(spark, path, rows([(1, f"v{i}", i, "t"), (100 + i, "a", 0, "t")], "id long, name string, owner long, updated_at string"))
        reader.collect()  # files of the state before the current one are still there
    assert filed.read(spark, path).filter("id = 1").first()["name"] == "v5" and filed.read(spark, path).count() == 16
    folders = [f for g in os.listdir(path) if g.startswith("gen=") for f in os.listdir(f"{path}/{g}") if f.startswith("_bucket")]
    assert len(folders) <= 2 * 4 and len(os.listdir(f"{path}/_state")) <= 2 * 2
    # files written by a change that never reached its state do not count, and are written over
    number = current(Files(spark, path))[0]
    people(spark, 5).write.parquet(f"{path}/gen={number + 1}/_bucket=3")
    assert filed.read(spark, path).count() == 16
    filed.upsert(spark, path, rows([(1, "last", 0, "t")], "id long, name string, owner long, updated_at string"))
    assert filed.read(spark, path).count() == 16
    with pytest.raises(RuntimeError):
        advance(Files(spark, path), number + 1, {"folders": []})
    with pytest.raises(ValueError):
        filed.change(spark, path, [0], lambda old: people(spark))


def test_empty_tables_null_keys_and_clashing_names(spark, rows, tmp_path):
    schema = "id string, bucket int, gen string, `_k` int"
    filed.create(rows([], schema), str(tmp_path / "e"), "id")
    assert filed.read(spark, str(tmp_path / "e")).count() == 0
    filed.upsert(spark, str(tmp_path / "e"), rows([(None, 1, "g", 2), ("a", 3, "h", 4)], schema))
    assert contents(filed.read(spark, str(tmp_path / "e"))) == [("a", 3, "h", 4), (None, 1, "g", 2)]
    with pytest.raises(FileExistsError):
        filed.create(rows([], schema), str(tmp_path / "e"), "id")
    with pytest.raises(FileNotFoundError):
        filed.read(spark, str(tmp_path / "none"))


def test_two_hundred_batches_leave_few_files(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(200):
        batch = spark.range(i, i + 1 if i % 7 else i, 1, 1).selectExpr("id", "concat('b', id) AS v")
        batchlog.append(batch, path, i)
        if i % 50 == 10:
            batchlog.append(batch, path, i)  # repeated after a failure
    assert sorted(r["id"] for r in batchlog.read(spark, path).collect()) == [i for i in range(200) if i % 7]
    folders = [f for f in os.listdir(path) if f.startswith("batches-")]
    assert len(folders) <= 40 and batchlog.mark(spark, path) == 199
    assert len(batchlog.read(spark, path).inputFiles()) <= 20
    assert batchlog.read(spark, str(tmp_path / "never")) is None
