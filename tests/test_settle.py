"""Edits laid into their files; the other files stay as they are."""

import os

from pyspark.sql import functions as F

from placeweave import queries
from placeweave.operators import edits
from placeweave.operators.status import STATUS, SUCCESS


def test_only_files_with_edited_rows_change(spark, tmp_path):
    base = spark.range(1, 4001).select("id", F.concat(F.lit("o"), "id").alias("v"), F.lit("x").alias(STATUS))
    base.repartitionByRange(8, "id").write.parquet(str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    before = {f: os.path.getmtime(f.removeprefix("file:")) for f in edits.files_of(base)}
    made = spark.createDataFrame([(6, {"v": "new"}), (3998, {"v": None}), (99999, {"v": "nowhere"})], "row_index int, edited map<string,string>")
    now = edits.settle(base, made, str(tmp_path / "a b"))
    assert len(before.keys() & set(now)) == len(before) - 2 and before == {f: os.path.getmtime(f.removeprefix("file:")) for f in before}
    done = spark.read.parquet(*now)
    where = {edits.path_of(r.f) for r in done.filter("id in (7, 3999)").select(F.col("_metadata.file_path").alias("f")).collect()}
    assert not where & before.keys()
    assert done.count() == 4000 and done.filter(F.col(STATUS) == SUCCESS).count() == 2
    assert [(r.id, r.v) for r in done.filter("id in (6, 7, 3999)").orderBy("id").collect()] == [(6, "o6"), (7, "new"), (3999, None)]
    assert sorted(edits.settle(done, made.filter("row_index > 9000"), str(tmp_path / "c"))) == sorted(now)
    assert sorted(edits.settle(done, made.limit(0), str(tmp_path / "d"))) == sorted(now)


def test_settled_task_reads_as_before(spark, tmp_path):
    engine, task_id = queries._engine(spark, "/root/testdata/sf0.001")
    engine.update_row(task_id, 3, {"ward": "first"})
    want = sorted(engine.records(task_id).collect())
    assert engine.settle(task_id) >= 2 and sorted(engine.records(task_id).collect()) == want
    engine.update_row(task_id, 3, {"ward": "second"})
    assert engine.row(task_id, 3)["ward"] == "second" and engine.tasks.original_of(task_id, 2)["ward"] != "first"
