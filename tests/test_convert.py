import io
import contextlib
import json
import os

import pytest
from pyspark.sql import functions as F

from placeweave.api import AddressEngine
from placeweave.operators import convert as conversion
from placeweave.operators import status
from placeweave.operators.convert import AddressGroup, plan_columns
from placeweave.plans import mapping as mappings
from placeweave.sources import files, sinks, sqldump

FIELDS = list(mappings.FIELDS)
ROWS = [  # ids, old names, new names, new ids
    ("1", "10", "100", "Tỉnh A", "Huyện B", "Xã C", "A mới", "C mới", "91", "9100"),
    ("1", "10", "101", "Tỉnh A", "Huyện B", "Xã D", "A mới", "D1", "91", "9101"),
    ("1", "10", "101", "Tỉnh A", "Huyện B", "Xã D", "A mới", "D2", "91", "9102"),
    ("1", "11", "102", "Tỉnh A", "Huyện E", "Xã F", "A mới", "F1", "91", "9103"),
    ("1", "12", "103", "Tỉnh A", "Huyện G", "Xã F", "A mới", "F2", "91", "9104"),
    ("2", "13", "104", "Tỉnh H", "Huyện I", "Phường 01", "H mới", "P1", "92", "9105"),
]


@pytest.fixture(scope="module")
def mapping(spark):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "ord long, " + ", ".join(f"{f} string" for f in FIELDS))
    return mappings.build(rows)


def run(spark, mapping, rows, columns, groups):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(f"{c} string" for c in columns) + f", {files.ORD} long")
    return conversion.with_ids(conversion.convert(df, groups, mapping), files.ORD)


def test_lookup_paths_and_options(spark, mapping):
    rows = [("A", "B", "C"), ("A", "nowhere", "c"), ("?", "B", "xã D"), ("A", "?", "F"), ("H", "I", "1"), (None, None, None)]
    got = run(spark, mapping, rows, ["p", "d", "w"], [AddressGroup(province="p", district="d", ward="w")])
    assert got.columns == ["id", "province_id_group1", "p", "ward_id_group1", "w", "ward_id_group1_option_2", "w_option_2", "statusState"]
    found = [tuple(r) for r in got.orderBy("id").collect()]
    ok, bad = "Thành công", "Lỗi _group1"
    assert found == [
        (1, "91", "A mới", "9100", "C mới", "", "", ok), (2, "91", "A mới", "9100", "C mới", "", "", ok), (3, "91", "A mới", "9101", "D1", "9102", "D2", ok),
        (4, "", "A", "", "F", "", "", bad), (5, "92", "H mới", "9105", "P1", "", "", ok), (6, "", "", "", "", "", "", bad),
    ]


def test_status_machine(spark):
    rows = spark.createDataFrame([("",), ("Thành công",), ("Lỗi _group1",)], "s string")
    got = rows.select(status.after_hit(F.col("s")), status.after_miss(F.col("s"), "_group2")).collect()
    assert [tuple(r) for r in got] == [("Thành công", "Lỗi _group2"), ("Thành công", "Lỗi _group2"), ("Lỗi _group1", "Lỗi _group1;_group2")]


def test_no_province_and_invalid_group(spark, mapping):
    got = run(spark, mapping, [("B", "C")], ["d", "w"], [AddressGroup(district="d", ward="w"), AddressGroup(ward="w")])
    assert got.columns[:5] == ["id", "province_id_group1", "provinceName_group1", "ward_id_group1", "w"]
    assert got.first()["provinceName_group1"] == "A mới"
    with pytest.raises(ValueError):
        conversion.with_ids(spark.createDataFrame([("1", 0)], f"id string, {files.ORD} long"), files.ORD)


def test_columns_planned_from_names():
    group = AddressGroup("ip", "id", "iw", "p", "d", "w")
    assert plan_columns(["x", "ip", "id", "iw", "p", "d", "w", "statusState"], group, "_group1", 1).columns == ["x", "ip", "p", "iw", "w", "statusState"]


def test_plan_has_no_python_and_no_nested_loops(spark, mapping):
    df = spark.createDataFrame([("a", "b", "c")], "p string, d string, w string")
    out, text = conversion.convert(df, [AddressGroup(province="p", district="d", ward="w")], mapping, 2), io.StringIO()
    with contextlib.redirect_stdout(text):
        out.explain()
    assert not any(x in text.getvalue() for x in ("NestedLoop", "Cartesian", "EvalPython", "SortMergeJoin"))


def test_counts_of_empty_and_null(spark):
    empty = spark.createDataFrame([], "statusState string")
    assert tuple(status.counts(empty, 100.0).first()) == (0, 0, 0, 100.0)
    some = spark.createDataFrame([("Thành công",), (None,), ("x",)], "statusState string")
    assert tuple(status.counts(some).first()) == (3, 1, 2, 33.3)
    assert status.filtered(some, "error").count() == 2 and status.filtered(some, "?").count() == 3


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("007", "x, \"y\"\nz"), ("NA", ""), ("", "it's")], "a string, b string")
    want = sorted((r.a or "", r.b or "") for r in df.collect())
    for write, read, ext in ((sinks.write_csv, files.read_csv, "csv"), (sinks.write_json, files.read_json, "json"), (sinks.write_excel, files.read_excel, "xlsx")):
        path = write(df, str(tmp_path / f"t.{ext}")) or str(tmp_path / f"t.{ext}")
        assert sorted((r.a or "", r.b or "") for r in read(spark, path).select("a", "b").collect()) == want, ext
    sinks.write_sql(df.filter("b not like '%z'"), str(tmp_path / "t.sql"))
    assert {r.b for r in files.read_sql(spark, str(tmp_path / "t.sql"), unescape=True).collect()} == {"", "it's"}


def test_csv_headers_and_encodings(spark, tmp_path):
    (tmp_path / "d.csv").write_bytes("a,a,é\n1,2,ü–\n".encode("cp1252"))
    df = files.read_csv(spark, str(tmp_path / "d.csv"))
    assert df.columns == ["a", "a.1", "é", files.ORD] and df.first()[2] == "ü–"
    (tmp_path / "n.json").write_text('// note\n{"a": 1}\n\n{"a": "x"}\n')
    assert [r.a for r in files.read_json(spark, str(tmp_path / "n.json")).select("a").collect() if r.a] == ["1", "x"]
    with pytest.raises(files.UnsupportedFormat):
        files.read_table(spark, "x.db")


def test_sql_dump_rules():
    ins = "INSERT INTO t (a, b) VALUES "
    assert sqldump.parse(ins + r"(1, 'a'), (NULL, 1.5), ('it\'s', 'it''s'), ('a, (b)', 1e5);")[2] == [[1, "a"], [None, 1.5], [r"it\'s", "it''s"], ["a, (b)", "1e5"]]
    assert sqldump.parse(ins + "(1), (1, 2);")[2:] == ([[1, 2]], ["1 values for 2 columns"])
    for bad in ("INSERT INTO t VALUES (1);", ins + "(1, 2); INSERT INTO u (a, b) VALUES (1, 2);", ins + "(1);"):
        with pytest.raises(sqldump.DumpError):
            sqldump.parse(bad)


def test_engine_end_to_end(spark, tmp_path, mapping):
    body = [{f: r[i] for i, f in enumerate(mappings.FIELDS.values())} for r in ROWS]
    del body[0]["Mã I"]
    body[1]["Mã I"] = None
    (tmp_path / "m.json").write_text(json.dumps(body, ensure_ascii=False))
    engine = AddressEngine.from_file(spark, str(tmp_path / "m.json"), str(tmp_path / "store"))
    assert [r.new_id_province for r in mappings.read_rows(spark, str(tmp_path / "m.json")).orderBy("ord").collect()][:3] == ["", "None", "91"]
    (tmp_path / "in.csv").write_text("province,district,ward,note\nA,B,C,1\nA,E,F,2\nx,y,z,3\nA,B,D,4\nH,I,1,5\n")
    path = str(tmp_path / "in.csv")
    groups = engine.detect(path)
    assert groups == []  # four of five rows match, and a candidate needs more than that
    base = engine.convert(engine.read(path), [AddressGroup(province="province", district="district", ward="ward")])
    engine.tasks.create("t1", filename="in.csv", bogus=1)
    assert engine.tasks.update("t1", progress=120.5, step=2)["progress"] == 100 and engine.tasks.get("t0") is None
    engine.tasks.add_edit("t1", 2, {"note": "fixed", "ward": None, "unknown": "x"})
    engine.tasks.add_edit("t1", 99, {"note": "nowhere"})
    engine.tasks.add_edit("t1", 2, {"note": "again"})
    done = engine.apply_edits("t1", base)
    row = done.filter("id = 3").first()
    assert (row["note"], row["ward"], row["statusState"]) == ("again", None, status.SUCCESS)
    assert done.count() == 5 and engine.counts(done).first()["success"] == 5
    out = engine.export(done, path, "success")
    assert os.path.basename(out) == "in_convert_success.csv" and "statusState" not in files.read_csv(spark, out).columns
    assert os.path.basename(sinks.output_name(path, "success")) == "in_convert_success(1).csv"
