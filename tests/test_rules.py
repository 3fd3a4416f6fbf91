"""Rules that SQL cannot see: exact rounding, broken files, dates, encodings, edits without fields, tasks."""

import zipfile

import pytest
from pyspark.sql import functions as F

from placeweave.api import AddressEngine, NotFound
from placeweave.operators import detect, ordering, status
from placeweave.operators.convert import AddressGroup
from placeweave.plans import mapping as mappings
from placeweave.sources import files, sinks, xlsx
from placeweave.tasks import TaskStore, elapsed, new_id

UNITS = [("Tỉnh A", "Huyện B", "Xã C"), ("Tỉnh A", "Huyện B", "Xã D"), ("Tỉnh H", "Huyện I", "Phường K")]


@pytest.fixture(scope="module")
def mapping(spark):
    fields = list(mappings.FIELDS)
    rows = [(k, "1", "2", "3", p, d, w, f"{p} mới", f"{w} mới", "91", f"9{k}") for k, (p, d, w) in enumerate(UNITS)]
    return mappings.build(spark.createDataFrame(rows, "ord long, " + ", ".join(f"{f} string" for f in fields)))


def test_percent_equals_round(spark):
    pairs = [(s, t) for t in (0, 1, 3, 7, 40, 400, 800, 2000, 4000, 12345) for s in range(0, t + 1, max(1, t // 401))]
    got = spark.createDataFrame(pairs, "s long, t long").select("s", "t", status.percent(F.col("s"), F.col("t"), 100.0).alias("p")).collect()
    assert [(r.s, r.t, r.p) for r in got if r.p != (round(r.s / r.t * 100, 1) if r.t else 100.0)] == []


def test_broken_json_is_told(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"zeta": 1, "alpha": {"x": 2}}\n{bad\n// note\n\n{"alpha": null, "mid": 1.25}\n')
    with pytest.raises(Exception, match="malformed"):
        files.read_json(spark, str(tmp_path / "lines.json"))
    kept = files.read_json(spark, str(tmp_path / "lines.json"), corrupt="broken").drop(files.ORD)
    assert kept.columns == ["zeta", "alpha", "mid", "broken"]
    assert [tuple(r) for r in kept.collect()] == [("1", '{"x":2}', None, None), (None, None, None, "{bad"), (None, None, "1.25", None)]
    (tmp_path / "cut.json").write_text('[{"a": 1}, {"a": ')
    with pytest.raises(Exception, match="malformed"):
        files.read_json(spark, str(tmp_path / "cut.json"))
    (tmp_path / "array.json").write_text('﻿[\n {"b": 1, "a": "x"},\n {"c": true}\n]')
    rows = files.read_json(spark, str(tmp_path / "array.json"))
    assert rows.columns == ["b", "a", "c", files.ORD] and [tuple(r)[:3] for r in rows.collect()] == [("1", "x", None), (None, None, "true")]


def test_encodings_are_told_by_bytes(spark, tmp_path):
    for name, data, want in (("u", "a\nô �\n".encode(), "UTF-8"), ("w", "a\nü–\n".encode("cp1252"), "windows-1252"), ("l", b"a\n\xfc\x81\n", "ISO-8859-1")):
        (tmp_path / f"{name}.csv").write_bytes(data)
        assert files.encoding_of(spark, str(tmp_path / f"{name}.csv")) == want
    assert files.read_csv(spark, str(tmp_path / "u.csv")).first()["a"] == "ô �"


def test_csv_splits_unless_a_value_has_a_break(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x ""y"""\n')
    (tmp_path / "b.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert not files.look(spark, str(tmp_path / "a.csv")).quoted_breaks and files.look(spark, str(tmp_path / "b.csv")).quoted_breaks
    assert files.read_csv(spark, str(tmp_path / "a.csv")).first()["b"] == 'x "y"'
    assert [r.b for r in files.read_table(spark, str(tmp_path / "b.csv")).collect()] == ["x\ny", "z"]
    assert files.count_rows(spark, str(tmp_path / "b.csv")) == 2  # records, not lines


def test_excel_dates_and_numbers(spark, tmp_path):
    path = str(tmp_path / "t.xlsx")
    xlsx.write(path, ["d", "n"], [["x", "1"]])
    styles = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/><numFmt numFmtId="165" formatCode="0.00&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
    cells = '<row r="2"><c r="A2" s="1"><v>45322</v></c><c r="B2"><v>0.10000000000000001</v></c></row><row r="3"><c r="A3" s="2"><v>45322.5</v></c><c r="B3" s="3"><v>3</v></c></row><row r="4"><c r="A4" s="1"><v>0.25</v></c><c r="B4" t="b"><v>1</v></c></row>'
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    sheet = parts["xl/worksheets/sheet1.xml"].decode()
    parts["xl/worksheets/sheet1.xml"] = (sheet[: sheet.index('<row r="2">')] + cells + "</sheetData></worksheet>").encode()
    with zipfile.ZipFile(path, "w") as z:
        for n, data in (parts | {"xl/styles.xml": styles.encode()}).items():
            z.writestr(n, data)
    got = [tuple(r)[:2] for r in files.read_excel(spark, path).select("d", "n").collect()]
    assert got == [("2024-01-31T00:00:00", "0.1"), ("2024-01-31T12:00:00", "3"), ("06:00:00", "True")]


def test_json_array_and_sql_of_no_rows(spark, tmp_path):
    import json

    df = spark.createDataFrame([("x", None), ("ô", 2)], "b string, a int").coalesce(1)
    sinks.write_json(df, str(tmp_path / "j"), array=True)
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    assert json.loads(text) == [{"b": "x", "a": None}, {"b": "ô", "a": 2}]
    sinks.write_json(df.limit(0), str(tmp_path / "none"), array=True)
    assert json.loads("".join(r.value for r in spark.read.text(str(tmp_path / "none")).collect())) == []
    sinks.write_sql(df.limit(0), str(tmp_path / "s"))
    assert [r.value for r in spark.read.text(str(tmp_path / "s")).collect()] == [sinks.NO_ROWS]


def test_candidates_and_groups(spark, mapping):
    rows = [(p, d, w, p, "1") for p, d, w in UNITS] * 5
    good = spark.createDataFrame(rows, "tinh string, huyen string, xa string, remark string, province_id string")
    found = detect.candidates(good, mapping.units)
    assert found == {"id_provinces": ["province_id"], "id_districts": [], "id_wards": [], "provinces": ["tinh"], "districts": ["huyen"], "wards": ["xa"]}
    assert detect.detect(good, mapping.units) == [AddressGroup("province_id", None, None, "tinh", "huyen", "xa")]
    half = good.withColumn("xa", F.when(F.rand(1) < 0.5, "?").otherwise(F.col("xa")))
    assert detect.candidates(half, mapping.units)["wards"] == [] and detect.detect(half, mapping.units) == []
    plain = good.withColumnRenamed("tinh", "x").withColumnRenamed("remark", "y")  # no name helps: all that match stay
    assert detect.candidates(plain, mapping.units)["provinces"] == ["x", "y"]
    assert detect.numeric_columns(good.select("tinh", F.lit(None).cast("string").alias("void")), ["tinh", "void"]) == set()


def test_tasks(spark, tmp_path, mapping):
    engine = AddressEngine(spark, mapping, str(tmp_path / "store"))
    (tmp_path / "in.csv").write_text("tinh,huyen,xa,note\n" + "".join(f"{p},{d},{w},{i}\n" for i, (p, d, w) in enumerate(UNITS * 4)) + "x,y,z,12\n")
    told = engine.upload_and_detect(str(tmp_path / "in.csv"))
    assert (told["rows"], told["all_columns"], told["suggested_workers"]) == (13, ["tinh", "huyen", "xa", "note"], 1)
    assert [(g["province"], g["district"], g["ward"]) for g in told["groups"]] == [("tinh", "huyen", "xa")]
    task = told["task_id"]
    with pytest.raises(NotFound):
        engine.records(task)
    done = engine.start_conversion(task, told["groups"], n_workers=3)
    assert (done["status"], done["progress"], done["step"], done["n_workers"], done["result"]["fail_count"]) == ("preview_ready", 92, 2, 3, 1)
    assert [r["note"] for r in engine.group_preview(task, ["note", "?"])["sample_data"]] == ["0", "1", "2", "3", "4"]
    saved = engine.update_row(task, 13, {})  # nothing changes but the status
    assert (saved["success_count"], saved["fail_count"], saved["progress"], saved["row_index"]) == (13, 0, 100.0, 12)
    assert engine.tasks.original_of(task, 12)["statusState"] == "Lỗi _group1"
    with pytest.raises(NotFound):
        engine.update_row(task, 99, {"xa": "q"})
    out = engine.download(task, "success")
    assert out.endswith("in_convert_success.csv") and files.read_csv(spark, out).count() == 13
    assert engine.filtered_data(task, "error").count() == 0 and files.count_rows(spark, engine.download(task, "success")) == 13
    with pytest.raises(ValueError):
        engine.start_conversion(task, [])
    with pytest.raises(NotFound):
        engine.start_conversion("none", told["groups"])
    engine.tasks.delete(task)
    assert engine.tasks.get(task) is None and engine.tasks.edits_of(task).count() == 0
    with pytest.raises(ValueError):
        engine.upload_and_detect(str(tmp_path / "missing.csv"))


def test_store_keeps_the_latest(spark, tmp_path):
    store = TaskStore(spark, str(tmp_path / "s"))
    store.create("t", filename="f")
    for k in range(4):
        store.update("t", step=k, unknown=1)
    assert store.get("t")["step"] == 3 and store.update("u") is None and store.edits_of("t").count() == 0
    assert len(new_id()) == 14 and new_id() != new_id() and elapsed(0).endswith("s")


def test_distinct_addresses_are_looked_up_alike(spark, mapping):
    from placeweave.operators import convert as conversion

    rows = [(p, d, w, i) for i, (p, d, w) in enumerate([*UNITS, (None, "Huyện B", "Xã C"), ("Tỉnh A", None, None), ("?", "?", "Xã D"), (" TỈNH A", "huyện B ", "Xã  C")] * 6)]
    df = spark.createDataFrame(rows, "p string, d string, w string, k int")
    groups = [AddressGroup(province="p", district="d", ward="w"), AddressGroup(district="gone", province="p", ward="w")]
    plain = sorted(map(tuple, conversion.convert(df, groups, mapping).collect()))
    for most in (100, 2):  # with the list, and with more addresses than it takes
        assert sorted(map(tuple, conversion.convert(df, groups, mapping, distinct_keys=most).collect())) == plain


def test_excel_of_more_rows_than_a_sheet_holds(spark, tmp_path):
    n = 1_048_576  # one too many, with the header
    df = spark.range(0, n, 1, 3).select(F.col("id").alias("k"), F.when(F.col("id") % 3 != 0, F.lit("a<\n\"é")).alias("t"))
    back = files.read_excel(spark, sinks.write_excel(df, str(tmp_path / "t.xlsx")))
    assert back.columns == ["k", "t", files.ORD]
    wrong = ordering.numbered(back, files.ORD, "place").filter("k <> place - 1 or t <> if(k % 3 = 0, '', 'a<\n\"é')")
    assert back.count() == n and wrong.isEmpty()
    names = sorted(p.name for p in (tmp_path / "t.xlsx").iterdir() if p.name.startswith("part"))
    assert len(names) == 6 and all(p.endswith(".xlsx") for p in names)
    with zipfile.ZipFile(tmp_path / "t.xlsx" / names[-1]) as z:
        assert z.testzip() is None
    # Whatever fits a sheet is one file as before, also without rows; asked for parts, no rows are one workbook.
    none = df.filter("k < 0")
    for how in (None, False):
        empty = files.read_excel(spark, sinks.write_excel(none, str(tmp_path / f"e{how}.xlsx"), one_file=how))
        assert empty.columns == ["k", "t", files.ORD] and empty.isEmpty()
        assert (tmp_path / f"e{how}.xlsx").is_file() == (how is None)
