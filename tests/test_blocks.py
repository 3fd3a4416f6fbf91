"""The splitting scan: automata against plain parsers over random cuts, and readers over several tasks."""

import csv
import io
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from placeweave.sources import blocks, files, formats, sinks, sqldump


def cut_up(rule, text, cuts):
    """Records of a text whose chunks are cut into blocks at the given places, as the scan finds and joins them."""
    chunks, followed = text.split(rule.separator), True
    if not chunks[-1]:
        chunks.pop()
    else:
        followed = False
    parts, at = [], 0
    for c in [*sorted(cuts), len(chunks)]:
        if c > at:
            parts.append(chunks[at:c])
            at = c
    found, state, depth = [], rule.states[0], 0
    for i, part in enumerate(parts):
        whole = followed or i < len(parts) - 1
        if not rule.neutral(state, depth):
            head = blocks._Head(rule, state, depth, whole)
            head.take(part)
            told = head.told(0).to_pylist()[0]
            if found and found[-1][1]:
                found[-1] = (found[-1][0] + told["head"], not told["done"])
                if told["drop"]:
                    found.pop()
        cutter = blocks._Cutter(rule, state, depth, i == 0, whole)
        found += [(raw, open_) for _, raw, open_, _ in cutter.take(part) + cutter.tail()]
        onward, deeper = blocks.folded(rule, {s: (s, 0) for s in rule.states}, part)[state]
        state, depth = onward, depth + deeper
    return [raw for raw, _ in found], state, depth


def places(rng, text, separator):
    return [rng.randrange(text.count(separator) + 2) for _ in range(rng.randrange(6))]


def test_csv_records_over_any_cut():
    rng = random.Random(0)
    for _ in range(1500):
        rows = [["".join(rng.choice('ab,"\n x') for _ in range(rng.randrange(6))) for _ in range(3)] for _ in range(rng.randrange(1, 8))]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n", quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerows(rows)
        text = out.getvalue()[: -1 if rng.random() < 0.3 else None]
        got, _, _ = cut_up(formats.CsvLines(), text, places(rng, text, "\n"))
        assert [next(csv.reader(io.StringIO(g))) for g in got] == [r for r in csv.reader(io.StringIO(text)) if r]


def test_quotes_inside_values_open_nothing():
    for text in ('a,b\n5" pipe,x\n"y""",z\n', 'a,"b"x,c\n"d\ne"f,g\n1,2\n'):
        got, state, _ = cut_up(formats.CsvLines(), text, [1, 2])
        assert state == "out" and len(got) == len(text.splitlines()) - ("d\ne" in text)


def value(rng, depth=0):
    kinds = [lambda: None, lambda: 1.5, lambda: "".join(rng.choice('ab{}[]"\\, \n') for _ in range(rng.randrange(6))), lambda: True]
    kinds += [lambda: {"k}": value(rng, depth + 1)}, lambda: [value(rng, depth + 1)], lambda: {"a": {"b": value(rng, depth + 1)}}] if depth < 2 else []
    return rng.choice(kinds)()


def test_json_records_over_any_cut():
    rng = random.Random(1)
    for _ in range(1500):
        rows = [{"".join(rng.choice('ab{"}') for _ in range(2)): value(rng) for _ in range(rng.randrange(3))} for _ in range(rng.randrange(7))]
        text = json.dumps(rows, indent=rng.choice([None, 1])) + rng.choice(["", " \n"])
        got, _, depth = cut_up(formats.JsonArray(), text, places(rng, text, "}"))
        assert [json.loads(g) for g in got] == rows


def brute_dump(text):
    """The dump's grammar as patterns over the whole text: comments out, white space folded, then statements up to `);`."""
    text = re.sub(r"\s+", " ", re.sub(r"--[^\n]*\n|/\*.*?\*/", "", text, flags=re.S)).strip()
    found = re.findall(r"INSERT\s+INTO\s+`?(\w+)`?\s*\(([\w\s`,]+)\)\s*VALUES\s*(.+?\));", text, re.I | re.S)
    return [row for _, _, values in found for row in sqldump.rows_of(values) if len(row) == 2]


TOKENS = [
    "INSERT INTO t (a, b) VALUES ", "INSERT INTO `t`(`a`,b) values\n", "(1, 'x')", "(NULL, 2.5)", ",", ",", ", ", ";", ");", "; \n", "'", "''", "\\'", "(", "-- c ) (\n", "/* x ) */",
    "('a)b', 'c;d')", "('it\\'s', 'q''q')", "CREATE TABLE z (x int);\n", " ", "(f(1), 2)",
]


def test_dump_rows_over_any_cut():
    rng = random.Random(2)
    for _ in range(2500):
        text = "".join(rng.choice(TOKENS) for _ in range(rng.randrange(2, 25)))
        text = ("INSERT INTO t (a, b) VALUES (0, 'z');\n" if rng.random() < 0.7 else "") + text + ("\nINSERT INTO t (a, b) VALUES (7, 'y');\n" if rng.random() < 0.8 else "")
        try:
            got, state, depth = cut_up(formats.SqlDump(), text, places(rng, text, ")"))
        except formats.DumpError:  # a comment with a bracket in a statement's head
            continue
        rows = [sqldump.row_of(g.partition("\0")[2]) for g in got if g[0] == "R" and (state[1] == "seek" or not g.startswith(f"R{depth}\0"))]
        assert [r for r in rows if len(r) == 2] == brute_dump(text)


@pytest.fixture
def small_blocks(spark):
    """Files are cut every 200 bytes."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


ROWS = [(str(i), ["plain", 'two\nlines, "quoted"', "x" * 500 + "\n\n" + "y)}" * 100, "", None, "it's }{ )( ;"][i % 6], f"z{i}") for i in range(60)]


def test_csv_with_breaks_splits(spark, tmp_path, small_blocks):
    for name, part in (("b", ROWS[:30]), ("c", ROWS[30:])):
        (tmp_path / "t.csv").mkdir(exist_ok=True)
        with open(tmp_path / "t.csv" / f"{name}.csv", "w", newline="") as f:
            csv.writer(f, lineterminator="\r\n" if name == "c" else "\n").writerows([("k", "text", "z"), *part])
    df = files.read_csv(spark, str(tmp_path / "t.csv"))
    got = [tuple(r)[:3] for r in df.orderBy(files.ORD).collect()]
    assert got == [(k, t or None, z) for k, t, z in ROWS] and files.count_rows(spark, str(tmp_path / "t.csv")) == 60
    seen = files.look(spark, str(tmp_path / "t.csv"))
    assert seen.quoted_breaks and len(seen.blocks) > 10  # as many tasks may read the two files
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    whole = files.read_csv(spark, str(tmp_path / "t.csv"), multi_line=True)
    assert sorted(map(str, (tuple(r)[:3] for r in whole.collect()))) == sorted(map(str, got))
    # Other encodings.
    (tmp_path / "w.csv").write_bytes("k,é\n1,\"ü–\n\"\"x\"\"\"\n".encode("cp1252") * 1)
    assert [tuple(r)[:2] for r in files.read_csv(spark, str(tmp_path / "w.csv")).collect()] == [("1", 'ü–\n"x"')]


def test_plain_csv_keeps_the_order_of_files(spark, tmp_path):
    for name, n in (("a", 3), ("b", 400), ("c", 40)):
        (tmp_path / "p.csv").mkdir(exist_ok=True)
        (tmp_path / "p.csv" / f"{name}.csv").write_text("k\n" + "".join(f"{name}{i}\n" for i in range(n)) + "\n")
    got = [r.k for r in files.read_csv(spark, str(tmp_path / "p.csv")).orderBy(files.ORD).collect()]
    assert got == [f"{name}{i}" for name, n in (("a", 3), ("b", 400), ("c", 40)) for i in range(n)]
    assert files.count_rows(spark, str(tmp_path / "p.csv")) == 443


def test_json_array_splits_and_is_written_in_parts(spark, tmp_path, small_blocks):
    df = spark.createDataFrame(ROWS, "k string, text string, z string").repartition(5, "k").sortWithinPartitions("z")
    sinks.write_json(df, str(tmp_path / "j"), array=True)
    parts = sorted((tmp_path / "j").glob("part*"))
    told = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 2 and sorted(tuple(r.values()) for r in told if r["text"]) == sorted(r for r in ROWS if r[1])
    back = files.read_json(spark, str(tmp_path / "j"))
    assert [tuple(r)[:3] for r in back.orderBy(files.ORD).collect()] == [tuple(r.values()) for r in told]
    # One file, on one line; numbers stay as they are written, in nested values too.
    body = [{"n": i, "deep": {"x": ["}", {"y": i}]}, "t": "a\\" * (i % 3)} for i in range(50)]
    (tmp_path / "one.json").write_text(json.dumps(body).replace('"n": 7,', '"n": 7.50,').replace('"y": 7}', '"y": -0.70e+3}'))
    rows = files.read_json(spark, str(tmp_path / "one.json")).orderBy(files.ORD).collect()
    assert [r.t for r in rows] == [b["t"] for b in body] and rows[7].n == "7.50" and rows[7].deep == '{"x":["}",{"y":-0.70e+3}]}' and rows[8].deep == '{"x":["}",{"y":8}]}'


@pytest.mark.parametrize(("text", "bad"), [
    ('[{"a": 1}, {"a": 2}', "is not closed"), ('[{"a": 1}', "is not closed"), ('[{"a": 1} {"a": 2}]', '{"a": 2}'), ('[{"a": 1}, 5, {"a": 2}]', "5"), ('[{"a": 1}] x', "x"), ("[1, 2]", "1, 2"), ('[{"a": }]', "{"),
])
def test_broken_arrays(spark, tmp_path, text, bad):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(ValueError, match="malformed"):
        files.read_json(spark, str(tmp_path / "x.json"))
    kept = files.read_json(spark, str(tmp_path / "x.json"), corrupt="broken").collect()
    assert any(bad in r.broken for r in kept if r.broken)


def test_dumps_split_and_keep_their_order(spark, tmp_path, small_blocks):
    rows = [(i, None if i % 7 == 0 else f"it's ({i}) ; -x") for i in range(80)]
    df = spark.createDataFrame(rows, "k long, t string")
    for one in (False, True):
        sinks.write_sql(df.repartitionByRange(4, "k").sortWithinPartitions("k"), path := str(tmp_path / f"d{one}.sql"), "t", one_statement=one)
        back = files.read_sql(spark, path, unescape=True)
        assert [tuple(r)[:2] for r in back.orderBy(files.ORD).collect()] == [(str(k), t) for k, t in rows]
        assert back.select(files.ORD).distinct().count() == 80
    # A statement without its end counts for nothing, also before other files; several tables are an error.
    (tmp_path / "e.sql").mkdir()
    (tmp_path / "e.sql" / "a.sql").write_text("INSERT INTO t (k) VALUES (1);\nINSERT INTO t (k) VALUES (2), (3)")
    (tmp_path / "e.sql" / "b.sql").write_text("-- note\nINSERT INTO `t` (k) VALUES (4);")
    assert [r.k for r in files.read_sql(spark, str(tmp_path / "e.sql")).orderBy(files.ORD).collect()] == ["1", "4"]
    (tmp_path / "e.sql" / "b.sql").write_text("INSERT INTO u (k) VALUES (4);")
    with pytest.raises(sqldump.DumpError, match="several"):
        files.read_sql(spark, str(tmp_path / "e.sql"))
    (tmp_path / "n.sql").write_text("INSERT INTO t VALUES (4);")
    with pytest.raises(sqldump.DumpError, match="column list"):
        files.read_sql(spark, str(tmp_path / "n.sql"))


def test_breaks_split_takes_documents_in_the_order_of_their_ids(spark, tmp_path):
    from placeweave import queries

    # The later file is the larger one, which Spark reads first.
    for at, ids, size in ((0, range(20), 10), (1, range(20, 200), 3000)):
        rows = [(i, f"{i}\n\"x\", " * (1 + size // 10), "s") for i in reversed(ids)]
        spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.mode("append" if at else "overwrite").parquet(str(tmp_path / "documents.parquet"))
    found = {int(r.doc_id): r.place for r in queries.csv_breaks_split(spark, str(tmp_path)).collect()}
    assert found == {i: i + 1 for i in range(200)}
