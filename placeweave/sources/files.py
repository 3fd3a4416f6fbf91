"""Readers: every format becomes an all-string DataFrame with its order (file name, place) in `_ord`.

CSV, NDJSON, JSON arrays and SQL dumps split over tasks (blocks.py); a workbook is one task.

Paths go through Spark's own readers, so any store works; only SQLite, of which a sample is read,
needs a local copy on the driver.
"""

from __future__ import annotations

import os
import sqlite3
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import head, sample_size
from . import blocks, formats, sqldump, xlsx

ORD = "_ord"
ROWS = f"{ORD} long, cells array<string>"


class UnsupportedFormat(ValueError):
    """No reader for this extension."""


def extension(path: str) -> str:
    return os.path.splitext(path)[1].lower()


def unique_names(names: list[str | None]) -> list[str]:
    """Missing names become col_{i}; repeated ones get .1, .2, ..."""
    out: list[str] = []
    for i, n in enumerate(names):
        n = f"col_{i}" if n is None else n.lstrip("﻿")
        k, name = 0, n
        while name in out:
            k += 1
            name = f"{n}.{k}"
        out.append(name)
    return out


#: Bytes 0x80..0x9F as Latin-1 and as Windows-1252 read them; five of them mean nothing in the latter.
_LATIN = "".join(chr(b) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))
_WINDOWS = _LATIN.encode("latin-1").decode("cp1252")


@dataclass(frozen=True)
class Look:
    """What one pass over the bytes of text files tells."""

    encoding: str
    quoted_breaks: bool
    lines: int  # that are not empty
    blocks: list[blocks.Block]

    @property
    def files(self) -> int:
        return len({b.file for b in self.blocks})


def look(spark: SparkSession, path: str) -> Look:
    """UTF-8 unless some line's bytes are none; then Windows-1252, or Latin-1 where a byte is unused there.

    Lines are taken as raw bytes. A line with an odd number of quotes begins or ends a value that
    reaches over a line break. The driver gets a row for each block of the files.
    """
    raw = F.col("value").cast("binary")
    unused = "|".join(f"{b:02X}" for b in range(0x80, 0xA0) if not bytes([b]).decode("cp1252", "ignore"))
    place = {"file": F.col("_metadata.file_path"), "start": F.col("_metadata.file_block_start")}
    found = spark.read.text(path).withColumns(place).groupBy("file", "start", F.xxhash64("file", "start").alias("key")).agg(
        F.count("*").alias("chunks"), F.count_if(F.trim("value") != "").alias("lines"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or(F.hex(raw).rlike(f"^(?:..)*?(?:{unused})") & ~F.is_valid_utf8("value")).alias("unused"),
        F.bool_or((F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).alias("odd"),
    ).collect()
    encoding = "UTF-8" if all(r["utf8"] for r in found) else "ISO-8859-1" if any(r["unused"] for r in found) else "windows-1252"
    known = sorted((blocks.Block(r["file"], r["start"], r["key"], r["chunks"]) for r in found), key=lambda b: (b.file, b.start))
    for rank, block in enumerate(known):
        block.rank = rank
    return Look(encoding, any(r["odd"] for r in found), sum(r["lines"] for r in found), known)


def encoding_of(spark: SparkSession, path: str) -> str:
    return look(spark, path).encoding


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _split_csv(spark: SparkSession, path: str, seen: Look) -> blocks.Scan | None:
    """The records of CSV files with quoted line breaks, cut side by side; None where line breaks are none of LF."""
    value = None if seen.encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    found = blocks.scan(spark, path, formats.CsvLines(), value)
    return None if sum(b.chunks for b in found.blocks) <= seen.files < seen.lines else found


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Text cells as written (007 stays 007), rows in order of file name and place.

    A file splits over tasks. Where values hold line breaks its records are found by the splitting scan;
    multi_line=True asks for Spark's own reader of them instead, one task a file, False for none.
    """
    seen = look(spark, path)
    # Spark reads Windows-1252 as Latin-1 only; the bytes that differ are put right afterwards.
    right = (lambda c: F.translate(c, _LATIN, _WINDOWS)) if seen.encoding == "windows-1252" else (lambda c: c)
    options = {"encoding": "UTF-8" if seen.encoding == "UTF-8" else "ISO-8859-1", "escape": '"', "quote": '"'}
    broken = seen.quoted_breaks if multi_line is None else multi_line
    first = spark.read.options(**options, multiLine=broken).csv(path, header=False).limit(1).collect()
    if not first:
        raise ValueError("the file is empty")
    names = unique_names([None if h is None else h.translate(str.maketrans(_LATIN, _WINDOWS)) if seen.encoding == "windows-1252" else h for h in first[0]])
    schema = ", ".join(f"{_quoted(n)} string" for n in names)
    cut = _split_csv(spark, path, seen) if broken and multi_line is None else None
    if cut is None:
        df = blocks.in_order(spark.read.options(**options, multiLine=broken).csv(path, header=True, schema=schema), seen.blocks)
    else:
        raw = F.regexp_replace("raw", "\r$", "")
        parsed = F.from_csv(raw, schema, {"escape": '"', "quote": '"'}).alias("row")
        df = cut.records.filter(~F.col("first")).select(parsed, ORD).select("row.*", ORD)
    return df.select(*[right(F.col(_quoted(n))).alias(n) for n in names], ORD)


#: Marks a number that stands as a text while JSON is parsed, so that it stays as it is written.
_MARK = "\uffff"
_NUMBER = r"\G((?:\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|[^\"0-9-]++)*+)(-?[0-9][0-9.eE+-]*+)"


def _fields(raw: Column) -> Column:
    """A record's fields as texts, null where it is malformed. Spark would write 1.50 as 1.5, so numbers with a point or exponent go as texts."""
    as_texts = F.when(raw.rlike("[0-9][.eE]|-0"), F.regexp_replace(raw, _NUMBER, f'$1"{_MARK}$2{_MARK}"')).otherwise(raw)
    plain = lambda v: F.when(v.contains(_MARK), F.regexp_replace(v, f'"?{_MARK}(-?[0-9][0-9.eE+-]*){_MARK}"?', "$1")).otherwise(v)
    known = F.from_json(raw, "map<string,string>")  # tells whether the record is one
    return F.when(known.isNotNull(), F.transform_values(F.from_json(as_texts, "map<string,string>"), lambda _, v: plain(v)))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """_ord, raw (the record's text), m (its fields, or null where it is malformed), in file order."""
    known = blocks.blocks_of(blocks.chunks(spark, path, formats.JsonArray.separator))
    begin = next((b.begin for b in known if b.begin), None)
    if begin is None:
        raise ValueError("the file is empty")
    if begin.startswith("["):
        cut = blocks.scan(spark, path, formats.JsonArray(), carry=True)
        lines = cut.records.select(ORD, "raw")
        # An array that isn't closed is a malformed record.
        for _, last, _, depth in cut.final:
            if depth > 0:
                shown = f"[... ({last.file} is not closed)"
                lines = lines.unionByName(spark.createDataFrame([((last.rank + 1 << blocks.PLACE_BITS) - 1, shown)], f"{ORD} long, raw string"))
    else:
        lines = blocks.in_order(spark.read.text(path), blocks.blocks_of(blocks.chunks(spark, path, "\n"))).select(ORD, F.trim(F.regexp_replace("value", "^\ufeff", "")).alias("raw"))
        lines = lines.filter((F.col("raw") != "") & ~F.col("raw").startswith("//"))
    return lines.select(F.col(ORD).cast("long").alias(ORD), "raw", _fields(F.col("raw")).alias("m"))


def read_json(spark: SparkSession, path: str, corrupt: str | None = None) -> DataFrame:
    """An array of objects, or one object a line; blank lines and // lines are skipped.

    Columns are the keys in order of first appearance, cells are texts. A malformed record is an
    error; with corrupt, such records are kept as rows with their text in a column of that name.
    """
    records = _records(spark, path)
    broken = F.when(F.col("m").isNull(), F.struct(F.col(ORD), F.substring("raw", 1, 200).alias("raw")))
    each = records.select(ORD, broken.alias("broken"), F.posexplode_outer(F.map_keys("m")).alias("at", "key"))
    seen = each.groupBy("key").agg(F.min(F.struct(ORD, "at")).alias("first"), F.min("broken").alias("broken")).orderBy("first").collect()  # one row for each column
    if corrupt is None and (bad := [r["broken"]["raw"] for r in seen if r["broken"]]):
        raise ValueError(f"malformed JSON record: {bad[0]}")
    names = [r["key"] for r in seen if r["key"] is not None]
    extra = [] if corrupt is None else [F.when(F.col("m").isNull(), F.col("raw")).alias(corrupt)]
    return records.select(*[F.col("m")[n].alias(n) for n in names], *extra, ORD)


def _cells(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col("cells")[i].alias(n) for i, n in enumerate(names)], ORD)


#: Rows of a sheet that a task passes on at once.
SHEET_BATCH = 10_000


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """Active sheets of the workbooks at path, in order of their names; the first row of each is the header, the same in all; absent cells are ''.

    A workbook is one task, which passes its rows on as it reads them.
    """
    books = spark.read.format("binaryFile").load(path).select("path", "content")
    ranks = {p: i for i, p in enumerate(sorted(r["path"] for r in books.select("path").collect()))}  # a row for each workbook

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, data in zip(b["path"].to_pylist(), b["content"], strict=True):
                rows = xlsx.read(data.as_py())
                header = next(rows, None)
                width = max(map(len, rows), default=0)
                yield pa.RecordBatch.from_arrays([pa.array([ranks[own]], pa.int64()), pa.array([width], pa.int64()), pa.array([header], pa.list_(pa.string()))], names=["rank", "width", "header"])

    told = books.mapInArrow(tell, "rank long, width long, header array<string>").filter("header is not null").orderBy("rank").collect()
    if not told:
        raise ValueError("the sheet is empty")
    width = max(max(r["width"], len(r["header"])) for r in told)
    headers = [r["header"] + [None] * (width - len(r["header"])) for r in told]
    if any(h != headers[0] for h in headers):
        raise ValueError("the workbooks have different headers")

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, data in zip(b["path"].to_pylist(), b["content"], strict=True):
                rows, first = xlsx.read(data.as_py()), ranks[own] << blocks.PLACE_BITS
                next(rows, None)
                at = first + 1
                while some := [r + [None] * (width - len(r)) for r in islice(rows, SHEET_BATCH)]:
                    yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(some)), pa.int64()), pa.array(some, pa.list_(pa.string()))], names=[ORD, "cells"])
                    at += len(some)

    return _cells(books.mapInArrow(parse, ROWS), unique_names(headers[0])).na.fill("")


def read_sql(spark: SparkSession, path: str, unescape: bool = False) -> DataFrame:
    """Rows of the dumps' INSERT statements as text, in order of file name and place; a dump splits over tasks.

    Rows that don't fit the first statement's columns are left out, and so is a statement without its end.
    """
    cut = blocks.scan(spark, path, formats.SqlDump(), carry=True)
    if not cut.blocks:
        raise sqldump.DumpError("the file is empty")
    tag = F.substring_index("raw", "\0", 1)
    records = cut.records.select(ORD, tag.alias("tag"), F.expr("substr(raw, instr(raw, char(0)) + 1)").alias("body"))
    for first, last, state, depth in cut.final:
        if state[1] != "seek":  # a statement without its end
            inside = F.shiftright(ORD, blocks.PLACE_BITS).between(first.rank, last.rank)
            records = records.filter(~(inside & F.col("tag").isin(f"H{depth}", f"R{depth}")))
    heads = records.filter(F.col("tag").startswith("H")).select(ORD, F.substring_index("body", "\0", 1).alias("table"), F.substring_index("body", "\0", -1).alias("columns"))
    told = heads.agg(F.min(F.struct(ORD, "columns"))["columns"].alias("columns"), F.min("table").alias("a"), F.max("table").alias("z")).first()
    if told["columns"] is None:
        raise sqldump.DumpError("no INSERT statement with a column list")
    if told["a"] != told["z"]:
        raise sqldump.DumpError(f"several tables: {[told['a'], told['z']]}")
    names = sqldump.columns_of(told["columns"])

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sqldump.row_of(t, unescape) for t in b["body"].to_pylist()]
            fits = [i for i, r in enumerate(rows) if len(r) == len(names)]
            cells = pa.array([[None if v is None else str(v) for v in rows[i]] for i in fits], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b[ORD].take(pa.array(fits, pa.int64())), cells], names=[ORD, "cells"])

    rows = records.filter(F.col("tag").startswith("R")).select(ORD, "body").mapInArrow(parse, ROWS)
    if rows.isEmpty():
        raise sqldump.DumpError("no row fits the columns")
    return _cells(rows, unique_names(names))


def read_sqlite(spark: SparkSession, path: str, limit: int = 500) -> tuple[int, DataFrame]:
    """Row count and the first rows of the first user table; a sample only."""
    return sqlite_rows(spark, spark.read.format("binaryFile").load(path).select("content").first()[0], limit)


def sqlite_rows(spark: SparkSession, content: bytes, limit: int) -> tuple[int, DataFrame]:
    with tempfile.NamedTemporaryFile(suffix=".db") as f:
        f.write(content)
        f.flush()
        db = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
        try:
            table = db.execute("SELECT name FROM sqlite_master WHERE type='table' AND name NOT LIKE 'sqlite_%' LIMIT 1").fetchone()
            if not table:
                raise ValueError("the database has no table")
            name = table[0].replace('"', '""')
            count = db.execute(f'SELECT COUNT(*) FROM "{name}"').fetchone()[0]
            found = db.execute(f'SELECT * FROM "{name}" LIMIT ?', (limit,))
            names = unique_names([d[0] for d in found.description])
            rows = [[None if v is None else str(v) for v in r] + [i] for i, r in enumerate(found)]
        finally:
            db.close()
    schema = ", ".join(f"`{n}` string" for n in names) + f", {ORD} long"
    return count, spark.createDataFrame(rows, schema)


READERS = {".csv": read_csv, ".json": read_json, ".xlsx": read_excel, ".xls": read_excel, ".sql": read_sql}


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """The table at path by the reader of its extension; options go to that reader (multi_line, corrupt, unescape)."""
    reader = READERS.get(extension(path))
    if reader is None:
        raise UnsupportedFormat(extension(path))
    return reader(spark, path, **options)


DATABASES = (".db", ".sqlite", ".sqlite3")


@dataclass(frozen=True)
class FileInfo:
    """Rows, columns, names, megabytes and the first rows of a file; error says why the rest is missing."""

    rows: int
    cols: int
    names: list[str]
    mb: float
    sample: DataFrame | None
    error: str | None


def file_size(spark: SparkSession, path: str) -> int:
    """Bytes of all files at path, through Spark's own file system."""
    return spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def count_rows(spark: SparkSession, path: str) -> int:
    """Records, without the header that each CSV file has."""
    kind = extension(path)
    if kind == ".csv":
        seen = look(spark, path)
        if not seen.quoted_breaks:
            return max(0, seen.lines - seen.files)
    if kind in DATABASES:
        return read_sqlite(spark, path, 0)[0]
    return read_table(spark, path).count()


def file_info(spark: SparkSession, path: str) -> FileInfo:
    """What an upload is asked for. Problems are told in error, not raised."""
    size = 0
    try:
        size = file_size(spark, path)
        rows = count_rows(spark, path)
        few = sample_size(rows)
        sample = read_sqlite(spark, path, few)[1] if extension(path) in DATABASES else head(read_table(spark, path), few, ORD)
        names = [c for c in sample.columns if c != ORD]
        if not rows or not names:
            return FileInfo(rows, 0, [], round(size / 2**20, 1), None, "the file has no rows")
        return FileInfo(rows, len(names), names, round(size / 2**20, 1), sample.drop(ORD), None)
    except Exception as e:  # any reader's own errors
        return FileInfo(-1 if size else 0, 0, [], round(size / 2**20, 1), None, f"{type(e).__name__}: {str(e).splitlines()[0][:300]}")
