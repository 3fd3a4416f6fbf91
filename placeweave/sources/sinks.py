"""Writers, and the names of exported files."""

from __future__ import annotations

import io
import os
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sql_literal
from ..plans.storage import scratch
from . import xlsx


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_json(df: DataFrame, path: str, array: bool = False) -> None:
    """One object a line, nulls written; or, as array, an array of objects in as many parts as df has.

    Parts in order of their names, one behind the other, are the array; `read_json` reads them so.
    """
    if not array:
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
        return
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
    _framed(rows, "[", ",", "]").write.mode("overwrite").text(path)


def _settled(rows: DataFrame) -> DataFrame:
    """rows in partitions that are the same in every reading.

    Behind a shuffle they need not be (ranges are cut by a sample drawn anew each time, and partitions are
    coalesced by their sizes); such rows are written with their partition and place, and dealt out by these.
    """
    spark = rows.sparkSession
    if "Exchange" not in rows._jdf.queryExecution().executedPlan().toString():
        return rows
    marked = rows.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), "value")
    marked.write.parquet(path := scratch(spark, "rows"))
    kept = spark.read.schema("part int, place long, value string").parquet(path)
    parts = kept.agg(F.coalesce(F.max("part"), F.lit(0)) + 1).first()[0]
    return kept.repartitionById(parts, "part").sortWithinPartitions("place").select("value")


def _framed(rows: DataFrame, first: str, between: str, last: str) -> DataFrame:
    """The texts of rows (column value) in their order, in the partitions they are in, with what stands around them.

    A count of rows for each partition tells which row is the first and which the last of all. If there are
    none, one line has the frame alone. A partition that differs from its count is an error.
    """
    spark, rows = rows.sparkSession, _settled(rows)
    counted = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()
    sizes = {r["part"]: r["n"] for r in counted}
    if not sizes:
        return spark.createDataFrame([(first + last,)], "value string").coalesce(1)
    head, tail = min(sizes), max(sizes)

    def around(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        size = sizes.get(part, 0)
        for b in batches:
            if not b.num_rows:
                continue
            texts = [between + t for t in b["value"].to_pylist()]
            if part == head and not done:
                texts[0] = first + texts[0][len(between) :]
            done += len(texts)
            if part == tail and done == size:
                texts[-1] += last
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])
        if done != size:
            raise RuntimeError(f"partition {part} has {done} rows, counted were {size}")

    return rows.mapInArrow(around, "value string")


def insert_rows(df: DataFrame) -> Column:
    """A row as a parenthesised list of SQL literals."""
    return F.concat(F.lit("("), F.concat_ws(", ", *[sql_literal(F.col(f"`{n}`"), kind) for n, kind in df.dtypes]), F.lit(")"))


# Fixed value: what stands in a dump without rows.
NO_ROWS = "-- Không có dữ liệu hợp lệ để tạo câu lệnh INSERT"


def write_sql(df: DataFrame, path: str, table: str = "converted_addresses", one_statement: bool = False) -> None:
    """A dump of single-row INSERT statements, one a line, so that parts are written side by side.

    one_statement: a single multi-row INSERT; its parts in order of their names, one behind the other, are
    the dump, and so is their only one if df has one. Without rows the dump is a comment line.
    """
    names = ", ".join(df.columns)
    if df.isEmpty():
        df.sparkSession.createDataFrame([(NO_ROWS,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    elif one_statement:
        _framed(df.select(insert_rows(df).alias("value")), f"INSERT INTO {table} ({names}) VALUES\n", ",", ";").write.mode("overwrite").text(path)
    else:
        df.select(F.concat(F.lit(f"INSERT INTO {table} ({names}) VALUES "), insert_rows(df), F.lit(";"))).write.mode("overwrite").text(path)


def put(spark: SparkSession, local: str, path: str) -> None:
    """A file of the driver's disk to any store that Spark reaches."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    source = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local}")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, source, target)


#: Rows of one workbook and characters of its cells, about, where a table is written as several.
BOOK_ROWS = 200_000
BOOK_CHARS = 1 << 27


def _books(names: list[str], rows: Iterable[Row], least: int) -> Iterator[tuple[bytearray]]:
    """Workbooks of a partition's rows, `least` at least. The line break that the text writer puts behind each is its archive's comment."""
    rows, made = iter(rows), 0
    ahead = next(rows, None)
    while ahead is not None or made < least:
        chars = 0

        def some() -> Iterator[Row]:
            nonlocal ahead, chars
            for _ in range(BOOK_ROWS):
                if ahead is None or chars > BOOK_CHARS:
                    return
                chars += sum(len(str(v)) for v in ahead)
                yield ahead
                ahead = next(rows, None)

        xlsx.write(out := io.BytesIO(), names, some(), b"\n")
        made += 1
        yield (bytearray(out.getbuffer()[:-1]),)


def write_excel(df: DataFrame, path: str, one_file: bool | None = None) -> str:
    """One workbook where a sheet holds all rows, streamed partition by partition through a file of the driver's; returns the real path.

    More rows, or one_file=False, make a folder of workbooks, written side by side; in order of their
    names they are the table, and `read_excel` reads them so.
    """
    path = os.path.splitext(path)[0] + ".xlsx"
    spark, names = df.sparkSession, df.columns
    one_file = df.count() < xlsx.SHEET_ROWS if one_file is None else one_file
    if one_file or not df.rdd.getNumPartitions():
        with tempfile.NamedTemporaryFile(suffix=".xlsx") as f:
            xlsx.write(f.name, names, (list(r) for r in df.toLocalIterator()))
            put(spark, f.name, path)
        return path
    books = df.rdd.mapPartitionsWithIndex(lambda i, rows: _books(names, rows, int(i == 0)))
    whole = spark.createDataFrame(books, "book binary").select(F.col("book").cast("string"))
    whole.write.mode("overwrite").options(maxRecordsPerFile=1, compression="none", lineSep="\n").text(path)  # a file each
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in store.listStatus(folder):
        if (own := found.getPath()).getName().endswith(".txt"):
            store.rename(own, folder.suffix("/" + own.getName().removesuffix(".txt") + ".xlsx"))
    return path


WRITERS = {".csv": write_csv, ".json": write_json, ".sql": write_sql, ".xlsx": write_excel, ".xls": write_excel}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is at path, in any store that Spark reaches."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def output_name(path: str, mode: str, spark: SparkSession | None = None) -> str:
    """{stem}_convert_success or _convert_error, with (1), (2), ... where the name is taken."""
    stem, ext = os.path.splitext(path)
    base = f"{stem}_convert_{mode}"
    taken = os.path.exists if spark is None else lambda p: exists(spark, p)
    name, k = base + ext, 0
    while taken(name):
        k += 1
        name = f"{base}({k}){ext}"
    return name
