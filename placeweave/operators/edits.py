"""Manual corrections: the latest edit of each row, laid over an unchanged base."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .status import STATUS, SUCCESS


def latest(edits: DataFrame, keys: list[str], *newest_first) -> DataFrame:
    """One row per key: the newest (an upsert kept as an append-only log)."""
    return edits.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))).filter("_n = 1").drop("_n")


def overlay(base: DataFrame, edits: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """base with edits (row_index, edited MAP<STRING,STRING>) laid over by id - 1.

    A key that is in the map wins, also with null; keys outside the columns are ignored, as are
    edits of rows that do not exist. An edited row is a success.
    """
    columns = columns or [c for c in base.columns if c != "id"]
    e = edits.select((F.col("row_index") + 1).cast("long").alias("_id"), F.col("edited").alias("_edited"))
    joined = base.join(e, F.col("id") == F.col("_id"), "left")

    def cell(c: str):
        if c == STATUS:
            return F.when(F.col("_id").isNotNull(), SUCCESS).otherwise(F.col(c)).alias(c)
        old = F.col(f"`{c}`").cast("string")
        return F.when(F.coalesce(F.map_contains_key("_edited", F.lit(c)), F.lit(False)), F.col("_edited")[c]).otherwise(old).alias(c)

    return joined.select("id", *[cell(c) if c in base.columns else F.lit("").alias(c) for c in columns])


def number_of(row_id) -> int | None:
    """The id that reads as row_id when written as text, if any does."""
    shown = str(row_id)
    return int(shown) if shown.removeprefix("-").isdecimal() and shown == str(int(shown)) else None


def row_by_id(df: DataFrame, row_id) -> DataFrame:
    """The row with this id, compared as text; no row where there is none. As a number, so that files whose ids lie elsewhere are not read."""
    number = number_of(row_id)
    return df.filter(F.lit(False) if number is None else F.col("id") == number).limit(1)


def merged(edits: DataFrame, keys: list[str], fields: str, *newest_first) -> DataFrame:
    """One row per key with all fields ever edited, the newest value of each; an edit without fields counts too."""
    each = edits.select(*edits.columns, F.explode_outer(fields).alias("_k", "_v"))
    newest = latest(each, [*keys, "_k"], *newest_first)
    pairs = F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "_v")))  # nulls are left out
    return newest.groupBy(*keys).agg(F.map_from_entries(pairs).alias(fields))


def cascade(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """The children whose parent is still there."""
    return children.join(parents.select(*keys).distinct(), keys, "left_semi")


def path_of(uri: str) -> str:
    """A file's path for the reader: listings escape it, and write an empty host as // or not at all."""
    return unquote(uri).replace(":///", ":/", 1)


def files_of(df: DataFrame) -> list[str]:
    return [path_of(f) for f in df.inputFiles()]


def settle(base: DataFrame, edits: DataFrame, folder: str) -> list[str]:
    """Lay edits (row_index, edited) into the files of base, read from Parquet, and return the files that now hold its rows.

    Only files with edited rows are written anew, into folder; the others are neither read (but for
    their ids, where those can be an edit's) nor changed. No file is deleted, so a reader of the old
    ones is not disturbed. Without an edit of a row that exists, the files stay the same.
    """
    spark, files = base.sparkSession, files_of(base)
    low, high = edits.agg(F.min("row_index") + 1, F.max("row_index") + 1).first()
    if low is None:
        return files
    wanted = edits.select((F.col("row_index") + 1).cast("long").alias("_id"))
    there = base.select("id", F.col("_metadata.file_path").alias("_file")).filter(F.col("id").between(low, high))
    touched = {path_of(r["_file"]) for r in there.join(wanted, F.col("id") == F.col("_id"), "left_semi").select("_file").distinct().collect()}
    if not touched:
        return files
    kept = [f for f in files if f not in touched]
    if len(kept) + len(touched) != len(files):
        raise ValueError("files are named differently by the reader and by their rows")
    part = spark.read.schema(base.schema).parquet(*sorted(touched))
    overlay(part, edits).select(*base.columns).write.parquet(folder)
    return kept + files_of(spark.read.schema(base.schema).parquet(folder))
