"""Row numbers and heads in file order."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_of(key: Column, cuts: list[int] | list[float], kind: str = "double") -> Column:
    """How many of the ascending cuts are at or below the key, found in as many steps as their number has bits.

    The cuts are one constant array, so thousands of ranges cost a row a dozen comparisons.
    """
    return place(key.cast(kind), F.array(*map(F.lit, cuts)).cast(f"array<{kind}>"), len(cuts))


def file_rows(df: DataFrame, name: str, wanted: list[str]) -> DataFrame:
    """`wanted` columns of a Parquet scan and each row's 1-based number in order of file name and place in the file.

    Counts per file and the scan's own row index give it: no row is moved, sorted or sampled.
    """
    path, index = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    sizes = {r["f"]: r["n"] for r in df.groupBy(path.alias("f")).agg((F.max(index) + 1).alias("n")).collect()}  # a row for each file
    files = sorted(sizes)
    before, total = {}, 0
    for f in files:
        before[f], total = total, total + sizes[f]
    known = df.sparkSession.createDataFrame(list(before.items()), "_file string, _before long")
    placed = df.select(*wanted, path.alias("_path"), index.alias("_index")).join(F.broadcast(known) if len(files) <= KNOWN_BLOCKS else known, F.col("_path") == F.col("_file"), "left")
    return placed.select(*wanted, (F.col("_before") + F.col("_index") + 1).alias(name))


def place(key: Column, known: Column, count: int) -> Column:
    """How many of the `count` ascending entries of the constant array `known` are at or below the key, of the entries' type."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(count.bit_length()))]).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(known, at + s - 1) <= key, at + s).otherwise(at))


#: Keys drawn for each range when rows are dealt out by their order.
SAMPLE_PER_RANGE = 64


def sampled_cuts(df: DataFrame, key: str, n: int) -> list:
    """At most n - 1 ascending values of key that deal its rows out evenly, from a bounded sample.

    Sampling sets only how the work is dealt; the driver gets SAMPLE_PER_RANGE values a range.
    """
    if n < 2:
        return []
    share = n * SAMPLE_PER_RANGE / max(1, df.count())
    keys = df.select(key).filter(F.col(key).isNotNull())
    drawn = keys if share >= 1 else keys.sample(share, seed=7)
    found = sorted({r[0] for r in drawn.collect()})
    return sorted({found[i * len(found) // n] for i in range(1, n)}) if found else []


def constant_array(values: list, kind: str) -> Column:
    """One literal whatever the number of values."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def dense_numbers(df: DataFrame, ordinal: str, name: str, ranges: int | None = None) -> DataFrame:
    """df with the 1-based rank of `ordinal` (unique whole numbers), without a single task over all rows.

    A sample of the ordinals cuts them into ranges; the driver sees it and a count per range only.
    Rows are numbered inside their range, after the rows of all ranges before it.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sampled_cuts(df, ordinal, n)
    ranged = df.withColumn("_bucket", place(F.col(ordinal).cast("long"), constant_array(cuts, "bigint"), len(cuts)))
    sizes = dict(ranged.groupBy("_bucket").count().collect())  # a number for each range
    before = [0]
    for b in range(len(cuts)):
        before.append(before[-1] + sizes.get(b, 0))
    start = F.get(constant_array(before, "bigint"), F.col("_bucket"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(ordinal))
    return ranged.withColumn(name, (start + own).cast("long")).drop("_bucket")


#: Blocks of rows whose numbers are a constant of the plan.
KNOWN_BLOCKS = 20_000
PLACE_BITS = 33


def numbered(df: DataFrame, ordinal: str, name: str, ranges: int | None = None) -> DataFrame:
    """df with the 1-based rank of `ordinal`, without moving rows where it tells each row's place in its block.

    Readers give such ordinals: the block's rank, and in the low bits the row's place in it. The driver gets
    a count for each block; where places have gaps (rows were left out), or there are too many blocks, rows
    are ranged instead.
    """
    high, low = F.shiftright(ordinal, PLACE_BITS), F.col(ordinal).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    found = df.groupBy(high.alias("block")).agg(F.count("*").alias("n"), F.min(low).alias("first"), F.max(low).alias("last")).orderBy("block").limit(KNOWN_BLOCKS + 1).collect()
    if len(found) > KNOWN_BLOCKS or any(r["last"] - r["first"] + 1 != r["n"] for r in found):
        return dense_numbers(df, ordinal, name, ranges)
    blocks, before = [r["block"] for r in found], [0]
    for r in found:
        before.append(before[-1] + r["n"])
    # What is added to a place: the rows of earlier blocks, less the block's own first place.
    added = constant_array([b - r["first"] for b, r in zip(before, found, strict=False)], "bigint")
    at = place(high, constant_array(blocks, "bigint"), len(blocks)) - 1
    return df.withColumn(name, (low + F.get(added, at) + 1).cast("long"))


def sample_size(rows: int) -> int:
    """One row of a hundred, 10 to 500; none of an empty table."""
    return 0 if rows <= 0 else max(10, min(500, rows // 100))


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows: a bounded top-n, not a sort of everything."""
    return df.orderBy(*order).limit(n)


def suggested_workers(rows: int, megabytes: float) -> int:
    return min(8, max(1, rows // 15000 + int(megabytes // 25) + 1))


def workers_for(rows: Column, megabytes: Column | float = 0.0) -> Column:
    """suggested_workers as an expression."""
    more = F.floor((megabytes if isinstance(megabytes, Column) else F.lit(megabytes)) / 25)
    return F.least(F.lit(8), F.greatest(F.lit(1), F.floor(rows / 15000) + more + 1)).cast("int")


def union_chunks(parts: list[DataFrame]) -> DataFrame:
    """Chunks under each other, columns by name in order of first appearance; what a chunk lacks is null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def without(df: DataFrame, other: DataFrame) -> DataFrame:
    """The distinct rows of df that other doesn't hold; nulls equal nulls."""
    return df.subtract(other)
