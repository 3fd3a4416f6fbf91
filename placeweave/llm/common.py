"""Helpers shared by the operators: reading, materialising, ordering, grouped batches."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import place, range_of  # noqa: F401  range_of is used through this module

LOWEST = -(2**63)
#: Keys drawn for each range when rows are dealt out by their order.
SAMPLE_PER_RANGE = 64
#: Bytes of one Arrow batch to a Python worker, so that long rows don't gather there.
ARROW_BATCH_BYTES = 16 << 20
#: Rows that Spark decodes from Parquet at once, and bytes of a row group that a task gathers as it writes; the
#: next reader of that table holds as much. By default 4,096 rows (whole texts) and 128 MB, in every task.
READ_ROWS = 256
ROW_GROUP_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound what a task holds of whole texts at once: read, sent to a Python worker and written."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    spark.conf.set("parquet.block.size", str(ROW_GROUP_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="placeweave-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    df.write.parquet(path := shared_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that no later step reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: str | Column = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def id_columns(col: str) -> list[Column]:
    """The id for a Python worker: `id` without nulls and `no_id`. A null beside longs would make pandas round them all."""
    own = F.col(col).cast("long")
    return [F.coalesce(own, F.lit(0).cast("long")).alias("id"), own.isNull().alias("no_id")]


def ids(batch: pd.DataFrame) -> pd.arrays.IntegerArray:
    """The exact ids of a batch that has id_columns, nulls included."""
    return pd.arrays.IntegerArray(batch["id"].to_numpy(np.int64), batch["no_id"].to_numpy(bool))


def key_of(id_col: str, text: Column) -> Column:
    """Ascending ids, null ids first; rows of one id by a hash of their text, so that an id with any share of all rows is dealt out too."""
    own = F.col(id_col).cast("long")
    return F.struct(own.isNotNull().alias("named"), F.coalesce(own, F.lit(0).cast("long")).alias("k"), F.xxhash64(text).alias("h"))


KEY = "struct<named:boolean,k:bigint,h:bigint>"


@dataclass(frozen=True)
class Ranges:
    """Ascending cut points (named, k, h), each the key of some row and none the least key of all."""

    cuts: list[tuple[bool, int, int]]
    n: int  # partitions, one for each range at least

    def at(self, i: Column) -> Column:
        """Key of the first row of range i >= 1."""
        return F.get(self._known(), i - 1)

    def of(self, key: Column) -> Column:
        return place(key, self._known(), len(self.cuts))

    def _known(self) -> Column:
        # One literal whatever the number of cuts; it is folded to a constant array.
        shown = json.dumps([{"named": a, "k": k, "h": h} for a, k, h in self.cuts])
        return F.from_json(F.lit(shown), f"array<{KEY}>")


def find_ranges(keys: DataFrame) -> Ranges:
    """Ranges that deal the rows of keys (column `key`) out evenly, from a sample of SAMPLE_PER_RANGE keys a range.

    Sampling sets only how the work is dealt. The driver gets that sample, whatever the input's size.
    """
    n = partitions(keys.sparkSession)
    share = n * SAMPLE_PER_RANGE / max(1, keys.count())
    drawn = keys if share >= 1 else keys.sample(share, seed=7)
    found = sorted({(bool(a), int(k), int(h)) for a, k, h in drawn.select("key.*").toPandas().itertuples(index=False)})
    cuts = sorted({found[i * len(found) // n] for i in range(1, n)} - {found[0]}) if found else []
    return Ranges(cuts, n)


def whole_groups(batches: Iterable[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """From batches sorted by key: frames that each hold all rows of their keys."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[key].to_numpy()
        last = len(keys) - int(np.argmax((keys != keys[-1])[::-1])) if (keys != keys[-1]).any() else 0
        if last == 0:
            if held and held[-1][key].iloc[-1] != keys[-1]:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(batch)
            continue
        held.append(batch.iloc[:last])
        yield pd.concat(held, ignore_index=True)
        held = [batch.iloc[last:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def doc_hash_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n
