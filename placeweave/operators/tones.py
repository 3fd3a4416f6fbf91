"""Canonical tone marks of whole texts through a dictionary of their distinct syllables.

Texts repeat their words a great deal, and putting one syllable into canonical form costs far more than
looking it up. So the distinct runs that hold a tone mark are found, each is canonicalised once, and those
that change are put back. The dictionary goes to the tasks only if its counted size is small; beyond that
every run is put right where it stands.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MARKED, canonical_run, canonical_tones
from ..plans.storage import scratch

#: Bytes of changed syllables, old and new, that are sent to every task.
DICTIONARY_BYTES = 32 << 20
# A run of word characters with a tone mark; it is looked at from its begin only, so long runs cost no more.
_RUN = rf"(?<![\p{{L}}\p{{N}}_])[\p{{L}}\p{{N}}_&&[^{MARKED}]]*+[{MARKED}][\p{{L}}\p{{N}}_]*+"
_OWN = re.compile(rf"(?<!\w)[^\W{MARKED}]*+[{MARKED}]\w*+")


def changed_syllables(df: DataFrame, source: Column) -> DataFrame:
    """run, form: the distinct runs of the texts whose canonical form differs."""
    marked = df.select(source.alias("text")).filter(F.col("text").rlike(f"[{MARKED}]"))
    runs = marked.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_RUN), F.lit(0)))).alias("run")).distinct()
    return runs.select("run", canonical_run(F.col("run")).alias("form")).filter(F.col("form") != F.col("run"))


def with_canonical(df: DataFrame, source: Column, out: str, most: int = DICTIONARY_BYTES) -> DataFrame:
    """df with `out`: the text of source, every run with its tone mark in canonical place. Null stays null.

    The rows are the same as with the expression `canonical_tones`, whichever way is taken.
    """
    spark = df.sparkSession
    changed_syllables(df, source).write.parquet(path := scratch(spark, "syllables"))
    found = spark.read.schema("run string, form string").parquet(path)
    size = found.agg(F.coalesce(F.sum(F.octet_length("run") + F.octet_length("form") + 100), F.lit(0))).first()[0]
    if size > most:
        return df.withColumn(out, canonical_tones(source))
    known = spark.sparkContext.broadcast({r["run"]: r["form"] for r in found.collect()})

    @F.arrow_udf("string")
    def put_back(texts: pa.Array) -> pa.Array:
        forms = known.value
        put = lambda m: forms.get(m[0], m[0])
        return pa.array([None if t is None else _OWN.sub(put, t) for t in texts.to_pylist()], pa.string())

    # Texts without a tone mark stay in the JVM.
    return df.withColumn(out, F.when(source.rlike(f"[{MARKED}]"), put_back(source)).otherwise(source))
