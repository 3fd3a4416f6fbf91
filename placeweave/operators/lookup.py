"""Exact lookup, then the unique partial match, as hash joins on the fact side's own partitioning.

The partial match asks for exactly one key with the same ward and the same province or district.
After an exact miss no key has both, so the keys found by province and by district are disjoint:
their counts, prepared per (ward, province) and (ward, district), add up. No row is multiplied, and
with a mapping of bounded size the fact side is never shuffled.

A larger mapping is joined by shuffle. Addresses are then aggregated to distinct ones first, each is
looked up once, and rows meet their answers again at the end. In each of these joins the keys that
hold more than a task's share of the rows are joined by broadcast, where they are: fewer keys than
there are tasks can hold so much, whatever the data. So no hot ward gathers in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.mapping import Mapping
from ..plans.storage import scratch


def heavy_keys(counted: DataFrame, on: list[str], rows: int, n: str = "n") -> DataFrame:
    """The keys of counted (keys, n: their rows) with more than one task's share of rows; fewer than there are tasks."""
    tasks = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counted.filter(F.col(n) * F.lit(tasks) > F.lit(rows)).select(*on)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], heavy: DataFrame) -> DataFrame:
    """left with right's columns (one row a key at most; null keys match each other), rows kept as in a left join.

    Rows of heavy keys (a bounded list, as from heavy_keys) stay where they are and meet their few
    answers by broadcast; the rest is shuffled by key. left is read twice.
    """
    hot = F.broadcast(heavy.select(*[F.col(c).alias(f"_hot_{c}") for c in on]))
    is_hot = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_hot_{c}")) for c in on])
    new = [c for c in right.columns if c not in on]
    kept = right.select(*[F.col(c).alias(f"_key_{c}") for c in on], *new)
    meets = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in on])
    answers = F.broadcast(right.join(hot, is_hot, "left_semi").select(*[F.col(c).alias(f"_key_{c}") for c in on], *new))
    light = left.join(hot, is_hot, "left_anti").join(kept, meets, "left")
    heavy_rows = left.join(hot, is_hot, "left_semi").join(answers, meets, "left")
    columns = [*left.columns, *new]
    return light.select(*columns).unionByName(heavy_rows.select(*columns))


def _answers(found: DataFrame, out: str, how: str | None) -> DataFrame:
    """The rule, on rows that have met the three tables."""
    col = F.col
    near = F.coalesce("_bn", F.lit(0)) + F.coalesce("_cn", F.lit(0))
    vals = F.when(col("_av").isNotNull(), col("_av")).when(near == 1, F.coalesce("_bv", "_cv"))
    found = found.withColumn(out, vals)
    if how:
        kind = F.when(col("_av").isNotNull(), "exact").when(near == 1, "fallback").when(near > 1, "ambiguous").otherwise("miss")
        found = found.withColumn(how, kind)
    return found


def distinct_addresses(df: DataFrame, p: str, d: str, w: str) -> DataFrame:
    """The distinct keys of df with their rows n, written: p, d, w, n."""
    counted = df.groupBy(F.col(p).alias("p"), F.col(d).alias("d"), F.col(w).alias("w")).agg(F.count("*").alias("n"))
    counted.write.parquet(path := scratch(df.sparkSession, "addresses"))
    return df.sparkSession.read.schema("p string, d string, w string, n long").parquet(path)


def lookup_spread(df: DataFrame, mapping: Mapping, p: str, d: str, w: str, out: str, how: str | None) -> DataFrame:
    """lookup for a mapping of any size and keys of any share; columns as there. Reads df three times."""
    known = distinct_addresses(df, p, d, w)
    each, rows = known.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def hot(on: list[str]) -> DataFrame:
        return heavy_keys(known.groupBy(*on).agg(F.count("*").alias("n")), on, each)

    # A key of the mapping is never null, so a null part finds nothing, as with plain equality.
    whole = known.join(mapping.exact.withColumnRenamed("vals", "_av"), ["p", "d", "w"], "left")  # distinct keys: nothing is hot
    found = spread_join(whole, mapping.by_province.withColumnsRenamed({"n": "_bn", "vals": "_bv"}), ["w", "p"], hot(["w", "p"]))
    found = spread_join(found, mapping.by_district.withColumnsRenamed({"n": "_cn", "vals": "_cv"}), ["w", "d"], hot(["w", "d"]))
    found = _answers(found, "_out", "_how").select("p", "d", "w", "n", "_out", "_how")
    found.write.parquet(path := scratch(df.sparkSession, "answers"))
    found = df.sparkSession.read.schema(found.schema).parquet(path)
    names = {"p": p, "d": d, "w": w, "_out": out} | ({"_how": how} if how else {})
    answers = found.select(*[F.col(c).alias(name) for c, name in names.items()], "n")
    return spread_join(df, answers.drop("n"), [p, d, w], heavy_keys(answers, [p, d, w], rows))


def lookup(df: DataFrame, mapping: Mapping, p: str = "_p", d: str = "_d", w: str = "_w", out: str = "_vals", how: str | None = None) -> DataFrame:
    """df with `out`, the new values of its key or null; with `how`, also exact / fallback / ambiguous / miss."""
    if not mapping.is_small:
        return lookup_spread(df, mapping, p, d, w, out, how)
    a = mapping.exact.select(F.col("p").alias("_ap"), F.col("d").alias("_ad"), F.col("w").alias("_aw"), F.col("vals").alias("_av"))
    b = mapping.by_province.select(F.col("w").alias("_bw"), F.col("p").alias("_bp"), F.col("n").alias("_bn"), F.col("vals").alias("_bv"))
    c = mapping.by_district.select(F.col("w").alias("_cw"), F.col("d").alias("_cd"), F.col("n").alias("_cn"), F.col("vals").alias("_cv"))
    col = F.col
    found = df.join(F.broadcast(a), (col(p) == col("_ap")) & (col(d) == col("_ad")) & (col(w) == col("_aw")), "left")
    found = found.join(F.broadcast(b), (col(w) == col("_bw")) & (col(p) == col("_bp")), "left")
    found = found.join(F.broadcast(c), (col(w) == col("_cw")) & (col(d) == col("_cd")), "left")
    return _answers(found, out, how).drop("_ap", "_ad", "_aw", "_av", "_bw", "_bp", "_bn", "_bv", "_cw", "_cd", "_cn", "_cv")
