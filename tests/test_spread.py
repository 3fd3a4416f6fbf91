"""Lookups beyond the broadcast bound: same answers, hot keys never in one task."""

import random

from pyspark.sql import functions as F

from placeweave.operators.lookup import heavy_keys, lookup, spread_join
from placeweave.plans import mapping as mappings


def _mapping(spark, most):
    names = [(f"p{p}", f"d{p}{d}", f"w{w}") for p in range(3) for d in range(3) for w in range(4) if (p + d + w) % 3]
    rows = [(i, p, d, w, f"n{i}") for i, (p, d, w) in enumerate(names)]
    frame = spark.createDataFrame(rows, "ord long, province string, district string, ward string, new_ward string")
    return mappings.build(frame.select("*", *[F.lit("").alias(f) for f in mappings.FIELDS if f not in frame.columns]), most=most)


def test_any_size_of_mapping_gives_the_same_answers(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["p0", "p1", "p2", "?", None]), rng.choice(["d00", "d11", "d22", "?", None]), "w1" if i % 2 else rng.choice(["w0", "w2", "w3", "?", None])) for i in range(800)]
    df = spark.createDataFrame(rows, "i int, _p string, _d string, _w string")
    shown = ["i", "_p", "_d", "_w", "_vals", "how"]
    want, got = ([tuple(r) for r in lookup(df, _mapping(spark, most), how="how").select(*shown).orderBy("i").collect()] for most in (1000, 0))
    assert len(got) == 800 and got == want and {r[5] for r in got} == {"exact", "fallback", "ambiguous", "miss"}
    assert lookup(df, _mapping(spark, 0)).columns == lookup(df, _mapping(spark, 1000)).columns


def test_empty_rows_and_empty_mapping(spark):
    df = spark.createDataFrame([(1, "p0", "d00", "w1"), (1, "p0", "d00", "w1")], "i int, _p string, _d string, _w string")
    assert lookup(df.limit(0), _mapping(spark, 0), how="how").count() == 0
    none = mappings.build(spark.createDataFrame([], "ord long, " + ", ".join(f"{f} string" for f in mappings.FIELDS)), most=-1)
    assert [r["how"] for r in lookup(df, none, how="how").collect()] == ["miss", "miss"]


def test_hot_keys_stay_where_they_are(spark):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = spark.range(8000).select("id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 16 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"))
    right = left.select("k").filter("k is not null").distinct().withColumn("v", F.concat(F.lit("v"), "k"))
    counted = left.groupBy("k").agg(F.count("*").alias("n"))
    heavy = heavy_keys(counted, ["k"], 8000)
    assert [r.k for r in heavy.collect()] == ["hot"]
    found = spread_join(left, right, ["k"], heavy)
    assert found.count() == 8000 and found.filter("not (v <=> concat('v', k))").count() == 0
    # What is shuffled by key: every task within twice the mean.
    light = left.join(heavy, left["k"].eqNullSafe(heavy["k"]), "left_anti").filter("k is not null")
    sizes = [r["count"] for r in light.repartition(tasks, "k").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * light.count() / tasks
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "Cartesian" not in plan
