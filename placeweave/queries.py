"""Driver queries: each operator of the engine on the star-schema tables.

Addresses are made of customer, nation and region: province = region, district = nation, ward =
market segment, some of them spoiled, so that exact, partial, ambiguous and missing keys all occur.
"""

from __future__ import annotations

import json
import sqlite3
import tempfile
import unicodedata
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import AddressEngine, NotFound
from .functions import text
from .functions.similarity import jaro_winkler
from .operators import convert as conversion
from .operators import detect as detection
from .operators import edits, ordering, status, tones
from .operators.convert import AddressGroup
from .operators.lookup import lookup
from .plans import mapping as mappings
from .plans.storage import scratch
from .sources import files, sinks
from .tasks import progress_of

GROUP = AddressGroup(province="province", district="district", ward="ward")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation with its region, and the market segments (a handful of names)."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    segments = table(spark, sf_dir, "customer").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    return places.withColumn("one", F.lit(1)).join(segments.withColumn("one", F.lit(1)), "one").drop("one")


def mapping_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _units(spark, sf_dir).select("*", F.posexplode("segments").alias("pos", "segment"))
    return rows.select(
        (F.col("n_nationkey") * 100 + F.col("pos")).cast("long").alias("ord"), F.col("n_regionkey").cast("string").alias("id_province"),
        F.col("n_nationkey").cast("string").alias("id_district"), F.col("pos").cast("string").alias("id_ward"),
        F.col("r_name").alias("province"), F.col("n_name").alias("district"), F.col("segment").alias("ward"),
        F.concat(F.lit("New "), "r_name").alias("new_province"), F.concat_ws(" ", "segment", "n_name").alias("new_ward"),
        F.concat(F.lit("P"), "n_regionkey").alias("new_id_province"), F.concat(F.lit("W"), F.col("n_nationkey") * 100 + F.col("pos")).alias("new_id_ward"),
    )


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One address per customer; every fifth province and every third district is spoiled."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    bad = lambda name, k: F.when(F.col("c_custkey") % k == 0, F.concat(F.lit("Bad "), name)).otherwise(F.col(name))
    return joined.select("c_custkey", bad("r_name", 5).alias("province"), bad("n_name", 3).alias("district"), F.col("c_mktsegment").alias("ward"))


def _looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = addresses(spark, sf_dir).select("c_custkey", *[text.place_key(F.col(c)).alias(k) for c, k in (("province", "_p"), ("district", "_d"), ("ward", "_w"))])
    found = lookup(keys, mappings.build(mapping_rows(spark, sf_dir)), how="how")
    return found.select("c_custkey", "how", F.try_element_at("_vals", F.lit(1))["ward"].alias("new_ward"))


def _converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversion.convert(addresses(spark, sf_dir), [GROUP], mappings.build(mapping_rows(spark, sf_dir)), distinct_keys=conversion.DISTINCT_KEYS)


def normalize_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_custkey") % 8
    name = F.col("n_name")
    noisy = (
        F.when(k == 0, F.concat(F.lit("Tỉnh "), name)).when(k == 1, F.concat(F.lit("  TP. "), name)).when(k == 2, F.concat(name, F.lit(" Province")))
        .when(k == 3, F.concat(F.lit("Quận 0"), F.col("c_custkey").cast("string"))).when(k == 4, F.concat(F.lit("District of "), name, F.lit(" (cũ)")))
        .when(k == 5, F.concat(name, F.lit("-x, y./ "))).when(k == 6, F.concat(F.lit("Thị xã Hoà "), name)).otherwise(name)
    )
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", text.normalize_place(noisy).alias("place"))


def tone_canonical_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.canonical_tones(F.lower("text"))).alias("canonical"))


def tone_dictionary_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the dictionary of distinct syllables."""
    found = tones.with_canonical(table(spark, sf_dir, "documents").select("doc_id", "text"), F.lower("text"), "canonical")
    return found.select("doc_id", F.md5("canonical").alias("canonical"))


def tone_changed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    d = table(spark, sf_dir, "documents").select("lang", low.alias("low"), text.canonical_tones(low).alias("canonical"))
    return d.groupBy("lang").agg(F.count_if(F.col("low") != F.col("canonical")).alias("changed"), F.count("*").alias("n"))


def mapping_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mappings.keyed(mapping_rows(spark, sf_dir)).select("p", "d", "w", F.col("val")["id_ward"].alias("id_ward"))


def mapping_grouped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping_rows(spark, sf_dir).withColumn("district", F.lit(""))
    return mappings.grouped(rows).select("p", "w", F.size("vals").cast("long").alias("n"), F.array_join(F.transform("vals", lambda v: v["ward"]), "|").alias("wards"))


def unit_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mappings.unit_sets(mapping_rows(spark, sf_dir))


def lookup_kind(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _looked_up(spark, sf_dir).filter(F.col("how") == kind).select("c_custkey", "new_ward")

    return query


def lookup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _looked_up(spark, sf_dir).groupBy("how").agg(F.count("*").alias("n"))


def _hot_ward(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Addresses of which one ward holds half, spoiled parts all different, and a mapping that has a key for each customer."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    places = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    joined = c.join(places, c["c_nationkey"] == n["n_nationkey"])
    key, hot = F.col("c_custkey"), F.lit("Big market")
    own = joined.filter(key % 2 == 1).select(key.cast("long").alias("ord"), "r_name", "n_name", F.col("c_name").alias("ward"))
    every = own.unionByName(places.select((-F.col("n_nationkey").cast("long") - 1).alias("ord"), "r_name", "n_name", hot.alias("ward")))
    units = {"id_province": "r_name", "id_district": "n_name", "id_ward": "ward", "province": "r_name", "district": "n_name", "ward": "ward", "new_province": "r_name", "new_id_province": "r_name"}
    rows = every.select("ord", *[F.col(v).alias(k) for k, v in units.items()], F.concat(F.lit("New "), "ward", F.lit(" "), "n_name").alias("new_ward"), F.concat(F.lit("W"), "ord").alias("new_id_ward"))
    bad = lambda name, k: F.when(key % k == 0, F.concat(F.lit("Bad "), key)).otherwise(F.col(name))
    return rows, joined.select("c_custkey", bad("r_name", 5).alias("province"), bad("n_name", 3).alias("district"), F.when(key % 2 == 0, hot).otherwise(F.col("c_name")).alias("ward"))


def lookup_hot_ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping beyond its broadcast bound: the lookup by shuffle, no task of which gathers the hot ward."""
    rows, facts = _hot_ward(spark, sf_dir)
    keys = facts.select("c_custkey", *[text.place_key(F.col(c)).alias(k) for c, k in (("province", "_p"), ("district", "_d"), ("ward", "_w"))])
    with mappings.build(rows, most=0) as mapping:
        return lookup(keys, mapping, how="how").select("c_custkey", "how", F.try_element_at("_vals", F.lit(1))["ward"].alias("new_ward"))


def convert_single_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(spark, sf_dir)


def convert_multi_group_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups with their own columns; the second one's district is never spoiled, its ward sometimes."""
    a = addresses(spark, sf_dir)
    ward2 = F.when(F.col("c_custkey") % 7 == 0, "nowhere").otherwise(F.col("ward"))
    two = a.withColumns({"province2": F.regexp_replace("province", "^Bad ", ""), "district2": F.regexp_replace("district", "^Bad ", ""), "ward2": ward2})
    groups = [GROUP, AddressGroup(province="province2", district="district2", ward="ward2")]
    return conversion.convert(two, groups, mappings.build(mapping_rows(spark, sf_dir)), distinct_keys=conversion.DISTINCT_KEYS)


def convert_no_province(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", F.col("n_name").alias("district"), F.lit("BUILDING").alias("ward"))
    return conversion.convert(rows, [AddressGroup(district="district", ward="ward")], mappings.build(mapping_rows(spark, sf_dir)))


def convert_options_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old keys without district have several new values, which widen the row by as many as the mapping has."""
    rows = mapping_rows(spark, sf_dir).withColumn("district", F.lit("x")).filter(F.col("id_ward") == "0")
    a = addresses(spark, sf_dir).withColumn("district", F.lit("x"))
    return conversion.convert(a, [GROUP], mappings.build(rows))


def unit_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = ordering.head(addresses(spark, sf_dir), 500, "c_custkey")
    return detection.membership(sample, mappings.unit_sets(mapping_rows(spark, sf_dir)), ["province", "district", "ward"])


def detect_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = ordering.head(addresses(spark, sf_dir), 500, "c_custkey")
    n = detection.membership(sample, mappings.unit_sets(mapping_rows(spark, sf_dir)), ["province", "district", "ward"])
    return n.select("column", "kind", detection.enough(F.col("n"), F.lit(sample.count())).alias("candidate"))


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with two clean addresses, ids of units, a note that holds unit names and a column too spoiled to count."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    at = lambda c, k: F.when(F.col("s_suppkey") % k == 0, "?").otherwise(F.col(c))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        "s_suppkey", (F.col("n_nationkey") % 4 + 1).cast("string").alias("home_province_id"), F.col("r_name").alias("home_province"), F.col("n_name").alias("home_district"),
        F.lit("building").alias("home_ward"), F.upper("r_name").alias("work_province"), F.concat(F.lit("Quận "), "n_name").alias("work_district"), F.lit("Phường Machinery").alias("work_ward"),
        F.col("r_name").alias("note"), at("r_name", 4).alias("old_province"),
    )


def _sheet_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.head(_sheet(spark, sf_dir), 500, "s_suppkey").drop("s_suppkey")


def detect_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detection.candidates(_sheet_sample(spark, sf_dir), mappings.unit_sets(mapping_rows(spark, sf_dir)))
    rows = [(kind, i, c) for kind, columns in found.items() for i, c in enumerate(columns)]  # names of columns
    return spark.createDataFrame(rows, "kind string, place int, column string")


def _group_rows(spark: SparkSession, cases: dict[str, list[AddressGroup]]) -> DataFrame:
    names = list(AddressGroup.__dataclass_fields__)
    rows = [(case, i, *(getattr(g, f) for f in names)) for case, groups in cases.items() for i, g in enumerate(groups)]
    return spark.createDataFrame(rows, "case string, place int, " + ", ".join(f"{f} string" for f in names))


def detect_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group_rows(spark, {"sheet": detection.detect(_sheet_sample(spark, sf_dir), mappings.unit_sets(mapping_rows(spark, sf_dir)))})


def group_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group, several, one whose ward has no partner of its own, none without wards."""
    none = dict.fromkeys(mappings.KINDS, [])
    return _group_rows(spark, {
        "single": detection.group_columns(none | {"provinces": ["tinh"], "wards": ["xa"]}),
        "several": detection.group_columns(none | {"provinces": ["home_p", "work_p"], "districts": ["work_d", "home_d"], "wards": ["home_w", "work_w"]}),
        "left_over": detection.group_columns(none | {"provinces": ["a_province"], "wards": ["a_ward", "zz"]}),
        "no_ward": detection.group_columns(none | {"provinces": ["p"], "districts": ["d"]}),
    })


def detect_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' sheet cut down: one group, a ward without partners, no ward at all."""
    sample, units = _sheet_sample(spark, sf_dir), mappings.unit_sets(mapping_rows(spark, sf_dir))
    cases = {"single": ["home_province", "home_district", "home_ward"], "left_over": ["home_province", "home_ward", "work_ward"], "no_ward": ["home_province", "home_district", "work_province"]}
    return _group_rows(spark, {case: detection.detect(sample.select(*columns), units) for case, columns in cases.items()})


def greedy_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a sheet 500 units wide, named by the nations: each ward finds the province and district of its name."""
    names = [r[0] for r in table(spark, sf_dir, "nation").select("n_name").orderBy("n_nationkey").collect()]  # names of columns
    stems = [f"{n}_{i:02d}" for i in range(20) for n in names]
    none = dict.fromkeys(mappings.KINDS, [])
    groups = detection.group_columns(none | {"wards": [f"{x}_ward" for x in stems], "provinces": [f"{x}_province" for x in reversed(stems)], "districts": [f"{x}_district" for x in sorted(stems)]})
    return spark.createDataFrame([(g.ward, g.province, g.district) for g in groups], "ward string, province string, district string")


def numeric_convertible(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    raw = F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).when(F.col("p_partkey") % 4 == 1, F.concat(F.col("p_size").cast("string"), F.lit("d"))).otherwise(F.col("p_size").cast("string"))
    return p.select("p_partkey", text.numeric(raw).alias("number"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.counts(_converted(spark, sf_dir))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("o_totalprice") / 1000 - 50
    return table(spark, sf_dir, "orders").select("o_orderkey", progress_of(share).cast("long").alias("progress"))


def percent_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of 2000 and less, many of them half way between two tenths."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 401).alias("part"), (F.col("o_orderkey") % 5 * 400).alias("whole"))
    return rows.select("o_orderkey", status.percent(F.col("part"), F.col("whole"), 100.0).alias("percent"))


def filter_mode(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return status.filtered(_converted(spark, sf_dir), mode).select("c_custkey", "ward", status.STATUS)

    return query


def export_success_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.export_rows(_converted(spark, sf_dir).withColumn("id", F.col("c_custkey")), "success")


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    newest = edits.latest(e, ["user_id"], F.desc("ts"), F.desc("event_id"))
    edited = F.create_map(F.lit("ward"), F.when(F.col("event_id") % 10 != 0, F.col("event_type")), F.lit("unknown"), F.lit("x"))
    return newest.select(F.col("user_id").cast("int").alias("row_index"), edited.alias("edited"))


def edit_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _converted(spark, sf_dir).withColumn("id", F.col("c_custkey"))
    return edits.overlay(base, _edits(spark, sf_dir), ["province", "ward", status.STATUS])


def edit_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.counts(edit_overlay(spark, sf_dir), empty=100.0)


def edit_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return edits.latest(e, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in file order, which is that of the keys, from the scan's own row index."""
    return ordering.file_rows(table(spark, sf_dir, "orders"), "id", ["o_orderkey", "o_custkey"])


def row_ids_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in order of a column that lies anyhow."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") * 7919 % 1000003 * 10000019 + F.col("o_orderkey")).alias("mixed"))
    return ordering.dense_numbers(o, "mixed", "id").drop("mixed")


def head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return ordering.head(li, ordering.sample_size(li.count()), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def suggested_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    counts = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in names]
    every = counts[0]
    for c in counts[1:]:
        every = every.union(c)
    return every.select("name", "n", ordering.workers_for(F.col("n")).cast("long").alias("workers"))


def jaro_winkler_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of columns against names of columns: metadata, scored on the driver."""
    names = sorted({c for t in ("customer", "supplier", "part", "orders", "lineitem", "nation", "region") for c in table(spark, sf_dir, t).columns})
    rows = [(a, b, round(jaro_winkler(a, b), 6)) for a in names for b in names]
    return spark.createDataFrame(rows, "a string, b string, score double")


def greedy_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = {
        "id_provinces": ["home_province_id", "work_province_id"], "id_districts": ["home_district_id", "work_district_id"], "id_wards": ["home_ward_id", "work_ward_id"],
        "provinces": ["home_province", "work_province"], "districts": ["home_district", "work_district"], "wards": ["home_ward", "work_ward"],
    }
    rows = [tuple(getattr(g, f) for f in AddressGroup.__dataclass_fields__) for g in detection.group_columns(found)]
    return spark.createDataFrame(rows, ", ".join(f"{f} string" for f in AddressGroup.__dataclass_fields__))


def sql_literal_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("O'"), "c_name")).when(F.col("c_custkey") % 3 == 1, F.col("c_name"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), "c_nationkey")
    return rows.select("c_custkey", sinks.insert_rows(rows).alias("literal"))


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("string").alias("n_regionkey"))


def _small_blocks(spark: SparkSession, path: str, read) -> DataFrame:
    """read(spark, path) while files are cut into twenty blocks or more, so that a small table is split like a large one."""
    size = max(1024, files.file_size(spark, path) // 20)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        _split(read(spark, path)).write.parquet(out := scratch(spark, "read"))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    return _several(spark.read.parquet(out))


def _split(read: DataFrame) -> DataFrame:
    """read with its rows' place among all, and the number of the task that read each."""
    return ordering.numbered(read.withColumn("_task", F.spark_partition_id()), files.ORD, "place").drop(files.ORD)


def _several(df: DataFrame) -> DataFrame:
    """df without `_task`, once more than one task has read it."""
    if df.select("_task").distinct().limit(2).count() < 2:
        raise AssertionError("one task has read everything")
    return df.drop("_task")


def csv_breaks_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as CSV, whose texts hold line breaks and quotes, read by many tasks. Spark reads the table's files by size, so doc_id sets the order."""
    d = table(spark, sf_dir, "documents").orderBy(F.col("doc_id").asc_nulls_last())
    rows = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit('"a"\n\n,'), "text", F.lit("\n")).alias("text"), "source")
    sinks.write_csv(rows, path := scratch(spark, "csv"))
    back = _small_blocks(spark, path, files.read_csv)
    return back.select("doc_id", F.md5("text").alias("text_md5"), "source", "place")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders in four ranges of their keys, one task and so one file each; some comments missing, some with quotes and brackets."""
    note = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("it's {\"("), "o_orderstatus", F.lit(")} -"))).when(F.col("o_orderkey") % 5 != 1, F.col("o_orderstatus"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), note.alias("note"), F.col("o_custkey").alias("customer"))
    return rows.repartitionByRange(4, F.col("key").cast("long")).sortWithinPartitions(F.col("key").cast("long"))


def sql_dump_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as a dump of several files, read by many tasks in the order of files and statements."""
    sinks.write_sql(_orders(spark, sf_dir), path := scratch(spark, "dump"), "orders")
    return _small_blocks(spark, path, lambda s, p: files.read_sql(s, p, unescape=True))


def sql_statement_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as one statement in several parts."""
    sinks.write_sql(_orders(spark, sf_dir), path := scratch(spark, "dump"), "orders", one_statement=True)
    return _small_blocks(spark, path, lambda s, p: files.read_sql(s, p, unescape=True))


def json_array_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as an array that several tasks write and many read."""
    sinks.write_json(_orders(spark, sf_dir), path := scratch(spark, "json"), array=True)
    if len(spark.read.text(path).inputFiles()) < 2:
        raise AssertionError("one task has written everything")
    return _small_blocks(spark, path, files.read_json)


def sql_dump_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sinks.write_sql(_nation(spark, sf_dir).repartitionByRange(3, "n_nationkey"), path := scratch(spark, "dump"), "nation")
    return files.read_sql(spark, path, unescape=True).drop(files.ORD)


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sinks.write_csv(_nation(spark, sf_dir), path := scratch(spark, "csv"))
    return files.read_csv(spark, path).drop(files.ORD)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns in an order that is not the alphabet's; some names missing, some with quotes."""
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('O"'), "c_name")).when(F.col("c_custkey") % 3 == 1, F.col("c_name"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("zeta"), name.alias("name"), F.col("c_mktsegment").alias("alpha"))


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sinks.write_json(_customers(spark, sf_dir), path := scratch(spark, "json"))
    return files.read_json(spark, path).drop(files.ORD)


def json_array_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sinks.write_json(_customers(spark, sf_dir), path := scratch(spark, "json"), array=True)
    return files.read_json(spark, path).drop(files.ORD)


def json_column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    sinks.write_json(_customers(spark, sf_dir), path := scratch(spark, "json"))
    names = [c for c in files.read_json(spark, path).columns if c != files.ORD]
    return spark.createDataFrame(list(enumerate(names)), "place int, name string")


def csv_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same names in Windows-1252 and, with a replacement character among them, in UTF-8."""
    n = table(spark, sf_dir, "nation")
    parts = []
    # Byte 0x96 is a dash in Windows-1252; Latin-1, which Spark writes, has a control character there.
    for encoding, charset, more in (("windows-1252", "ISO-8859-1", " café \x96 ü"), ("UTF-8", "UTF-8", " café – ü \ufffd")):
        own = F.concat(F.col("n_name"), F.lit(more))
        n.select(F.col("n_nationkey").cast("string").alias("key"), own.alias("name")).write.option("encoding", charset).csv(path := scratch(spark, "csv"), header=True)
        parts.append(files.read_csv(spark, path).select(F.lit(encoding).alias("encoding"), "key", "name"))
    return ordering.union_chunks(parts)


def excel_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as workbooks, written and read side by side; one sheet holds no more than 1,048,576 rows."""
    where = sinks.write_excel(_customers(spark, sf_dir), scratch(spark, "book"), one_file=False)
    return files.read_excel(spark, where).drop(files.ORD)


def sqlite_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [tuple(r) for r in _nation(spark, sf_dir).collect()]  # 25 rows
    with tempfile.NamedTemporaryFile(suffix=".db") as f:
        db = sqlite3.connect(f.name)
        db.execute("CREATE TABLE nation (n_nationkey TEXT, n_name TEXT, n_regionkey TEXT)")
        db.executemany("INSERT INTO nation VALUES (?, ?, ?)", rows)
        db.commit()
        db.close()
        sinks.put(spark, f.name, path := scratch(spark, "base") + ".db")
    return files.read_sqlite(spark, path, 500)[1].drop(files.ORD)


def file_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What uploads in each format are said to hold."""
    n, found = _nation(spark, sf_dir), []
    for kind, write in ((".csv", sinks.write_csv), (".json", sinks.write_json), (".sql", sinks.write_sql), (".xlsx", sinks.write_excel)):
        path = scratch(spark, "upload") + kind
        write(n.coalesce(1), path)
        info = files.file_info(spark, path)
        found.append((kind, info.rows, info.cols, "|".join(info.names), info.sample.count(), info.error is None))
    bad = files.file_info(spark, scratch(spark, "missing") + ".csv")
    found.append(("missing", bad.rows, bad.cols, "", 0, bad.error is None))
    return spark.createDataFrame(found, "kind string, n long, cols int, names string, sampled long, fine boolean")


def header_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.createDataFrame([("a,a,,a",), ("1,2,3,4",)], "value string").coalesce(1).write.text(path := scratch(spark, "heads"))
    names = [c for c in files.read_csv(spark, path).columns if c != files.ORD]
    return spark.createDataFrame(list(enumerate(names)), "place int, name string")


def header_repair_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet whose header holds each nation's region, so that names repeat, and every seventh name is missing."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    head = F.when(F.col("n_nationkey") % 7 != 3, F.col("r_name")).otherwise("")
    cells = n.join(r, n["n_regionkey"] == r["r_regionkey"]).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", head.alias("head"), "n_name"))).alias("c"))  # one row, as wide as nation
    lines = cells.select(F.explode(F.array(F.array_join("c.head", ","), F.array_join("c.n_name", ","))).alias("value"))
    lines.coalesce(1).write.text(path := scratch(spark, "heads"))
    sheet = files.read_csv(spark, path).drop(files.ORD)
    found = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("name"), F.col(f"`{c}`").alias("value")) for i, c in enumerate(sheet.columns)]
    return sheet.select(F.explode(F.array(*found)).alias("x")).select("x.*")


def ndjson_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as one object a line, with notes and empty lines between; numbers stay as they are written."""
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2")
    shown = F.concat(F.lit('{"key": '), "l_orderkey", F.lit(', "line": '), "l_linenumber", F.lit(', "quantity": '), F.format_string("%.2f", F.col("l_quantity").cast("double")), F.lit(', "deep": {"n": 1.50}}'))
    note = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit(" // "), shown)).when(F.col("l_orderkey") % 3 == 1, "  ").otherwise("")
    li.select(F.explode(F.array(shown, note)).alias("value")).write.text(path := scratch(spark, "notes"))
    return files.read_json(spark, path).drop(files.ORD)


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, found = scratch(spark, "out") + ".csv", []
    for _ in range(3):
        name = sinks.output_name(path, "success", spark)
        sinks.write_csv(_nation(spark, sf_dir), name)
        found.append(name.removeprefix(path.removesuffix(".csv")))
    return spark.createDataFrame(list(enumerate(found)), "place int, name string")


def sql_statement_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One multi-row statement; and the dump of no rows, which is a comment."""
    sinks.write_sql(_nation(spark, sf_dir), path := scratch(spark, "dump"), "nation", one_statement=True)
    sinks.write_sql(_nation(spark, sf_dir).limit(0), empty := scratch(spark, "dump"), "nation")
    note = spark.read.text(empty).select(F.lit("").alias("n_nationkey"), F.substring("value", 1, 2).alias("n_name"), F.lit("").alias("n_regionkey"))
    return files.read_sql(spark, path, unescape=True).drop(files.ORD).unionByName(note)


def _engine(spark: SparkSession, sf_dir: str) -> tuple[AddressEngine, str]:
    """An engine with the addresses' CSV taken in as a task and converted."""
    sinks.write_csv(addresses(spark, sf_dir).withColumn("c_custkey", F.col("c_custkey").cast("string")).orderBy(F.col("c_custkey").cast("long")).coalesce(1), path := scratch(spark, "upload") + ".csv")
    engine = AddressEngine(spark, mappings.build(mapping_rows(spark, sf_dir)), scratch(spark, "tasks"))
    task_id = engine.upload_and_detect(path)["task_id"]
    engine.start_conversion(task_id, [asdict(GROUP)], n_workers=2)
    return engine, task_id


def task_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, task_id = _engine(spark, sf_dir)
    return engine.records(task_id)


def task_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task after an upload, after a conversion, and after one that fails; counts are -1 where there are none."""
    engine, task_id = _engine(spark, sf_dir)
    done = engine.tasks.get(task_id)
    bad = engine.upload_and_detect(done["filename"])["task_id"]
    fresh = engine.tasks.get(bad)
    engine.tasks.update(bad, filename="gone.csv")
    failed = engine.start_conversion(bad, [asdict(GROUP)])
    rows = [(t["status"], t["progress"], t["step"], "|".join(t["columns"]), *((t["result"] or {}).get(c, -1) for c in ("total_rows", "success_count", "fail_count"))) for t in (fresh, done, failed)]
    return spark.createDataFrame(rows, "status string, progress int, step int, columns string, total long, success long, fail long")


def task_row_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits of one row, one without fields of another; a row that isn't there is an error."""
    engine, task_id = _engine(spark, sf_dir)
    engine.update_row(task_id, 3, {"ward": "first", "province": "P"})
    engine.update_row(task_id, "3", {"ward": "second"})
    engine.update_row(task_id, 5, {})
    try:
        engine.update_row(task_id, 0, {"ward": "nowhere"})
    except NotFound:
        return engine.records(task_id).filter("id <= 20").select("id", "province", "ward", status.STATUS)
    raise AssertionError("a missing row must not be found")


def task_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts kept after each of several edits, an edited row and a row that was right among them, and a recount of all records."""
    engine, task_id = _engine(spark, sf_dir)
    wrong = [r["id"] for r in engine.filtered_data(task_id, "error").select("id").orderBy("id").limit(3).collect()]
    right = engine.filtered_data(task_id, "success").select("id").orderBy("id").first()["id"]
    told = [engine.update_row(task_id, i, {"ward": f"w{i}"}) for i in (*wrong, wrong[0], right)]
    rows = [(step, t["total_rows"], t["success_count"], t["fail_count"], t["progress"]) for step, t in enumerate([*told, engine.recount(task_id)])]
    return spark.createDataFrame(rows, "step int, total long, success long, fail long, percent double")


def task_row_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _converted(spark, sf_dir).withColumn("id", F.col("c_custkey"))
    return edits.row_by_id(base, "7").select("c_custkey", "ward")


def task_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, task_id = _engine(spark, sf_dir)
    return engine.filtered_data(task_id, "error").select("c_custkey", "ward", status.STATUS)


def download(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine, task_id = _engine(spark, sf_dir)
        return files.read_csv(spark, engine.download(task_id, mode)).drop(files.ORD)

    return query


def group_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, task_id = _engine(spark, sf_dir)
    found = engine.group_preview(task_id, ["ward", "absent", "province"])
    return spark.createDataFrame([(i, r["ward"], r["province"]) for i, r in enumerate(found["sample_data"])], "place int, ward string, province string")


def edit_fields_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest value of each field that was ever edited; every tenth edit has none."""
    fields = F.when(F.col("event_id") % 10 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map("event_type", F.col("value").cast("string")))
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", fields.alias("edited"))
    found = edits.merged(e, ["user_id"], "edited", F.desc("ts"), F.desc("event_id"))
    return found.select("user_id", F.size("edited").cast("long").alias("fields"), F.array_join(F.array_sort(F.map_keys("edited")), "|").alias("names"))


def edits_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in files by id, and the newest event of each user laid into those files that hold its order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias(status.STATUS))
    orders.repartitionByRange("id").write.parquet(path := scratch(spark, "orders"))
    newest = edits.latest(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id"))
    made = newest.select(F.col("user_id").alias("row_index"), F.create_map(F.lit("priority"), F.col("event_type")).alias("edited"))
    now = edits.settle(spark.read.parquet(path), made, scratch(spark, "settled"))
    return spark.read.parquet(*now)


def child_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of the orders that are left."""
    left = table(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return edits.cascade(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), left, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


def compose_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = [unicodedata.normalize("NFD", x) for x in ("Hà Nội", "Đắk Lắk", "Thừa Thiên Huế", "QUẢNG NGÃI", "Bà Rịa - Vũng Tàu", "plain")]
    name = F.element_at(F.array(*map(F.lit, apart)), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.compose(name).alias("name"))


def mapping_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping written as its JSON file and read again."""
    rows = mapping_rows(spark, sf_dir).orderBy("ord").collect()  # 125 rows
    body = json.dumps([{f: r[k] for k, f in mappings.FIELDS.items()} for r in rows], ensure_ascii=False)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(path := scratch(spark, "mapping"))
    return mappings.read_rows(spark, path).select("ord", "province", "district", "ward", "new_ward", "new_id_ward")


def union_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    both = ordering.union_chunks([li.filter(F.col("l_orderkey") % 2 == 0), li.filter(F.col("l_orderkey") % 2 == 1).withColumn("extra", F.lit(""))])
    return both.groupBy(F.col("extra").isNull().alias("first_chunk")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    return ordering.without(n.select(F.col("n_nationkey").alias("key")), s.filter("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("key")))


def iso_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.iso_time(F.col("o_orderdate")).alias("at"))


QUERIES = {
    "normalize_place": normalize_place, "tone_canonical_docs": tone_canonical_docs, "tone_dictionary_docs": tone_dictionary_docs, "tone_changed_count": tone_changed_count,
    "mapping_key": mapping_key, "mapping_file": mapping_file, "mapping_grouped_values": mapping_grouped_values, "unit_sets": unit_sets,
    "lookup_exact": lookup_kind("exact"), "lookup_fallback_unique": lookup_kind("fallback"), "lookup_ambiguous": lookup_kind("ambiguous"), "lookup_counts": lookup_counts, "lookup_hot_ward": lookup_hot_ward,
    "convert_single_group": convert_single_group, "convert_multi_group_status": convert_multi_group_status, "convert_no_province": convert_no_province,
    "convert_options_wide": convert_options_wide, "unit_membership": unit_membership, "detect_threshold": detect_threshold, "numeric_convertible": numeric_convertible,
    "status_counts": status_counts, "progress": progress, "filter_success": filter_mode("success"), "filter_error": filter_mode("error"), "filter_all": filter_mode("all"),
    "export_success_projection": export_success_projection, "edit_overlay": edit_overlay, "edit_recount": edit_recount, "edit_upsert_latest": edit_upsert_latest,
    "row_ids": row_ids, "row_ids_ranged": row_ids_ranged, "head_sample": head_sample, "suggested_workers": suggested_workers, "jaro_winkler_pairs": jaro_winkler_pairs, "greedy_grouping": greedy_grouping,
    "csv_breaks_split": csv_breaks_split, "sql_dump_split": sql_dump_split, "sql_statement_split": sql_statement_split, "json_array_split": json_array_split,
    "sql_literal_format": sql_literal_format, "sql_dump_roundtrip": sql_dump_roundtrip, "csv_roundtrip": csv_roundtrip, "json_roundtrip": json_roundtrip,
    "detect_candidates": detect_candidates, "detect_groups": detect_groups, "group_cases": group_cases, "percent_half_even": percent_half_even,
    "json_array_roundtrip": json_array_roundtrip, "json_column_order": json_column_order, "csv_encodings": csv_encodings, "file_infos": file_infos,
    "header_repair": header_repair, "header_repair_units": header_repair_units, "ndjson_notes": ndjson_notes, "detect_cases": detect_cases, "greedy_wide": greedy_wide, "output_names": output_names, "sql_statement_roundtrip": sql_statement_roundtrip, "task_records": task_records, "task_state": task_state,
    "task_row_edit": task_row_edit, "task_edit_counts": task_edit_counts, "task_row_lookup": task_row_lookup, "task_filtered": task_filtered, "download_success": download("success"), "download_error": download("error"),
    "group_preview": group_preview, "edit_fields_merged": edit_fields_merged, "edits_settled": edits_settled, "child_cascade": child_cascade, "compose_marks": compose_marks,
    "excel_roundtrip": excel_roundtrip, "sqlite_sample": sqlite_sample, "union_chunks": union_chunks, "set_difference": set_difference, "iso_timestamps": iso_timestamps,
}
