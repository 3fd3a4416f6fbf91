"""The mapping from old to new units, as three lookup tables and a table of unit names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import place_key, strip

# Field names of the mapping file.
FIELDS = {
    "id_province": "Mã I (CŨ)", "id_district": "Mã II (CŨ)", "id_ward": "Mã III (CŨ)",
    "province": "Tỉnh (CŨ)", "district": "Huyện (CŨ)", "ward": "Xã (CŨ)",
    "new_province": "Tỉnh", "new_ward": "Xã", "new_id_province": "Mã I", "new_id_ward": "Mã III",
}
KINDS = ("id_provinces", "id_districts", "id_wards", "provinces", "districts", "wards")
#: Distinct keys up to which the lookup tables are broadcast; larger mappings are joined by shuffle.
BROADCAST_KEYS = 200_000


@dataclass(frozen=True)
class Mapping:
    """exact: p, d, w -> vals. by_province: w, p -> n, vals. by_district: w, d -> n, vals. units: kind, value."""

    exact: DataFrame
    by_province: DataFrame
    by_district: DataFrame
    units: DataFrame
    keys: int
    most: int = BROADCAST_KEYS

    def close(self) -> None:
        """Release the prepared table; the mapping stays usable and is then computed again."""
        self.exact.unpersist()

    def __enter__(self) -> Mapping:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @property
    def is_small(self) -> bool:
        """Whether the lookup tables may be broadcast: by the counted number of keys."""
        return self.keys <= self.most

    def most_values(self) -> int:
        return self.exact.agg(F.coalesce(F.max(F.size("vals")), F.lit(0))).first()[0]


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The mapping file (a JSON array of objects) as rows with their ordinal; absent: '', null: 'None'."""
    parsed = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<map<string,string>>")).alias("ord", "m"))
    cell = lambda name: F.when(F.map_contains_key("m", F.lit(name)), F.coalesce(F.col("m")[name], F.lit("None"))).otherwise("")
    return parsed.select(F.col("ord").cast("long").alias("ord"), *[strip(cell(f)).alias(k) for k, f in FIELDS.items()])


def keyed(rows: DataFrame) -> DataFrame:
    return rows.select(
        place_key(F.col("province")).alias("p"), place_key(F.col("district")).alias("d"), place_key(F.col("ward")).alias("w"),
        F.struct("ord", F.col("new_province").alias("province"), F.col("new_ward").alias("ward"), F.col("new_id_province").alias("id_province"), F.col("new_id_ward").alias("id_ward")).alias("val"),
    )


def grouped(rows: DataFrame) -> DataFrame:
    """p, d, w, vals: all new values of an old key in file order, duplicates kept."""
    return keyed(rows).groupBy("p", "d", "w").agg(F.array_sort(F.collect_list("val")).alias("vals"))


def unit_sets(rows: DataFrame) -> DataFrame:
    """Six distinct sets of names and ids, blanks left out; ids as they are, names as keys."""
    ids = [strip(F.col(c)) for c in ("id_province", "id_district", "id_ward")]
    names = [place_key(F.col(c)) for c in ("province", "district", "ward")]
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in zip(KINDS, ids + names, strict=True)])
    return rows.select(F.explode(pairs).alias("u")).select("u.*").filter(F.col("value") != "").distinct()


def build(rows: DataFrame, materialise: bool = True, most: int = BROADCAST_KEYS) -> Mapping:
    """rows: ord and the columns of FIELDS. Nulls count as ''. most: the keys up to which lookups broadcast."""
    rows = rows.select("ord", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in FIELDS])
    exact = grouped(rows)
    if materialise:
        exact = exact.cache()

    def near(part: str) -> DataFrame:
        # One row per (ward, part); values only where a single key has both, which is all a lookup may accept.
        one = F.when(F.count("*") == 1, F.first("vals"))
        return exact.groupBy("w", part).agg(F.count("*").alias("n"), one.alias("vals"))

    return Mapping(exact, near("p"), near("d"), unit_sets(rows), exact.count(), most)


def key_of(c: str | None) -> Column:
    return place_key(F.col(f"`{c}`")) if c else F.lit("")
