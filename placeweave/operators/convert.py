"""Conversion of address groups: planned on column names, executed as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.mapping import Mapping, key_of
from ..plans.storage import scratch
from .lookup import lookup
from .ordering import numbered
from .status import STATUS, after_hit, after_miss


#: Distinct addresses of a group up to which each is looked up once, not row by row.
DISTINCT_KEYS = 200_000


@dataclass(frozen=True)
class AddressGroup:
    """Column names; None or '' where a group has no such column."""

    id_province: str | None = None
    id_district: str | None = None
    id_ward: str | None = None
    province: str | None = None
    district: str | None = None
    ward: str | None = None

    def cleaned(self) -> AddressGroup:
        return AddressGroup(*[getattr(self, f) or None for f in self.__dataclass_fields__])

    def valid(self) -> bool:
        return bool(self.ward and (self.province or self.district))


@dataclass(frozen=True)
class Layout:
    """Names and order of one group's output columns."""

    columns: list[str]
    id_province: str
    id_ward: str
    province: str


def plan_columns(columns: list[str], group: AddressGroup, suffix: str, options: int) -> Layout:
    """Where the new columns go; a column's place is relative to province and ward."""
    id_province, id_ward = group.id_province or f"province_id{suffix}", group.id_ward or f"ward_id{suffix}"
    own = [c for c in columns if c not in {group.id_province, group.id_district, group.id_ward}]
    anchor = next((c for c in (group.province, group.ward) if c in own), None)
    at = own.index(anchor) if anchor else len(own)
    own.insert(at, id_province)
    province = group.province
    if province is None:
        province = f"provinceName{suffix}"
        own.insert(at + 1, province)
    own.insert(own.index(group.ward), id_ward)
    after = own.index(group.ward) + 1
    own[after:after] = [c for n in range(2, options + 1) for c in (f"{id_ward}_option_{n}", f"{group.ward}_option_{n}")]
    return Layout([c for c in own if c != group.district], id_province, id_ward, province)


def by_distinct_keys(df: DataFrame, raw: dict[str, str | None], mapping: Mapping, most: int) -> DataFrame | None:
    """df with `_vals`, each distinct address looked up once; None where there are more than `most` of them.

    Addresses repeat a great deal, and putting one into its canonical form costs far more than
    hashing it. The distinct ones are written, so this reads df once more; the list is broadcast
    only after it has been counted.
    """
    spark = df.sparkSession
    cells = {k: F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string") for k, c in raw.items()}
    few = df.select(*[c.alias(f"_raw{k}") for k, c in cells.items()]).distinct().limit(most + 1)
    few.write.parquet(path := scratch(spark, "keys"))
    few = spark.read.parquet(path)
    if few.count() > most:
        return None
    found = lookup(few.withColumns({k: key_of(f"_raw{k}") for k in raw}), mapping).select(*[f"_raw{k}" for k in raw], "_vals")
    same = [F.col(f"_raw{k}").eqNullSafe(c) for k, c in cells.items()]
    return df.join(F.broadcast(found), same, "left").drop(*[f"_raw{k}" for k in raw])


def convert_group(df: DataFrame, group: AddressGroup, mapping: Mapping, suffix: str, options: int, distinct_keys: int = 0) -> DataFrame:
    """One group; an invalid one leaves everything as it is. A named column that is gone reads as ''."""
    group = group.cleaned()
    if not group.valid() or group.ward not in df.columns:
        return df
    has = lambda c: c if c in df.columns else None
    province, district = has(group.province), has(group.district)
    raw = {"_p": province, "_d": district, "_w": group.ward}
    found = by_distinct_keys(df, raw, mapping, distinct_keys) if distinct_keys else None
    if found is None:
        found = lookup(df.withColumns({k: key_of(c) for k, c in raw.items()}), mapping)
    layout = plan_columns(df.columns, AddressGroup(group.id_province, group.id_district, group.id_ward, province, district, group.ward), suffix, options)
    hit = F.col("_vals").isNotNull()
    part = lambda n, name: F.try_element_at("_vals", F.lit(n))[name]
    old = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    new = {
        layout.id_province: F.when(hit, part(1, "id_province")).otherwise(""),
        layout.id_ward: F.when(hit, part(1, "id_ward")).otherwise(""),
        layout.province: F.when(hit, part(1, "province")).otherwise(old(province) if province else F.lit("")),
        group.ward: F.when(hit, part(1, "ward")).otherwise(old(group.ward)),
        STATUS: F.when(hit, after_hit(F.col(STATUS))).otherwise(after_miss(F.col(STATUS), suffix)),
    }
    for n in range(2, options + 1):
        new[f"{layout.id_ward}_option_{n}"] = F.coalesce(part(n, "id_ward"), F.lit(""))
        new[f"{group.ward}_option_{n}"] = F.coalesce(part(n, "ward"), F.lit(""))
    return found.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in layout.columns])


def convert(df: DataFrame, groups: list[AddressGroup], mapping: Mapping, options: int | None = None, distinct_keys: int = 0) -> DataFrame:
    """A fold over the groups: later ones see what earlier ones rewrote.

    distinct_keys: look up up to so many distinct addresses once instead of row by row (0: never).
    options: the most values of a key that get columns; by default as many as the mapping has.
    Failed rows lose district and old ids too. A group without effect leaves the status ''.
    """
    if STATUS not in df.columns:
        df = df.withColumn(STATUS, F.lit(""))
    else:
        df = df.withColumn(STATUS, F.coalesce(F.col(STATUS), F.lit("")))
    options = mapping.most_values() if options is None else options
    for k, group in enumerate(groups, 1):
        df = convert_group(df, group, mapping, f"_group{k}", options, distinct_keys)
    return df


def with_ids(df: DataFrame, ordinal: str) -> DataFrame:
    """The 1-based row number in file order as first column `id`; ordinal is dropped.

    The readers' ordinals hold each row's place, so a count for each block of the files numbers all
    rows where they are; other ordinals are ranged, without one task for all rows.
    """
    if "id" in df.columns:
        raise ValueError("the input has a column named id already")
    cols = [c for c in df.columns if c != ordinal]
    return numbered(df, ordinal, "id").select("id", *[F.col(f"`{c}`") for c in cols])
