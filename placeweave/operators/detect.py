"""Which columns hold addresses: counted in Spark on a bounded sample, grouped on the driver by name."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import jaro_winkler
from ..functions.text import NUMERIC, place_key
from ..plans.mapping import KINDS
from .convert import AddressGroup

# Words that mark a column by its name.
PROVINCE_WORDS = (
    "tỉnh", "thành phố", "tỉnh/thành phố", "tỉnh thành", "province", "provincename",
    "prov", "city", "tinh", "thanhpho", "tinhthanh", "thanh pho", "tinh thanh",
)
DISTRICT_WORDS = (
    "huyện", "quận", "thị xã", "huyện/quận", "districtname", "district", "dist", "town",
    "township", "town ship", "quan", "huyen", "thi xa", "thixa", "quanhuyen",
)
WARD_WORDS = (
    "xã", "phường", "thị trấn", "xã/phường", "wardname", "communename", "commune", "ward",
    "townlet", "xa", "phuong", "thi tran", "thitran", "phuongxa",
)
WORDS = (PROVINCE_WORDS, DISTRICT_WORDS, WARD_WORDS)


def threshold(rows: int) -> int:
    """A column is a candidate when more than this many sample rows match."""
    return rows * 80 // 100


def enough(n: Column, rows: Column) -> Column:
    """Whether n of so many sample rows make a candidate."""
    return n > F.floor(rows * 80 / 100)


def membership(sample: DataFrame, units: DataFrame, columns: list[str]) -> DataFrame:
    """column, kind, n: how many sample values of each column are in each set of units."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), place_key(F.col(f"`{c}`")).alias("value")) for c in columns])
    long = sample.select(F.explode(pairs).alias("x")).select("x.*").filter(F.col("value") != "")
    # The sample has 500 rows at most, so it is the side to send.
    counted = units.join(F.broadcast(long), "value")
    return counted.groupBy("column", "kind").agg(F.count("*").alias("n"))


def numeric_columns(sample: DataFrame, columns: list[str]) -> set[str]:
    """Columns with at least one value that reads as a number."""
    if not columns:
        return set()
    row = sample.agg(*[F.coalesce(F.bool_or(F.col(f"`{c}`").cast("string").rlike(NUMERIC)), F.lit(False)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c for i, c in enumerate(columns) if row[i]}


def named(columns: list[str], words: tuple[str, ...], fall_back: bool) -> list[str]:
    if fall_back and len(columns) <= 1:
        return columns
    fit = [c for c in columns if any(w in c.lower() for w in words)]
    return fit or (columns if fall_back else [])


def candidates(sample: DataFrame, units: DataFrame, columns: list[str] | None = None) -> dict[str, list[str]]:
    """For each kind of unit the columns that may hold it, in column order."""
    columns = [c for c in (columns or sample.columns)]
    hits = {(r["column"], r["kind"]) for r in membership(sample, units, columns).filter(enough(F.col("n"), F.lit(sample.count()))).collect()}
    found = {k: [c for c in columns if (c, k) in hits] for k in KINDS}
    for k, words in zip(KINDS[:3], WORDS, strict=True):
        ids = named(found[k], words, fall_back=False)
        numbers = numeric_columns(sample, ids)
        found[k] = [c for c in ids if c in numbers]
    for k, words in zip(KINDS[3:], WORDS, strict=True):
        found[k] = named(found[k], words, fall_back=True)
    return found


def _matched(wards: list[str], others: list[str]) -> dict[int, str]:
    """Greedy: the most similar pair first (first in row-major order), each row and column once.

    A queue holds each row's best column that was free when it was put there. If that is taken by now, the
    row goes back with its next one; so a pair is looked at once, and nothing is scanned again.
    """
    waiting: list[tuple[float, int, int, int]] = []  # -score, row, column, place in the row's order
    orders: list[list[tuple[float, int]]] = []
    for i, w in enumerate(wards):
        orders.append(sorted((-s, j) for j, o in enumerate(others) if (s := jaro_winkler(w, o)) > 0))
        if orders[i]:
            waiting.append((orders[i][0][0], i, orders[i][0][1], 0))
    heapify(waiting)
    out: dict[int, str] = {}
    taken: set[int] = set()
    while waiting:
        _, i, j, at = heappop(waiting)
        if j not in taken:
            taken.add(j)
            out[i] = others[j]
            continue
        at = next((k for k in range(at + 1, len(orders[i])) if orders[i][k][1] not in taken), None)
        if at is not None:
            heappush(waiting, (*orders[i][at][:1], i, orders[i][at][1], at))
    return out


def group_columns(found: dict[str, list[str]]) -> list[AddressGroup]:
    """Candidates as address groups; empty slots are None."""
    kinds = [found[k] for k in KINDS]
    wards = found["wards"]
    if not wards:
        return []
    if len(wards) == 1 and all(len(k) <= 1 for k in kinds):
        return [AddressGroup(*[k[0] if k else None for k in kinds])]
    others = kinds[:5]
    pairs = [_matched(wards, k) for k in others]
    left_over = [i for i in range(len(wards)) if i not in pairs[3] and i not in pairs[4]]
    for i in left_over:
        for p in pairs[:3]:
            p.pop(i, None)
    rest = [next((c for c in k if c not in p.values()), None) for k, p in zip(others, pairs, strict=True)]
    return [AddressGroup(*(rest if i in left_over else [p.get(i) for p in pairs]), w) for i, w in enumerate(wards)]


def detect(sample: DataFrame, units: DataFrame) -> list[AddressGroup]:
    return group_columns(candidates(sample, units))
