"""Shards by best-fit-decreasing bin packing of indivisible groups.

Groups are equal texts; a group is never divided. Groups above a small size are placed one by one,
largest first, each into the bin with the tightest remaining capacity that holds it, found in a
balanced tree. Smaller ones are first put together, whole groups only, into bundles of about that
size, and a bundle is placed like a group. So the driver places UNITS groups and UNITS bundles at
most, or some for each shard where a capacity asks for more, whatever the number of texts, and no
bin ever holds more than its capacity (but for a single group that is larger).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Groups that are placed one by one, at most, and bundles of smaller ones, about.
UNITS = 1 << 15
#: A bundle is at most two of so many parts of a shard's capacity.
CAPACITY_PARTS = 32
#: Lists of small groups that are cut into bundles side by side.
BUNDLE_LISTS = 1024
#: Rows that one ordering task takes of a unit, at least, before it is salted.
SLOT_ROWS = 2000
ROW_BYTES = 16


class CapacityTree:
    """AVL tree of (remaining capacity, bin): insert, and take the least entry at or above a size."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list | None = None  # [key, left, right, height]

    def insert(self, key: tuple[int, int]) -> None:
        self.root = self._insert(self.root, key)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest entry whose capacity is at least size; ties to the lower bin."""
        node, found = self.root, None
        while node:
            if node[0][0] >= size:
                found, node = node[0], node[1]
            else:
                node = node[2]
        if found is not None:
            self.root = self._remove(self.root, found)
        return found

    @classmethod
    def _insert(cls, node: list | None, key: tuple[int, int]) -> list:
        if node is None:
            return [key, None, None, 1]
        side = 1 if key < node[0] else 2
        node[side] = cls._insert(node[side], key)
        return cls._balance(node)

    @classmethod
    def _remove(cls, node: list, key: tuple[int, int]) -> list | None:
        if key < node[0]:
            node[1] = cls._remove(node[1], key)
        elif key > node[0]:
            node[2] = cls._remove(node[2], key)
        elif node[1] is None:
            return node[2]
        elif node[2] is None:
            return node[1]
        else:
            after = node[2]
            while after[1]:
                after = after[1]
            node[0] = after[0]
            node[2] = cls._remove(node[2], after[0])
        return cls._balance(node)

    @staticmethod
    def _height(node: list | None) -> int:
        return node[3] if node else 0

    @classmethod
    def _balance(cls, node: list) -> list:
        lean = cls._height(node[1]) - cls._height(node[2])
        if abs(lean) > 1:
            side, other = (1, 2) if lean > 0 else (2, 1)
            child = node[side]
            if cls._height(child[other]) > cls._height(child[side]):
                node[side] = cls._turn(child, other)
            return cls._turn(node, side)
        node[3] = 1 + max(cls._height(node[1]), cls._height(node[2]))
        return node

    @classmethod
    def _turn(cls, node: list, side: int) -> list:
        """The child at side comes up."""
        other = 3 - side
        up = node[side]
        node[side], up[other] = up[other], node
        for x in (node, up):
            x[3] = 1 + max(cls._height(x[1]), cls._height(x[2]))
        return up


def best_fit_decreasing(sizes: dict[int, int], capacity: int, at_most: int | None = None) -> dict[int, int] | None:
    """Bin of each group; None if more than at_most bins were needed.

    A group larger than the capacity has a bin of its own. Groups of equal size are taken by name.
    """
    tree, out, bins = CapacityTree(), {}, 0
    for name, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        entry = tree.take(size)
        if entry is None:
            if bins == at_most:
                return None
            entry = (max(capacity, size), bins)
            bins += 1
        out[name] = entry[1]
        if entry[0] > size:
            tree.insert((entry[0] - size, entry[1]))
    return out


def near_equal(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Best fit decreasing at about the least capacity that needs no more than `shards` bins: tried by doubling, then halved twice."""
    left, n, rest = sorted(sizes.values(), reverse=True), shards, sum(sizes.values())
    for size in left:  # groups beyond an equal share fill shards of their own
        if n > 1 and size > rest / n:
            n, rest = n - 1, rest - size
        else:
            break
    share = -(-rest // n)
    low, slack = -1, 0
    while (found := best_fit_decreasing(sizes, share + slack, shards)) is None:
        low, slack = slack, max(1, share // 10_000, 2 * slack)
    for _ in range(2):
        mid = (low + slack) // 2
        if low < mid < slack:
            better = best_fit_decreasing(sizes, share + mid, shards)
            if better is None:
                low = mid
            else:
                slack, found = mid, better
    return found


def fixed_capacity(sizes: dict[int, int], capacity: int) -> dict[int, int]:
    """As few bins of the given capacity as best fit decreasing needs."""
    return best_fit_decreasing(sizes, capacity)


def _frame(spark: SparkSession, columns: dict[str, list[int]], schema: str) -> DataFrame:
    kinds = {"int": pa.int32(), "long": pa.int64()}
    typed = [part.split() for part in schema.split(", ")]
    table = pa.table({n: pa.array(columns[n], kinds[k]) for n, k in typed})
    return spark.createDataFrame(table)


def with_units(groups: DataFrame, most: int) -> DataFrame:
    """groups (h, text_crc32, size, n) with the unit (list, seq) that each is placed in.

    A group of over `most` bytes is a unit of its own, (-1, its hash). The others are taken list by
    list, larger ones first, and a new unit begins after every `most` bytes, so none has twice that.
    """
    each = groups.withColumn("bytes", F.col("size") * F.col("n"))
    large = each.filter(F.col("bytes") > most).select("*", F.lit(-1).alias("list"), F.col("h").alias("seq"))
    small = each.filter(F.col("bytes") <= most).withColumn("list", F.pmod("h", F.lit(BUNDLE_LISTS)).cast("int"))
    before = F.sum("bytes").over(Window.partitionBy("list").orderBy(F.desc("bytes"), "h", "text_crc32").rowsBetween(Window.unboundedPreceding, -1))
    return large.unionByName(small.withColumn("seq", F.floor(F.coalesce(before, F.lit(0)) / most).cast("long")))


def shard_documents(docs: DataFrame, shards: int = 40, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot: whole groups of equal texts in shards of near equal bytes.

    With capacity, as few shards of at most that many bytes as best fit finds (a larger group alone).
    Size: UTF-8 bytes plus 16, null text: no bytes. Null and empty texts are one group. Slots are
    gapless from 0 in each shard, by unit, then id (null ids first). Repeated rows each have a slot.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = common.text_of(text_col)
    base = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    base = common.materialise(base, "sizes")  # a few bytes a row, instead of the texts again
    groups = common.materialise(base.groupBy("h", "text_crc32", "size").agg(F.count("*").alias("n")), "groups")
    total = groups.agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0))).first()[0]
    most = min(total // UNITS, (total // shards if capacity is None else capacity) // CAPACITY_PARTS)
    groups = common.materialise(with_units(groups, max(1, most)), "units")
    units = groups.groupBy("list", "seq").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).orderBy("list", "seq").toPandas()
    sizes = dict(enumerate(units["bytes"].tolist()))
    placed = near_equal(sizes, shards) if capacity is None else fixed_capacity(sizes, capacity)

    # A unit with many rows is ordered in salted parts; their counts make the slots gapless.
    counts = units["n"].tolist()
    usual = max(SLOT_ROWS, -(-sum(counts) // UNITS))
    parts = [-(-n // usual) for n in counts]
    of = [placed[u] for u in range(len(units))]
    table = {"list": units["list"].tolist(), "seq": units["seq"].tolist(), "unit": list(range(len(units))), "parts": parts, "shard": of}
    # Units are bounded as the module says: a few numbers each, always small enough to broadcast.
    known = F.broadcast(_frame(spark, table, "list int, seq long, unit int, parts int, shard int"))
    rows = base.join(groups.select("h", "text_crc32", "size", "list", "seq"), ["h", "text_crc32", "size"]).join(known, ["list", "seq"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "size"), F.col("parts")).cast("int")).select("id", "size", "text_crc32", "unit", "part", "parts", "shard")
    rows = common.materialise(rows, "placed")
    part_counts = {(u, 0): n for u, n in enumerate(counts) if parts[u] == 1}
    if len(part_counts) < len(counts):  # at most twice UNITS parts
        part_counts |= {(r["unit"], r["part"]): r["count"] for r in rows.filter("parts > 1").groupBy("unit", "part").count().collect()}
    first, offsets = {}, []
    for u, part in sorted(part_counts):
        offsets.append(first.get(of[u], 0))
        first[of[u]] = offsets[-1] + part_counts[u, part]
    order = sorted(part_counts)
    starts = F.broadcast(_frame(spark, {"unit": [u for u, _ in order], "part": [p for _, p in order], "first": offsets}, "unit int, part int, first long"))
    number = F.row_number().over(Window.partitionBy("unit", "part").orderBy("id", "size", "text_crc32"))
    ranked = rows.withColumn("n", number - 1).join(starts, ["unit", "part"])
    return ranked.select("id", "size", "text_crc32", "shard", (F.col("first") + F.col("n")).cast("long").alias("slot"))
