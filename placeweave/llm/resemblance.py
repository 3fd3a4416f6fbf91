"""Near copies: SimHash candidates, verified by exact five-word resemblance.

Texts are first made distinct by their sets of five-word shingles, so copies, also those that
differ in case or spacing only, are one node and never a pair. Candidates come from SimHash: under
each of ORDERS fixed orders of the 64 bits the pivots lie in groups of GROUP bits, and the
coordinates of one group, sharpened by two min-wise shingles, are a cell. Without the shingles the
number of unrelated texts in a cell would grow with the corpus; with them a cell holds texts that
share passages. Within a cell, pairs whose fingerprints lie within the radii are joined to
families; families are all that leaves a cell, never its pairs.

Cells and families are searched with representatives first: one is compared with all others, and
what it joins to the largest component so far needs no look of its own, as links between two members
of a component change nothing. So a crowd of copies of one text costs a few passes over it, not the
square of its size; only members outside the largest component are compared with everything.

Every family is then verified by its own texts: a link is a Jaccard resemblance of at least 0.8
between two sets of shingles. Large families are divided into blocks. The first block is compared
with all blocks; then those members that are outside the largest component found, with all blocks.
No link between different components is lost and no task holds more than two blocks. The cells come
from the fingerprint's bits directly, without pivot tables. The search for families goes by chance: two
texts at distance d (bits) and resemblance r share a given cell with probability
r^2 * C(64-d, GROUP) / C(64, GROUP), and there are 64 / GROUP * ORDERS of them.

Null and empty texts are one node; repeated rows share a node; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import connected
from .shingles import BITS, SEED, hashes, majority, words_of

# What a near copy is: words per shingle and least resemblance.
WORDS = 5
RESEMBLANCE = 0.8
#: Words per shingle of the fingerprint that proposes pairs.
FINGERPRINT_WORDS = 3
#: Orders of the bits, bits of a group, and the farthest candidates in bits of either fingerprint.
ORDERS = 8
GROUP = 8
RADIUS = 20
RADIUS_FIVE = 24
CELLS = ORDERS * (BITS // GROUP)
#: A block of a family: texts and shingles, about. They set how the work is dealt, never what is compared.
BLOCK_TEXTS = 1024
BLOCK_SHINGLES = 1 << 20
#: Rows of a cell above which representatives are compared first.
CROWD = 64
#: Members of families (one number each) up to which their list is broadcast; beyond, texts meet it by a shuffle.
BROADCAST_MEMBERS = 500_000


def shingles(own: list[bytes], words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words has one shingle of all."""
    return np.unique(hashes(own, words))


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard resemblance of two sets, each sorted and distinct; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def bit_orders() -> np.ndarray:
    """[order, 64]: fixed orders of the bits."""
    rng = np.random.default_rng(SEED)
    return np.stack([rng.permutation(BITS) for _ in range(ORDERS)]).astype(np.uint64)


_GROUPS = bit_orders().reshape(CELLS, GROUP)
_FACTORS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, 2 * CELLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.arange(GROUP, dtype=np.uint64)


def cells_of(fp: int, own: np.ndarray) -> np.ndarray:
    """The CELLS cell numbers of a text: coordinates of a group, and two min-wise shingles of the set."""
    least = np.full(2 * CELLS, ~np.uint64(0))
    for i in range(0, len(own), 4096):
        least = np.minimum(least, (own[None, i : i + 4096] * _FACTORS[:, None]).min(axis=1))
    bits = ((np.uint64(fp) >> _GROUPS & np.uint64(1)) << _SHIFTS).sum(axis=1, dtype=np.uint64)
    key = (np.arange(CELLS, dtype=np.uint64) << np.uint64(GROUP)) | bits
    for part in (least[:CELLS], least[CELLS:]):
        key = (key ^ part ^ (part >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, node (hash of the set of shingles), size of the set, fp and five (fingerprints), cells."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                words = words_of(text)
                own = shingles(words)
                fp = majority(shingles(words, FINGERPRINT_WORDS))
                rows.append((xxhash.xxh64_intdigest(own.tobytes()), len(own), fp, majority(own), cells_of(fp, own).view(np.int64)))
            node, size, fp, five = (np.array(x, np.uint64).view(np.int64) for x in (zip(*[r[:4] for r in rows], strict=True) if rows else [()] * 4))
            yield pd.DataFrame({"id": common.ids(b), "text_hash": b["text_hash"], "node": node, "size": size, "fp": fp, "five": five, "cells": [r[4] for r in rows]})

    text = common.text_of(text_col)
    plain = docs.select(*common.id_columns(id_col), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return plain.mapInPandas(run, "id long, text_hash long, node long, size long, fp long, five long, cells array<long>")


def near_in_cell(size: np.ndarray, fp: np.ndarray, five: np.ndarray) -> np.ndarray:
    """A label per row, equal for rows that pairs within the radii connect; rows are sorted by size.

    Each row that is compared is compared with all; rows that are never compared all lie in one component.
    """
    label, seen = np.arange(len(size)), np.zeros(len(size), dtype=bool)
    todo = np.array([len(size) // 2])
    while len(todo):
        i, todo = todo[0], todo[1:]
        seen[i] = True
        lo = np.searchsorted(size, (RESEMBLANCE - 1e-9) * size[i])
        hi = np.searchsorted(size, size[i] / (RESEMBLANCE - 1e-9), side="right")
        near = (np.bitwise_count(fp[lo:hi] ^ fp[i]) <= RADIUS) & (np.bitwise_count(five[lo:hi] ^ five[i]) <= RADIUS_FIVE)
        names = np.unique(label[lo:hi][near])
        if len(names) > 1:
            label[np.isin(label, names)] = names[0]
        if len(names) > 1 or seen.sum() == 1:  # who is outside changes only with the labels
            todo = np.flatnonzero(~seen & (label != np.bincount(label).argmax()))
    return label


def near_in_cells(cell: np.ndarray, size: np.ndarray, fp: np.ndarray, five: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect, in each cell, all pairs within the radii; rows are sorted by cell and size."""
    root = np.arange(len(cell))
    _, first, count = np.unique(cell, return_index=True, return_counts=True)
    large = np.repeat(count > CROWD, count)
    at, k = np.flatnonzero(~large), 1
    while len(at):
        at = at[at + k < len(cell)]
        # Sizes ascend: once the next one is too large, so are all after it.
        at = at[(cell[at] == cell[at + k]) & (size[at] >= (RESEMBLANCE - 1e-9) * size[at + k])]
        near = at[root[at] != root[at + k]]
        near = near[np.bitwise_count(fp[near] ^ fp[near + k]) <= RADIUS]
        near = near[np.bitwise_count(five[near] ^ five[near + k]) <= RADIUS_FIVE]
        for i in near.tolist():
            a, b = root[i], root[i + k]
            if a != b:
                lo, hi = np.searchsorted(cell, cell[i]), np.searchsorted(cell, cell[i], side="right")
                part = root[lo:hi]
                part[part == max(a, b)] = min(a, b)
        k += 1
    for lo, n in zip(first[count > CROWD].tolist(), count[count > CROWD].tolist(), strict=True):
        root[lo : lo + n] = lo + near_in_cell(size[lo : lo + n], fp[lo : lo + n], five[lo : lo + n])
    moved = np.flatnonzero(root != np.arange(len(cell)))
    return list(zip(moved.tolist(), root[moved].tolist(), strict=True))


def families(nodes: DataFrame) -> DataFrame:
    """node, root: connected candidates; nodes (node, size, fp, five, cells) without any are left out."""
    n = common.partitions(nodes.sparkSession)

    def search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in common.whole_groups(batches, "cell"):
            cell, size, node = (whole[c].to_numpy() for c in ("cell", "size", "node"))
            fp, five = (whole[c].to_numpy().view(np.uint64) for c in ("fp", "five"))
            found = near_in_cells(cell, size, fp, five)
            if found:
                i, j = np.array(found).T
                yield pd.DataFrame({"a": node[i], "b": node[j]}).drop_duplicates()

    placed = nodes.select(F.explode("cells").alias("cell"), "node", "size", "fp", "five")
    links = placed.repartition(n, "cell").sortWithinPartitions("cell", "size", "node").mapInPandas(search, "a long, b long")
    return connected(common.materialise(links, "candidates"))


def verified_links(sizes: np.ndarray, fp: np.ndarray, five: np.ndarray, sets: list[np.ndarray], side: np.ndarray, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all pairs of resembling sets: any two positions if side is all False, else only pairs across.

    known: labels of components found before; pairs of one label need no look.
    """
    order = np.argsort(sizes, kind="stable")
    sets = [sets[k] for k in order]
    sizes, fp, five, side = sizes[order], fp[order], five[order], side[order]
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.empty(0), np.empty(0, int))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(vocabulary), dtype=bool)
    root, across, out = np.arange(len(sets)) if known is None else np.unique(known[order], return_inverse=True)[1], bool(side.any()), []
    ends = np.searchsorted(sizes, sizes / (RESEMBLANCE - 1e-9), side="right")
    for i, end in enumerate(ends.tolist()):
        near = np.arange(i + 1, end)
        near = near[(root[near] != root[i]) & (np.bitwise_count(fp[near] ^ fp[i]) <= RADIUS) & (np.bitwise_count(five[near] ^ five[i]) <= RADIUS_FIVE)]
        if across:
            near = near[side[near] != side[i]]
        if not len(near):
            continue
        own = flat[starts[i] : starts[i + 1]]
        mark[own] = True
        for c in np.array_split(near, -(-int(sizes[near].sum()) // (1 << 22)) or 1):
            width = sizes[c]
            first = np.cumsum(width) - width
            hits = mark[flat[np.arange(width.sum()) + np.repeat(starts[c] - first, width)]]
            both = np.add.reduceat(hits, first, dtype=np.int64) if len(hits) else np.zeros(len(c), int)
            union = sizes[i] + width - both
            for j in c[(both >= RESEMBLANCE * union)].tolist():
                if root[i] != root[j]:
                    a, b = sorted((root[i], root[j]))
                    root[root == b] = a
                    out.append((int(order[i]), int(order[j])))
        mark[own] = False
    return out


def _compared(sent: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of each family's meetings (i, j): across the sides where a meeting has two, else among all."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(words_of(t)) for t in rows["t"]]
        sizes = np.array([len(s) for s in sets])
        bits = [rows[c].to_numpy().view(np.uint64) for c in ("fp", "five")]
        found = verified_links(sizes, *bits, sets, rows["side"].to_numpy(bool), rows["known"].to_numpy())
        name = rows["node"].to_numpy()
        return pd.DataFrame({"a": [name[x] for x, _ in found], "b": [name[y] for _, y in found]}, dtype="int64")

    return sent.join(texts, "text_hash").groupBy("family", "i", "j").applyInPandas(compare, "a long, b long")


def _first_links(dealt: DataFrame, texts: DataFrame) -> DataFrame:
    """Each family's first block, compared with itself and with every other block."""
    every = ["node", "text_hash", "size", "fp", "five", "family"]
    fixed = [F.col("node").alias("known"), F.lit(0).alias("i")]
    there = dealt.select(*every, *fixed, F.col("own").alias("j"), F.lit(False).alias("side"))
    first = dealt.filter("own = 0 and blocks > 1").select(*every, *fixed, F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("side"))
    return _compared(there.unionByName(first), texts)


def _later_links(dealt: DataFrame, links: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between components: members outside a family's largest one, compared with all its blocks."""
    every = ["node", "text_hash", "size", "fp", "five", "family", "known"]
    several = dealt.filter("blocks > 1").join(connected(links).withColumnRenamed("root", "known"), "node", "left")
    several = common.materialise(several.withColumn("known", F.coalesce("known", "node")), "labelled")
    largest = several.groupBy("family", "known").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("known", F.struct("n", "known")).alias("largest"))
    rest = common.materialise(several.join(largest, "family").filter("known <> largest and own <> 0"), "outside")
    if rest.isEmpty():
        return links.limit(0)
    rounds = F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    dealt_again = rest.groupBy("family").agg(rounds.alias("rounds"))
    again = several.join(dealt_again, "family")
    there = again.select(*every, F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("i"), F.col("own").alias("j"), F.lit(False).alias("side"))
    part = F.pmod(F.xxhash64("node", F.lit(SEED + 1)), "rounds").cast("int")
    asked = rest.join(dealt_again, "family").select(*every, part.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("side"))
    return _compared(there.unionByName(asked), texts).filter("a <> b")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, text_hash, fp, root (one for all that chains of verified links connect)."""
    marked = common.materialise(describe(docs, id_col, text_col), "described")
    one = F.min(F.struct("text_hash", "size", "fp", "five", "cells")).alias("x")
    nodes = common.materialise(marked.groupBy("node").agg(one).select("node", "x.*"), "nodes")
    members = nodes.drop("cells").join(families(nodes.filter("size > 0")).withColumnRenamed("root", "family"), "node")
    members = common.materialise(members, "members")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    dealt = common.materialise(members.join(members.groupBy("family").agg(blocks.alias("blocks")), "family"), "dealt")
    # Texts of members only; equal ones once. Texts stay where they are while the list of members is short.
    text, wanted = common.text_of(text_col), dealt.select("text_hash")
    wanted = F.broadcast(wanted) if dealt.count() <= BROADCAST_MEMBERS else wanted
    texts = docs.select(F.xxhash64(text).alias("text_hash"), text.alias("t")).join(wanted, "text_hash", "left_semi")
    texts = texts.groupBy("text_hash").agg(F.min("t").alias("t"))
    own = F.pmod(F.xxhash64("node", F.lit(SEED)), "blocks").cast("int")
    dealt = dealt.withColumn("own", own)
    links = common.materialise(_first_links(dealt, texts), "verified")
    links = links.unionByName(common.materialise(_later_links(dealt, links, texts), "verified"))
    roots = connected(links)
    return marked.join(roots, "node", "left").select("id", "text_hash", "fp", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that keep_one keeps, by the groups in found (id, text_hash, root)."""
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), F.coalesce("id", F.lit(0).cast("long")).alias("k"), F.col("text_hash").alias("h"))).alias("kept")
    kept = found.groupBy("root").agg(first).select("kept.*")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # whatever the columns are called
    own = F.col(id_col).cast("long")
    rows = docs.select(row, own.isNull().alias("unnamed"), F.coalesce(own, F.lit(0).cast("long")).alias("k"), F.xxhash64(common.text_of(text_col)).alias("h"))
    number = F.row_number().over(Window.partitionBy("unnamed", "k", "h").orderBy(F.col(f"row.{text_col}")))
    return rows.join(kept, ["unnamed", "k", "h"], "left_semi").withColumn("n", number).filter(F.col("n") == 1).select("row.*")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, columns as they are, with one row of each group of near copies: that of the least id (null ids last)."""
    return one_of_each(docs, near_copies(docs, id_col, text_col), id_col, text_col)
