"""SimHash near-duplicates by pivot distance tables.

Each distinct fingerprint gets a table of Hamming distances to many reference fingerprints. The
references come in groups: those of group g differ from one base fingerprint only in the bits of
that group, so within a group the difference of two distances depends on the group's bits alone.
(The coordinates of a group are thus the same as a band of the fingerprint's own bits: candidates
are blocked by bands, read off the distance table; pruning and verification then work on distances.)
Flipping at most `max_bits` bits leaves all groups but `max_bits` untouched, and there every
coordinate of the table is equal: a pair is a candidate where all coordinates of all but max_bits
groups agree. Candidates whose tables differ by more than max_bits in any coordinate are
discarded, and the survivors are verified by their own Hamming distance. Nothing is lost: a pair
within max_bits shares such coordinates for certain.

Fingerprints are made distinct before any pair is looked for, and what leaves a cell is a forest
of links, not all its pairs. Cells with too many fingerprints are divided again by the same rule
on the bits still free, which bounds every cell by the number of values of its free bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, resemblance
from .components import connected
from .shingles import BITS, hashes, majority, words_of

#: Words per shingle of a fingerprint.
SHINGLE_WORDS = 3
#: Groups of pivots, bits of each, and parts of a large cell's free bits.
GROUPS = 4
WIDTH = BITS // GROUPS
PARTS = 4
#: Distinct fingerprints in a cell beyond which it is divided again.
CELL_LIMIT = 4096


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """A bit is 1 where more than half of the shingles' hashes (repeats included) have it set."""
    return majority(hashes(words_of(text), words))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def pivots(groups: int = GROUPS, width: int = WIDTH) -> np.ndarray:
    """Reference fingerprints [group, j]: the base 0 with bit j of the group set, and all bits from j up."""
    one = np.uint64(1)
    out = np.zeros((groups, 2 * width), dtype=np.uint64)
    for g in range(groups):
        for j in range(width):
            out[g, j] = one << np.uint64(g * width + j)
            out[g, width + j] = np.bitwise_or.reduce(one << np.arange(g * width + j, g * width + width, dtype=np.uint64))
    return out


def distance_table(fps: np.ndarray) -> np.ndarray:
    """int16 [fingerprint, 1 + pivots]: Hamming distances to the base and to each reference."""
    refs = np.concatenate([[np.uint64(0)], pivots().ravel()])
    return popcount(fps[:, None] ^ refs[None, :])


def cell_keys(table: np.ndarray, max_bits: int) -> np.ndarray:
    """uint64 [fingerprint, combination]: the coordinates of each choice of untouched groups, as one number.

    Within a group, distance to a reference less distance to the base says which bits are set there.
    """
    per = 2 * WIDTH
    rel = (table[:, 1:] - table[:, :1]).reshape(len(table), GROUPS, per)
    weights = (np.uint64(1) << np.arange(WIDTH, dtype=np.uint64))
    code = ((rel[:, :, :WIDTH] < 0) * weights).sum(axis=2, dtype=np.uint64)
    keys = []
    for c, kept in enumerate(combinations(range(GROUPS), GROUPS - max_bits)):
        key = np.full(len(table), np.uint64(c))
        for g in kept:
            key = key << np.uint64(WIDTH) | code[:, g]
        keys.append(key)
    return np.stack(keys, axis=1) if len(table) else np.empty((0, 1), np.uint64)


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of one cell: for each fingerprint linked to others there, one to the first it reaches."""
    table = distance_table(fps)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order].astype(np.int8)
    ends = np.searchsorted(table[:, 0], table[:, 0] + max_bits, side="right")  # the first coordinate, as a window
    root = np.arange(len(fps))
    for i, end in enumerate(ends.tolist()):
        near = np.arange(i + 1, end)
        for columns in (slice(1, 5), slice(5, 17), slice(17, None)):
            if not len(near):
                break
            near = near[np.abs(table[near, columns] - table[i, columns]).max(axis=1) <= max_bits]
        near = near[popcount(fps[near] ^ fps[i]) <= max_bits] if len(near) else near
        if len(near):
            roots = np.unique(np.append(root[near], root[i]))
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
    return [(int(fps[i]), int(fps[root[i]])) for i in range(len(fps)) if root[i] != i]


def _links(frame: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """Links within the cells of a frame sorted by cell."""
    cell, fps = frame["cell"].to_numpy(), frame["fp"].to_numpy().astype(np.int64).view(np.uint64)
    cut = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    sizes = np.diff(cut)
    out: list[tuple[int, int]] = []
    for size in range(2, 9):  # small cells together: every pair of positions at once
        starts = cut[:-1][sizes == size]
        if len(starts):
            for i, j in combinations(range(size), 2):
                a, b = fps[starts + i], fps[starts + j]
                ta, tb = distance_table(a), distance_table(b)
                kept = np.abs(ta - tb).max(axis=1) <= max_bits
                kept[kept] = popcount(a[kept] ^ b[kept]) <= max_bits
                out += zip(a[kept].tolist(), b[kept].tolist(), strict=True)
    for k in np.flatnonzero(sizes > 8):
        out += _forest(fps[cut[k] : cut[k + 1]], max_bits)
    return pd.DataFrame({"a": np.array([x for x, _ in out], np.uint64).view(np.int64), "b": np.array([x for _, x in out], np.uint64).view(np.int64)})


def _subkeys(fps: np.ndarray, combo: np.ndarray, max_bits: int) -> np.ndarray:
    """For members of large cells: keys by parts of the bits that their cell leaves free."""
    choices = list(combinations(range(GROUPS), GROUPS - max_bits))
    out = np.empty((len(fps), len(list(combinations(range(PARTS), PARTS - max_bits)))), dtype=np.uint64)
    for c, kept in enumerate(choices):
        rows = np.flatnonzero(combo == c)
        free = [b for g in range(GROUPS) if g not in kept for b in range(g * WIDTH, g * WIDTH + WIDTH)]
        bits = [(fps[rows] >> np.uint64(b)) & np.uint64(1) for b in free]
        size = len(free) // PARTS
        for k, parts in enumerate(combinations(range(PARTS), PARTS - max_bits)):
            key = np.full(len(rows), np.uint64(k + 1))
            for p in parts:
                for b in bits[p * size : (p + 1) * size]:
                    key = key << np.uint64(1) | b
            out[rows, k] = key
    return out


def link_fingerprints(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints, signed longs in column fp, that connect all pairs within max_bits."""
    spark = fps.sparkSession
    n = common.partitions(spark)

    def tables(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = b["fp"].to_numpy().astype(np.int64).view(np.uint64)
            for i in range(0, len(own), 20_000):
                part = own[i : i + 20_000]
                keys = cell_keys(distance_table(part), max_bits)
                width = keys.shape[1]
                yield pd.DataFrame({"cell": keys.ravel().view(np.int64), "combo": np.tile(np.arange(width, dtype=np.int32), len(part)), "fp": np.repeat(part, width).view(np.int64)})

    cells = common.materialise(fps.mapInPandas(tables, "cell long, combo int, fp long"), "cells")
    sizes = cells.groupBy("cell").count().filter("count > 1")
    placed = cells.join(sizes, "cell")

    def divide(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = b["fp"].to_numpy().astype(np.int64).view(np.uint64)
            keys = _subkeys(own, b["combo"].to_numpy(), max_bits)
            width = keys.shape[1]
            yield pd.DataFrame({"cell": np.repeat(b["cell"].to_numpy(), width), "sub": keys.ravel().view(np.int64), "fp": np.repeat(own, width).view(np.int64)})

    small = placed.filter(F.col("count") <= CELL_LIMIT).select("cell", F.lit(0).cast("long").alias("sub"), "fp")
    large = placed.filter(F.col("count") > CELL_LIMIT).select("cell", "combo", "fp").mapInPandas(divide, "cell long, sub long, fp long")
    # Two longs as one cell number: equal cells stay together, and a chance collision only adds comparisons.
    dealt = small.unionByName(large).select(F.xxhash64("cell", "sub").alias("cell"), "fp")

    def search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in common.whole_groups(batches, "cell"):
            found = _links(whole, max_bits)
            if len(found):
                yield found

    return dealt.repartition(n, "cell").sortWithinPartitions("cell", "fp").mapInPandas(search, "a long, b long").distinct()


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the fingerprint as a signed long), text_hash. Null text: empty, fingerprint zero."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": common.ids(b), "fp": np.array([fingerprint(t) for t in b["text"]], np.uint64).view(np.int64), "text_hash": b["text_hash"]})

    text = common.text_of(text_col)
    plain = docs.select(*common.id_columns(id_col), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return plain.mapInPandas(run, "id long, fp long, text_hash long")


def linked_fingerprints(docs: DataFrame, id_col: str, text_col: str, max_bits: int) -> DataFrame:
    """id, fp, text_hash, root (a fingerprint of the group) for each row; links are of at most max_bits bits."""
    marked = common.materialise(fingerprint_documents(docs, id_col, text_col), "fingerprints")
    distinct = common.materialise(marked.select("fp").distinct(), "distinct")
    roots = common.materialise(connected(link_fingerprints(distinct, max_bits)), "roots")  # linked ones only
    # Both sides of a join with hot keys are written tables: Spark splits a skewed side only where
    # the shuffle lies right below the join.
    return marked.join(roots, marked["fp"] == roots["node"], "left").select("id", "fp", "text_hash", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int | None = None) -> DataFrame:
    """Per row of docs: id, fp, text_hash, root, component (least id reachable over links).

    Rows are linked where their five-word shingles have a resemblance of 0.8 or more, or, with
    max_bits, where their fingerprints differ in at most so many bits. Repeated rows are kept as
    they are. Null ids are ignored as component names unless a component has no other. root, one
    for each group, tells such groups apart. An empty table gives no rows.
    """
    found = resemblance.near_copies(docs, id_col, text_col) if max_bits is None else linked_fingerprints(docs, id_col, text_col, max_bits)
    found = common.materialise(found, "linked")
    least = common.materialise(found.groupBy("root").agg(F.min("id").alias("component")), "least")
    return found.join(least, "root").select("id", "fp", "text_hash", "root", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int | None = None) -> DataFrame:
    """docs, columns as they are, with one row of each group of near_duplicates: that of the least id (null ids last).

    Rows that share an id are told apart by a hash of their text, so a group never loses its row to
    another one's. Only ids, fingerprints and hashes are grouped; the texts meet the list of kept
    rows by a join. Of rows with one id and one text, one stays.
    """
    if max_bits is None:
        return resemblance.keep_one(docs, id_col, text_col)
    found = linked_fingerprints(docs, id_col, text_col, max_bits)
    return resemblance.one_of_each(docs, found, id_col, text_col)


def hex_of(col: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))
