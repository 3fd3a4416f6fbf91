"""Sum-of-squares packing of token documents into sequences of fixed capacity.

A document longer than the capacity is cut into pieces of exactly the capacity, after a first piece
that may be shorter. Each piece goes where the sum over residual gaps of squared counts of open
bins becomes smallest. Gaps are at most the capacity, so a placement costs O(capacity) whatever
the number of bins.

Pieces are dealt to shards by a hash of document, piece and ids; each shard packs its own pieces,
and the number of shards follows the number of pieces, so no task grows with the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_ids import encoder

#: Pieces of one shard, about; what a shard leaves open at its end is a few bins.
SHARD_PIECES = 16_384
PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def sum_of_squares(lengths: np.ndarray, capacity: int, early: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item in the given order, and the number of bins.

    A new bin opens only where no open one has room; with early, as the textbook has it, also where
    that makes the sum smaller than any open bin does. Ties go to an open bin, among these to the smallest gap left, then to
    the bin opened last at that gap. Lengths lie in 1..capacity; anything else is an error.
    """
    if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
        raise ValueError("a length is outside 1..capacity")
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap; full bins (gap 0) don't count
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    never = np.int64(1 << 60)
    for i, s in enumerate(lengths.tolist()):
        # Growth of the sum for a bin of gap g >= s: it leaves g and, unless full, joins g - s.
        cost = np.where(count[s:] > 0, 1 - 2 * count[s:], never)
        cost[1:] += 2 * count[1 : capacity + 1 - s] + 1
        best = int(cost.argmin())
        new = 2 * int(count[capacity - s]) + 1 if capacity > s else 0  # growth for a bin of its own
        if cost[best] < never and not (early and new < cost[best]):
            gap = s + best
            b = at[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += s
        if gap - s:
            at[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets, len(used)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """One row per piece, texts tokenised where they lie. Null text: empty, so just the end id."""
    common.bound_batches(docs.sparkSession)
    plain = docs.select(*common.id_columns(id_col), common.text_of(text_col).alias("text"))

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, end = encoder(tokenizer, added_tokens), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, row = [], []
            for i, text in enumerate(batch["text"]):
                ids, a, k = own.encode_batch([text])[0] + end, 0, 0
                n = len(ids) // 4
                b = n % capacity or min(n, capacity)
                while a < n:
                    rows.append((k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                    row.append(i)
                    a, b, k = b, b + capacity, k + 1
            out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32"])
            out.insert(0, "id", common.ids(batch)[row])
            yield out

    return plain.mapInPandas(cut, PIECES)


def pack_pieces(pieces: DataFrame, capacity: int, shard_pieces: int = SHARD_PIECES, early: bool = False) -> DataFrame:
    """pieces with sequence_id and offset. pieces is read twice, so it should be materialised. early: as in sum_of_squares."""
    shards = max(1, -(-pieces.count() // shard_pieces))
    shard = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(shards)).cast("int")
    dealt = pieces.select(*common.id_columns("id"), *[c for c in pieces.columns if c != "id"], shard.alias("shard"))

    def place(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in common.whole_groups(batches, "shard"):
            for key, rows in whole.groupby("shard", sort=False):
                # Longest first; the rest of the order only makes a repeated task give the same bins.
                rows = rows.sort_values(["length", "no_id", "id", "piece", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable")
                bins, offsets, _ = sum_of_squares(rows["length"].to_numpy(), capacity, early)
                yield rows.assign(id=common.ids(rows), sequence_id=(int(key) << 32) + bins, offset=offsets).drop(columns=["shard", "no_id"])

    # Shards go to partitions by their number: hashed, several could meet in one task while others wait.
    n = min(shards, common.partitions(pieces.sparkSession))
    return dealt.repartitionById(n, "shard").sortWithinPartitions("shard").mapInPandas(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null ids and texts, empty and repeated rows each have their piece; other columns are ignored;
    an empty table gives an empty result. added_tokens: their content in a text is that token.
    """
    pieces = common.materialise(pieces_of(docs, tokenizer, capacity, end_id, id_col, text_col, added_tokens), "pieces")
    return pack_pieces(pieces, capacity)
