"""Token ids as a static range asymmetric numeral system (rANS) of independent interleaved blocks.

A segment is one binary value that stands alone: magic, header, the frequency table that all its
blocks share, a block directory, the blocks. A block holds whole documents and has its own final
states, renormalisation words, checkpoints (states and word position at every CHECK_STEPS steps,
so that parts of a block decode in parallel) and the crc32 of its ids.

Segments are kept in a Parquet folder, one row each (`range`, `segment`, `first`, `n_docs`,
`n_tokens`, `data`), so any store Spark can write takes them and a lost task is written again whole.
Empty documents have no ids of their own; an empty table yields a folder without segments.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_ids import encoder

MAGIC = b"RANSEG1\0"
BITS = 18  # of the frequency total
LOW = np.uint64(1 << 31)
LANES = 256
BLOCK_TOKENS = 1 << 17
SEGMENT_TOKENS = 1 << 21
CHECK_STEPS = 256

SEGMENTS = "range int, segment int, first long, n_docs int, n_tokens long, data binary"


def quantise(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that add up to 2**bits, at least 1 for each symbol with a count."""
    total, seen = 1 << bits, counts > 0
    if not seen.any():
        return np.zeros(len(counts), dtype=np.uint64)
    if seen.sum() > total:
        raise ValueError(f"{seen.sum()} symbols do not fit into {bits} bits")
    share = counts * ((total - seen.sum()) / counts.sum())
    freq = np.floor(share).astype(np.int64) + seen
    rest = total - int(freq.sum())
    order = np.argsort(-(share - np.floor(share)) * seen, kind="stable")
    freq[order[:rest]] += 1
    return freq.astype(np.uint64)


class Table:
    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols.astype(np.uint32), freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if len(freq) else self.freq
        self.slots: np.ndarray | None = None

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        # Ids are dense numbers below a vocabulary's size, so counting them needs no sort.
        counts = np.bincount(ids) if len(ids) and ids.max() < 1 << 24 else None
        symbols, counts = (np.flatnonzero(counts), counts[counts > 0]) if counts is not None else np.unique(ids, return_counts=True)
        return cls(symbols, quantise(counts))

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Each id's place among the symbols; an id that is not there is an error."""
        if not len(ids):
            return np.empty(0, np.int64)
        if not len(self.symbols) or ids.max() > self.symbols[-1]:
            raise ValueError("an id is not in the frequency table")
        if self.symbols[-1] < 1 << 24:
            place = np.full(int(self.symbols[-1]) + 1, -1, dtype=np.int32)
            place[self.symbols] = np.arange(len(self.symbols), dtype=np.int32)
            at = place[ids]
        else:
            at = np.searchsorted(self.symbols, ids)
            at = np.where(self.symbols[at] == ids, at, -1)
        if at.min() < 0:
            raise ValueError("an id is not in the frequency table")
        return at

    def by_slot(self) -> np.ndarray:
        if self.slots is None:
            self.slots = np.repeat(np.arange(len(self.freq), dtype=np.uint16 if len(self.freq) <= 1 << 16 else np.uint32), self.freq.astype(np.int64))
        return self.slots

    def dump(self) -> bytes:
        gaps = np.diff(self.symbols, prepend=np.uint32(0)).astype("<u4")
        return zlib.compress(gaps.tobytes() + self.freq.astype("<u4").tobytes(), 6)

    @classmethod
    def load(cls, data: bytes) -> Table:
        both = np.frombuffer(zlib.decompress(data), dtype="<u4")
        n = len(both) // 2
        return cls(np.cumsum(both[:n], dtype=np.uint32), both[n:])


_BITS, _TOP, _LOW32, _W32, _MASK = np.uint64(BITS), np.uint64(63 - BITS), np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64((1 << BITS) - 1)


def _push(x: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states after one more symbol on each lane; which lanes gave up a word first."""
    full = x >= (freq << _TOP)
    np.right_shift(x, _W32, out=x, where=full)
    q = x // freq
    return (q << _BITS) + (x - q * freq) + start, full


def encode_blocks(parts: list[np.ndarray], table: Table, lanes: int = LANES) -> list[bytes]:
    """Blocks of a segment, all coded in step with each other; each stands alone all the same."""
    order = sorted(range(len(parts)), key=lambda k: -len(parts[k]))
    own = [parts[k] for k in order]
    whole = [len(p) // lanes for p in own]  # steps with a symbol on every lane
    x = np.full((len(own), lanes), LOW, dtype=np.uint64)
    steps = max(whole, default=0)
    freq, start = np.ones((steps, len(own), lanes), np.uint64), np.zeros((steps, len(own), lanes), np.uint64)
    words: list[list[np.ndarray]] = [[] for _ in own]
    sizes = np.zeros(len(own), dtype=np.int64)
    marks: list[list[tuple[int, int, bytes]]] = [[] for _ in own]
    for k, ids in enumerate(own):
        at = table.places(ids)
        f, s, n = table.freq[at], table.start[at], whole[k] * lanes
        freq[: whole[k], k], start[: whole[k], k] = f[:n].reshape(-1, lanes), s[:n].reshape(-1, lanes)
        if rest := len(ids) - n:  # the last step, on some lanes only
            before = x[k, :rest].copy()
            x[k, :rest], full = _push(x[k, :rest].copy(), f[n:], s[n:])
            words[k].append((before[full] & _LOW32).astype("<u4"))
            sizes[k] += len(words[k][0])
            if whole[k] and whole[k] % CHECK_STEPS == 0:
                marks[k].append((whole[k], int(sizes[k]), x[k].astype("<u8").tobytes()))
    flat: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    active = 0
    for step in range(steps - 1, -1, -1):
        while active < len(own) and whole[active] > step:
            active += 1
        before = x[:active]
        after, full = _push(before.copy(), freq[step, :active], start[step, :active])
        flat.append((before[full] & _LOW32).astype("<u4"))
        counts = np.count_nonzero(full, axis=1)
        owner.append(counts)
        sizes[:active] += counts
        x[:active] = after
        if step and step % CHECK_STEPS == 0:
            for k in range(active):
                marks[k].append((step, int(sizes[k]), x[k].astype("<u8").tobytes()))
    if flat:
        # Words were made from the last step to the first, over all blocks; each block takes its own, in the reader's order.
        of = np.concatenate([np.repeat(np.arange(len(c), dtype=np.uint16 if len(own) <= 1 << 16 else np.int64), c) for c in reversed(owner)])
        body = np.concatenate(flat[::-1])[np.argsort(of, kind="stable")]
        ends = np.cumsum(np.bincount(of, minlength=len(own)))
        for k, end in enumerate(ends.tolist()):
            words[k].insert(0, body[(ends[k - 1] if k else 0) : end])
    out: list[bytes] = [b""] * len(parts)
    for k, ids in enumerate(own):
        total = int(sizes[k])
        head = struct.pack("<IIIII", len(ids), lanes, total, len(marks[k]), zlib.crc32(ids.astype("<u4").tobytes()))
        saved = b"".join(struct.pack("<II", s, total - o) + st for s, o, st in reversed(marks[k]))
        out[order[k]] = head + x[k].astype("<u8").tobytes() + saved + b"".join(w.tobytes() for w in words[k])
    return out


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES) -> bytes:
    return encode_blocks([ids], table, lanes)[0]


@dataclass
class _Run:
    """From one checkpoint of a block to the next."""

    n: int  # ids
    words: np.ndarray
    at: int  # next word
    x: np.ndarray


def _runs(data: bytes | memoryview) -> tuple[list[_Run], int]:
    """The block's runs, which can be decoded in any order or side by side, and the crc32 of its ids."""
    n, lanes, n_words, n_marks, crc = struct.unpack_from("<IIIII", data)
    at, starts = 20, []
    starts.append((0, 0, np.frombuffer(data, "<u8", lanes, at)))
    at += 8 * lanes
    for _ in range(n_marks):
        step, word = struct.unpack_from("<II", data, at)
        starts.append((step, word, np.frombuffer(data, "<u8", lanes, at + 8)))
        at += 8 + 8 * lanes
    words = np.frombuffer(data, "<u4", n_words, at)
    edges = [s * lanes for s, _, _ in starts] + [n]
    return [_Run(min(edges[k + 1], n) - edges[k], words, w, x.astype(np.uint64)) for k, (_, w, x) in enumerate(starts)], crc


def _decode_runs(runs: list[_Run], table: Table) -> list[np.ndarray]:
    """Ids of each run; runs of one lane count go in step with each other."""
    if not runs:
        return []
    lanes = len(runs[0].x)
    order = sorted(range(len(runs)), key=lambda k: -runs[k].n)
    own = [runs[k] for k in order]
    whole = [r.n // lanes for r in own]
    slots, freq, start = table.by_slot(), table.freq, table.start
    out = np.empty((len(own), max(whole) + 1, lanes), dtype=slots.dtype)
    x = np.stack([r.x for r in own])
    pool = np.concatenate([r.words[r.at :] if k == 0 else r.words for k, r in enumerate(own)]) if len(own) == 1 else None
    if pool is None:  # words of a block are shared by its runs: lay each array down once
        first: dict[int, int] = {}
        laid, size = [], 0
        for r in own:
            if id(r.words) not in first:
                first[id(r.words)] = size
                laid.append(r.words)
                size += len(r.words)
        pool = np.concatenate(laid)
        at = np.array([first[id(r.words)] + r.at for r in own], dtype=np.int64)
    else:
        at = np.zeros(1, dtype=np.int64)
    pool = pool.astype(np.uint64)

    def pull(y: np.ndarray, at: np.ndarray, into: np.ndarray) -> np.ndarray:
        slot = y & _MASK
        s = slots[slot]
        into[...] = s
        y = freq[s] * (y >> _BITS) + slot - start[s]
        short = y < LOW
        row, lane = np.nonzero(short)
        if len(row):
            counts = np.bincount(row, minlength=len(y))
            before = np.cumsum(counts) - counts
            y[row, lane] = (y[row, lane] << _W32) | pool[np.arange(len(row)) + (at - before)[row]]
            at += counts
        return y

    active = len(own)
    for step in range(max(whole)):
        while whole[active - 1] <= step:
            active -= 1
        x[:active] = pull(x[:active], at[:active], out[:active, step])
    for k, r in enumerate(own):
        if rest := r.n - whole[k] * lanes:
            pull(x[k : k + 1, :rest], at[k : k + 1], out[k : k + 1, whole[k], :rest])
    found: list[np.ndarray] = [np.empty(0, np.uint32)] * len(runs)
    for k, r in enumerate(own):
        found[order[k]] = table.symbols[out[k].reshape(-1)[: r.n]]
    return found


def decode_blocks(blocks: list[bytes | memoryview], table: Table) -> list[np.ndarray]:
    """All ids of each block, decoded from all of their checkpoints at once and checked against its crc32."""
    split = [_runs(b) for b in blocks]
    by_lanes: dict[int, list[tuple[int, int]]] = {}
    for i, (runs, _) in enumerate(split):
        for k, r in enumerate(runs):
            by_lanes.setdefault(len(r.x), []).append((i, k))
    pieces: list[list[np.ndarray]] = [[np.empty(0, np.uint32)] * len(runs) for runs, _ in split]
    for names in by_lanes.values():
        for (i, k), ids in zip(names, _decode_runs([split[i][0][k] for i, k in names], table), strict=True):
            pieces[i][k] = ids
    out = [np.concatenate(p) for p in pieces]
    for ids, (_, crc) in zip(out, split, strict=True):
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block does not match its checksum")
    return out


def decode_block(data: bytes, table: Table, part: int | None = None) -> np.ndarray:
    """All ids of a block, checked against its crc32; or part k, from checkpoint k (0: the start) to the next."""
    if part is None:
        return decode_blocks([data], table)[0]
    return _decode_runs([_runs(data)[0][part]], table)[0]


def encode_segment(doc_ids: list[int | None], docs: list[bytes]) -> bytes:
    """Whole documents (ids as little-endian uint32 bytes) in order; blocks are cut between documents, a longer document has a block of its own."""
    ids = np.frombuffer(b"".join(docs), "<u4")
    table = Table.of(ids)
    lens = np.fromiter(map(len, docs), "<u4", len(docs)) // 4
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    cuts, size, first = [], 0, 0
    for i, n in enumerate([*lens.tolist(), BLOCK_TOKENS + 1]):
        if i > first and size + n > BLOCK_TOKENS:
            cuts.append((first, i))
            first, size = i, 0
        size += n
    ends = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
    blocks = encode_blocks([ids[ends[a] : ends[b]] for a, b in cuts], table)
    packed = table.dump()
    index = zlib.compress(names.tobytes() + lens.astype("<u4").tobytes() + known.tobytes(), 6)
    head = MAGIC + struct.pack("<IIIII", len(docs), len(packed), len(index), len(blocks), zlib.crc32(packed + index))
    directory = b"".join(struct.pack("<II", b - a, len(x)) for (a, b), x in zip(cuts, blocks, strict=True))
    return b"".join([head, packed, index, directory, *blocks])


def decode_segment(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    if data[:8] != MAGIC:
        raise ValueError("not a segment")
    n, n_table, n_index, n_blocks, crc = struct.unpack_from("<IIIII", data, 8)
    at = 28
    if zlib.crc32(data[at : at + n_table + n_index]) != crc:
        raise ValueError("a segment's table does not match its checksum")
    table = Table.load(data[at : at + n_table])
    index = zlib.decompress(data[at + n_table : at + n_table + n_index])
    names, lens, known = np.frombuffer(index, "<i8", n), np.frombuffer(index, "<u4", n, 8 * n), np.frombuffer(index, np.uint8, n, 12 * n)
    at += n_table + n_index
    directory = [struct.unpack_from("<II", data, at + 8 * i) for i in range(n_blocks)]
    at, doc, view = at + 8 * n_blocks, 0, memoryview(data)
    blocks = []
    for _, size in directory:
        blocks.append(view[at : at + size])
        at += size
    for (n_docs, _), ids in zip(directory, decode_blocks(blocks, table), strict=True):
        ends = np.cumsum(lens[doc : doc + n_docs], dtype=np.int64)
        for i, (start, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True), doc):
            yield int(names[i]) if known[i] else None, ids[start:end]
        doc += n_docs


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> None:
    """Encode every text, append end_id, and write segments whose ranges ascend with the id.

    Null text: empty. Null ids come first; equal ids keep all their rows, ordered by a hash of their
    text. Other columns are ignored. added_tokens: their content in a text is that token.
    """
    common.bound_batches(docs.sparkSession)
    text = common.text_of(text_col)
    keyed = docs.select(common.key_of(id_col, text).alias("key"), text.alias("text"))
    ranges = common.find_ranges(keyed.select("key"))
    end = np.array([end_id], "<u4").tobytes()

    def segments(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(tokenizer, added_tokens)
        now, segment, first, size = 0, 0, 0, 0
        names: list[int | None] = []
        held: list[bytes] = []

        def row() -> pd.DataFrame:
            return pd.DataFrame({"range": [now], "segment": [segment], "first": [first], "n_docs": [len(held)], "n_tokens": [size], "data": [encode_segment(names, held)]})

        for batch in batches:
            for r, named, k, text in zip(batch["r"].tolist(), batch["named"].tolist(), batch["k"].tolist(), batch["text"], strict=True):
                if held and (r != now or size >= SEGMENT_TOKENS):
                    yield row()
                    segment, first, size, names, held = segment + 1, first + size, 0, [], []
                if r != now:
                    now, segment, first = r, 0, 0
                held.append(own.encode_batch([text])[0] + end)
                names.append(k if named else None)
                size += len(held[-1]) // 4
        if held:
            yield row()

    sent = keyed.withColumn("r", ranges.of(F.col("key")).cast("int")).repartitionById(ranges.n, "r").sortWithinPartitions("r", "key", "text")
    sent.select("r", "key.named", "key.k", "text").mapInPandas(segments, SEGMENTS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document: id, start, n_tokens, ids (little-endian uint32 bytes), from the files alone."""
    common.bound_batches(spark)
    files = spark.read.schema(SEGMENTS).parquet(path)
    # One number for each range; ranges are a few times the shuffle partitions.
    sums = files.groupBy("range").agg(F.sum("n_tokens").alias("n")).orderBy("range").collect()
    offsets, total = {}, 0
    for r in sums:
        offsets[r["range"]] = total
        total += r["n"]

    def documents(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r, first, data in zip(batch["range"], batch["first"], batch["data"], strict=True):
                start, rows = offsets[r] + first, []
                for name, ids in decode_segment(data):
                    rows.append((name, start, len(ids), ids.astype("<u4").tobytes()))
                    start += len(ids)
                out = pd.DataFrame(rows, columns=["id", "start", "n_tokens", "ids"])
                out["id"] = out["id"].astype("Int64")
                yield out

    return files.select("range", "first", "data").mapInPandas(documents, "id long, start long, n_tokens long, ids binary")


def ids_crc32(col: str) -> Column:
    return F.crc32(F.col(col))
