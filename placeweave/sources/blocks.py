"""Splitting scan of files whose records reach over the places where Spark cuts them.

Spark's text reader cuts a file into blocks and each block into chunks at a separator of our choice: the
line break for CSV, `}` for JSON arrays, `)` for SQL dumps. Where a chunk stands (inside a quoted value, a
comment, a nested object) depends on everything before it, so a block alone can't tell. An automaton of
few states can, in two passes:

1. Every block tells, for each state it may begin in, the state it ends in. The driver composes these maps
   over the blocks in file order (a row for each block) and so knows the state that each begins in.
2. Every block cuts its chunks into records from its true state. What a block holds of a record that
   began in an earlier one, its head, is joined to that block's tail.

No file is read by one task, and rows are never shuffled: only heads are, one a block at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import scratch

#: Bits of an ordinal for the place in a block; the block's rank stands above them.
PLACE_BITS = 33
#: Bytes of heads that are broadcast; more are joined by shuffle.
HEAD_BYTES = 32 << 20
#: Blocks that are broadcast with their ranks and states.
MAX_BLOCKS = 200_000


class Piece(NamedTuple):
    """What a chunk adds to the record under way. `fresh` drops what was gathered before it."""

    text: str
    ends: bool
    fresh: bool = False


class Automaton(Protocol):
    """A format's rule. States are small hashable values; the first is that of a file's begin."""

    separator: str
    states: tuple

    def step(self, state, chunk: str) -> tuple:
        """State behind a chunk and its separator, and how much deeper the nesting is there."""

    def cut(self, state, depth: int, chunk: str, followed: bool = True) -> tuple:
        """State, depth and pieces of a chunk; followed: its separator stands behind it."""

    def neutral(self, state, depth: int) -> bool:
        """Whether no record is under way."""

    def goes_on(self, state, depth: int) -> bool:
        """Whether a file that ends so may go on in the next one of its path."""

    def last(self, state, depth: int) -> tuple:
        """State and depth behind a file whose last chunk has no separator, from those that step gives."""


@dataclass
class Block:
    """A block of a file as the reader cuts it, and where the automaton stands when it begins."""

    file: str
    start: int
    key: int
    chunks: int
    begin: str = ""  # the first characters that are no white space
    ends_file: bool = False
    followed: bool = True  # its last chunk has a separator behind it
    rank: int = 0
    state: object = None
    depth: int = 0
    maps: dict = field(default_factory=dict)
    owner: int | None = None  # rank of the block in which the record under way began


@dataclass
class Scan:
    """Records of the files at a path: `_ord` (file order; place in the block in the low bits), raw, first (of its file)."""

    records: DataFrame
    blocks: list[Block]
    final: list[tuple[Block, Block, object, int]]  # first and last block of each file, or of files that go on in each other; state and depth behind it


def chunks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """value and the key of its block, of every chunk; a block's chunks follow each other in one partition."""
    read = spark.read.option("lineSep", separator).text(path)
    return read.select("value", F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"))


def blocks_of(lines: DataFrame) -> list[Block]:
    """The blocks in order of files and places; the driver gets a row for each."""
    placed = lines.withColumn("at", F.monotonically_increasing_id())
    shown = F.substring(F.regexp_replace(F.substring("value", 1, 400), "^[\\s\ufeff]+", ""), 1, 40)
    found = placed.groupBy("key", "file", "start", "size").agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.min_by(shown, F.when(shown != "", F.col("at"))).alias("begin")).collect()
    known = [Block(r["file"], r["start"], r["key"], r["n"], r["begin"] or "") for r in found]
    known.sort(key=lambda b: (b.file, b.start))
    if len({b.key for b in known}) < len(known):
        raise RuntimeError("two blocks have one key")
    # A file ends with a separator if the chunks, each with one, are as long as the file (the reader leaves out
    # a byte-order mark). Of compressed files that isn't known; they count as ending without one.
    length: dict[str, int] = {}
    for r in found:
        length[r["file"]] = length.get(r["file"], 0) + r["bytes"]
    whole = {r["file"]: r["size"] - length[r["file"]] in (0, 3) for r in found}
    for rank, b in enumerate(known):
        b.rank = rank
        b.ends_file = rank + 1 == len(known) or known[rank + 1].file != b.file
        b.followed = not b.ends_file or whole[b.file]
    return known


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[str]]]:
    """Runs of chunks of one block; a block may come in several runs, one behind the other."""
    for b in batches:
        keys, values = b["key"].to_pylist(), b["value"].to_pylist()
        at = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[at]:
                yield keys[at], values[at:i]
                at = i


def folded(rule: Automaton, held: dict, values: list[str]) -> dict:
    """held (first state: state and depth now) after some more chunks. States that have met go on as one."""
    now = {state for state, _ in held.values()}
    moved = {s: (s, 0) for s in now}
    for chunk in values:
        seen = {}
        for s, (state, depth) in moved.items():
            if state not in seen:
                seen[state] = rule.step(state, chunk)
            onward, deeper = seen[state]
            moved[s] = (onward, depth + deeper)
    return {s: (moved[state][0], depth + moved[state][1]) for s, (state, depth) in held.items()}


def find_states(lines: DataFrame, rule: Automaton, known: list[Block], carry: bool = False) -> list[tuple[Block, Block, object, int]]:
    """Fill in every block's state, depth and owner; returns where each file ends. carry: a list that a file leaves open goes on in the next, if that begins with a comma."""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}

        def told() -> pa.RecordBatch:
            rows = [(last, rule.states.index(s), rule.states.index(state), depth) for s, (state, depth) in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=["key", "first", "last", "depth"])

        for key, values in _by_block(batches):
            if key != last:
                if last is not None:
                    yield told()
                last, held = key, {s: (s, 0) for s in rule.states}
            held = folded(rule, held, values)
        if last is not None:
            yield told()

    by_key = {b.key: b for b in known}
    for r in lines.select("value", "key").mapInArrow(fold, "key long, first long, last long, depth long").collect():
        by_key[r["key"]].maps[rule.states[r["first"]]] = (rule.states[r["last"]], r["depth"])
    ends: list[tuple[Block, Block, object, int]] = []
    first, state, depth = known[0], rule.states[0], 0
    for b in known:
        b.state, b.depth = state, depth
        b.owner = None if rule.neutral(state, depth) else b.rank - 1
        if state not in b.maps:
            raise RuntimeError(f"a block of {b.file} was cut otherwise in the second reading")
        state, deeper = b.maps[state]
        depth += deeper
        if b.ends_file:
            if not b.followed:
                state, depth = rule.last(state, depth)
            following = known[b.rank + 1] if b.rank + 1 < len(known) else None
            if not (carry and following and following.begin.startswith(",") and rule.goes_on(state, depth)):
                ends.append((first, b, state, depth))
                first, state, depth = following, rule.states[0], 0
    return ends


PIECES = "key long, place long, raw string, open boolean, first boolean"


def scan(spark: SparkSession, path: str, rule: Automaton, value: Column | None = None, carry: bool = False) -> Scan:
    """The records of all files at path, in order of file name and place. value: the chunk's text, where it isn't UTF-8."""
    lines = chunks(spark, path, rule.separator)
    if value is not None:
        lines = lines.withColumn("value", value)
    known = blocks_of(lines)
    if not known:
        return Scan(spark.createDataFrame([], "_ord long, raw string, first boolean"), [], [])
    ends = find_states(lines, rule, known, carry)
    begins = {b.key: (b.state, b.depth, b.start == 0, b.followed) for b in known}
    heads = _heads(lines, rule, known)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rest = None, None
        for key, values in _by_block(batches):
            if key != last:
                if rest is not None and (tail := rest.tail()):
                    yield _rows(last, tail)
                if key not in begins:
                    raise RuntimeError("a block was cut otherwise in the second reading")
                last, rest = key, _Cutter(rule, *begins[key])
            yield _rows(key, rest.take(values))
        if rest is not None and (tail := rest.tail()):
            yield _rows(last, tail)

    pieces = lines.select("value", "key").mapInArrow(cut, PIECES)
    if heads is not None:
        pieces = _joined(pieces, heads)
    return Scan(_ranked(pieces, known).select((F.shiftleft("rank", PLACE_BITS) + F.col("place")).alias("_ord"), "raw", "first"), known, ends)


def _ranked(rows: DataFrame, known: list[Block]) -> DataFrame:
    """rows (with the key of their block) and the block's rank."""
    ranks = rows.sparkSession.createDataFrame([(b.key, b.rank) for b in known], "key long, rank long")
    joined = rows.join(F.broadcast(ranks) if len(known) <= MAX_BLOCKS else ranks, "key", "left")
    lost = F.raise_error(F.lit("a block was cut otherwise in the second reading"))
    return joined.withColumn("rank", F.coalesce("rank", lost.cast("long")))


def in_order(read: DataFrame, known: list[Block]) -> DataFrame:
    """A file scan with `_ord`, its rows' order by file name and place. known: the blocks of all its files."""
    own = F.monotonically_increasing_id()
    if len({b.file for b in known}) < 2:
        return read.withColumn("_ord", own)
    place = own.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    keyed = read.withColumns({"_place": place, "key": F.xxhash64("_metadata.file_path", "_metadata.file_block_start")})
    return _ranked(keyed, known).withColumn("_ord", F.shiftleft("rank", PLACE_BITS) + F.col("_place")).drop("_place", "key", "rank")


def _rows(key: int, rows: list[tuple]) -> pa.RecordBatch:
    place, raw, opened, first = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([
        pa.array([key] * len(rows), pa.int64()), pa.array(place, pa.int64()), pa.array(raw, pa.string()), pa.array(opened, pa.bool_()), pa.array(first, pa.bool_()),
    ], names=["key", "place", "raw", "open", "first"])


class _Cutter:
    """Cuts the chunks of one block into records; what belongs to a record of an earlier block is left out."""

    def __init__(self, rule: Automaton, state, depth: int, at_begin: bool, followed: bool):
        self.rule, self.state, self.depth, self.at_begin, self.followed = rule, state, depth, at_begin, followed
        self.foreign = not rule.neutral(state, depth)  # inside a record of an earlier block
        self.held: list[str] = []
        self.kept: list[str] = []  # the last chunk so far, where the file's last one has no separator
        self.place = 0

    def take(self, values: list[str], final: bool = False) -> list[tuple]:
        out = []
        if not self.followed:
            values = self.kept + values
            self.kept = [] if final else values[-1:]
            values = values if final else values[:-1]
        for chunk in values:
            self.state, self.depth, pieces = self.rule.cut(self.state, self.depth, chunk, not final)
            for text, ends, fresh in pieces:
                if fresh:
                    self.held, self.foreign = [], False
                if not self.foreign:
                    self.held.append(text)
                if ends:
                    if not self.foreign:
                        out.append((self.place, "".join(self.held), False, self.at_begin and self.place == 0))
                        self.place += 1
                    self.held, self.foreign = [], False
        return out

    def tail(self) -> list[tuple]:
        """What is left at the block's end; last, the record under way, if it began here."""
        out = self.take([], True) if self.kept else []
        if self.held and not self.foreign and not self.rule.neutral(self.state, self.depth):
            out.append((self.place, "".join(self.held), True, self.at_begin and self.place == 0))
        return out


class _Head:
    """What a block holds of the record under way where it begins: up to its end, or to where it is dropped."""

    def __init__(self, rule: Automaton, state, depth: int, followed: bool):
        self.rule, self.state, self.depth, self.followed = rule, state, depth, followed
        self.held: list[str] = []
        self.kept: list[str] = []
        self.done = self.dropped = False

    def take(self, values: list[str], final: bool = False) -> None:
        if not self.followed and not final:
            values = self.kept + values
            self.kept, values = values[-1:], values[:-1]
        for chunk in values:
            if self.done:
                break
            self.state, self.depth, pieces = self.rule.cut(self.state, self.depth, chunk, not final)
            for text, ends, fresh in pieces:
                self.done = self.dropped = fresh
                if fresh:
                    break
                self.held.append(text)
                self.done = ends
                if ends:
                    break

    def told(self, key: int) -> pa.RecordBatch:
        if self.kept and not self.done:
            self.take(self.kept, True)
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array(["".join(self.held)]), pa.array([self.done]), pa.array([self.dropped])], names=["key", "head", "done", "drop"])


def _heads(lines: DataFrame, rule: Automaton, known: list[Block]) -> DataFrame | None:
    """key of the block in which the record began, and what later blocks hold of it; None if no record reaches over.

    drop: the record under way is dropped there, not ended.
    """
    over = [b for b in known if b.owner is not None]
    if not over:
        return None
    spark = lines.sparkSession
    begins = {b.key: (b.state, b.depth, b.followed) for b in over}
    # Blocks' own keys, a row for each block that begins inside a record.
    wanted = spark.createDataFrame([(b.key,) for b in over], "key long")
    some = lines.select("value", "key").join(F.broadcast(wanted) if len(over) <= MAX_BLOCKS else wanted, "key", "left_semi")

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for key, values in _by_block(batches):
            if key != last:
                if own is not None:
                    yield own.told(last)
                last, own = key, _Head(rule, *begins[key])
            own.take(values)
        if own is not None:
            yield own.told(last)

    some.select("value", "key").mapInArrow(gather, "key long, head string, done boolean, drop boolean").write.parquet(path := scratch(spark, "heads"))
    found = spark.read.schema("key long, head string, done boolean, drop boolean").parquet(path)
    # A block that is inside one record from begin to end passes it on.
    through = {r["key"] for r in found.filter("not done").select("key").collect()}
    by_rank = {b.rank: b for b in known}
    for b in over:
        prior = by_rank[b.rank - 1]
        b.owner = prior.owner if prior.owner is not None and prior.key in through else prior.rank
    owners = spark.createDataFrame([(b.key, b.rank, by_rank[b.owner].key) for b in over], "key long, rank long, owner long")
    parts = found.join(F.broadcast(owners) if len(over) <= MAX_BLOCKS else owners, "key").groupBy(F.col("owner").alias("key"))
    joined = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "head"))), lambda x: x["head"]), "").alias("head"), F.bool_or("drop").alias("drop"))
    joined.write.parquet(path := scratch(spark, "heads"))
    return spark.read.schema("key long, head string, drop boolean").parquet(path)


def _joined(pieces: DataFrame, heads: DataFrame) -> DataFrame:
    """pieces with the heads behind their open records; those that were dropped are left out."""
    size = heads.agg(F.coalesce(F.sum(F.octet_length("head") + 16), F.lit(0))).first()[0]
    named = heads.select(F.col("key").alias("k"), "head", "drop")
    whole = lambda df: df.filter(~F.coalesce("drop", F.lit(False))).select("key", "place", F.concat("raw", F.coalesce("head", F.lit(""))).alias("raw"), "open", "first")
    if size <= HEAD_BYTES:
        return whole(pieces.join(F.broadcast(named), F.col("open") & (F.col("key") == F.col("k")), "left"))
    return pieces.filter("not open").unionByName(whole(pieces.filter("open").join(named, F.col("key") == F.col("k"), "left")))
