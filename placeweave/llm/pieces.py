"""SentencePiece models encoded and decoded by the tokenizers library.

The model file (a protocol buffer) is read field by field; its normaliser, whitespace marker, merges
or unigram scores and byte fallback are rebuilt as a tokenizer. If no piece holds the marker after
another character, no piece can reach over a word's start, so words are encoded once each and
kept; models with such pieces encode each text whole. New words of a batch go to the library's
own threads together.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

from . import common

MARK = "▁"
# Field numbers and kinds of the model format.
PIECES, TRAINER, NORMALISER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2

CACHE_WORDS = 600_000
#: New words that are encoded as one text.
RUN = 32
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_BYTE = re.compile("<0x([0-9A-Fa-f]{2})>")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        elif kind == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} is not in use")
        yield tag >> 3, value


@dataclass(frozen=True)
class PieceModel:
    pieces: list[tuple[str, float, int]]  # text, score, kind
    algorithm: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    fold_spaces: bool
    escape_spaces: bool

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            data = f.read()
        pieces, trainer, normaliser = [], {}, {}
        for number, value in fields(data):
            if number == PIECES:
                own = dict(fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
            elif number == TRAINER:
                trainer = dict(fields(value))
            elif number == NORMALISER:
                normaliser = dict(fields(value))
        return cls(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)))

    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def normaliser(self) -> normalizers.Normalizer:
        steps = []
        if self.charsmap:
            steps.append(normalizers.Precompiled(self.charsmap))
        if self.fold_spaces:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if self.escape_spaces:
            steps.append(normalizers.Replace(" ", MARK))
        return normalizers.Sequence(steps)

    def rebuild(self) -> Tokenizer:
        names = [p for p, _, _ in self.pieces]
        if self.algorithm == BPE:
            ids = {p: i for i, p in enumerate(names)}
            score = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER_DEFINED)}
            merges = []
            for piece, s in score.items():
                cuts = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in score and piece[k:] in score]
                merges += [(-s, ids[a], ids[b], a, b) for a, b in cuts]
            merges.sort()
            model = models.BPE(vocab=ids, merges=[(a, b) for *_, a, b in merges], unk_token=names[self.unknown()], fuse_unk=True, byte_fallback=self.byte_fallback, cache_capacity=0)
        elif self.algorithm == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unknown(), byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.algorithm} is not in use")
        out = Tokenizer(model)
        out.normalizer = self.normaliser()
        own = [AddedToken(p, normalized=True, special=False) for p, _, kind in self.pieces if kind == USER_DEFINED]
        if own:
            out.add_tokens(own)
        steps = [decoders.Replace(MARK, " ")] if self.escape_spaces else []
        steps += [decoders.ByteFallback(), decoders.Fuse()]
        if self.dummy_prefix:
            steps.append(decoders.Strip(" ", 1, 0))
        out.decoder = decoders.Sequence(steps)
        return out

    def spellings(self) -> list[bytes]:
        """What each id stands for in a decoded text, before a leading blank is cut."""
        named = [(p, _BYTE.fullmatch(p)) for p, _, _ in self.pieces]
        return [bytes.fromhex(m[1]) if m else (p.replace(MARK, " ") if self.escape_spaces else p).encode() for p, m in named]

    def breaks(self) -> bool:
        """Whether no piece holds a line break, so that merges never reach over one."""
        return self.algorithm == BPE and self.byte_fallback and self.escape_spaces and not any(k == USER_DEFINED or k != BYTE and "\n" in p for p, _, k in self.pieces)

    def by_words(self) -> bool:
        return self.escape_spaces and not any(k == USER_DEFINED or MARK in p.lstrip(MARK) for p, _, k in self.pieces)


class PieceCodec:
    """Encodes and decodes batches of texts; ids as little-endian uint32 bytes."""

    def __init__(self, path: str, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.path = path
        self.model = PieceModel.load(path)
        self.tokenizer = self.model.rebuild()
        self.words = self.model.by_words()
        self.plain = Tokenizer(self.tokenizer.model)  # for text already normalised
        self.plain_map = not self.model.charsmap and not self.model.fold_spaces
        self.known: dict[str, bytes] = {}  # word with its marks -> ids
        self.plain_words: dict[str, bytes] = {}  # the same for words after one mark, named without it
        self.breaks = self.model.breaks()
        self.starts = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.spelled = dict(enumerate(self.model.spellings()))
        self.reference = None

    def normalised(self, text: str) -> str:
        if not text:
            return ""
        if self.plain_map:  # what the rebuilt normaliser does, without a pass over its alignments
            text = f" {text}" if self.model.dummy_prefix else text
            return text.replace(" ", MARK) if self.model.escape_spaces else text
        return self.tokenizer.normalizer.normalize_str(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if not self.words:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.plain_map and self.model.dummy_prefix:
            # Without runs of blanks every word has one mark, so cutting at blanks is all there is to normalise.
            simple = [t and "  " not in t and t[0] != " " and t[-1] != " " and MARK not in t for t in texts]
            if all(simple):
                return self._join([self._blanks(t) for t in texts], self.plain_words, MARK)
            rest = iter(self._join([_WORDS.findall(self.normalised(t)) for t, s in zip(texts, simple, strict=True) if not s], self.known))
            fast = iter(self._join([self._blanks(t) for t, s in zip(texts, simple, strict=True) if s], self.plain_words, MARK))
            return [next(fast) if s else next(rest) for s in simple]
        return self._join([_WORDS.findall(self.normalised(t)) for t in texts], self.known)

    def _blanks(self, text: str) -> list[str]:
        """Words between blanks; a line break begins one too, as no piece holds it."""
        return (text.replace("\n", " \n") if self.breaks else text).split(" ")

    def _join(self, cut: list[list[str]], known: dict[str, bytes], mark: str = "") -> list[bytes]:
        """Ids of each list of words; a word stands for mark and itself, or for itself where it begins a line."""
        new = list(set().union(*cut).difference(known))
        fresh: dict[str, bytes] = {}
        for i in range(0, len(new), 8192):
            into = known if len(known) < CACHE_WORDS else fresh
            for w, ids in self._words(new[i : i + 8192], mark):
                (into if len(w) <= 40 else fresh)[w] = ids
        if not fresh:
            return [b"".join(map(known.__getitem__, c)) for c in cut]
        return [b"".join([known[w] if w in known else fresh[w] for w in c]) for c in cut]

    def _words(self, words: list[str], mark: str) -> Iterator[tuple[str, bytes]]:
        """Ids of words, by the library's own threads.

        Words that begin with one mark go RUN at a time as one text: no piece holds a mark after
        another character, so each piece with a mark begins the next word.
        """
        runs = [w for w in words if mark and w and w[0] != "\n"]
        alone = [w for w in words if not mark or not w or w[0] == "\n"]
        chunks = [runs[i : i + RUN] for i in range(0, len(runs), RUN)]
        for own, e in zip(chunks, self.plain.encode_batch_fast([mark + mark.join(c) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            data, starts = ids.tobytes(), (4 * np.flatnonzero(self.starts[ids])).tolist()
            for w, a, b in zip(own, starts, [*starts[1:], len(data)], strict=True):
                yield w, data[a:b]
        for w, e in zip(alone, self.plain.encode_batch_fast([w if w[:1] == "\n" else mark + w for w in alone], add_special_tokens=False), strict=True):
            yield w, array("I", e.ids).tobytes()

    def decode_batch(self, ids: list[bytes]) -> list[str]:
        """Texts of the ids, as the rebuilt decoder gives them.

        Ids are spelled as bytes. Where these are no UTF-8, or an id is unknown, the decoder itself
        marks what is broken. Pieces end with whole characters, so a broken run of byte pieces cannot
        be hidden by its neighbours.
        """
        spell = self.spelled.__getitem__
        out: list[str] = []
        for each in ids:
            numbers = array("I", each)
            try:
                text = b"".join(map(spell, numbers)).decode()
                out.append(text[1:] if self.model.dummy_prefix and text[:1] == " " else text)
            except (KeyError, UnicodeDecodeError):
                out.append(self.tokenizer.decode(numbers.tolist(), skip_special_tokens=False))
        return out

    def same_as_library(self, texts: list[str], ids: list[bytes]) -> list[bool]:
        """Whether the sentencepiece library gives the same ids."""
        if self.reference is None:
            self.reference = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return [array("I", x).tobytes() == b for x, b in zip(self.reference.encode(texts, num_threads=1), ids, strict=True)]


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


RESULT = "id long, n_tokens long, ids array<int>, ids_crc32 long, round_trip boolean, parity boolean"


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", verify: bool = True) -> DataFrame:
    """id, n_tokens, ids, ids_crc32, round_trip, parity: for every row of docs.

    Null text: empty, no ids. round_trip: decoding gives the text back; parity: the sentencepiece
    library gives the same ids (null unless verify). Repeated rows stay, other columns are ignored.
    """
    common.bound_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text"))
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                texts = b.column("text").to_pylist()
                ids = own.encode_batch(texts)
                back = own.decode_batch(ids)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([
                    b.column("id"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([x == y for x, y in zip(texts, back, strict=True)], pa.bool_()),
                    pa.array(own.same_as_library(texts, ids) if verify else [None] * len(ids), pa.bool_()),
                ], names=names)

    return plain.mapInArrow(run, RESULT)
