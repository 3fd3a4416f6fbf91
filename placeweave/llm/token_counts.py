"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch that were not counted before lie in ragged numpy arrays: all symbols behind
each other, and where each sequence begins. In each step every sequence's pair of lowest rank is
merged, wherever it stands in it and in all sequences at once; sequences without a pair are done, and
the symbols that are left are counted. A text's count is the sum over its pre-tokens.

What comes before the merges (control strings, normaliser, pre-tokens) is the library's own work, or,
for texts in which both surely agree, the same rules in compiled patterns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common
from .token_ids import UNSURE, byte_letters

#: Pre-tokens whose counts a worker keeps; later ones are counted in each batch anew.
CACHE_ENTRIES = 1_000_000
#: Symbols that are merged at once.
SYMBOLS = 1 << 21
NO_RANK = np.iinfo(np.int64).max

_loaded: dict[str, TokenCounter] = {}


class Merges:
    """Merge rules as arrays: pairs of symbols, sorted, with their ranks and what they become."""

    def __init__(self, model: dict):
        vocab: dict[str, int] = model["vocab"]
        rules = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.width = max(vocab.values(), default=0) + 1
        prefix = len(model.get("continuing_subword_prefix") or "")
        left, right = (np.array([vocab[r[i]] for r in rules], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b[prefix:]] for a, b in rules], np.int64)
        keys = left * self.width + right
        # A pair that is named twice has its last rank.
        order = np.argsort(keys, kind="stable")
        last = np.append(keys[order][1:] != keys[order][:-1], True) if len(order) else np.empty(0, bool)
        order = order[last]
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        # Where a symbol can be made after a pair that holds it, merging all places at once would differ.
        latest = np.full(self.width, -1, np.int64)
        np.maximum.at(latest, self.made, self.ranks)
        self.ordered = bool((self.ranks > np.maximum(latest[self.keys // self.width], latest[self.keys % self.width])).all())

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the rules, -1 where it is none."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int64)
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)


def surviving(symbols: np.ndarray, sizes: np.ndarray, merges: Merges) -> np.ndarray:
    """How many symbols are left of each sequence; `symbols` holds the sequences behind each other."""
    out = sizes.astype(np.int64)
    live = np.flatnonzero(out > 1)  # sequences that may still have a pair
    keep = np.repeat(out > 1, out)
    sym, seq = symbols[keep].astype(np.int64), np.repeat(np.arange(len(live)), out[live])
    while len(sym):
        joined = seq[:-1] == seq[1:]
        rule = np.full(len(sym), -1, np.int64)  # the pair that begins at each symbol
        rule[:-1][joined] = merges.find(sym[:-1][joined], sym[1:][joined])
        rank = np.where(rule >= 0, merges.ranks[rule] if len(merges.ranks) else NO_RANK, NO_RANK)
        first = np.flatnonzero(np.append(True, ~joined))
        lowest = np.minimum.reduceat(rank, first)
        sizes_now = np.diff(np.append(first, len(sym)))
        out[live] = sizes_now
        # Sequences without a pair leave.
        going = lowest != NO_RANK
        stay = np.repeat(going, sizes_now)
        sym, rule, rank, live = sym[stay], rule[stay], rank[stay], live[going]
        if not len(sym):
            break
        sizes_now, lowest = sizes_now[going], lowest[going]
        seq = np.repeat(np.arange(len(live)), sizes_now)
        hit = rank == lowest[seq]
        # Places that overlap (aaa): every other one, from the left. Without order, the first place only.
        spots = np.flatnonzero(hit)
        head = np.append(True, (np.diff(spots) > 1) | (np.diff(seq[spots]) > 0))
        if merges.ordered:
            run = np.arange(len(spots)) - np.maximum.accumulate(np.where(head, np.arange(len(spots)), 0))
            spots = spots[run % 2 == 0]
        else:
            spots = spots[np.append(True, np.diff(seq[spots]) > 0)]
        sym[spots] = merges.made[rule[spots]]
        gone = np.zeros(len(sym), bool)
        gone[spots + 1] = True
        sym, seq = sym[~gone], seq[~gone]
    return out


class TokenCounter:
    """count(texts): tokens of each text as the library's encode(text, add_special_tokens=False) has them.

    The content of an added token in a text is that one token, as by the library's default. Truncation
    and padding of the file are put out of use.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain byte-level BPE has ranks that can be merged like this")
        self.merges = Merges(model)
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.letters = byte_letters()
        if missing := [x for x in self.letters.values() for y in (x, x + self.suffix) if y not in self.vocab]:
            raise ValueError(f"a byte has no symbol: {missing[0]!r}")
        self.inner = np.array([self.vocab[self.letters[b]] for b in range(256)], np.int64)
        self.final = np.array([self.vocab[self.letters[b] + self.suffix] for b in range(256)], np.int64)
        self.bytes_of = {ch: b for b, ch in self.letters.items()}
        added = spec.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens must be plain strings of the text as it is written")
        self.added = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.normaliser, self.pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.latin = _latin_rule(spec)
        self.known: dict[bytes, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text without control strings, normalised, without the letters that stand for bytes."""
        if self.latin:
            try:
                data = text.encode("latin-1")
            except UnicodeEncodeError:
                data = None
            if data is not None and len(data.translate(None, UNSURE)) == len(data):
                # Latin-1 letters are composed as they are, and lower-cased one by one.
                return self.latin.findall(text.lower())
        shown = self.normaliser.normalize_str(text) if self.normaliser else text
        return [bytes(map(self.bytes_of.__getitem__, piece)).decode() for piece, _ in self.pre.pre_tokenize_str(shown)]

    def _parts(self, text: str) -> tuple[int, list[str]]:
        """Control tokens of a text, and the pre-tokens between them."""
        if self.added is None or not (found := len(self.added.findall(text))):
            return 0, self.pre_tokens(text)
        return found, [w for part in self.added.split(text) for w in self.pre_tokens(part)]

    def count(self, texts: list[str]) -> list[int]:
        out, waiting, known = [], [], self.known
        met: set[str] = set()
        for i, text in enumerate(texts):
            extra, words = self._parts(text)
            try:
                out.append(extra + sum(map(known.__getitem__, words)))
            except KeyError:
                out.append(extra)
                waiting.append((i, words))
                met.update(words)
        fresh = [w for w in met if w not in known]
        room = CACHE_ENTRIES - len(known)
        self._merge(fresh)
        for i, words in waiting:
            out[i] += sum(map(known.__getitem__, words))
        # What has no room, or is too long to come again, goes.
        for k, w in enumerate(fresh):
            if k >= room or len(w) > 40:
                del known[w]
        return out

    def _merge(self, words: list[str]) -> None:
        """Count new pre-tokens, those of like length together."""
        words = sorted(words, key=len)
        at = 0
        while at < len(words):
            size = end = 0
            part: list[bytes] = []
            while at + end < len(words) and size < SYMBOLS:
                part.append(words[at + end].encode())
                size += len(part[-1])
                end += 1
            sizes = np.fromiter(map(len, part), np.int64, end)
            data = np.frombuffer(b"".join(part), np.uint8)
            symbols, last = self.inner[data], np.cumsum(sizes) - 1
            symbols[last] = self.final[data[last]]
            self.known.update(zip(words[at : at + end], surviving(symbols, sizes, self.merges).tolist(), strict=True))
            at += end


# The pre-token pattern and normaliser of lower-casing BPE with word ends, as the file states them.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def _latin_rule(spec: dict) -> re.Pattern | None:
    """The file's pre-tokens of lower-case Latin-1 texts as a pattern with written-out classes, if it has these very rules."""
    split = {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    normaliser, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    if normaliser.get("normalizers") != NORMALISER or pre.get("pretokenizers") != [split, level]:
        return None
    sure = [chr(c) for c in range(256) if c not in UNSURE]
    letters = "".join(c for c in sure if c.isalpha())
    marks = "".join(re.escape(c) for c in sure if not c.isalnum() and not c.isspace())
    return re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[0-9]|[{marks}]+")


def counter(path: str) -> TokenCounter:
    """One per worker process."""
    if path not in _loaded:
        _loaded[path] = TokenCounter(path)
    return _loaded[path]


RESULT = "id long, n_bytes long, n_tokens long, over_limit boolean"


def count_documents(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens) for every row of docs.

    A null text counts as an empty one (no tokens), a null id stays null, repeated rows stay, an empty
    table gives an empty one; other columns are ignored. Texts of any length are counted whole.
    """
    common.bound_batches(docs.sparkSession)
    text = common.text_of(text_col)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                n = np.array(own.count(b.column("text").to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return plain.mapInArrow(run, RESULT)
