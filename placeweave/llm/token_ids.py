"""Whole-text token ids from the tokenizers library, with an exact cache of words.

A byte-level BPE tokenizer first cuts a text into words, by a pattern that its format defines; no
merge reaches over a word's end. Cutting a text by that pattern and giving each new word to the
library's BPE model yields the ids of the whole text; a word met before needs no second run of the
merges. Texts whose characters all lie in Latin-1 are cut by the same pattern with its classes
written out, which is twice as fast. Tokenizers of any other make encode each text whole, and so
are texts that hold the content of an added token where this is to be read as that token.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

import regex
from tokenizers import Tokenizer

# The word pattern of the byte-level pre-tokenizer, as its format defines it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of Latin-1 that two libraries class differently; texts with them go by the pattern itself.
UNSURE = bytes(c for c in range(256) if chr(c).isspace() and not chr(c) in "\t\n\v\f\r " or chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal())
#: Words that one worker keeps; later ones are encoded each time.
CACHE_ENTRIES = 500_000

_loaded: dict[tuple[str, bool], TextEncoder] = {}


def latin_words() -> re.Pattern:
    """WORDS for texts in Latin-1 without UNSURE characters, its classes written out."""
    sure = [chr(c) for c in range(256) if c not in UNSURE]
    letters = "".join(c for c in sure if c.isalpha())
    marks = "".join(re.escape(c) for c in sure if not c.isalnum() and not c.isspace())
    return re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[0-9]+| ?[{marks}]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where visible, else the next from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class _Words(dict):
    """Word -> ids; what is missing is made, and kept while there is room."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        found = self.make(word)
        if len(self) < CACHE_ENTRIES and len(word) <= 40:
            self[word] = found
        return found


class TextEncoder:
    """encode_batch(texts): for each text its ids as little-endian uint32 bytes, equal to the
    library's own encode(text, add_special_tokens=False).

    An added token's content in a text is ordinary text, as with the library's encode_special_tokens,
    so that no text can hold a control token; with added_tokens it is that token, as by the
    library's default.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens", [])
        self.by_words = (
            spec["model"]["type"] == "BPE"
            and not spec.get("normalizer")
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not any(t.get("special") is False for t in added)
        )
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added)) if added_tokens and added else None
        self.model = self.tokenizer.model
        self.letters = str.maketrans(byte_letters())
        self.words, self.latin = regex.compile(WORDS), latin_words()
        self.known = _Words(self._merge)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return [self._encode(t) if self.by_words else self._whole(t) for t in texts]

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _encode(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            return self._whole(text)
        return b"".join(map(self.known.__getitem__, (self.latin if self._sure(text) else self.words).findall(text)))

    @staticmethod
    def _sure(text: str) -> bool:
        try:
            data = text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return len(data.translate(None, UNSURE)) == len(data)

    def _merge(self, word: str) -> bytes:
        shown = f"Ġ{word[1:]}" if word[0] == " " and word.isascii() and word[1:].isalpha() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()


def encoder(path: str, added_tokens: bool = False) -> TextEncoder:
    """One per worker process."""
    if (path, added_tokens) not in _loaded:
        _loaded[path, added_tokens] = TextEncoder(path, added_tokens)
    return _loaded[path, added_tokens]
