"""Token counts against the library's own encoding."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from placeweave.llm import common, queries, token_counts

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


ODD = [
    "", " \n\t ", "aaaaaaaaaaaaaaaa aaa aaaa", "hello<|endoftext|>World's<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext|", "can't WE'RE it'S ''s 'LL 'll",
    "Élan µ ª º ß × ² ½ \x85 \xa0 \x1c a\x00b", "é İstanbul ΣΑΣ Привет 你好 🙂🙂 한국 Å ǅ ﬁ", "12345 a1b2 ٣٤", "x" * 5000, "ab" * 3000 + "c",
]


def test_odd_texts():
    assert token_counts.TokenCounter(PATH).count(ODD) == expected(ODD)


@given(st.lists(st.text(st.sampled_from([chr(c) for c in range(0x250)] + [*"̣́αςЖ中🙂  ' '"]), max_size=40), max_size=8))
@settings(max_examples=200, deadline=None)
def test_any_text(texts):
    assert token_counts.counter(PATH).count(texts) == expected(texts)


def test_long_pre_token_and_full_cache(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdef") for _ in range(20_000)), *(" ".join("".join(rng.choice("abcdef") for _ in range(9)) for _ in range(50)) for _ in range(20))]
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 10)
    monkeypatch.setattr(token_counts, "SYMBOLS", 64)
    own = token_counts.TokenCounter(PATH)
    assert own.count(texts) == expected(texts) and own.count(texts[::-1]) == expected(texts[::-1])
    assert len(own.known) <= 10


def naive(symbols, rules):
    symbols = list(symbols)
    while True:
        pairs = [(rules[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in rules]
        if not pairs:
            return len(symbols)
        i = min(pairs)[1]
        symbols[i : i + 2] = ["".join(symbols[i : i + 2])]


@pytest.mark.parametrize("rules", [[("a", "a"), ("aa", "aa"), ("a", "b")], [("ab", "a"), ("a", "b"), ("b", "a"), ("aba", "b")], []])
def test_merging_at_once_equals_one_by_one(rules):
    """Also with rules out of order, where a symbol is used before it can be made."""
    symbols = {s: i for i, s in enumerate(dict.fromkeys(["a", "b", "c", *(a + b for a, b in rules), *(x for r in rules for x in r)]))}
    merges = token_counts.Merges({"vocab": symbols, "merges": rules})
    rng = random.Random(5)
    words = ["".join(rng.choice("aabbc") for _ in range(rng.randrange(1, 15))) for _ in range(300)]
    flat = np.array([symbols[c] for w in words for c in w])
    ranks = {r: i for i, r in enumerate(rules)}
    assert token_counts.surviving(flat, np.array([len(w) for w in words]), merges).tolist() == [naive(w, ranks) for w in words]


def test_rows_of_any_kind(spark):
    rows = [(1, "two words"), (1, "two words"), (None, None), (2, None), (3, ""), (2**53 + 1, "word " * 2049), (5, "word " * 2048)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n_tokens int, id string")
    got = [tuple(r) for r in token_counts.count_documents(docs, PATH).collect()]
    assert got == [(i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, expected([t or "" for _, t in rows]), strict=True)]
    assert token_counts.count_documents(docs.limit(0), PATH).count() == 0


def test_tokenizers_of_another_make_are_refused():
    spec = LIBRARY.to_str().replace('"byte_fallback":false', '"byte_fallback":true')
    with pytest.raises(ValueError, match="plain"):
        token_counts.TokenCounter(_file(spec))


def _file(text):
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".json", delete=False) as f:
        f.write(text)
    return f.name


def test_query_against_the_library(spark):
    rows = common.read(spark, SF, "documents").select("doc_id", "text").collect()
    n = dict(zip([r.doc_id for r in rows], expected([r.text or "" for r in rows]), strict=True))
    got = queries.QUERIES["op12_token_counts"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {r.doc_id: (len((r.text or "").encode()), n[r.doc_id], n[r.doc_id] > 2048) for r in rows}
    assert len(got) == len(rows)
