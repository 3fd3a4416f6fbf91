"""Spelling variants against plain edit distance over all pairs."""

import re
import zlib
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placeweave.llm import common, queries, variants

SF = "/root/testdata/sf0.001"


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, least=7, every=31, times=2):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= times}


def brute_groups(words, ratio=10):
    near = {w: set() for w in words}
    for a, b in combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and one_apart(a, b):
            near[a].add(b)
            near[b].add(a)
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if words[b] >= ratio * words[w]}
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@given(st.lists(st.text("abé", max_size=6), unique=True, max_size=40))
@settings(max_examples=150, deadline=None)
def test_trie_finds_every_pair(words):
    found = sorted(variants.near_in_trie(words))
    assert found == sorted((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i != j and one_apart(a, b))


@pytest.mark.parametrize("limit", [1, 3, 40, variants.BLOCK_WORDS])
def test_blocks_of_any_size_give_the_same_groups(spark, limit):
    # Long words with one beginning and end, so that blocks are divided in every way.
    stems = ["abcdefg", "abcdefgh", "abcxefgh", "bbcdefgh", "aabcdefg", "abcdefgg", "abcdegfh", "éabcdefg", "abcdefé", "abcdef g"]
    words = {w: 3 + i for i, w in enumerate(stems)}
    words |= {"prefix" + x + "suffix": 1 + len(x) ** 3 for x in ("", "a", "b", "ab", "ba", "abc", "abd", "bbd", "aab", "abab", "abba")}
    words |= {"prefix" + x: 50 for x in ("aa", "a", "ab", "abb")}
    got = variants.near_words(table(spark, words), limit=limit).collect()
    near = {w: {x for x in words if x != w and one_apart(w, x)} for w in words}
    assert {r.word: (r.n_near, r.best_n, r.best) for r in got} == {w: (len(v), *(lambda x: (words[x], x))(min(v, key=lambda x: (-words[x], x)))) for w, v in near.items() if v}


def test_chains_ties_and_nulls(spark):
    words = {"abcdefg": 1000, "abcdefgh": 100, "abcdefghi": 10, "abcdefghij": 1, "xbcdefg": 1000, "lonelyword": 5, "zzzzzzz": 99, "zzzzzzzz": 10}
    df = table(spark, words).union(spark.createDataFrame([(None, 4), ("nullword", None)], "word string, n long"))
    got = result(variants.group_variants(df))
    assert got == brute_groups(words)
    assert got["abcdefghij"][:2] == ("abcdefghi", "abcdefg")  # a chain of three links
    assert got["zzzzzzzz"][0] is None and got["abcdefg"][0] is None  # 99 < 10 * 10; equal counts
    with pytest.raises(ValueError, match="frequent"):
        variants.group_variants(df, ratio=1)


def test_words_of_odd_texts(spark):
    long = "Verylongword" * 5000
    rows = [(1, "Straßen STRASSEN straßen Ünderway ünderway ÷×÷×÷×÷ ÷×÷×÷×÷"), (None, "nothing nothing"), (None, None), (2, ""), (2, "repeated"), (2, "repeated"), (3, f"{long} {long}"), (-4, "naïveté-naïveté 'quoted' Привет")]
    rows += [(i, "frequently occurring wordlist") for i in range(200)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = {r.word: r.n for r in variants.count_words(docs).collect()}
    assert got == brute_words(rows) and "Ünderway" not in got and long.lower() in got | {long.lower(): 1}
    empty = variants.count_words(docs.limit(0))
    assert empty.count() == 0 and variants.group_variants(empty).count() == 0


def test_one_batch_without_long_words():
    assert variants.spoiled_counts(["1"], pa.array(["a bc, d"]), 7, 31).num_rows == 0


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in common.read(spark, SF, "documents").select("doc_id", "text").collect()]
    words = brute_words(rows)
    # Only words that share a half can be near: the brute force over all pairs of these few thousand is enough.
    assert result(queries.QUERIES["op11_variants"](spark, SF)) == brute_groups(words)
