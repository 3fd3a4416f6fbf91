"""The pipeline's near-duplicate stage on planted near copies, against exact five-word resemblance."""

from itertools import combinations

import corpus_pipeline
import numpy as np
from placeweave.llm import resemblance, simhash

WORDS = [f"w{i}" for i in range(3000)]


def five(text):
    own = text.lower().split()
    k = min(5, len(own))
    return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()


def alike(a, b):
    x, y = five(a), five(b)
    return len(x & y) >= 0.8 * len(x | y)


def planted():
    rng = np.random.default_rng(4)
    out = []
    for n in rng.integers(40, 400, 60).tolist():
        own = [WORDS[i] for i in rng.integers(0, len(WORDS), n)]
        out.append(" ".join(own))
        for share in (0.006, 0.015, 0.03):  # resemblance on both sides of 0.8
            copy = list(own)
            for i in rng.choice(n, max(1, round(share * n)), replace=False):
                copy[i] = WORDS[rng.integers(0, len(WORDS))]
            out.append(" ".join(copy))
        out.append(" ".join(own[: round(n * 0.85)]))
    return out + ["", " \n", "one two", "One  TWO", "one three"]


def test_near_copies_are_found(spark):
    own = planted()
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    true = {(i, j) for i, j in combinations(range(len(own)), 2) if alike(own[i], own[j])}
    far = [p for p in true if bin(simhash.fingerprint(own[p[0]]) ^ simhash.fingerprint(own[p[1]])).count("1") > 2]
    assert len(far) > 100
    root = {r.id: r.root for r in resemblance.near_copies(docs).collect()}
    assert sum(root[i] == root[j] for i, j in true) >= 0.98 * len(true)
    name = list(range(len(own)))  # no group reaches over what the exact links connect
    for i, j in sorted(true):
        a, b = name[i], name[j]
        name = [a if x == b else x for x in name]
    assert all(name[i] == name[j] for i, j in combinations(range(len(own)), 2) if root[i] == root[j])
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert len(kept) <= 1.02 * len(set(name)) and {min(i for i in root if root[i] == r) for r in set(root.values())} == kept


def test_few_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resemblance.keep_one(none).count() == 0
    some = spark.createDataFrame([(None, None), (2, ""), (1, "a b"), (1, "c d"), (1, "c d")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in resemblance.keep_one(some).collect()) == [(1, "a b"), (1, "c d"), (2, "")]


def crowd(n, seed):
    """Rows of one cell: most near one fingerprint, some far, some in a chain that leads away from it."""
    rng = np.random.default_rng(seed)
    flips = lambda base, k: base ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False))
    base, fp = int(rng.integers(0, 1 << 63)), []
    for i in range(n):
        fp.append(flips(base, int(rng.integers(0, 12))) if i % 5 else int(rng.integers(0, 1 << 63)) if i % 2 else flips(fp[-1] if fp else base, 14))
    size = np.sort(rng.integers(50, 120, n))
    return size, np.array(fp, np.uint64), np.array([flips(f, 5) for f in fp], np.uint64)


def test_representatives_connect_what_all_pairs_connect():
    for seed in range(4):
        size, fp, five = crowd(300, seed)
        near = (np.bitwise_count(fp[:, None] ^ fp) <= resemblance.RADIUS) & (np.bitwise_count(five[:, None] ^ five) <= resemblance.RADIUS_FIVE)
        near &= np.minimum(size[:, None], size) >= (resemblance.RESEMBLANCE - 1e-9) * np.maximum(size[:, None], size)
        want = np.arange(300)
        for i, j in np.argwhere(near):
            want[want == max(want[i], want[j])] = min(want[i], want[j])
        links = resemblance.near_in_cells(np.zeros(300, int), size, fp, five)
        got = np.arange(300)
        for i, j in links:
            got[got == max(got[i], got[j])] = min(got[i], got[j])
        assert (want == got).all() and len(set(want.tolist())) > 5


def test_large_families_in_small_blocks(spark, monkeypatch):
    """Families of many blocks, some members joined to the rest only through others: groups as with one block."""
    rng = np.random.default_rng(9)
    own = []
    for n in (60, 120):
        base = [WORDS[i] for i in rng.integers(0, len(WORDS), n)]
        for _ in range(40):  # copies of copies: a chain that drifts from the first text
            copy = list(base)
            copy[rng.integers(0, n)] = WORDS[rng.integers(0, len(WORDS))]
            own.append(" ".join(copy))
            if rng.random() < 0.5:
                base = copy
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    whole = {r.id: r.root for r in resemblance.near_copies(docs).collect()}
    monkeypatch.setattr(resemblance, "BLOCK_TEXTS", 8)
    parts = {r.id: r.root for r in resemblance.near_copies(docs).collect()}
    assert whole == parts and len(set(whole.values())) < 60
