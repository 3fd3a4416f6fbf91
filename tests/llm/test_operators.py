"""Each operator against brute force, an exact round trip or held-out labels, with awkward rows."""

import hashlib
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from placeweave.llm import chat, common, components, fingerprint, packing, pieces, quality, rans, sharding, simhash, token_ids, toxicity, vptree

BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 977} x{i % 13}" for i in range(30_000))
TEXTS = ["", None, "one", "One  two\nthree", "a b c d e f g", "a b c d e f g", "A B c d e f g", "<|endoftext|> don't 'll \\ </turn>", "naïve é 漢字 ½  ", LONG, LONG + " end", " \n\t "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "clash", i) for i, t in enumerate(TEXTS)] + [(0, "", "clash", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, size long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < 0")


def texts():
    return sorted([(i * 3, t or "") for i, t in enumerate(TEXTS)] + [(0, "")])


# 1: fingerprints
def test_compare_with_next(docs, empty):
    got = sorted(fingerprint.compare_with_next(docs).toPandas().itertuples(index=False), key=lambda r: (r.id, r.edited_sha256))
    own = texts()
    want = [(i, len(t), hashlib.sha256(fingerprint.edited(t, own[(k + 1) % len(own)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(own)]
    assert [(r.id, r.n_chars, r.edited_sha256) for r in got] == sorted(want, key=lambda x: (x[0], x[2]))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = {}
    for r in got:
        assert by.setdefault(dict(own)[r.id], r.fingerprint) == r.fingerprint
    assert fingerprint.compare_with_next(empty).count() == 0


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(1)
    a = " ".join(f"w{x}" for x in rng.integers(0, 9999, 4000))
    b = " ".join(a.split()[:3000] + [f"v{x}" for x in rng.integers(0, 9999, 1500)])
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b)]
    x, y = fingerprint.sketch(a), fingerprint.sketch(b)
    assert abs(fingerprint.resemblance(x, y) - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.12
    assert abs(fingerprint.containment(x, y) - len(sets[0] & sets[1]) / len(sets[0])) < 0.12
    assert abs(fingerprint.distinct(x) / len(sets[0]) - 1) < 0.25
    whole = fingerprint.shingle_hashes(a)
    parts = fingerprint.merge(np.unique(whole[:1500])[: fingerprint.K], np.unique(whole[1500:])[: fingerprint.K])
    assert (parts == x).all() and (fingerprint.load(fingerprint.dump(x)) == x).all()


def test_merge_by_key(spark):
    rows = [(k, fingerprint.dump(fingerprint.sketch(f"{k} a b c d e f {i}"))) for k in ("x", None) for i in range(40)]
    got = {r.k: r.fingerprint for r in fingerprint.merge_by(spark.createDataFrame(rows, "k string, fingerprint string"), "k").collect()}
    for k in ("x", None):
        want = np.unique(np.concatenate([fingerprint.load(f) for n, f in rows if n == k]))[: fingerprint.K]
        assert got[k] == fingerprint.dump(want)


def test_merge_by_long_keys_beside_null(spark):
    keys = [2**53 + 1, None, 2**53 + 3, -(2**62) - 1]
    rows = [(k, fingerprint.dump(fingerprint.sketch(f"{k} a b c d e f {i}"))) for i in range(9) for k in keys]
    got = {r.k: r.fingerprint for r in fingerprint.merge_by(spark.createDataFrame(rows, "k long, fingerprint string").coalesce(1), "k").collect()}
    assert set(got) == set(keys)
    for k in keys:
        want = np.unique(np.concatenate([fingerprint.load(f) for n, f in rows if n == k]))[: fingerprint.K]
        assert got[k] == fingerprint.dump(want)


# 2: SentencePiece
def test_pieces_round_trip_and_parity(docs, empty):
    got = pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).toPandas()
    assert len(got) == len(TEXTS) + 1 and got["parity"].all() and got["round_trip"].all()
    assert pieces.encode_documents(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_pieces_any_text(text):
    own = pieces.codec(public_tokenizers.path("piece_bpe_32k.model"))
    ids = own.encode_batch([text.replace("\x00", "").replace("▁", "")])
    assert own.same_as_library([text.replace("\x00", "").replace("▁", "")], ids) == [True]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(3, 258), st.just(40_000)), max_size=30))
def test_pieces_any_ids(ids):
    own = pieces.codec(public_tokenizers.path("piece_bpe_32k.model"))
    assert own.decode_batch([np.array(ids, "<u4").tobytes()]) == [own.tokenizer.decode(ids, skip_special_tokens=False)]


def test_unigram_model_is_rebuilt():
    model = pieces.PieceModel([("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("▁", -2.0, 1), ("a", -2.0, 1), ("b", -1.5, 1), ("ab", -1.0, 1)], pieces.UNIGRAM, False, b"", True, True, True)
    assert model.rebuild().encode("a  ab ").tokens == ["▁a", "▁a", "b"]


# 3: nearest neighbours
def nearest_by_force(rows, queries, k):
    out = {}
    for q, v in queries:
        found = sorted((-float(np.dot(np.float64(v), np.float64(x))), i) for i, x in rows if i != q)[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


def test_exact_search_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:350] = x[100]  # many rows share a vector
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    bad = [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (1004, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("shard", F.lit("clash"))
    got = vptree.nearest(df, df.filter("vec_id % 20 = 0"), k=20, factor=1.0, shard_vectors=97, block_queries=11).toPandas()
    want = nearest_by_force(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert set(got["query_id"]) == set(want)
    for q, part in got.sort_values("rank").groupby("query_id"):
        assert part["vec_id"].tolist() == [i for i, _ in want[q]]
        assert np.allclose(part["score"], [s for _, s in want[q]], atol=1e-12) and part["rank"].tolist() == list(range(1, 21))
    assert vptree.nearest(df.filter("vec_id < 0"), df, k=3).count() == 0


def test_relaxed_search_keeps_recall():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, tree = x[::20], vptree.Tree(x)
    truth = np.argsort(-(q @ x.T), axis=1)[:, :21]
    ids, _ = tree.search(q, 21, 0.6)
    assert np.mean([len(set(a) & set(b)) / 21 for a, b in zip(ids, truth, strict=True)]) >= 0.9


# 4: token files
def test_token_encoder_is_exact():
    own, plain = token_ids.TextEncoder(BPE), Tokenizer.from_file(BPE)
    plain.encode_special_tokens = True
    for t in [x or "" for x in TEXTS] + ["  a  b", "a\n b", "x \x1c y \x85z", "́ ́a", "a　b  c", "1 ² x's 'S"]:
        assert np.frombuffer(own.encode_batch([t])[0], "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=30))
def test_token_encoder_any_text(text):
    own = token_ids.encoder(BPE)
    assert np.frombuffer(own.encode_batch([text])[0], "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(docs, empty, spark):
    rans.write_token_files(docs, path := common.shared_path(spark, "t"), BPE, end_id=0)
    got = rans.read_token_files(spark, path).toPandas().sort_values("start")
    plain, at = Tokenizer.from_file(BPE), 0
    plain.encode_special_tokens = True
    for (i, t), r in zip(texts(), got.itertuples(), strict=True):
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert (r.id, r.start, r.n_tokens, bytes(r.ids)) == (i, at, len(ids) // 4, ids)
        at += len(ids) // 4
    rans.write_token_files(empty, path := common.shared_path(spark, "t"), BPE)
    assert rans.read_token_files(spark, path).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 50_000), max_size=3000), st.sampled_from([1, 3, 256]))
def test_rans_block(ids, lanes):
    ids = np.array(ids, np.uint32)
    table = rans.Table.load(rans.Table.of(ids).dump())
    data = rans.encode_block(ids, table, lanes)
    assert (rans.decode_block(data, table) == ids).all()


def test_rans_checkpoints_and_checksums():
    ids = (np.random.default_rng(4).zipf(1.3, 200_000) % 5000).astype(np.uint32)
    table = rans.Table.of(ids)
    data = rans.encode_block(ids, table)
    parts = -(-(-(-len(ids) // rans.LANES)) // rans.CHECK_STEPS)
    assert parts > 1 and (np.concatenate([rans.decode_block(data, table, k) for k in range(parts)]) == ids).all()
    assert len(data) < 2 * len(ids)
    with pytest.raises(ValueError):
        rans.decode_block(data[:-9] + bytes([data[-9] ^ 1]) + data[-8:], table)


# 5: packing
def test_packing_is_whole_and_tight(docs, empty):
    got = packing.pack_documents(docs, BPE, capacity=64).toPandas()
    own = token_ids.encoder(BPE)
    for i, t in texts():
        ids = own.encode_batch([t])[0] + np.array([2], "<u4").tobytes()
        part = got[got["id"] == i].sort_values(["piece", "start"])
        for r in part.itertuples():
            assert zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        assert set(part["length"][part["piece"] > 0]) <= {64}
    assert len(got[got["id"] == 0]) == 2
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["length"].sum() <= 64 and s["offset"].tolist() == (s["length"].cumsum() - s["length"]).tolist()
    assert packing.pack_documents(empty, BPE).count() == 0


def test_sum_of_squares_choice():
    def slow(lengths, capacity):
        gaps, out = [], []
        for s in lengths:
            def total(skip):
                after = [g - s if j == skip else g for j, g in enumerate(gaps)]
                return sum(after.count(g) ** 2 for g in set(after) if g), after[skip]
            fits = [j for j, g in enumerate(gaps) if g >= s]
            if fits:
                j = min(fits, key=total)
            else:
                gaps.append(capacity)
                j = len(gaps) - 1
            gaps[j] -= s
            out.append(sum(gaps.count(g) ** 2 for g in set(gaps) if g))
        return len(gaps), out

    lengths = np.random.default_rng(5).integers(1, 21, 120)
    bins, offsets, n = packing.sum_of_squares(lengths, 20)
    assert n == slow(lengths.tolist(), 20)[0]
    assert all(lengths[bins == b].sum() <= 20 for b in range(n))


# 6 and 9: labels
def test_segments_equal_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(50):
        at = sorted(rng.choice(40, 8, replace=False).tolist())
        gains = rng.uniform(0.1, 3, 8).tolist()
        score = np.full(40, -0.4)
        score[at] = gains
        best = max(score[a : b + 1].sum() for a in range(40) for b in range(a, 40))
        found = toxicity.segments(at, gains, -0.4)
        assert abs(max(s for *_, s in found) - best) < 1e-9
        for a, b, s in found:
            assert abs(score[a : b + 1].sum() - s) < 1e-9
            assert all(score[a : k + 1].sum() > 0 for k in range(a, b + 1)) and all(score[k : b + 1].sum() > 0 for k in range(a, b + 1))
        assert all(x[1] < y[0] for x, y in zip(found, found[1:]))


def held_out_accuracy(spark, fit, score, label, modulus, remainder):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.read(spark, sf, "documents"), common.read(spark, sf, "labels")
    held = common.doc_hash_mod("doc_id", modulus) == remainder
    model = fit(docs, toxicity.labelled_sample(labels, label, held, 3000))
    found = score(docs.join(labels.filter(held), "doc_id"), model).join(labels, F.col("id") == F.col("doc_id")).toPandas()
    assert found["score"].between(0, 1).all()
    return model, ((found["score"] >= 0.5) == (found[label] == 1)).mean()


def test_toxicity_held_out(spark, docs, empty):
    model, accuracy = held_out_accuracy(spark, toxicity.fit, toxicity.score, "toxic", 5, 0)
    assert accuracy > 0.95
    assert toxicity.score(docs, model).count() == len(TEXTS) + 1 and toxicity.score(empty, model).count() == 0
    assert toxicity.filter_documents(docs, model).columns == docs.columns and toxicity.filter_documents(docs, model).count() == len(TEXTS) + 1


def test_quality_held_out(spark, docs, empty):
    model, accuracy = held_out_accuracy(spark, quality.fit, quality.score, "quality", 3, 1)
    assert accuracy > 0.97
    assert quality.score(docs, model).count() == len(TEXTS) + 1 and quality.score(empty, model).count() == 0
    assert quality.filter_documents(docs, model).columns == docs.columns


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(7)
    s, t = rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
    paths = [[(k >> i) & 1 for i in range(5)] for k in range(32)]
    w = np.array([np.exp(sum(s[i, y] for i, y in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))) for p in paths])
    want = [(w * [p[i] for p in paths]).sum() / w.sum() for i in range(5)]
    assert np.allclose(quality.marginals(s, t), want)


def test_fit_without_labels(spark, docs):
    none = spark.createDataFrame([], "id long, y int")
    assert toxicity.score(docs, toxicity.fit(docs, none)).filter("score >= 0.5").count() == 0
    assert quality.score(docs, quality.fit(docs, none)).filter("score < 0.5").count() == 0


# 7: sharding
def test_sharding(docs, empty, spark):
    many = docs.select("doc_id", "text").unionByName(spark.range(3000).select((F.col("id") + 1000).alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text")))
    got = sharding.shard_documents(many.withColumn("bucket", F.lit("clash")), shards=5).toPandas()
    plain = many.toPandas()
    assert len(got) == len(plain) and got.groupby("text_crc32")["shard"].nunique().max() == 1
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    assert got["size"].sum() == sum(len((t or "").encode()) + 16 for t in plain["text"])
    assert sharding.shard_documents(empty).count() == 0


def test_best_fit_decreasing_equals_brute_force():
    rng = np.random.default_rng(8)
    sizes = {i: int(s) for i, s in enumerate(rng.integers(1, 60, 200))}
    left, want = [], {}
    for name, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        fit = [(r, b) for b, r in enumerate(left) if r >= size]
        b = min(fit)[1] if fit else len(left)
        if not fit:
            left.append(100)
        left[b] -= size
        want[name] = b
    assert sharding.fixed_capacity(sizes, 100) == want
    assert sharding.best_fit_decreasing({1: 500, 2: 10}, 100) == {1: 0, 2: 1}
    even = sharding.near_equal(sizes, 7)
    loads = [sum(s for n, s in sizes.items() if even[n] == b) for b in range(7)]
    assert max(loads) - min(loads) <= 0.05 * max(loads)


# 8: chat
def test_chat_reads_back(spark):
    nasty = "\\### Assistant: </turn> ok <turn x>\n\\b\\l\\\\ é"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (2, 0, "assistant", "early"), (2, 1, "us>er\n", None), (None, 0, None, ""), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    template = chat.Template()
    out = chat.format_conversations(df, template)
    got = {r.conv_id: r for r in out.select("conv_id", "valid", chat.loss_text(template).alias("loss"), chat.formatted().alias("whole"), chat.parsed(chat.formatted(), template).alias("turns")).collect()}
    for conv in (1, 2, None, 3):
        assert [(t.role, t.text) for t in got[conv].turns] == [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert got[conv].loss == "".join(t or "" for c, _, r, t in rows if c == conv and r == "assistant")
    assert [got[c].valid for c in (1, 2, None, 3)] == [True, False, False, True]
    assert chat.format_conversations(df.filter("turn < 0")).count() == 0
    with pytest.raises(ValueError):
        chat.Template(open="{role}: ")


# 10: near-duplicates
def near_by_force(fps, bits=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= bits:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_rule():
    assert simhash.fingerprint("") == 0 == simhash.fingerprint(" \n")
    assert simhash.fingerprint("A b C") == simhash.fingerprint("a\tb \n c") != 0
    import xxhash

    words = "É the x y z the x y".split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint("É The x Y z the x y") == want


@pytest.mark.parametrize("limit", [simhash.CELL_LIMIT, 3])
def test_links_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "CELL_LIMIT", limit)
    rng = np.random.default_rng(9)
    base = [int(x) for x in rng.integers(0, 2**63, 30)]
    fps = {0}
    for b in base:
        for _ in range(12):
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                b ^= 1 << int(bit)
            fps.add(b)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    roots = components.connected(simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"))).toPandas()
    name = dict(zip(roots["node"], roots["root"], strict=True))
    got = [name.get(x, x) for x in signed]
    want = near_by_force(fps)
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


def test_near_duplicates(docs, empty):
    got = simhash.near_duplicates(docs).toPandas().sort_values(["id", "fp"])
    own = texts()
    fps = [simhash.fingerprint(t) for _, t in own]
    want = [own[r][0] for r in near_by_force(fps)]
    assert got["component"].tolist() == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_one_row_of_each_group_stays(spark):
    far = ["alpha beta gamma delta", "one two three four five", "red green blue black white", "north south east west up"]
    assert min(bin(simhash.fingerprint(a) ^ simhash.fingerprint(b)).count("1") for a, b in combinations(far, 2)) > 2
    rows = [(None, far[0]), (None, far[0]), (None, far[1]), (5, far[2]), (5, far[3]), (3, far[3]), (None, far[2])]
    df = spark.createDataFrame([(i, t, k, 7, "clash", "clash") for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int, n int, root string, row string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text, r.n, r.row) for r in kept.collect()) == sorted([(0, far[0], 7, "clash"), (0, far[1], 7, "clash"), (5, far[2], 7, "clash"), (3, far[3], 7, "clash")])


def test_ranges(spark):
    cuts = [-5, 0, 3, 3 + 2**40, 2**62]
    keys = [common.LOWEST, -6, -5, -1, 0, 2, 3, 4, 2**40 + 3, 2**62 - 1, 2**62, 2**63 - 1]
    for n in range(len(cuts) + 1):
        got = spark.createDataFrame([(x,) for x in keys], "k long").select("k", common.range_of(F.col("k"), cuts[:n], "bigint").alias("r")).collect()
        assert {r.k: r.r for r in got} == {x: sum(c <= x for c in cuts[:n]) for x in keys}


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (7, 3), (None, 1)], "a long, b long")
    got = {r.node: r.root for r in components.connected(links).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500}


def test_whole_groups():
    parts = [pd.DataFrame({"k": k}) for k in ([1, 1, 2], [2], [2, 2], [3, 4], [])]
    whole = [x["k"].tolist() for x in common.whole_groups(parts, "k")]
    seen = [k for x in whole for k in set(x)]
    assert len(seen) == len(set(seen)) and sum(map(len, whole)) == 8


# Contract queries' own choices, and awkward ids
BIG = [2**53 + 1, None, 2**53 + 3, 2**63 - 1, -(2**63), -(2**63) + 1]


@pytest.fixture(scope="module")
def large_ids(spark):
    return spark.createDataFrame([(i, f"text number {k} stands alone here", 1.5) for k, i in enumerate(BIG)], "doc_id long, text string, id double")


def same_ids(found):
    key = lambda x: (x is not None, x or 0)
    return sorted(found, key=key) == sorted(BIG, key=key)


def test_added_tokens_as_by_default():
    own, plain = token_ids.TextEncoder(BPE, added_tokens=True), Tokenizer.from_file(BPE)
    for t in ["a<|endoftext|>b", "a <|endoftext|> b  <|endoftext|>", "<|endoftext|>", "<|endoftext", *(x or "" for x in TEXTS)]:
        assert np.frombuffer(own.encode_batch([t])[0], "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_token_files_with_added_tokens(docs, spark):
    plain, at = Tokenizer.from_file(BPE), 0
    rans.write_token_files(docs, path := common.shared_path(spark, "t"), BPE, end_id=0, added_tokens=True)
    got = rans.read_token_files(spark, path).toPandas().sort_values("start")
    for (i, t), r in zip(texts(), got.itertuples(), strict=True):
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert (r.id, r.start, bytes(r.ids)) == (i, at, ids)
        at += len(ids) // 4
    packed = packing.pack_documents(docs, BPE, added_tokens=True).toPandas()
    own = [len(plain.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts()]
    assert packed["length"].sum() == sum(own)


def test_ids_are_exact(spark, large_ids):
    assert same_ids([r.id for r in fingerprint.compare_with_next(large_ids).collect()])
    assert same_ids([r.id for r in fingerprint.sketch_documents(large_ids).collect()])
    rans.write_token_files(large_ids, path := common.shared_path(spark, "t"), BPE)
    got = rans.read_token_files(spark, path).orderBy("start").collect()
    assert [r.id for r in got] == sorted(BIG, key=lambda x: (x is not None, x or 0))
    assert same_ids([r.id for r in packing.pack_documents(large_ids, BPE).collect()])
    assert same_ids([r.id for r in simhash.near_duplicates(large_ids, max_bits=2).collect()])
    assert same_ids([r.id for r in simhash.near_duplicates(large_ids).collect()])


@pytest.mark.parametrize("max_bits", [None, 2])
def test_no_document_of_a_large_id_is_lost(spark, max_bits):
    texts_ = ["alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue black white grey pink"]
    rows = spark.createDataFrame(list(zip([2**53 + 1, None, 2**53 + 3], texts_, strict=True)), "doc_id long, text string")
    assert sorted(r.text for r in simhash.keep_one(rows, max_bits=max_bits).collect()) == sorted(texts_)


def test_hot_ids_are_dealt_out(spark):
    rows = spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.concat("id", F.lit(" is the number "), "id").alias("text"))
    text = common.text_of("text")
    ranges = common.find_ranges(rows.select(common.key_of("doc_id", text).alias("key")))
    sizes = [r["count"] for r in rows.select(ranges.of(common.key_of("doc_id", text)).alias("r")).groupBy("r").count().collect()]
    assert len(sizes) == ranges.n and max(sizes) < 2 * 4000 / ranges.n
    got = fingerprint.compare_with_next(rows).toPandas()
    assert len(got) == 4000 and got["edited_sha256"].nunique() > 3900
    keyed = rows.select(common.key_of("doc_id", text).alias("key"), "text").orderBy("key").collect()
    own = [r.text for r in keyed]
    want = sorted(hashlib.sha256(fingerprint.edited(t, own[(k + 1) % len(own)]).encode()).hexdigest() for k, t in enumerate(own))
    assert sorted(got["edited_sha256"]) == want


def test_blocks_in_step_equal_blocks_alone():
    rng = np.random.default_rng(11)
    parts = [(rng.zipf(1.3, n) % 3000).astype(np.uint32) for n in (0, 1, 255, 256, 70_000, 131_072, 300_000)]
    table = rans.Table.of(np.concatenate(parts))
    together = rans.encode_blocks(parts, table)
    assert together == [rans.encode_block(p, table) for p in parts]
    assert all((a == b).all() for a, b in zip(rans.decode_blocks(together, table), parts, strict=True))


def test_chains_equal_marginals_of_each_document():
    rng = np.random.default_rng(12)
    lines = np.array([1, 2, 3, 17, 64, 1, 200])
    s, t = rng.normal(size=(lines.sum(), 2)) * 3, rng.normal(size=(2, 2))
    place = np.concatenate([np.arange(n) for n in lines])
    left = np.repeat(lines, lines) - 1 - place
    p, pair = quality.chains(s, t, place, left)
    at, seen = 0, 0
    for n in lines.tolist():
        own = p[at : at + n]
        assert np.allclose(own[:, 1], quality.marginals(s[at : at + n], t))
        both = pair[seen : seen + n - 1].reshape(-1, 2, 2)
        assert np.allclose(both.sum(axis=1), own[1:]) and np.allclose(both.sum(axis=2), own[:-1])
        at, seen = at + n, seen + n - 1


def test_scores_have_exact_ids_and_lines(spark, docs, large_ids):
    tox, good = toxicity.Model({}, 1.0, 1.0, (0.0, 0.0, 0.0)), quality.Model(np.zeros((quality.FEATURES, 2)), np.zeros((2, 2)), np.array([1.0, 0.0]))
    assert same_ids([r.id for r in toxicity.score(large_ids, tox).collect()])
    assert same_ids([r.id for r in quality.score(large_ids, good).collect()])
    found = pieces.encode_documents(large_ids, public_tokenizers.path("piece_bpe_32k.model"))
    assert same_ids([r.id for r in found.collect()])
    lines = quality.label_lines(docs, good).toPandas()
    own = docs.toPandas()
    assert len(lines) == sum(len((t or "").split("\n")) for t in own["text"])
    for i, t in texts():
        for r in lines[lines["id"] == i].itertuples():
            assert (t[r.start : r.start + r.length] == t.split("\n")[r.line]) or i == 0


def test_fits_take_one_text_of_a_repeated_id(spark):
    rows = [(i % 4, f"{'bad stupid words' if i % 2 else 'fine calm words'} {i}") for i in range(200)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    sample = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 1)], "id long, y int")
    assert toxicity.score(docs_, toxicity.fit(docs_, sample)).count() == 200
    assert quality.score(docs_, quality.fit(docs_, sample)).count() == 200


def test_all_maximal_segments():
    rng = np.random.default_rng(13)

    def maximal(s, at=0):
        """By the definition: the best segment (shortest), then the same left and right of it."""
        best = max(((s[a : b + 1].sum(), a - b, a, b) for a in range(len(s)) for b in range(a, len(s))), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        _, _, a, b = best
        return maximal(s[:a], at) + [(at + a, at + b)] + maximal(s[b + 1 :], at + b + 1)

    for _ in range(60):
        at = sorted(rng.choice(40, 14, replace=False).tolist())
        gains = rng.normal(0.4, 1.5, 14).tolist()
        score = np.full(40, -0.3)
        score[at] = gains
        assert [(a, b) for a, b, _ in toxicity.segments(at, gains, -0.3)] == maximal(score)


def test_segments_take_linear_steps():
    class Counted(float):
        steps = 0

        def __ge__(self, other):
            Counted.steps += 1
            return float(self) >= other

    def steps(n):
        Counted.steps = 0
        low = [Counted(-float(i)) for i in range(n)]  # sums fall: no candidate ever merges
        high = [Counted(-float(i) + 0.5) for i in range(n)]
        assert len(toxicity._maximal(list(range(n)), low, high)) == n
        return Counted.steps

    assert steps(4000) <= 2.2 * steps(2000) <= 2.2 * 3 * 2000


def test_words_of_known_passages_are_found():
    model = toxicity.Model({"vile": 4.0, "mean": 3.0, "kind": -2.0}, 1.0, 0.05, (0.0, 1.0, 0.0), 0.01)
    text = " ".join(["calm"] * 200 + ["vile", "mean", "words", "vile"] + ["kind"] * 3 + ["calm"] * 50)
    (a, b, _, e), = toxicity.Scanner(model).passages(text)
    assert (a, b) == (200, 203) and e <= 0.01


@pytest.mark.parametrize("units", [sharding.UNITS, 4])
def test_shards_keep_their_capacity(spark, monkeypatch, units):
    monkeypatch.setattr(sharding, "UNITS", units)  # far more texts than units
    monkeypatch.setattr(sharding, "BUNDLE_LISTS", 3)
    rows = [(i, f"text {i % 390}") for i in range(600)] + [(-1, "y" * 900), (None, "z" * 40), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("unit", F.lit("clash"))
    got = sharding.shard_documents(df, capacity=500).toPandas()
    assert len(got) == len(rows) and got.groupby(["text_crc32", "size"])["shard"].nunique().max() == 1
    for _, s in got.groupby("shard"):
        assert s["size"].sum() <= 500 or s["text_crc32"].nunique() == 1
        assert sorted(s["slot"]) == list(range(len(s)))
    bound = (got["size"].sum() - 916) / 500
    assert got["shard"].nunique() <= 1.1 * bound + 2
    even = sharding.shard_documents(df, shards=5).toPandas().groupby("shard")["size"].sum()
    assert len(even) == 5 and even.max() - even.min() <= 0.1 * even.max() + 60


@pytest.mark.parametrize("early", [False, True])
def test_each_placement_makes_the_sum_smallest(early):
    lengths, capacity = np.random.default_rng(14).integers(1, 21, 150), 20
    bins, offsets, n = packing.sum_of_squares(lengths, capacity, early)
    total = lambda gaps: sum(gaps.count(g) ** 2 for g in set(gaps) if g)
    gaps: list[int] = []
    for s, b, at in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        choices = {j: total([g - s if k == j else g for k, g in enumerate(gaps)]) for j, g in enumerate(gaps) if g >= s}
        alone = total([*gaps, capacity - s])
        least = min([*choices.values(), *([alone] if early or not choices else [])])
        if b == len(gaps):
            gaps.append(capacity)
            assert at == 0 and alone == least and (not choices or early)
        else:
            assert choices[b] == least
        assert at == capacity - gaps[b]
        gaps[b] -= s
    assert n == len(gaps)


def test_search_over_many_leaves_draws_a_bounded_sample(spark, monkeypatch):
    """More leaves than Spark's own group limit would cover; the driver gets some rows a leaf, not all."""
    rng = np.random.default_rng(16)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(6000, 4)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    drawn, made = [], vptree.Router

    def router(x, leaves, top):
        drawn.append((len(x), leaves))
        return made(x, leaves, top)

    monkeypatch.setattr(vptree, "Router", router)
    got = vptree.nearest(df, df.filter("vec_id % 500 = 0"), k=20, factor=1.0, shard_vectors=100).toPandas()
    (size, leaves), = drawn
    assert leaves == 60 and vptree.LEAF_SAMPLE * leaves <= size <= 2 * vptree.LEAF_SAMPLE * leaves < 6000
    want = nearest_by_force(rows, [r for r in rows if r[0] % 500 == 0], 20)
    for q, part in got.sort_values("rank").groupby("query_id"):
        assert part["vec_id"].tolist() == [i for i, _ in want[q]]


def test_one_word_vocabulary(spark):
    docs = spark.createDataFrame([(i, "same") for i in range(12)], "doc_id long, text string")
    sample = spark.createDataFrame([(i, i % 2) for i in range(12)], "id long, y int")
    scored = toxicity.score(docs, toxicity.fit(docs, sample)).toPandas()
    assert len(scored) == 12 and scored["score"].between(0, 1).all()


def test_search_with_awkward_rows(spark):
    """Vectors of two lengths, an id twice, a vector that a third of all rows share, shards divided by a hash."""
    rng = np.random.default_rng(15)
    x = rng.normal(size=(400, 6))
    x[:130] = x[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(5, [1.0, 2.0]), (1000, [2.0, 1.0]), (1020, [3.0, 3.0]), (7, [float(c) for c in x[300]]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vptree.nearest(df, df.filter("vec_id % 20 = 0"), k=20, factor=1.0, shard_vectors=16).toPandas()
    known = [(i, np.array(v)) for i, v in rows if i is not None]
    for q, part in got.groupby("query_id"):
        own = min(v.tolist() for i, v in known if i == q)
        best = sorted({(-round(float(np.dot(own, v)), 9), i) for i, v in known if i != q and len(v) == len(own)})[:20]
        part = part.sort_values("rank")
        assert part["vec_id"].tolist() == [i for _, i in best] or np.allclose(part["score"], [-s for s, _ in best], atol=1e-8)
        assert part["rank"].tolist() == list(range(1, len(best) + 1))
    assert set(got["query_id"]) == {i for i, _ in known if i % 20 == 0}


def test_sample_of_labels(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (2, None, None), (None, 1, 1), (3, 0, 1), (4, 1, 0)], "doc_id long, toxic int, quality int")
    held = F.col("doc_id") == 4
    assert {(r.id, r.y) for r in toxicity.labelled_sample(labels, "toxic", held, 10).collect()} == {(1, 1), (3, 0)}
    assert {(r.id, r.y) for r in toxicity.labelled_sample(labels, "quality", held, 10).collect()} == {(1, 0), (3, 1)}
    assert toxicity.labelled_sample(labels, "toxic", held, 1).count() == 1


def test_sketches_of_documents(docs):
    got = {r.id: (r.fingerprint, r.n_shingles) for r in fingerprint.sketch_documents(docs.select("doc_id", "text")).collect()}
    for i, t in texts():
        own = fingerprint.sketch(t)
        assert got[i] == (fingerprint.dump(own), fingerprint.distinct(own))
