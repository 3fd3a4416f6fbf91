"""Every contract query on a small table: names, types, and what it returns, against brute force."""

import hashlib
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from placeweave.llm import common, fingerprint, queries, resemblance, simhash

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
TYPES = {
    "op1_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op2_pieces": "doc_id bigint, n_tokens bigint, ids array<int>, ids_crc32 bigint, round_trip boolean, parity boolean",
    "op3_vantage_points": "query_id bigint, rank int, vec_id bigint, score double",
    "op4_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op5_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int, n_passages int",
    "op7_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_chat": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean",
    "op9_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op11_variants": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op12_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op13_exponion": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
}


@pytest.fixture(scope="module")
def texts(spark):
    rows = common.read(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    return {r.doc_id: r.text or "" for r in rows}


@pytest.fixture(scope="module")
def found(spark):
    known = {}

    def get(name):
        if name not in known:
            df = queries.QUERIES[name](spark, SF)
            known[name] = (", ".join(f"{c} {t}" for c, t in df.dtypes), df.toPandas())
        return known[name]

    return get


@pytest.mark.parametrize("name", sorted(TYPES))
def test_names_and_types(found, name):
    assert found(name)[0] == TYPES[name]


def test_all_are_registered():
    assert set(TYPES) == set(queries.QUERIES) and set(TYPES) | {"pipeline"} <= set(entry.queries())
    assert "op8_chat" in entry.oracle_sql()


def test_op1(found, texts):
    got = found("op1_fingerprints")[1].set_index("doc_id")
    ids = sorted(texts)
    assert sorted(got.index) == ids

    def sketch(text):
        words = text.split()
        size = min(5, len(words))
        return {int(h) for h in fingerprint.shingle_hashes(text)} if size else set()

    def likeness(a, b):
        """The share of the least 256 hashes of both that both have."""
        least = set(sorted(a | b)[:256])
        x, y = set(sorted(a)[:256]), set(sorted(b)[:256])
        return len(least & x & y) / len(least) if least else 1.0

    for k, i in enumerate(ids):
        own, following = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        r = got.loc[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(likeness(sketch(own), sketch(edited))) and r.near_next == pytest.approx(likeness(sketch(own), sketch(following)))
        assert set(fingerprint.load(r.fingerprint).tolist()) == set(sorted(sketch(own))[:256])


def test_op2(found, texts):
    got = found("op2_pieces")[1]
    assert sorted(got["doc_id"]) == sorted(texts) and got["parity"].all() and got["round_trip"].all()
    for r in got.itertuples():
        assert r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_op3_recall(spark, sf):
    df = common.read(spark, f"/root/testdata/{sf}", "embeddings").select("vec_id", "embedding").toPandas()
    fine = [v is not None and len(v) > 0 and np.isfinite(np.asarray(v, float)).all() and np.any(np.asarray(v, float)) for v in df["embedding"]]
    df = df[fine]
    x, ids = np.stack(df["embedding"].to_numpy()).astype(np.float64), df["vec_id"].to_numpy()
    got = {q: g.sort_values("rank") for q, g in queries.QUERIES["op3_vantage_points"](spark, f"/root/testdata/{sf}").toPandas().groupby("query_id")}
    asked = np.flatnonzero(ids % 20 == 0)
    assert sorted(got) == sorted(ids[asked])
    hits = []
    for i in asked:
        scores = x @ x[i]
        scores[i] = -np.inf
        best = np.lexsort((ids, -scores))[:20]
        own = got[ids[i]]
        assert own["rank"].tolist() == list(range(1, min(20, len(ids) - 1) + 1)) and (np.diff(own["score"]) <= 0).all()
        at = {v: k for k, v in enumerate(ids.tolist())}
        assert np.allclose(own["score"], [x[at[v]] @ x[i] for v in own["vec_id"]], atol=1e-12)
        hits.append(len(set(own["vec_id"]) & set(ids[best].tolist())) / len(own))
    assert np.mean(hits) >= 0.9


def test_op4_and_op5(found, texts):
    plain = Tokenizer.from_file(BPE)
    ids = {i: plain.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    at = 0
    files = found("op4_token_files")[1].set_index("doc_id")
    for i in sorted(texts):
        own = np.array([*ids[i], 0], "<u4")
        assert tuple(files.loc[i]) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    packed = found("op5_packing")[1]
    for i, part in packed.sort_values("piece").groupby("doc_id"):
        own = np.array([*ids[i], 2], "<u4")
        assert part["piece"].tolist() == list(range(len(part))) and part["length"].sum() == len(own) and (part["length"].iloc[1:] == 1024).all()
        for r in part.itertuples():
            assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
    assert set(packed["doc_id"]) == set(texts)
    for _, part in packed.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == (part["length"].cumsum() - part["length"]).tolist() and part["length"].sum() <= 1024
    assert packed["sequence_id"].nunique() <= 1.03 * packed["length"].sum() / 1024 + 3


@pytest.mark.parametrize(("name", "label", "n", "rest"), [("op6_toxicity", "toxic", 5, 0), ("op9_quality", "quality", 3, 1)])
def test_op6_and_op9(spark, found, texts, name, label, n, rest):
    got = found(name)[1]
    assert sorted(got["doc_id"]) == sorted(texts) and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % n == rest for i in got["doc_id"]]).all()
    labels = common.read(spark, SF, "labels").toPandas()
    both = got.merge(labels, on="doc_id")
    # Of each class, so that one answer for all would fail.
    assert both[label].nunique() == 2 and (both["predicted"] == both[label]).groupby(both[label]).mean().min() > 0.3


def test_op7(found, texts):
    got = found("op7_sharding")[1]
    assert sorted(got["doc_id"]) == sorted(texts) and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    for r in got.itertuples():
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
    assert got.groupby("text_crc32")["shard"].nunique().max() == 1 and set(got["shard"]) <= set(range(40))
    filled, whole = got.groupby("shard")["size"].sum(), got.groupby("text_crc32")["size"].sum()
    assert len(filled) == 40 and filled.max() <= max(filled.mean() + whole.median(), whole.max())  # near equal, but for a group beyond a share
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_op8(found):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    want = db.execute(queries.ORACLE_SQL["op8_chat"]).df().sort_values("conv_id").reset_index(drop=True)
    got = found("op8_chat")[1].sort_values("conv_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(want)], check_dtype=False)


def components(n, linked):
    root = list(range(n))
    for i, j in combinations(range(n), 2):
        if root[i] != root[j] and linked(i, j):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    return root


def test_op10(found, texts):
    ids = sorted(texts)
    fps = [simhash.fingerprint(texts[i]) for i in ids]
    root = components(len(ids), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    got = found("op10_simhash")[1].set_index("doc_id")
    for k, i in enumerate(ids):
        assert tuple(got.loc[i]) == (f"{fps[k]:016x}", ids[root[k]])


def test_near_copies_by_force(spark, texts):
    """The general rule of the operator, as the pipeline takes it, on the whole table."""
    ids = sorted(texts)
    sets = [resemblance.shingles(resemblance.words_of(texts[i])) for i in ids]
    root = components(len(ids), lambda i, j: resemblance.resemblance(sets[i], sets[j]) >= 0.8)
    got = {r.id: r.component for r in simhash.near_duplicates(common.read(spark, SF, "documents")).collect()}
    assert got == {i: ids[root[k]] for k, i in enumerate(ids)}
