"""Exponion clustering against plain assignment over all centroids."""

import hashlib

import numpy as np
import pytest

from placeweave.llm import common, exponion, queries

SF = "/root/testdata/sf0.001"


def plain(v, centroids):
    d = ((v[:, None, :] - centroids[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)  # the first of equal ones


def lloyd(v, centroids, rounds):
    centroids = centroids.copy()
    for _ in range(rounds):
        at, _ = plain(v, centroids)
        for k in range(len(centroids)):
            if (at == k).any():
                centroids[k] = v[at == k].sum(0) // (at == k).sum()
    return *plain(v, centroids), centroids


def starting(ids, v, k):
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"1:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), v[i].tolist()))
    return v[order[:k]]


def vectors(spark, rows, extra=False):
    kind = "vec_id long, embedding array<float>" + (", cluster string, id int, v int" if extra else "")
    return spark.createDataFrame([(*r, "x", 1, 2) if extra else r for r in rows], kind)


@pytest.mark.parametrize("spread", [2, 40, 3000])
def test_bounds_keep_every_tie_over_many_rounds(spread):
    """Small whole numbers make ties the rule; bounds are carried over all rounds."""
    rng = np.random.default_rng(spread)
    v = rng.integers(-spread, spread, (600, 4))
    centroids = np.concatenate([v[:9], v[:2]])  # two of them twice
    at, upper, lower, moved, total = np.zeros(600, int), np.full(600, np.inf), np.zeros(600), np.zeros(11), 0
    for _ in range(12):
        search = exponion.Search(centroids, moved)
        at, upper, lower, measured = search.assign(v, at, upper, lower)
        total += measured
        want, squared = plain(v, centroids)
        assert (at == want).all() and (upper >= np.sqrt(squared)).all()
        before, centroids = centroids, np.array([v[at == k].sum(0) // (at == k).sum() if (at == k).any() else centroids[k] for k in range(11)])
        moved = exponion.root_up(exponion.squares(centroids, before))
    assert total < 12 * 600 * 11  # fewer than all distances


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(i % 5, 0.3, 8))]) for i in range(400)] + [(7, [0.0] * 8), (7, [0.0] * 8), (None, [1.0] * 8)]
    bad = [(900, None), (901, [1.0] * 7), (902, [1.0] * 9), (903, [None] + [1.0] * 7), (904, [float("nan")] * 8), (905, [float("inf")] + [0.0] * 7), (906, [])]
    v = np.floor(np.array([r[1] for r in rows], np.float32).astype(float) * 64).astype(np.int64)
    for k, rounds in ((6, 3), (1, 2), (16, 0)):
        found, centroids = exponion.cluster(vectors(spark, rows + bad, extra=True), k=k, rounds=rounds, size=8)
        want, squared, last = lloyd(v, starting([r[0] for r in rows], v, k), rounds)
        assert (centroids == last).all()
        got = sorted((r.id is None, r.id or 0, tuple(r.v), r.cluster, r.distance) for r in found.collect())
        assert got == sorted((r[0] is None, r[0] or 0, tuple(x), int(c), int(d)) for r, x, c, d in zip(rows, v.tolist(), want, squared, strict=True))
        told = exponion.with_inertia(found).select("cluster", "cluster_inertia", "inertia").distinct().collect()
        assert {r.cluster: (r.cluster_inertia, r.inertia) for r in told} == {int(c): (int(squared[want == c].sum()), int(squared.sum())) for c in set(want.tolist())}


def test_few_none_and_too_large(spark):
    few, centroids = exponion.cluster(vectors(spark, [(1, [0.5, -0.01]), (2, [0.5, -0.01])]), k=16, size=2)
    assert [(r.id, r.v, r.cluster, r.distance) for r in few.orderBy("id").collect()] == [(1, [32, -1], 0, 0), (2, [32, -1], 0, 0)] and len(centroids) == 2
    none, centroids = exponion.cluster(vectors(spark, [(1, None)]), size=2)
    shown = exponion.with_inertia(none).withColumn("digest", exponion.centroid_digest(centroids))
    assert shown.count() == 0 and "digest" in shown.columns
    with pytest.raises(Exception, match="beyond"):
        exponion.cluster(vectors(spark, [(1, [1e30, 0.0])]), size=2)


def test_query_against_brute_force(spark):
    rows = common.read(spark, SF, "embeddings").select("vec_id", "embedding").collect()
    kept = [r for r in rows if r.embedding is not None and len(r.embedding) == 64 and all(x is not None and np.isfinite(x) for x in r.embedding)]
    v = np.array([[int(np.floor(x * 64)) for x in r.embedding] for r in kept])
    want, squared, last = lloyd(v, starting([r.vec_id for r in kept], v, 16), 3)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last.tolist()]
    got = {r.vec_id: tuple(r)[1:] for r in queries.QUERIES["op13_exponion"](spark, SF).collect()}
    assert got == {r.vec_id: (int(c), int(d), int(squared[want == c].sum()), int(squared.sum()), digest[c]) for r, c, d in zip(kept, want, squared, strict=True)}
