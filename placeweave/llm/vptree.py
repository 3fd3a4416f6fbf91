"""Nearest vectors by largest inner product: vantage-point trees per shard, relaxed pruning.

Vectors are lifted by one coordinate to equal norm, so that the largest inner product is the smallest
Euclidean distance. A tree node splits its points by distance to a vantage point; a subtree is
passed over when the triangle inequality puts all its points beyond `factor` times the distance of
the k-th nearest found so far. factor 1 never passes over a nearer point: exact search. Smaller
factors prune more.

Shards are the leaves of a small tree of the same kind over all vectors, whose vantage points come
from a sample of LEAF_SAMPLE vectors a leaf, MAX_LEAVES leaves at most; every vector is indexed in
the leaf it falls into, and leaves that hold many are divided by a hash. Each shard's tree is built
once and written. A query goes to its own leaf first and takes the distance of its k-th nearest
along; then it goes to those leaves only that the rule above does not pass over.

Equal vectors are one point with the least ids that could still be asked for, so a vector that many
rows share costs as much as one. Ties go to the smaller id.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAF = 64
SHARD_VECTORS = 4096
BLOCK_QUERIES = 4096
#: Leaves of the tree that deals vectors to shards, at most, and vectors drawn for each.
MAX_LEAVES = 2048
LEAF_SAMPLE = 32
#: Vectors that are held against all vantage points at once.
ROUTE_ROWS = 1024


@dataclass
class Node:
    points: np.ndarray | None = None  # leaf
    vantage: int = -1
    low: tuple[float, float] = (0.0, 0.0)  # distances of the inner points to the vantage point
    high: tuple[float, float] = (0.0, 0.0)
    inner: Node | None = None
    outer: Node | None = None
    children: list = field(default_factory=list)


class Tree:
    """Points are rows of x (float64); the query side is batched."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, top: float | None = None):
        self.x, self.leaf = x, leaf
        self.sq = np.einsum("ij,ij->i", x, x)
        self.top = top if top is not None else float(self.sq.max()) if len(x) else 0.0  # squared norm that all are lifted to
        self.lift = np.sqrt(np.maximum(0.0, self.top - self.sq))
        self.root = self._build(np.arange(len(x)))

    def _build(self, points: np.ndarray) -> Node:
        if len(points) <= self.leaf:
            return Node(points=points)
        # A far point from the first one is a vantage point whose distances spread well.
        seed = self._between(points[0], points)
        v = points[int(seed.argmax())]
        d = self._between(v, points)
        order = np.argsort(d, kind="stable")
        half = len(points) // 2
        a, b = order[:half], order[half:]
        return Node(vantage=int(v), low=(d[a[0]], d[a[-1]]), high=(d[b[0]], d[b[-1]]), inner=self._build(points[a]), outer=self._build(points[b]))

    def _between(self, v: int, points: np.ndarray) -> np.ndarray:
        dot = self.x[points] @ self.x[v] + self.lift[points] * self.lift[v]
        return np.sqrt(np.maximum(0.0, 2 * self.top - 2 * dot))

    def search(self, q: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Point numbers (-1: none) and inner products of the k nearest, nearest first, ties to the lesser number.

        floor: for each query an inner product below which nothing is wanted any more.
        """
        n = len(q)
        floor = np.full(n, -np.inf) if floor is None else floor
        best = np.full((n, k), -np.inf)
        ids = np.full((n, k), -1, dtype=np.int64)
        qq = np.einsum("ij,ij->i", q, q)
        slack = 1e-9 * (1.0 + self.top + qq)  # rounding must not prune an equal

        def leaf(node: Node, act: np.ndarray) -> None:
            dots = np.concatenate([best[act], q[act] @ self.x[node.points].T], axis=1)
            names = np.concatenate([ids[act], np.broadcast_to(node.points, (len(act), len(node.points)))], axis=1)
            order = np.lexsort((np.where(names < 0, np.iinfo(np.int64).max, names), -dots), axis=1)[:, :k]
            best[act], ids[act] = np.take_along_axis(dots, order, 1), np.take_along_axis(names, order, 1)

        def distance(node: Node, act: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0.0, qq[act] + self.top - 2 * (q[act] @ self.x[node.vantage])))

        seen = np.full(n, -1, dtype=np.int64)
        leaves: list[Node] = []

        def descend(node: Node, act: np.ndarray) -> None:
            """Each query looks into its own leaf first, so that pruning has a distance to start from."""
            if not len(act):
                return
            if node.points is not None:
                leaf(node, act)
                seen[act] = len(leaves)
                leaves.append(node)
                return
            near = distance(node, act) <= (node.low[1] + node.high[0]) / 2
            descend(node.inner, act[near])
            descend(node.outer, act[~near])

        number: dict[int, int] = {}

        def walk(node: Node, act: np.ndarray) -> None:
            if not len(act):
                return
            if node.points is not None:
                act = act[seen[act] != number.get(id(node), -2)]
                if len(act):
                    leaf(node, act)
                return
            d = distance(node, act)
            for (lo, hi), child in ((node.low, node.inner), (node.high, node.outer)):
                bound = np.maximum(0.0, np.maximum(lo - d, d - hi))
                reach = qq[act] + self.top - 2 * np.maximum(best[act, -1], floor[act])  # infinite while fewer than k are found
                walk(child, act[bound * bound <= factor * factor * np.maximum(0.0, reach) + slack[act]])

        descend(self.root, np.arange(n))
        number.update({id(x): i for i, x in enumerate(leaves)})
        walk(self.root, np.arange(n))
        return ids, best


class Router:
    """The tree over all vectors whose leaves are shards: built from a sample, the same for points and queries."""

    def __init__(self, sample: np.ndarray, leaves: int, top: float):
        self.top, self.leaves = top, 0
        self.vantage: list[np.ndarray] = []
        self.lift: list[float] = []
        self.split: list[float] = []
        self.paths: dict[int, list[int]] = {}  # leaf -> nodes from the root
        self.root = self._build(sample, leaves, [])
        self.x = np.stack(self.vantage) if self.vantage else np.empty((0, sample.shape[1] if sample.ndim == 2 else 0))
        self.low: dict[int, list[float]] = {}
        self.high: dict[int, list[float]] = {}

    def _lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.top - np.einsum("ij,ij->i", x, x)))

    def _build(self, points: np.ndarray, leaves: int, path: list[int]) -> tuple:
        if leaves <= 1 or len(points) < 2:
            self.leaves += 1
            self.paths[self.leaves - 1] = path
            return (self.leaves - 1,)
        lift = self._lift(points)
        between = lambda i: np.sqrt(np.maximum(0.0, 2 * self.top - 2 * (points @ points[i] + lift * lift[i])))
        v = int(between(0).argmax())  # a far point from the first one
        d = between(v)
        order = np.argsort(d, kind="stable")
        half = len(points) * (leaves // 2) // leaves
        node = len(self.vantage)
        self.vantage.append(points[v])
        self.lift.append(float(lift[v]))
        self.split.append(float((d[order[half - 1]] + d[order[half]]) / 2) if half else float(d[order[0]]))
        return node, self._build(points[order[:half]], leaves // 2, [*path, node]), self._build(points[order[half:]], leaves - leaves // 2, [*path, node])

    def distances(self, x: np.ndarray, lift: np.ndarray | float) -> np.ndarray:
        """[vector, node]; queries have a lift of zero and keep their own norm."""
        own = np.einsum("ij,ij->i", x, x) + np.asarray(lift) ** 2
        dot = x @ self.x.T + np.multiply.outer(np.broadcast_to(lift, len(x)), np.array(self.lift))
        return np.sqrt(np.maximum(0.0, own[:, None] + self.top - 2 * dot))

    def leaf_of(self, d: np.ndarray) -> np.ndarray:
        out = np.zeros(len(d), dtype=np.int64)

        def go(node: tuple, rows: np.ndarray) -> None:
            if len(node) == 1:
                out[rows] = node[0]
                return
            near = d[rows, node[0]] <= self.split[node[0]]
            go(node[1], rows[near])
            go(node[2], rows[~near])

        go(self.root, np.arange(len(d)))
        return out

    def place(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The leaf of each point, and its distances to the nodes above that leaf."""
        d = self.distances(x, self._lift(x))
        leaf = self.leaf_of(d)
        return leaf, [row[self.paths[i]] for row, i in zip(d, leaf.tolist(), strict=True)]

    def visits(self, q: np.ndarray, floor: np.ndarray, factor: float, home_only: bool) -> Iterator[tuple[np.ndarray, int]]:
        """(queries, leaf) for each leaf to be looked into: each query's own, or all others that floor and factor leave."""
        d = self.distances(q, 0.0)
        home = self.leaf_of(d)
        qq = np.einsum("ij,ij->i", q, q)
        reach = np.maximum(0.0, qq + self.top - 2 * floor)
        slack = 1e-9 * (1.0 + self.top + qq)
        for leaf, path in self.paths.items():
            if leaf not in self.low:  # no point lies there
                continue
            if home_only:
                rows = np.flatnonzero(home == leaf)
            else:
                own = d[:, path]
                bound = np.maximum(0.0, np.maximum(np.array(self.low[leaf]) - own, own - np.array(self.high[leaf]))).max(axis=1, initial=0.0)
                rows = np.flatnonzero((home != leaf) & (bound * bound <= factor * factor * reach + slack))
            if len(rows):
                yield rows, leaf


class Shard:
    """A tree over the distinct vectors of a shard, with the ids that share each."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, top: float):
        distinct, inverse = np.unique(x, axis=0, return_inverse=True)
        inverse = inverse.ravel()
        order = np.lexsort((ids, inverse))  # ids ascend within equal vectors
        starts = np.searchsorted(inverse[order], np.arange(len(distinct) + 1))
        # Number distinct vectors by their least id, so that the tree's ties go the right way.
        by = np.argsort(ids[order[starts[:-1]]], kind="stable")
        self.tree = Tree(distinct[by], top=top)
        groups = [ids[order[starts[p] : starts[p + 1]]] for p in by]
        self.sizes = np.array([len(g) for g in groups])
        self.flat, self.first = np.concatenate(groups), np.concatenate([[0], np.cumsum(self.sizes)[:-1]])

    def nearest(self, names: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, factor: float) -> pd.DataFrame:
        """query_id, vec_id, score: the k nearest of each query but itself, none below its floor."""
        points, _ = self.tree.search(q, k + 1, factor, floor)
        qi, slot = np.nonzero(points >= 0)
        p = points[qi, slot]
        scores = np.einsum("ij,ij->i", q[qi], self.tree.x[p])
        reps = self.sizes[p]
        within = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        rq, rv, rs = np.repeat(qi, reps), self.flat[np.repeat(self.first[p], reps) + within], np.repeat(scores, reps)
        kept = names[rq] != rv
        rq, rv, rs = rq[kept], rv[kept], rs[kept]
        order = np.lexsort((rv, -rs, rq))
        rq, rv, rs = rq[order], rv[order], rs[order]
        kept = np.arange(len(rq)) - np.searchsorted(rq, rq) < k
        return pd.DataFrame({"query_id": names[rq[kept]], "vec_id": rv[kept], "score": rs[kept]})


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v: rows whose vector is neither null, empty nor zero and has finite components only."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


FOUND = "query_id long, vec_id long, score double"
#: Rows drawn for each one that a router needs, and the fineness of the share that is drawn.
DRAWN = 1.5
SHARE_STEPS = 1 << 30


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64)


def _routers(points: DataFrame, shard_vectors: int) -> tuple[dict[int, Router], dict[int, float]]:
    """A router for each length of vectors, from a bounded sample of points (h, v, width)."""
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stats = points.groupBy("width").agg(F.count("*").alias("n"), F.max(squares).alias("top")).collect()  # a row for each length
    leaves = {r["width"]: max(1, min(MAX_LEAVES, -(-r["n"] // shard_vectors))) for r in stats}
    top = {r["width"]: float(r["top"]) * (1 + 1e-12) for r in stats}
    # A hash of the row tells whether it is drawn, so no task sees more rows than its own; some more than
    # LEAF_SAMPLE a leaf are drawn, so that hardly ever fewer come.
    shares = [(r["width"], min(1.0, DRAWN * LEAF_SAMPLE * leaves[r["width"]] / r["n"])) for r in stats]
    drawn = F.pmod(F.xxhash64("h", "id", F.lit("sample")), F.lit(SHARE_STEPS))
    known = points.sparkSession.createDataFrame([(w, max(1, round(s * SHARE_STEPS))) for w, s in shares], "width int, below int")
    sample = points.select("width", "id", "h", "v").join(F.broadcast(known), "width").filter(drawn < F.col("below")).select("width", "v").toPandas()
    routers = {w: Router(_matrix(part["v"]), leaves[w], top[w]) for w, part in sample.groupby("width")}
    if len(routers) < len(leaves):
        raise RuntimeError("no vector was drawn of some length")
    return routers, top


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 0.6, id_col: str = "vec_id", vec_col: str = "embedding", shard_vectors: int = SHARD_VECTORS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k nearest rows of vectors but itself.

    Null, zero and non-finite vectors take no part, nor do vectors of another length than the query's;
    repeated ids count once per vector, a query id with several vectors asks with the least of each
    length. Only k rows of each meeting of a query and a shard go on. No vectors or no queries: no rows.
    """
    spark = vectors.sparkSession
    width = F.size("v").alias("width")
    base = common.materialise(valid(vectors, id_col, vec_col).select("id", "v", F.xxhash64("v").alias("h"), width), "vectors")
    asked = valid(queries, id_col, vec_col).select("id", "v", width).groupBy("id", "width").agg(F.min("v").alias("v"))
    asked = common.materialise(asked, "queries")
    # Of equal vectors the k + 1 least ids are all that any query can need.
    ranked = base.distinct().withColumn("n", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).filter(F.col("n") <= k + 1)
    points = common.materialise(ranked.drop("n"), "points")
    routers, top = _routers(points, shard_vectors)
    if not routers:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def by_width(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
        for b in batches:
            for w, part in b.groupby("width"):
                for i in range(0, len(part), ROUTE_ROWS):
                    yield w, part.iloc[i : i + ROUTE_ROWS]

    def route(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for w, part in by_width(batches):
            leaf, path = routers[w].place(_matrix(part["v"]))
            yield pd.DataFrame({"width": w, "leaf": leaf, "path": path, "id": part["id"].to_numpy(), "v": part["v"].to_numpy(), "h": part["h"].to_numpy()})

    routed = common.materialise(points.select("id", "v", "h", "width").mapInPandas(route, "width int, leaf int, path array<double>, id long, v array<double>, h long"), "routed")
    ends = routed.select("width", "leaf", F.posexplode_outer("path").alias("at", "d")).groupBy("width", "leaf", "at").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n"))
    subs: dict[tuple[int, int], int] = {}
    for r in ends.orderBy("width", "leaf", "at").collect():  # a few numbers for each leaf
        router = routers[r["width"]]
        for known, value in ((router.low, r["low"]), (router.high, r["high"])):
            known.setdefault(r["leaf"], []).extend([] if r["at"] is None else [value])
        subs[r["width"], r["leaf"]] = max(1, round(r["n"] / shard_vectors))

    # A row for each leaf, of which there are MAX_LEAVES for a length at most.
    divided = spark.createDataFrame([(w, leaf, n) for (w, leaf), n in subs.items()], "width int, leaf int, parts int")
    sharded = routed.join(F.broadcast(divided), ["width", "leaf"]).withColumn("sub", F.pmod("h", "parts").cast("int"))

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = Shard(_matrix(rows["v"]), rows["id"].to_numpy(), top[key[0]])
        return pd.DataFrame({"width": [key[0]], "leaf": [key[1]], "sub": [key[2]], "tree": [pickle.dumps(tree)]})

    trees = sharded.select("width", "leaf", "sub", "id", "v").groupBy("width", "leaf", "sub").applyInPandas(grow, "width int, leaf int, sub int, tree binary")
    trees = common.materialise(trees, "trees")

    def search(askers: DataFrame, home_only: bool) -> DataFrame:
        """askers (id, v, width, floor) against the leaves they visit."""

        def go(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for w, part in by_width(batches):
                if w in routers:
                    for rows, leaf in routers[w].visits(_matrix(part["v"]), part["floor"].to_numpy(), factor, home_only):
                        yield part.iloc[rows].assign(leaf=leaf, subs=subs[w, leaf])

        visits = askers.mapInPandas(go, "id long, v array<double>, width int, floor double, leaf int, subs int")
        visits = common.materialise(visits.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs"), "visits")
        shard = ["width", "leaf", "sub"]
        # As many blocks as a shard's queries need: a tree is sent once for each.
        blocks = visits.groupBy(*shard).agg(F.ceil(F.count("*") / block_queries).cast("int").alias("blocks"))
        dealt = visits.join(blocks, shard).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
        sent = trees.join(blocks, shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

        def meet(tree: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            if not len(tree) or not len(theirs):
                return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
            return pickle.loads(tree["tree"].iloc[0]).nearest(theirs["id"].to_numpy(), _matrix(theirs["v"]), theirs["floor"].to_numpy(), k, factor)

        keys = [*shard, "block"]
        met = sent.select(*keys, "tree").groupBy(*keys).cogroup(dealt.select(*keys, "id", "v", "floor").groupBy(*keys)).applyInPandas(meet, FOUND)
        return common.materialise(met, "met")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    first = search(asked.select("id", "v", "width", F.lit(float("-inf")).alias("floor")), True)
    if len(subs) == len(routers):  # one leaf for each length: everything has been visited
        return first.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    kth = first.withColumn("n", rank).filter(F.col("n") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    floored = asked.join(kth, "id", "left").select("id", "v", "width", F.coalesce("kth", F.lit(float("-inf"))).alias("floor"))
    found = first.unionByName(search(floored, False))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
