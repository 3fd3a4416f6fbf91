"""Centroid clustering of whole-number vectors by Exponion search.

Each vector carries an upper bound of its distance to its centroid and a lower bound of that to every
other. After a round the bounds move by as much as the centroids did. Only a vector whose bounds no
longer tell its centroid apart is measured again, and against those centroids only that lie in a ball
around its own: of radius twice its distance plus that centroid's distance to its nearest neighbour,
read off a sorted list. The radius is inclusive and bounds are rounded outwards, so ties are seen.

Distances are whole numbers, compared as such; only bounds are floating-point numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Components below this keep every sum of squares of up to 2,048 components within a long.
LARGEST = 2**25
#: Vectors that are measured at once.
ROWS = 8192
STATE = "id long, v array<int>, cluster int, upper double, lower double, distance long"


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = 64) -> DataFrame:
    """id, v: floor(scale * x) of the components of all vectors of exactly `size` finite ones.

    Null vectors, others' sizes, and null, NaN or infinite components leave a row out. A component whose
    whole number is 2^25 or more is an error, as distances would not fit a long.
    """
    ok = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter((F.size(vector_col) == size) & ok).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double") * scale).alias("y"))
    fits = F.forall("y", lambda y: (y < LARGEST) & (y >= -LARGEST))
    checked = F.when(fits, F.transform("y", lambda y: F.floor(y).cast("int"))).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST}")))
    return kept.select("id", checked.alias("v"))


# Bounds and balls.


def root_up(square: np.ndarray) -> np.ndarray:
    """Never below the root: converting and rooting err by less than the one step added."""
    return np.nextafter(np.sqrt(square.astype(np.float64)), np.inf)


def root_down(square: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, np.nextafter(np.sqrt(square.astype(np.float64)), -np.inf))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a to those of b (or to one b), exact."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


@dataclass
class Search:
    """A round's centroids with their sorted distance lists, and how far they came since the round before."""

    centroids: np.ndarray  # k x size, long
    moved: np.ndarray  # k, rounded up

    def __post_init__(self) -> None:
        c = self.centroids
        k = len(c)
        apart = np.stack([root_down(squares(c, c[i])) for i in range(k)])
        # Its own centroid leads each list; others follow by distance.
        apart[np.arange(k), np.arange(k)] = -1.0
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        self.apart[:, 0] = 0.0
        # Distance to the nearest other, rounded up.
        self.gap = root_up(np.array([squares(c[self.order[i, 1 : 2]], c[i])[0] if k > 1 else 0 for i in range(k)], np.int64))
        top = np.argsort(-self.moved, kind="stable")
        self.most = np.full(k, self.moved[top[0]])
        self.most[top[0]] = self.moved[top[1]] if k > 1 else 0.0  # the furthest move among the others

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New cluster, upper and lower of vectors v; and how many distances were measured."""
        cluster = cluster.copy()
        upper = np.nextafter(upper + self.moved[cluster], np.inf)
        lower = np.maximum(0.0, np.nextafter(lower - self.most[cluster], -np.inf))
        # With a strict order no tie is lost.
        unsure = np.flatnonzero(upper >= lower)
        exact = squares(v[unsure], self.centroids[cluster[unsure]])
        measured = len(unsure)
        upper[unsure] = root_up(exact)
        still = upper[unsure] >= lower[unsure]
        unsure, exact = unsure[still], exact[still]
        radius = np.nextafter(2 * upper[unsure] + self.gap[cluster[unsure]], np.inf)
        own = cluster[unsure]
        none = np.iinfo(np.int64).max
        for a in np.unique(own):
            mine = np.flatnonzero(own == a)
            reach = np.searchsorted(self.apart[a], radius[mine], side="right")  # centroids in the ball, its own included
            mine = mine[np.argsort(-reach, kind="stable")]
            reach = np.sort(reach)[::-1]
            rows = unsure[mine]
            best, best_at, second = exact[mine].copy(), np.full(len(mine), a), np.full(len(mine), none)
            for j in range(1, int(reach[0]) if len(reach) else 0):
                n = int(np.searchsorted(-reach, -j, side="left"))  # vectors whose ball holds more than j centroids
                c = int(self.order[a, j])
                d = squares(v[rows[:n]], self.centroids[c])
                measured += n
                first = (d < best[:n]) | ((d == best[:n]) & (c < best_at[:n]))
                second[:n] = np.where(first, best[:n], np.minimum(second[:n], d))
                best[:n], best_at[:n] = np.where(first, d, best[:n]), np.where(first, c, best_at[:n])
            cluster[rows], upper[rows] = best_at, root_up(best)
            lower[rows] = np.where(second == none, np.inf, root_down(np.where(second == none, 0, second)))
        return cluster, upper, lower, measured


# Rounds.


def _assigned(state: DataFrame, search: Search, final: bool) -> DataFrame:
    """The state after one more assignment; distances are filled in by the final one."""
    names = [c.split()[0] for c in STATE.replace("array<int>", "x").split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = search.centroids.shape[1]
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                v = b["v"].flatten().to_numpy().reshape(-1, size).astype(np.int64)
                cluster, upper, lower, _ = search.assign(v, b["cluster"].to_numpy(), b["upper"].to_numpy(), b["lower"].to_numpy())
                distance = pa.array(squares(v, search.centroids[cluster]) if final else np.zeros(len(v), np.int64))
                yield pa.RecordBatch.from_arrays([b["id"], b["v"], pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), distance], names=names)

    return state.mapInArrow(run, STATE)


def _replaced(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid by its vectors' componentwise floor(sum / count); one without vectors stays."""
    size = centroids.shape[1]
    sums = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(size)]
    out = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # a row for each centroid
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(size)]
    return out


def starts(vectors: DataFrame, k: int, seed: int = 1) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `<seed>:<id>`, ascending; equal ones by their components."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    return [r["v"] for r in vectors.select("v", F.sha2(name, 256).alias("h")).orderBy("h", "v").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """id, v, cluster, distance (squared) for every vector that whole_numbers keeps, and the final centroids.

    Assign and replace `rounds` times, then assign once more. Ties go to the smaller number. With fewer
    vectors than k there are as many centroids; without any there are no rows. Rows with one id, or
    none, are vectors of their own; other columns are ignored.

    The driver sees sums for k centroids, never a vector but the first k.
    """
    spark = vectors.sparkSession
    common.bound_batches(spark)
    whole_numbers(vectors, id_col, vector_col, size, scale).write.parquet(path := common.shared_path(spark, "vectors"))
    kept = spark.read.schema("id long, v array<int>").parquet(path)
    centroids = np.array(starts(kept, k), np.int64).reshape(-1, size)
    known = ("id", "v", "cluster", "distance")
    if not len(centroids):
        return kept.select("id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    state = kept.select("id", "v", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("distance"))
    moved = np.zeros(len(centroids))
    for turn in range(rounds + 1):
        # A written table a round: the one before it is not needed any more, and goes.
        final = turn == rounds
        _assigned(state, Search(centroids, moved), final).write.parquet(now := common.shared_path(spark, "assigned"))
        state = spark.read.schema(STATE).parquet(now)
        common.discard(spark, path)
        path = now
        if not final:
            before, centroids = centroids, _replaced(state, centroids)
            moved = root_up(squares(centroids, before))
    return state.select(*known), centroids


def with_inertia(found: DataFrame) -> DataFrame:
    """found with cluster_inertia and inertia: its distances summed over the cluster and over all."""
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid
    return found.withColumns({"cluster_inertia": _by_cluster(sums, "long"), "inertia": F.lit(sum(sums.values())).cast("long")})


def _by_cluster(values: dict[int, int] | dict[int, str], kind: str) -> Column:
    """The cluster's value; a constant array, as there are k of them."""
    top = max(values, default=-1)
    return F.get(F.array(*[F.lit(values.get(i)).cast(kind) for i in range(top + 1)]).cast(f"array<{kind}>"), F.col("cluster"))


def centroid_digest(centroids: np.ndarray) -> Column:
    """sha256 of the cluster's centroid: its components in decimal, joined by commas."""
    return _by_cluster({i: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for i, c in enumerate(centroids.tolist())}, "string")
