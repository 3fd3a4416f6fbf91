"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest distinct 64-bit hashes of a text's five-word shingles (a text of fewer
words is one shingle, a text without words has an empty sketch). Sketches of parts merge into that
of the whole, and estimate resemblance, containment and the number of distinct shingles. Equal
texts have equal sketches; two empty sketches resemble each other fully (1.0), an empty and another
not at all (0.0).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K = 256
WORDS = 5
#: Words whose hashes a worker keeps.
CACHE_WORDS = 1_000_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode())
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


_words = _Hashes()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """One hash per shingle, repeats included."""
    own = text.split()
    if not own:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, own), np.uint64, len(own))
    size = min(words, len(w))
    h = np.full(len(w) - size + 1, np.uint64(size))
    for i in range(size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - size + 1 + i])
    return h


def sketch(text: str, k: int = K, words: int = WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's shingles that b has, from the hashes below both sketches' ends."""
    if not len(a):
        return 1.0
    ends = [s[-1] for s in (a, b) if len(s) == k]
    seen = a[a <= min(ends)] if ends else a
    return float(np.isin(seen, b, assume_unique=True).mean()) if len(seen) else 0.0


def distinct(a: np.ndarray, k: int = K) -> float:
    """Distinct shingles: exact below k, else (k - 1) over the k-th smallest hash as a share of all."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def dump(a: np.ndarray, k: int = K) -> str:
    return f"bk{k}:" + base64.b64encode(a.astype("<u8").tobytes()).decode()


def load(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text.partition(":")[2]), "<u8").astype(np.uint64)


def sketch_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """id, fingerprint, n_shingles (estimated distinct). Null text: empty; rows map one to one; ids of any type pass as they are."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sketch(t, k, words) for t in b.column("text").to_pylist()]
            columns = [b.column("id"), pa.array([dump(s, k) for s in found], pa.string()), pa.array([distinct(s, k) for s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "fingerprint", "n_shingles"])

    plain = docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    return plain.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fingerprint string, n_shingles double")


def merge_by(sketches: DataFrame, key: str, k: int = K, salts: int = 64) -> DataFrame:
    """One sketch per key from columns key and fingerprint: salted partial merges, then one more.

    A key with any share of all rows is first merged in `salts` groups per input partition chunk;
    what the last merge gets for a key is at most `salts` sketches. Null keys form one key.
    """
    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            merged: dict = {}  # keys stay as they are: pandas would round long ones beside a null
            for name, shown in zip(b[key].to_pylist(), b["fingerprint"].to_pylist(), strict=True):
                whole = np.concatenate([merged[name], load(shown)]) if name in merged else load(shown)
                merged[name] = np.unique(whole)[:k]
            yield pa.RecordBatch.from_arrays([pa.array(list(merged), b.schema.field(key).type), pa.array([dump(w, k) for w in merged.values()], pa.string())], names=[key, "fingerprint"])

    def final(rows: pd.DataFrame) -> pd.DataFrame:
        whole = np.unique(np.concatenate([load(f) for f in rows["fingerprint"]]))[:k]
        return rows.iloc[:1][[key]].assign(fingerprint=dump(whole, k))

    kind = sketches.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, fingerprint string"
    small = sketches.select(key, "fingerprint").mapInArrow(partial, schema)
    salted = small.withColumn("_salt", F.pmod(F.xxhash64("fingerprint"), F.lit(salts)))
    return salted.groupBy(key, "_salt").applyInPandas(final, schema).groupBy(key).applyInPandas(final, schema)


def edited(text: str, following: str) -> str:
    """The last half (rounded down, code points) replaced by as many first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


PAIRS = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """Each text's sketch beside those of its edited text and of the next document by ascending id.

    After the last comes the first; a single document follows itself. Null ids come first, equal ids
    are ordered by a hash of their text. The rows at a range's first key are also sent to the range
    before it, so every comparison is local; the driver gets a sample of keys only.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    text = common.text_of(text_col)
    keyed = docs.select(common.key_of(id_col, text).alias("key"), text.alias("text"))
    ranges = common.find_ranges(keyed.select("key"))
    own = F.col(id_col).cast("long")
    # The least key from the ids alone, then from the rows of that id.
    least = docs.agg(F.min(F.struct(own.isNotNull().alias("named"), own.alias("k"))).alias("x")).first()["x"]
    if least is None:
        return spark.createDataFrame([], PAIRS)
    first = docs.filter(own == least["k"] if least["named"] else own.isNull()).agg(F.min(common.key_of(id_col, text)).alias("x")).first()["x"]
    head = F.struct(F.lit(first["named"]).alias("named"), F.lit(first["k"]).cast("long").alias("k"), F.lit(first["h"]).cast("long").alias("h"))
    last = len(ranges.cuts)
    ranged = keyed.withColumn("r", ranges.of(F.col("key")))
    target = lambda r, ahead: F.struct(r.cast("int").alias("r"), F.lit(ahead).alias("ahead"))
    also = F.when(F.col("key") == head, target(F.lit(last), 1)).when((F.col("r") > 0) & (F.col("key") == ranges.at(F.col("r"))), target(F.col("r") - 1, 1))
    to = F.filter(F.array(target(F.col("r"), 0), also), lambda x: x.isNotNull())
    sent = ranged.select(F.explode(to).alias("to"), "key", "text").select("to.r", "to.ahead", "key", "text")
    sent = sent.repartitionById(ranges.n, "r").sortWithinPartitions("ahead", "key", "text").select("ahead", "key.named", "key.k", "text")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None  # the last row, waiting for the one after it
        for b in batches:
            rows = []
            for ahead, named, key, text in zip(b["ahead"].tolist(), b["named"].tolist(), b["k"].tolist(), b["text"].tolist(), strict=True):
                if ahead and not held:
                    continue
                own = sketch(text, k, words)
                if held:
                    name, prior, kept = held
                    changed = edited(prior, text)
                    other = sketch(changed, k, words)
                    rows.append((name, len(prior), hashlib.sha256(changed.encode()).hexdigest(), dump(kept, k), dump(other, k), resemblance(kept, other, k), resemblance(kept, own, k)))
                held = None if ahead else (key if named else None, text, own)
            if rows:
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in PAIRS.split(", ")])
                out["id"] = pd.array([r[0] for r in rows], dtype="Int64")
                yield out

    return sent.mapInPandas(run, PAIRS)
