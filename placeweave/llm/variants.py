"""Spelling variants: words at edit distance one, found by a trie self-join with active-node sets.

The vocabulary lies in tries, dealt out by prefix. A trie is walked from its root; beside each node
goes the set of nodes whose strings are at distance one, made from the parent's set. Where a word
ends, the words that end in its set are its near words.

Two words at distance one share their first `h` code points, or the edit lies before and they share
their end. So every word is in a trie of the words with its prefix, and in one of the words with its
end, turned round, which answers only for pairs whose first `h` code points differ. A block of more
than `limit` words is divided: by one more code point of the prefix, its other pairs (those that part
right behind the prefix) by their ends. Each pair belongs to one block exactly, and a block that can't
be divided holds words with at most two free code points, so no size of the input makes one unbounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a block that one task joins at once.
BLOCK_WORDS = 20_000
# Fixed value: what lies between two runs.
BETWEEN = "[^A-Za-zÀ-ÿ]+"
NO_END = 2**31 - 1
FRONTIER = "word string, n long, turned boolean, p int, q int, s int, lo int, hi int"


# Words of the texts.


def runs_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Text number and run of every maximal run of letters, A-Z in lower case; some runs are empty."""
    split = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    return pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)


def _moved(start: int, size: int, plain: dict[int, int]) -> int:
    """What crc32 of a beginning adds to the crc32 of `size` bytes that follow it."""
    zeros = bytes(size)
    if size not in plain:
        plain[size] = zlib.crc32(zeros)
    return zlib.crc32(zeros, start) ^ plain[size]


def spoiled_counts(names: list[str], texts: pa.Array, least: int, every: int) -> pa.Table:
    """word, n: how often each result occurs in these texts, results shorter than `least` left out.

    Let h be the crc32 of `<name>:<run>`; where `every` divides it, the run loses its code point h % length.
    """
    at, runs = runs_of(texts)
    long = pc.greater_equal(pc.utf8_length(runs), least)
    at, runs = at[long.to_numpy(zero_copy_only=False)], runs.filter(long)
    coded = runs.dictionary_encode()
    words = coded.dictionary
    if not len(words):
        return pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    # One row for each text and run: their h is the same wherever the run stands in the text.
    pairs, n = np.unique(at * len(words) + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    doc, code = np.divmod(pairs, len(words))
    shown = words.to_pylist()
    own = np.fromiter((zlib.crc32(w.encode()) for w in shown), np.uint32, len(shown))
    chars, size = pc.utf8_length(words).to_numpy().astype(np.int64), pc.binary_length(words).to_numpy().astype(np.int64)
    # crc32(a + b) is crc32(b) with a value laid over it that depends on a and the length of b only.
    widest = int(size.max()) + 1
    spots, back = np.unique(doc * widest + size[code], return_inverse=True)
    starts, plain = [zlib.crc32(f"{name}:".encode()) for name in names], {}
    over = np.fromiter((_moved(starts[s // widest], s % widest, plain) for s in spots.tolist()), np.uint32, len(spots))
    h = (own[code] ^ over[back]).astype(np.int64)
    hit = np.flatnonzero(h % every == 0)
    whole = n.copy()
    whole[hit] = 0
    totals = np.bincount(code, weights=whole, minlength=len(words)).astype(np.int64)
    cut: dict[str, int] = {}
    for w, place, times in zip(code[hit].tolist(), (h[hit] % chars[code[hit]]).tolist(), n[hit].tolist(), strict=True):
        word = shown[w][:place] + shown[w][place + 1 :]
        if len(word) >= least:
            cut[word] = cut.get(word, 0) + times
    kept = totals > 0
    plain_words = pa.table({"word": words.filter(pa.array(kept)).cast(pa.string()), "n": totals[kept]})
    return pa.concat_tables([plain_words, pa.table({"word": pa.array(list(cut), pa.string()), "n": pa.array(list(cut.values()), pa.int64())})])


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, every: int = 31, times: int = 2) -> DataFrame:
    """word, n of all results of at least `least` code points that occur `times` times or more over all texts.

    Null texts have no words, a null id counts as an empty name, rows with one id are texts of their
    own. An empty table gives an empty one. Other columns are not looked at.
    """
    common.bound_batches(docs.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from spoiled_counts(b["name"].to_pylist(), b["text"], least, every).combine_chunks().to_batches()

    name = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name")
    counted = docs.select(name, common.text_of(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


# The self-join of one block.


def near_in_trie(words: list[str]) -> Iterator[tuple[int, int]]:
    """Every ordered pair of places of two different words at distance one; the words are distinct."""
    kids: list[dict[str, int]] = [{}]
    ends = [-1]
    for i, word in enumerate(words):
        node = 0
        for ch in word:
            found = kids[node].get(ch)
            if found is None:
                found = kids[node][ch] = len(kids)
                kids.append({})
                ends.append(-1)
            node = found
        ends[node] = i
    # A node and the nodes at distance one from it: its children, and for others what the walk brought.
    walk = [(0, set(kids[0].values()))]
    while walk:
        node, active = walk.pop()
        own = kids[node]
        if (i := ends[node]) >= 0:
            for other in active:
                if (j := ends[other]) >= 0:
                    yield i, j
        for ch, child in own.items():
            # Active for the child: its children (one more), the node itself (one less), its siblings
            # (one replaced) and what follows by the same code point on a node active for its parent.
            near = {kids[a][ch] for a in active if ch in kids[a]}
            near.update(kids[child].values())
            near.update(own.values())
            near.discard(child)
            near.add(node)
            walk.append((child, near))


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    """word, n_near, best_n, best of the block's pairs: each word's number of partners, and the partner of largest n."""
    first = frame.iloc[0]
    p, q, s, lo, hi, turned = (int(first[c]) for c in ("p", "q", "s", "lo", "hi", "turned"))
    words, n = frame["word"].tolist(), frame["n"].tolist()
    stems = [w[p : len(w) - s] for w in words]
    if turned:
        stems = [w[::-1] for w in stems]
    partners: dict[int, tuple[int, int, str]] = {}  # partners, and least of (-n, word) among them
    for i, j in near_in_trie(stems):
        a, b = words[i], words[j]
        if turned and (a[:q] == b[:q] or not lo <= min(len(a), len(b)) <= hi):
            continue
        count, *best = partners.get(i, (0, 1, ""))
        partners[i] = (count + 1, *min((best[0], best[1]), (-n[j], b)))
    return pd.DataFrame([(words[i], c, -m, b) for i, (c, m, b) in partners.items()], columns=["word", "n_near", "best_n", "best"])


def _key() -> F.Column:
    """The block of a frontier row; prefix and end have the lengths that stand before them."""
    marks = F.concat_ws(",", *[F.col(c).cast("string") for c in ("turned", "p", "q", "s", "lo", "hi")])
    return F.concat(marks, F.lit(":"), F.expr("substr(word, 1, p)"), F.expr("right(word, s)"))


def _part(turned: bool, p, q, s, lo, hi):
    whole = lambda x: F.lit(x).cast("int")
    return F.struct(F.lit(turned).alias("turned"), *[whole(x).alias(c) for c, x in zip(("p", "q", "s", "lo", "hi"), (p, q, s, lo, hi), strict=True)])


def _divided(rows: DataFrame, reach: int) -> DataFrame:
    """The rows of blocks that are too large, in the smaller blocks that answer for the same pairs."""
    p, q, s, lo, hi = (F.col(c) for c in ("p", "q", "s", "lo", "hi"))
    # A trie by prefix: one more code point; pairs that part right behind p, by their ends.
    by_prefix = F.array(_part(False, p + 1, p + 1, F.lit(0), lo, hi), _part(True, p, p + 1, F.greatest(F.lit(0), lo - p - 1), lo, hi))
    # Pairs that part in p..q-1: one block for each place.
    places = F.array(*[_part(True, p + i, p + i + 1, F.greatest(s, lo - p - i - 1), lo, hi) for i in range(reach)])
    by_place = F.filter(places, lambda x: x["q"] <= q)
    # Pairs that part right behind p: one more code point of the end, but for words too short to have it.
    by_end = F.array(_part(True, p, q, s + 1, F.greatest(lo, p + s + 2), hi), _part(True, p, q, s, lo, F.least(hi, p + s + 1)))
    parts = F.when(~F.col("turned"), by_prefix).when(q - p > 1, by_place).otherwise(by_end)
    return _fitting(rows.select("word", "n", F.explode(parts).alias("part")).select("word", "n", "part.*"))


def _fitting(rows: DataFrame) -> DataFrame:
    """Rows whose word is long enough for its block's prefix and end, and for some pair of it."""
    size = F.char_length("word")
    return rows.filter((size >= F.col("p") + F.col("s")) & (size >= F.col("lo")) & (size <= F.col("hi") + 1) & (F.col("lo") <= F.col("hi")))


def near_words(vocabulary: DataFrame, least: int = 7, limit: int = BLOCK_WORDS) -> DataFrame:
    """word, n_near, best_n, best for every word that has a near word: how many, and the one of largest n.

    vocabulary: distinct words (word, n) of at least `least` code points; ties between near words go to
    the smallest in code-point order. Nulls are left out. No words, or none near: no rows.
    """
    h = max(1, least // 2)
    start = F.array(_part(False, h, h, 0, least, NO_END - 1), _part(True, 0, h, max(0, least - h), least, NO_END - 1))
    rows = vocabulary.filter("word is not null and n is not null").select("word", "n", F.explode(start).alias("part")).select("word", "n", "part.*")
    # Words shorter than the first prefix can't be; `least` says so.
    rows, done = _fitting(rows).withColumn("key", _key()), []
    while True:
        # A turned block of one place whose words have at most two free code points is never divided.
        final = F.col("turned") & (F.col("q") - F.col("p") == 1) & (F.col("hi") <= F.col("p") + F.col("s") + 1)
        sizes = rows.filter(~final).groupBy("key").count().filter(F.col("count") > limit).select("key")
        large = common.materialise(sizes, "large-blocks")
        if large.isEmpty():
            break
        done.append(rows.join(large, "key", "left_anti"))
        rows = common.materialise(_divided(rows.join(large, "key", "left_semi"), h).withColumn("key", _key()), "blocks")
    for part in done:
        rows = rows.unionByName(part)
    dealt = rows.repartition(common.partitions(rows.sparkSession), "key").sortWithinPartitions("key", "word")

    def join(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in common.whole_groups(batches, "key"):
            for _, block in frame.groupby("key", sort=False):
                if len(block) > 1:
                    yield _block(block)

    found = dealt.mapInPandas(join, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def _followed(links: DataFrame) -> DataFrame:
    """word, root: where the links (word, form) lead in the end; n grows along them, so there is no circle."""
    now = common.materialise(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = common.materialise(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def group_variants(vocabulary: DataFrame, least: int = 7, ratio: int = 10, limit: int = BLOCK_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary (distinct word, n).

    A word's form is its near word of largest n, if that n is `ratio` times its own or more (ratio above
    1); root is the last form on the way. Words with no near word have n_near 0 and are their own root.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its variants")
    vocabulary = common.materialise(vocabulary.select("word", "n").filter("word is not null and n is not null"), "vocabulary")
    near = near_words(vocabulary, least, limit)
    strong = F.col("best_n") >= ratio * F.col("n")
    formed = common.materialise(
        vocabulary.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n")
        ),
        "variants",
    )
    roots = _followed(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
