"""Toxic passages by maximum-scoring segments.

Each word, and each beginning of four or five letters, has a log-odds score between toxic and clean
labelled documents (counted once a document), with an informative Dirichlet prior from the words of
both, weighted by how sure the odds are: the posterior probability that they differ from zero, were
a word at SURE standard errors as likely to matter as not. Scores are kept in steps of STEP. A token
takes the score of the longest of its forms whose score isn't zero; a form that the labels don't
hold has the prior's odds, zero. The odds are those of a word's presence in a document, so its k-th
occurrence in a text brings a k-th of them. From each token's score DRIFT is taken, so that clean
text scores below zero on average. A linear-time scan finds every maximal scoring segment of a text; a
segment is significant when its expected number in clean text of that length (Karlin and
Altschul's extreme-value law) is at most the model's e_value. The law's lambda and K are the likeliest for the
best segments of clean documents. The evidence of a document, minus the logarithm of the probability that clean text holds such a best segment, and
the sum over its significant segments, are calibrated to a probability.

Labels are learned from a bounded sample of labelled rows (MAX_LABELLED, taken by a hash of the
id; an id that repeats counts once, with the least of its texts). The law, e_value (one of E_VALUES,
the likeliest) and the calibration see
each labelled document through scores learned from the other fold, so no document vouches for its
own words. The word counts are summed on the executors; all words with a score are kept. Null and
empty texts have no token and so no evidence. A text is always scanned whole. Rows that repeat, also
whole, are scored one by one and alike.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .calibrate import apply_logistic, fit_logistic

MAX_LABELLED = 20_000
PRIOR_WORDS = 1_000.0
#: Least prior count of a word, so that a word new to one side isn't taken as certain.
LEAST_PRIOR = 0.5
#: Standard errors at which log-odds count half, and the steps in which scores are kept.
SURE = 3.0
STEP = 0.05
#: Share of a toxic passage's tokens that are toxic words themselves, about; what the others cost.
DENSITY = 0.2
DRIFT = math.log(1 - DENSITY)
#: Expected numbers in clean text from which the fit chooses what counts as significant.
E_VALUES = (0.05, 0.01, 1e-3, 1e-4, 1e-5)
FOLDS = 2
#: Words whose scores a scanner keeps, and forms that a worker counts before it passes them on.
CACHE_WORDS = 150_000
COUNT_FORMS = 50_000
TOKEN = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    scores: dict[str, float]  # form -> weighted log-odds, none of them zero
    lam: float
    k: float
    weights: tuple[float, ...]
    e_value: float = E_VALUES[0]


def labelled_sample(labels: DataFrame, label: str, held_out: Column, limit: int) -> DataFrame:
    """At most limit rows (id, y) that are not held out, in the order of a hash of the id."""
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    one = rows.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(limit)


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def forms(word: str) -> tuple[str, ...]:
    """The word and its beginnings, longest first."""
    return (word, f"{word[:5]}*", f"{word[:4]}*") if len(word) > 4 else (word,)


class _Scores(dict):
    """Word -> score, looked up by its forms once."""

    def __init__(self, known: dict[str, float]):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> float:
        score = next((self.known[f] for f in forms(word) if f in self.known), 0.0)
        if len(self) < CACHE_WORDS:
            self[word] = score
        return score


def _maximal(first: list[int], low: list[float], high: list[float]) -> list[tuple[int, int, float]]:
    """Maximal segments from the tokens above zero: place, sum before, sum up to and with each.

    Each candidate points to the last one before it that starts lower, so a later search goes from
    pointer to pointer; what a pointer has passed once is never looked at again, and all searches
    together take a number of steps in proportion to the tokens.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum up to the end, pointer
    for p, lo, hi in zip(first, low, high, strict=True):
        start, before, j = p, lo, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= hi:
                break
            start, before, back = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = back
        found.append((start, p, before, hi, j))
    return [(a, b, e - s) for a, b, s, e, _ in found]


def segments(positions: list[int], gains: list[float], drift: float) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (first token, last token, score) in linear time.

    positions and gains are the tokens with a score of their own, of either sign; all others add
    drift (below zero).
    """
    first, low, high = [], [], []
    total, at = 0.0, 0
    for p, g in zip(positions, gains, strict=True):
        before = total + drift * (p - at)
        total, at = before + g, p + 1
        if g > 0:
            first.append(p)
            low.append(before)
            high.append(total)
    return _maximal(first, low, high)


class Scanner:
    """One per worker task: a model and its word cache."""

    def __init__(self, model: Model):
        self.model, self.scores = model, _Scores(model.scores)

    def each(self, text: str) -> np.ndarray:
        """The score of each token; a word's k-th occurrence brings a k-th of its odds."""
        own = tokens(text)
        odds = np.fromiter(map(self.scores.__getitem__, own), np.float64, len(own))
        times: dict[str, int] = {}
        for i in np.flatnonzero(odds).tolist():
            times[own[i]] = k = times.get(own[i], 0) + 1
            if k > 1:
                odds[i] /= k
        return odds + DRIFT

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and every maximal segment."""
        each = self.each(text)
        at = np.flatnonzero(each > 0)
        if not len(at):
            return len(each), []
        high = np.cumsum(each)[at]
        return len(each), _maximal(at.tolist(), (high - each[at]).tolist(), high.tolist())

    def expected(self, n: int, score: float) -> float:
        """How many such segments clean text of n tokens would hold."""
        return self.model.k * n * math.exp(-min(700.0, self.model.lam * score))

    def passages(self, text: str) -> list[tuple[int, int, float, float]]:
        """(first token, last token, score, expected number in clean text) of each significant passage."""
        n, found = self.segments(text)
        return [(a, b, s, e) for a, b, s in found if (e := self.expected(n, s)) <= self.model.e_value]

    def evidence_at(self, text: str, levels: tuple[float, ...]) -> tuple[float, list[float], list[int]]:
        """log(1 - log p) of the best segment; at each level the same of all significant ones together, and their number."""
        n, found = self.segments(text)
        best, total, count = 0.0, [0.0] * len(levels), [0] * len(levels)
        for _, _, s in found:
            e = self.expected(n, s)
            bits = -math.log(max(1e-300, -math.expm1(-e)))
            best = max(best, bits)
            for i, level in enumerate(levels):
                if e <= level:
                    total[i] += bits
                    count[i] += 1
        return math.log1p(best), [math.log1p(t) for t in total], count

    def evidence(self, text: str) -> tuple[float, float, int]:
        best, total, count = self.evidence_at(text, (self.model.e_value,))
        return best, total[0], count[0]


def extreme_value_law(n: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """lambda and K of P(best < x) = exp(-K n exp(-lambda x)), likeliest for clean texts of n tokens with these best scores.

    For a given lambda, n exp(-lambda x) is exponential with rate K; a text without any segment only
    says that it is at least n. So K is their number over their sum, and lambda is found on a grid.
    """
    hit = best > 0
    if not hit.any():
        return math.log(2), 1.0 / max(1.0, float(n.sum()))
    laws = []
    for lam in np.exp(np.linspace(math.log(0.05), math.log(8.0), 400)):
        k = hit.sum() / (n * np.exp(-lam * best)).sum()
        laws.append((hit.sum() * (math.log(k) + math.log(lam)) - lam * best[hit].sum(), lam, k))
    _, lam, k = max(laws)
    return float(lam), float(k)


def weighted_odds(n_clean: Column, n_toxic: Column, clean: str = "clean", toxic: str = "toxic") -> Column:
    """Log-odds of a word's counts with the Dirichlet prior, weighted by how sure they are, in steps of STEP."""
    both = F.col(clean) + F.col(toxic)
    prior = F.greatest(F.lit(LEAST_PRIOR), F.lit(PRIOR_WORDS) * both / (n_clean + n_toxic))
    a, b = F.col(toxic) + prior, F.col(clean) + prior
    # What is left for all other words; none where a vocabulary has one word only.
    other = lambda n, x: F.greatest(F.lit(LEAST_PRIOR), n + PRIOR_WORDS - x)
    odds = F.log(a / other(n_toxic, a)) - F.log(b / other(n_clean, b))
    z2 = odds * odds / (1 / a + 1 / b)
    weight = 1 / (1 + F.exp(F.least(F.lit(700.0), (SURE**2 - z2) / 2)))
    return F.round(odds * weight / STEP) * STEP


def fit(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """docs holds the texts, sample (id, y) the bounded labelled rows."""
    common.bound_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text"))
    # One text for each sampled id, so that no more than the sample's rows are ever gathered.
    known = plain.join(F.broadcast(sample), "id").groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    known = common.materialise(known.withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int")), "labelled")

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, list[int]] = {}
        for b in batches:
            for text, y, fold in zip(b["text"], b["y"], b["fold"], strict=True):
                for w in {f for w in set(tokens(text)) for f in forms(w)}:
                    sums.setdefault(w, [0] * (2 * FOLDS))[2 * fold + y] += 1
                if len(sums) >= COUNT_FORMS:
                    yield pd.DataFrame([[w, *v] for w, v in sums.items()], columns=["word", *names])
                    sums = {}
        yield pd.DataFrame([[w, *v] for w, v in sums.items()], columns=["word", *names])

    names = [f"{side}{k}" for k in range(FOLDS) for side in ("clean", "toxic")]
    words = known.mapInPandas(count, "word string, " + ", ".join(f"{c} long" for c in names)).groupBy("word").agg(*[F.sum(c).alias(c) for c in names])
    words = common.materialise(words, "words")
    sums = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    # Column sets: all folds, then all but one.
    chosen = [range(FOLDS), *[[k for k in range(FOLDS) if k != f] for f in range(FOLDS)]]
    totals = [{side: sum(sums[f"{side}{k}"] for k in ks) for side in ("clean", "toxic")} for ks in chosen]
    if not totals[0]["clean"] or not totals[0]["toxic"]:
        return Model({}, math.log(2), 0.1, (0.0, 0.0, -8.0 if totals[0]["clean"] or not totals[0]["toxic"] else 8.0))
    odds = []
    for ks, n in zip(chosen, totals, strict=True):
        own = words.select("word", *[sum((F.col(f"{side}{k}") for k in ks), F.lit(0)).alias(side) for side in ("clean", "toxic")])
        score = weighted_odds(F.lit(n["clean"]), F.lit(n["toxic"])) if n["clean"] and n["toxic"] else F.lit(0.0)
        odds.append(own.select("word", score.alias("odds")).filter("odds != 0"))
    scores: list[dict[str, float]] = []
    for part in odds:  # words of a bounded sample; as columns, which take a tenth of the driver's memory that rows do
        got = part.select("word", "odds").toArrow()
        scores.append(dict(zip(got["word"].to_pylist(), got["odds"].to_pylist(), strict=True)))
    raw = [Model(s, 1.0, 1.0, ()) for s in scores]

    def best(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanners = [Scanner(m) for m in raw[1:]]
        for b in batches:
            rows = []
            for text, y, fold in zip(b["text"], b["y"], b["fold"], strict=True):
                n, found = scanners[fold].segments(text)
                rows.append((y, n, max((s for *_, s in found), default=0.0)))
            yield pd.DataFrame(rows, columns=["y", "n", "best"])

    found = known.mapInPandas(best, "y int, n long, best double").toPandas()
    clean = found[(found["y"] == 0) & (found["n"] > 0)]
    lam, k = extreme_value_law(clean["n"].to_numpy().astype(float), clean["best"].to_numpy())

    def measure(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanners = [Scanner(Model(m.scores, lam, k, ())) for m in raw[1:]]
        for b in batches:
            x = [scanners[f].evidence_at(t, E_VALUES) for t, f in zip(b["text"], b["fold"], strict=True)]
            yield pd.DataFrame([[y, v[0], *v[1]] for y, v in zip(b["y"], x, strict=True)], columns=["y", "best", *levels])

    levels = [f"total{i}" for i in range(len(E_VALUES))]
    seen = known.mapInPandas(measure, "y int, best double, " + ", ".join(f"{c} double" for c in levels)).toPandas()
    y, found = seen["y"].to_numpy().astype(float), []
    for e, c in zip(E_VALUES, levels, strict=True):
        x = seen[["best", c]].to_numpy()
        w = fit_logistic(x, y)
        p = np.clip(apply_logistic(w, x), 1e-9, 1 - 1e-9)
        found.append((float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), e, tuple(w.tolist())))
    _, e_value, weights = max(found)
    return Model(scores[0], lam, k, weights, e_value)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, n_passages: for every row of docs, repeated ones included. Null text: empty; null ids stay null."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner, w = Scanner(model), np.array(model.weights)
        for b in batches:
            x = np.array([scanner.evidence(t) for t in b["text"]]).reshape(-1, 3)
            yield pd.DataFrame({"id": common.ids(b), "score": apply_logistic(w, x[:, :2]), "n_passages": x[:, 2].astype(int)})

    plain = docs.select(*common.id_columns(id_col), common.text_of(text_col).alias("text"))
    return plain.mapInPandas(run, "id long, score double, n_passages int")


def filter_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below the threshold, columns as they are; equal rows stay or go together."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, w = Scanner(model), np.array(model.weights)
        for b in batches:
            x = np.array([scanner.evidence(t or "")[:2] for t in b.column(text_col).to_pylist()]).reshape(-1, 2)
            yield b.filter(pa.array(apply_logistic(w, x) < threshold))

    return docs.mapInArrow(run, docs.schema)
