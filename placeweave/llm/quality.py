"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad; the features of a line are its own character and word shares
and those of the lines before and after it. Forward-backward gives each line's marginal probability
of being good; the mean weighted by line length is calibrated to the document's probability.

Only documents carry labels, so in training all lines of a document have its label: the learned
moves say little more than "stay", and a line's own label is as good as its document's was.

The model is fitted on the driver from a bounded sample: at most MAX_LABELLED documents (by a hash
of the id; an id that repeats counts once, with the least of its texts), all lines of each. Scoring
takes all lines of every text. Null and empty texts are one empty line. Rows that repeat, also
whole, are scored one by one and alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .calibrate import apply_logistic, fit_logistic

MAX_LABELLED = 4_000
#: Training steps, their rate, and the weight of the squared parameters.
STEPS, RATE, RIDGE = 150, 0.1, 1e-4

# Character classes of a line.
CLASSES = ("lower", "upper", "digit", "space", "stop", "bang", "bar", "symbol", "other")
LOWER, UPPER, DIGIT, SPACE, STOP, BANG, BAR, SYMBOL, OTHER = range(9)


def _classes() -> np.ndarray:
    out = np.full(0x3000, OTHER, dtype=np.uint8)
    for c in range(0x3000):
        s = chr(c)
        if s.islower():
            out[c] = LOWER
        elif s.isupper():
            out[c] = UPPER
        elif s.isdigit():
            out[c] = DIGIT
        elif s.isspace():
            out[c] = SPACE
        elif s in ".,;:?'\"()-":
            out[c] = STOP
        elif s == "!":
            out[c] = BANG
        elif s == "|":
            out[c] = BAR
        elif s in "#$%&*@^~=+_<>/\\{}[]`":
            out[c] = SYMBOL
    return out


TABLE = _classes()
WORD = re.compile(r"\S+")
OWN = len(CLASSES) + 7
FEATURES = 3 * OWN + 3


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """[line, FEATURES] with both neighbours' features, and the lines' lengths."""
    lines = text.split("\n")
    n = len(lines)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = TABLE[np.minimum(codes, len(TABLE) - 1)].astype(np.int64)
    breaks = codes == 10
    of = np.cumsum(breaks) - breaks
    counts = np.bincount((of * len(CLASSES) + kinds)[~breaks], minlength=n * len(CLASSES)).reshape(n, len(CLASSES)).astype(np.float64)
    lengths = counts.sum(axis=1)
    own = np.zeros((n, OWN))
    own[:, : len(CLASSES)] = counts / np.maximum(1.0, lengths)[:, None]
    seen: set[str] = set()
    extra = np.empty((n, 7))
    for i, line in enumerate(lines):
        words = line.split()
        k = len(words)
        chars = max(1, len(line))
        extra[i] = (
            min(1.0, chars / 400), np.log1p(k) / 6, min(2.0, (chars - k) / max(1, k) / 8), len(set(words)) / max(1, k),
            line in seen, line[-1:] in ".?!", k <= 3,
        )
        if k:
            seen.add(line)
    own[:, len(CLASSES) :] = extra
    x = np.zeros((n, FEATURES))
    x[:, :OWN] = own
    x[1:, OWN : 2 * OWN] = own[:-1]
    x[:-1, 2 * OWN : 3 * OWN] = own[1:]
    x[0, 3 * OWN] = x[-1, 3 * OWN + 1] = x[:, 3 * OWN + 2] = 1.0
    return x, np.maximum(1.0, lengths)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # [FEATURES, 2]: bad, good
    moves: np.ndarray  # [from, to]
    calibration: np.ndarray


def marginals(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(good) of each line of one document, scores [line, 2]."""
    n = len(scores)
    m = np.exp(moves)
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    f, b = np.empty((n, 2)), np.ones((n, 2))
    f[0] = e[0] / e[0].sum()
    (m00, m01), (m10, m11) = m.tolist()
    ef, p, q = e.tolist(), *f[0].tolist()
    for i in range(1, n):
        x, y = (p * m00 + q * m10) * ef[i][0], (p * m01 + q * m11) * ef[i][1]
        p, q = x / (x + y), y / (x + y)
        f[i, 0], f[i, 1] = p, q
    p = q = 1.0
    for i in range(n - 2, -1, -1):
        u, v = ef[i + 1][0] * p, ef[i + 1][1] * q
        x, y = m00 * u + m01 * v, m10 * u + m11 * v
        p, q = x / (x + y), y / (x + y)
        b[i, 0], b[i, 1] = p, q
    both = f * b
    return both[:, 1] / both.sum(axis=1)


def document_signal(text: str, model: Model) -> float:
    """Length-weighted mean of the lines' good marginals, as log-odds."""
    x, lengths = line_features(text)
    p = marginals(x @ model.weights, model.moves)
    mean = float((p * lengths).sum() / lengths.sum())
    mean = min(1 - 1e-6, max(1e-6, mean))
    return float(np.log(mean / (1 - mean)))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices, [4, n] row by row, scaled so that none grows or vanishes."""
    out = np.stack([a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]])
    return out / out.sum(axis=0)


def chains(scores: np.ndarray, moves: np.ndarray, place: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P of each label of each line, and of each pair of labels with the line before it, for many documents at once.

    Lines lie one after another, place counts from each document's start and left to its end. The
    messages are running products of 2 x 2 matrices, found by doubling: a step for each bit of the
    longest document's number of lines, over the lines that reach so far only.
    """
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).T
    m = np.exp(moves - moves.max())
    step = np.stack([m[0, 0] * e[0], m[0, 1] * e[1], m[1, 0] * e[0], m[1, 1] * e[1]])
    first = place == 0
    front = np.where(first, np.stack([e[0], e[1], e[0], e[1]]), step)
    front /= front.sum(axis=0)
    back = np.zeros_like(front)
    back[0] = back[3] = 0.5
    inner = np.flatnonzero(left > 0)
    back[:, inner] = step[:, inner + 1] / step[:, inner + 1].sum(axis=0)
    d = 1
    while (far := np.flatnonzero(place >= d)).size:
        front[:, far] = _times(front[:, far - d], front[:, far])
        d *= 2
    d = 1
    while (far := np.flatnonzero(left >= d)).size:
        back[:, far] = _times(back[:, far], back[:, far + d])
        d *= 2
    f, b = front[:2], np.stack([back[0] + back[1], back[2] + back[3]])
    own = f * b
    later = np.flatnonzero(~first)
    pair = np.stack([f[x, later - 1] * step[2 * x + y, later] * b[y, later] for x in (0, 1) for y in (0, 1)])
    return (own / own.sum(axis=0)).T, (pair / pair.sum(axis=0)).T


def train(docs: list[np.ndarray], labels: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Maximum conditional likelihood (Adam, full batch) over all lines of the documents."""
    lines = np.array([len(d) for d in docs])
    x, of = np.concatenate(docs).astype(np.float32), np.repeat(np.arange(len(docs)), lines)
    place = np.arange(len(of)) - np.repeat(np.cumsum(lines) - lines, lines)
    left = np.repeat(lines, lines) - 1 - place
    # Both labels weigh the same, whatever their shares, and so do documents of a label.
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) / lines
    weight, gold = share[of], labels[of]
    target = np.eye(2)[gold]
    later = place > 0
    pair_target, pair_weight = np.eye(4)[3 * gold[later]], weight[later]
    w, t = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for step in range(1, steps + 1):
        p, pair = chains(x @ w.astype(np.float32), t, place, left)
        gw = x.T @ ((target - p) * weight[:, None]).astype(np.float32) - RIDGE * w
        gt = ((pair_target - pair) * pair_weight[:, None]).sum(axis=0).reshape(2, 2) - RIDGE * t
        for k, (v, g) in enumerate(((w, gw), (t, gt))):
            m1, m2 = state[2 * k], state[2 * k + 1]
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            v += RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return w, t


def fit(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """docs holds the texts, sample (id, y) the bounded labelled rows."""
    common.bound_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text"))
    # One text for each sampled id, so that no more than the sample's rows are ever gathered.
    known = common.materialise(plain.join(F.broadcast(sample), "id").groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text")), "labelled")

    def features(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "x": [line_features(t)[0].astype("<f4").tobytes() for t in b["text"]]})

    seen = known.mapInPandas(features, "id long, y int, x binary").toPandas().sort_values("id", kind="stable")
    y = seen["y"].to_numpy().astype(np.int64)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.array([0.0, 8.0 if len(y) == 0 or y[0] else -8.0]))
    x = [np.frombuffer(b, "<f4").reshape(-1, FEATURES) for b in seen["x"]]
    w, t = train(x, y)
    raw = Model(w, t, np.array([1.0, 0.0]))

    def signals(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "signal": [document_signal(text, raw) for text in b["text"]]})

    found = known.mapInPandas(signals, "y int, signal double").toPandas()
    return Model(w, t, fit_logistic(found[["signal"]].to_numpy(), found["y"].to_numpy().astype(float), ridge=0.5))


def label_lines(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line (from 0), start (its first code point), length, p_good, good: for every line of every row."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, text in enumerate(b["text"]):
                x, _ = line_features(text)
                p = marginals(x @ model.weights, model.moves)
                size = np.array([len(line) for line in text.split("\n")])
                own = common.ids(b.iloc[[i] * len(p)])
                yield pd.DataFrame({"id": own, "line": range(len(p)), "start": np.cumsum(size + 1) - size - 1, "length": size, "p_good": p, "good": p >= 0.5})

    plain = docs.select(*common.id_columns(id_col), common.text_of(text_col).alias("text"))
    return plain.mapInPandas(run, "id long, line int, start long, length long, p_good double, good boolean")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score: for every row of docs, repeated ones included. Null text: empty; null ids stay null."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([[document_signal(t, model)] for t in b["text"]]).reshape(-1, 1)
            yield pd.DataFrame({"id": common.ids(b), "score": apply_logistic(model.calibration, x)})

    plain = docs.select(*common.id_columns(id_col), common.text_of(text_col).alias("text"))
    return plain.mapInPandas(run, "id long, score double")


def filter_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score reaches the threshold, columns as they are; equal rows stay or go together."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([[document_signal(t or "", model)] for t in b.column(text_col).to_pylist()]).reshape(-1, 1)
            yield b.filter(pa.array(apply_logistic(model.calibration, x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
