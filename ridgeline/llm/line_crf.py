"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .labelled import TRAIN_ROWS, logistic, probability, training_rows

#: Lines in a stretch of a training document.
STRETCH = 48
KINDS = 7


def _kinds() -> np.ndarray:
    """Byte -> kind: 1 lower-case letter, 2 upper-case, 3 digit, 4 symbol, 5 other punctuation, 6 part of another character, 0 white space."""
    t = np.zeros(256, np.int64)
    for b in range(33, 127):
        c = chr(b)
        t[b] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c in "#*$%&|<>" else 5
    t[128:] = 6
    return t


TABLE = _kinds()


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line, its weight in characters + 1). A null or empty text is one empty line.

    Shares of each kind of byte, words, distinct words, word length, words seen in the line
    before, whether an earlier line is equal; then the same of the lines before and after.
    """
    data = (text or "").encode("utf-8", "replace")
    lines = data.split(b"\n")
    sizes = np.array([len(x) for x in lines], np.int64)
    where = np.repeat(np.arange(len(lines)), sizes + 1)[: len(data)]
    counts = np.bincount(where * KINDS + TABLE[np.frombuffer(data, np.uint8)], minlength=len(lines) * KINDS).reshape(-1, KINDS).astype(float)
    own = np.empty((len(lines), 5))
    seen, before = set(), frozenset()
    for i, x in enumerate(lines):
        words = x.lower().split()
        distinct = frozenset(words)
        n = len(words)
        own[i] = (np.log1p(n), len(distinct) / n if n else 1.0, min(len(x) / n, 40.0) / 10 if n else 0.0, len(distinct & before) / len(distinct) if n else 0.0, x in seen and n > 0)
        seen.add(x)
        before = distinct
    visible = np.maximum(sizes - counts[:, 0], 1)
    f = np.column_stack([counts[:, 1:] / visible[:, None], own, sizes == 0])
    blank = np.zeros((1, f.shape[1]))
    return np.column_stack([np.ones(len(f)), f, np.vstack([blank, f[:-1]]), np.vstack([f[1:], blank])]), sizes + 1.0


@dataclass
class Crf:
    """Weights of the state "good" (bad is 0), the scores of staying bad and staying good, and the calibration of a document's mean."""

    weights: np.ndarray
    stay: tuple[float, float] = (0.0, 0.0)
    calibration: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    prior: float = 0.5

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """P(good) of each line, by forward and backward messages scaled to ratios."""
        good = np.exp(np.clip(x @ self.weights, -20, 20)).tolist()
        bb, gg = float(np.exp(self.stay[0])), float(np.exp(self.stay[1]))
        ahead, a = [], 1.0  # ratio good : bad of what came before
        for g in good:
            ahead.append(a)
            a = min(max(a * g, 1e-12), 1e12)
            a = (1 + a * gg) / (bb + a)
        out, b = np.empty(len(good)), 1.0
        for i in range(len(good) - 1, -1, -1):
            r = ahead[i] * good[i] * b
            out[i] = r / (1 + r)
            b = min(max(b * good[i], 1e-12), 1e12)
            b = (1 + gg * b) / (bb + b)
        return out

    def mean(self, text: str | None) -> np.ndarray:
        x, size = line_features(text)
        p = self.marginals(x)
        m = float((p * size).sum() / size.sum())
        return np.array([np.log((m + 1e-4) / (1 - m + 1e-4)), np.log(size.sum())])

    def score(self, text: str | None) -> float:
        return probability(self.mean(text), self.calibration) if self.calibration else self.prior


def fit(rows: list[tuple[str, int]], steps: int = 150, rate: float = 0.05, ridge: float = 2e-3) -> Crf:
    """Maximum likelihood by Adam over stretches of STRETCH lines, each line labelled as its document.

    All stretches of all texts count, those of a text with many the less. All are walked in step, line by line, as columns of a matrix. The scores of staying
    are held to 2 at most, as lines of a document never differ in label here. Without both labels
    the score is the share of label 1 (0.5 without a row).
    """
    y_all = np.array([y for _, y in rows], float)
    width = line_features("")[0].shape[1]
    if len(set(y_all.tolist())) < 2:
        return Crf(np.zeros(width), prior=float(y_all.mean()) if len(y_all) else 0.5)
    parts, ys, weight = [], [], []
    for text, y in rows:
        x, _ = line_features(text)
        at = range(0, len(x), STRETCH)
        for a in at:
            parts.append(x[a : a + STRETCH].astype(np.float32))
            ys.append(y)
            weight.append(len(at) ** -0.5)
    n, t = len(parts), max(map(len, parts))
    x, mask = np.zeros((n, t, width), np.float32), np.zeros((n, t))
    for i, p in enumerate(parts):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    y = np.array(ys, float)[:, None] * mask
    rare = mask * np.where(np.array(ys) == 1, 1.0, (y_all == 1).sum() / max(1, (y_all == 0).sum()) / 2)[:, None]
    rare = rare * np.array(weight)[:, None] / mask.sum(1, keepdims=True) ** 0.5
    flat = x.reshape(-1, width)
    theta, m1, m2 = np.zeros(width + 2), np.zeros(width + 2), np.zeros(width + 2)
    for step in range(1, steps + 1):
        g = np.exp(np.clip((flat @ theta[:width]).reshape(n, t), -20, 20))
        bb, gg = np.exp(theta[width:])
        fwd, bwd = np.ones((n, t)), np.ones((n, t))
        for i in range(1, t):
            a = np.clip(fwd[:, i - 1] * g[:, i - 1], 1e-12, 1e12)
            fwd[:, i] = (1 + a * gg) / (bb + a)
        for i in range(t - 2, -1, -1):
            b = np.clip(bwd[:, i + 1] * g[:, i + 1], 1e-12, 1e12)
            bwd[:, i] = np.where(mask[:, i + 1] > 0, (1 + gg * b) / (bb + b), 1.0)
        r = fwd * g * bwd
        p = r / (1 + r)
        a, b = fwd[:, :-1] * g[:, :-1], bwd[:, 1:] * g[:, 1:]
        both = mask[:, 1:] * np.sqrt(rare[:, 1:] * rare[:, :-1])
        z = bb + a + b + a * b * gg
        d = np.empty(width + 2)
        d[:width] = ((p - y) * rare).reshape(-1) @ flat / rare.sum()
        d[width] = (both * (bb / z - (1 - y[:, 1:]))).sum() / rare.sum()
        d[width + 1] = (both * (a * b * gg / z - y[:, 1:])).sum() / rare.sum()
        d += ridge * theta
        m1, m2 = 0.9 * m1 + 0.1 * d, 0.999 * m2 + 0.001 * d * d
        theta -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        theta[width:] = np.clip(theta[width:], 0, 2)
    crf = Crf(theta[:width], (float(theta[width]), float(theta[width + 1])), prior=float(y_all.mean()))
    crf.calibration = logistic(np.array([crf.mean(t) for t, _ in rows]), y_all)
    return crf


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Crf:
    """A model from labelled rows that are not held out. Repeated documents and labels count once; with several labels or texts, a doc_id has all of them."""
    return fit(training_rows(docs, labels, "quality", rows))


def scored(docs: DataFrame, crf: Crf, threshold: float = 0.3) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score, predicted (1 from the threshold on); one row for each row of docs.

    Null and empty texts are one empty line and get its score. Repeated rows score alike, other
    columns change nothing, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [crf.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], ["doc_id", "score", "predicted"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")
