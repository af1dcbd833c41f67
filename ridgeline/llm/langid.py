"""Language identification: averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, bucket_of, small_batches

BUCKETS, DIMENSIONS, SLICE = 1 << 16, 16, 1 << 20
#: Rows at most that a model is fitted on.
TRAIN_ROWS = 3000
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")

#: Byte -> byte: ASCII letters in lower case, other ASCII as a space, the bytes of all other characters as they are.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def subwords(data: bytes) -> Iterator[np.ndarray]:
    """Buckets of the byte n-grams, n = 3 and 4, of a text between spaces; long texts come in slices, none left out."""
    b = np.frombuffer(b" " + data.translate(FOLD) + b" ", np.uint8).astype(np.uint32)
    for at in range(0, max(1, len(b) - 2), SLICE):
        s = b[at : at + SLICE + 3]
        h = s[:-2] * np.uint32(0x9E3779B1) ^ s[1:-1] * np.uint32(0x85EBCA77) ^ s[2:] * np.uint32(0xC2B2AE3D)
        h = h[:SLICE]
        yield (h * np.uint32(0x27D4EB2F)) >> np.uint32(16)
        if len(s) > 3:
            g = (h[: len(s) - 3] ^ s[3:][: len(h)] * np.uint32(0x165667B1))[:SLICE]
            yield (g * np.uint32(0x2545F491)) >> np.uint32(16)


@dataclass
class Model:
    """Class scores of each bucket (embedding times softmax weights), the bias, the temperature and the rejection threshold."""

    classes: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.classes)), 0
        for h in subwords(text.encode("utf-8", "replace")):
            total += self.scores[h].sum(0, dtype=np.float64)
            n += len(h)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether that is under the rejection threshold."""
        if not self.classes or not text or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.classes[k], float(p[k]), bool(p[k] < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit(texts: list[str], langs: list[str], epochs: int = 2, rate: float = 0.5, stretch: int = 400, reject: float = 0.01, seed: int = 7) -> Model:
    """Stochastic gradient descent over all stretches of the texts, of `stretch` bytes each; a tenth of the texts sets temperature and threshold.

    The threshold is the `reject` quantile of the probabilities of right answers. Texts without a
    letter teach nothing; with no text left the model has no class.
    """
    rows = [(t, y) for t, y in zip(texts, langs, strict=True) if t and LETTER.search(t)]
    classes = sorted({y for _, y in rows})
    rng = np.random.default_rng(seed)
    if not rows:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    order = rng.permutation(len(rows))
    held = [rows[i] for i in order[: len(rows) // 10]]
    parts = []
    for i in order[len(rows) // 10 :]:
        data, y = rows[i][0].encode("utf-8", "replace"), classes.index(rows[i][1])
        pieces = [data[a : a + stretch] for a in range(0, len(data), stretch)]
        parts += [(np.concatenate(list(subwords(p))), y) for p in pieces]
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w, bias = np.zeros((DIMENSIONS, len(classes))), np.zeros(len(classes))
    steps = epochs * len(parts)
    for step, k in enumerate(np.concatenate([rng.permutation(len(parts)) for _ in range(epochs)]) if parts else []):
        h, y = parts[k]
        r = rate * (1 - step / steps)
        e = emb[h].mean(0)
        g = softmax(e @ w + bias)
        g[y] -= 1
        down = w @ g
        w -= r * np.outer(e, g)
        bias -= 0.1 * r * g
        np.subtract.at(emb, h, (r * 4 * down / len(h) ** 0.5).astype(np.float32))
    model = Model(classes, (emb @ w).astype(np.float32), bias)
    check = [(model.logits(t), classes.index(y)) for t, y in held]
    if check:
        loss = lambda t: -np.mean([np.log(softmax(z / t)[y] + 1e-12) for z, y in check])
        model.temperature = float(min(np.geomspace(0.02, 20, 40), key=loss))
        right = [p[y] for p, y in ((softmax(z / model.temperature), y) for z, y in check) if p.argmax() == y]
        model.threshold = float(np.quantile(right, reject)) if right else 0.0
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score, rejected; one row for each row.

    Null texts and texts without a letter are `und`, score 0 and rejected. Repeated rows, rows
    without doc_id and an empty table are as they are; further columns are ignored. The model, of
    fixed size, goes to the executors with the function.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, no = zip(*map(model.predict, b.column(1).to_pylist()), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(no, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    return bucket_of(doc_id, 3) == 1


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on about `rows` rows at most, picked by a hash of doc_id, of those with a lang that are not held out; a repeated row counts as often as it occurs."""
    chosen = bounded_sample(docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"), "doc_id", rows)
    found = sorted(((r["doc_id"], r["lang"], r["text"]) for r in chosen.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    return fit([r[2] for r in found], [r[1] for r in found])
