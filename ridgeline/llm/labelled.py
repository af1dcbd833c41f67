"""What the document classifiers share: the split, the training rows and a logistic calibration."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, bucket_of, staged

#: Labelled rows at most that a classifier is fitted on.
TRAIN_ROWS = 4000


def held_out(doc_id: Column) -> Column:
    return bucket_of(doc_id, 5) == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> list[tuple[str, int]]:
    """(text, label) of about `rows` labelled rows at most that are not held out, one for each family of copies.

    The labels are sampled first, by a hash of doc_id, so the join has a side of bounded size.
    Of texts whose least hash over four-word shingles is equal, the first by doc_id stays: copies
    would otherwise weigh as often as they occur.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    chosen = staged(bounded_sample(known.select("doc_id", F.col(label).cast("int").alias("y")), "doc_id", rows).distinct())
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").collect()
    families, out = set(), []
    for r in sorted(found, key=lambda r: (r["doc_id"], r["y"], r["text"])):
        w = r["text"].encode("utf-8", "replace").split()
        sign = min((xxhash.xxh64_intdigest(b" ".join(w[i : i + 4])) for i in range(max(1, len(w) - 3))))
        if sign not in families:
            families.add(sign)
            out.append((r["text"], r["y"]))
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, bias first; mean; deviation) of a logistic regression on standardised columns, by Newton's method."""
    mean, dev = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.column_stack([np.ones(len(x)), (x - mean) / dev])
    w = np.zeros(z.shape[1])
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * len(x) * np.eye(len(w))
        w = w - np.linalg.solve(h, z.T @ (p - y) + ridge * len(x) * w)
    return w, mean, dev


def probability(x: np.ndarray, fitted: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    w, mean, dev = fitted
    return float(1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / dev) @ w[1:], -30, 30))))
