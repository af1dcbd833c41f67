"""Toxicity by compression distance: two Zstandard dictionaries, one of toxic and one of ordinary text."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .labelled import TRAIN_ROWS, logistic, probability, training_rows

#: Sizes of the toxic dictionary to choose from, windows that a worker remembers and bytes of the longest.
TOXIC_BYTES, REMEMBERED, REMEMBERED_BYTES = (128, 256, 512, 1024, 2048), 1 << 17, 64

#: Ends both dictionaries and follows every window: Zstandard looks for no match in the last bytes, and stores what is shorter than a block's cost as it is.
CARRIER = bytes(range(1, 33))
#: Around each window, there and in the dictionaries: a part of a word is no whole word.
OPEN, CLOSE = b"((<", b">))"

#: Byte -> byte: ASCII letters and the bytes of other characters stay, all else separates words.
SEPARATE = bytes(b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def windows(text: str | None) -> list[bytes]:
    """The words of the whole text in lower case, without ASCII punctuation and digits; each is a window of its own."""
    return (text or "").lower().encode("utf-8", "replace").translate(SEPARATE).split()


#: How often each byte of a window is written: a short word that is stored as it is must cost more than a match.
SPELLED = 2


def _bounded(w: bytes) -> bytes:
    return OPEN + bytes(c for c in w for _ in range(SPELLED)) + CLOSE


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Small windows need short matches, the longest of them, and no header fields that only cost."""
    log = max(10, (len(dictionary) + len(CARRIER)).bit_length() + 1)
    params = zstandard.ZstdCompressionParameters(window_log=log, hash_log=log, chain_log=log, search_log=6, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
    d = zstandard.ZstdCompressionDict(dictionary + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


def length_with(dictionary: bytes) -> Callable[[bytes], int]:
    """Window -> its compressed length with this dictionary."""
    compress = _compressor(dictionary).compress
    return lambda w: len(compress(_bounded(w) + CARRIER))


def ordinary_dictionary(texts: list[str]) -> bytes:
    """All windows of the ordinary texts, each once, those of more texts nearer to the end."""
    seen = Counter(w for t in texts for w in set(windows(t)))
    return b"".join(_bounded(w) for w, _ in sorted(seen.items(), key=lambda x: (x[1], x[0])))


def toxic_dictionary(texts: list[str], ordinary: Callable[[bytes], int], size: int, least: int = 3) -> bytes:
    """Windows of the toxic texts by what a dictionary with them saves over the ordinary one, in bytes over all the texts that have them.

    What the ordinary dictionary compresses well is not worth a place, and neither is what is in
    under `least` texts (under all if there are fewer).
    """
    seen = Counter(w for t in texts for w in set(windows(t)))
    gain = {w: n * (ordinary(w) - WHOLE) for w, n in seen.items() if n >= min(least, len(texts))}
    return _joined([w for w in sorted(gain, key=lambda w: (-gain[w], w)) if gain[w] > 0], size)


def _joined(best_first: list[bytes], size: int) -> bytes:
    """As many of the windows as `size` bytes hold, the best last, nearest to what is compressed."""
    each = list(map(_bounded, best_first))
    ends = list(accumulate(map(len, each)))
    return b"".join(each[: bisect_right(ends, size)][::-1])


#: Length of a window that a toxic dictionary of the largest size has as a whole, at its far end.
WHOLE = length_with(_bounded(bytes(range(160, 168))) + np.random.default_rng(0).integers(33, 65, TOXIC_BYTES[-1], np.uint8).tobytes())(bytes(range(160, 168)))


class _Lengths(dict):
    """Window -> (length with the toxic dictionary, bytes that this saves against the ordinary one); emptied when full."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.toxic, self.ordinary = length_with(toxic), length_with(ordinary)

    def __missing__(self, w: bytes) -> tuple[int, int]:
        n = self.toxic(w)
        found = n, self.ordinary(w) - n
        if len(w) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[w] = found
        return found


@dataclass
class Model:
    """The two dictionaries, the calibrated thresholds of a toxic window (length at most, saving at least), and the calibration of scores."""

    toxic: bytes = b""
    ordinary: bytes = b""
    longest: int = WHOLE
    saving: int = 1
    calibration: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    prior: float = 0.5

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_lengths"}

    def lengths(self, text: str | None) -> list[tuple[int, int]]:
        if "_lengths" not in self.__dict__:
            self._lengths = _Lengths(self.toxic, self.ordinary)
        return [self._lengths[w] for w in windows(text)]

    def features(self, text: str | None) -> np.ndarray:
        each = self.lengths(text)
        hits = sum(saved >= self.saving and n <= self.longest for n, saved in each)
        return np.array([hits > 0, math.log1p(hits), hits / max(len(each), 1) ** 0.5], float)

    def score(self, text: str | None) -> float:
        return probability(self.features(text), self.calibration) if self.calibration else self.prior


def fit(rows: list[tuple[str, int]], seed: int = 3) -> Model:
    """Dictionaries, thresholds and calibration from (text, toxic).

    The ordinary dictionary is trained on all texts with label 0, the toxic one on all with label
    1. Its size and the thresholds are those with the best F1 where dictionaries of one half of
    the texts judge the other half, so what only a few texts share does not count. Without both
    labels the score is the share of label 1 (0.5 without a row).
    """
    y = np.array([y for _, y in rows], float)
    if len(set(y.tolist())) < 2:
        return Model(prior=float(y.mean()) if len(y) else 0.5)
    order = np.random.default_rng(seed).permutation(len(rows))
    of = lambda k, label: [rows[i][0] for i in k if rows[i][1] == label]
    size, longest, saving = TOXIC_BYTES[-1], WHOLE, 2
    a, b = order[::2], order[1::2]
    if of(a, 1) and of(b, 1):
        found: dict[tuple[int, int, int], np.ndarray] = {}
        for learn, judge in (a, b), (b, a):
            cost = length_with(ordinary_dictionary(of(learn, 0)))
            sets = [set(windows(rows[i][0])) for i in judge]
            usual = {w: cost(w) for w in set().union(*sets)}
            for k in TOXIC_BYTES:
                toxic = length_with(toxic_dictionary(of(learn, 1), cost, k))
                short = {w: (n, usual[w] - n) for w in usual if (n := toxic(w)) < WHOLE + 4}
                each = [{short[w] for w in ws if w in short} for ws in sets]
                for most in range(WHOLE, WHOLE + 4):
                    top = np.array([max((saved for n, saved in e if n <= most), default=0) for e in each])
                    for least in range(1, 8):
                        hit = top >= least
                        found[k, most, least] = found.get((k, most, least), np.zeros(2)) + [(hit & (y[judge] == 1)).sum(), hit.sum()]
        f1 = {choice: 2 * right / (hits + y.sum()) for choice, (right, hits) in found.items()}
        size, longest, saving = min(f1, key=lambda c: (-f1[c], c))
    ordinary = ordinary_dictionary(of(order, 0))
    model = Model(toxic_dictionary(of(order, 1), length_with(ordinary), size), ordinary, longest, saving, prior=float(y.mean()))
    model.calibration = logistic(np.array([model.features(t) for t, _ in rows]), y)
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from labelled rows that are not held out. Repeated documents and labels count once; with several labels or texts, a doc_id has all of them."""
    return fit(training_rows(docs, labels, "toxic", rows))


def scored(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score, predicted (1 from the threshold on); one row for each row.

    Null and empty texts score low. Repeated rows, rows without doc_id and an empty table are as they are; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], ["doc_id", "score", "predicted"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")
