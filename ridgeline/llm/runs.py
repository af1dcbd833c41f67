"""Runs of words that repeat with a period, by the branching-tandem test over an enhanced suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Words of the shortest run that counts.
LEAST = 12
RUNS = "array<struct<start long, length long, period long>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def suffix_array(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, classes) of several documents laid end to end; words and doc have a number for each word.

    Suffixes are sorted by their document first, so no comparison leaves it. classes[l] says which
    stretches of 2**l words of a document are equal; a place past the end is equal to none. By
    prefix doubling; what is told apart is not sorted again.
    """
    n = len(words)
    key = doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    sa = np.argsort(key, kind="stable")
    end = np.searchsorted(doc, doc, side="right")
    rank, place = np.full(n + 1, -1, np.int32), np.arange(n)
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    rank[sa] = np.maximum.accumulate(np.where(new, place, 0))
    classes, step, open_ = [rank], 1, place
    while len(open_):
        alone = new & np.append(new[1:], True)
        open_, new = open_[~alone], new[~alone]
        if not len(open_):
            break
        at = sa[open_]
        first, second = rank[at], np.where(at + step < end[at], rank[np.minimum(at + step, n)], -1)
        by = np.lexsort((second, first))
        at, first, second = at[by], first[by], second[by]
        sa[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        classes.append(rank)
        step *= 2
    return sa, classes


def _common(classes: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words on from i and from j are equal, i and j apart and of one document."""
    far, n = np.zeros(len(i), np.int64), len(classes[0]) - 1
    for level in range(len(classes) - 1, -1, -1):
        far += np.where(classes[level][np.minimum(i + far, n)] == classes[level][np.minimum(j + far, n)], 1 << level, 0)
    return far


def _common_before(classes: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i and before j are equal, i < j and of one document."""
    far = np.zeros(len(i), np.int64)
    for level in range(len(classes) - 1, -1, -1):
        a, b = i - far - (1 << level), j - far - (1 << level)
        far += np.where((a >= 0) & (classes[level][np.maximum(a, 0)] == classes[level][np.maximum(b, 0)]), 1 << level, 0)
    return far


def _last_below(lcp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place in `at` the last one before it with a smaller value; lcp[0] is below all. Places skip what others have skipped."""
    to = np.arange(-1, len(lcp) - 1)
    while len(at):
        at = at[lcp[to[at]] >= lcp[at]]
        to[at] = to[to[at]]
    return to


def squares(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(start, period) of each branching square, two equal stretches of which the word after does not go on, and suffix_array()'s classes.

    A square of period d branches where its two halves lie in different children of the LCP
    interval of depth d. So of each interval all suffixes but those of its largest child look for
    the suffixes d words on and d words before, by the inverse suffix array. Intervals are pairs of
    places in the LCP array; no tree is built. Children halve, so this is n log n looks at most.
    """
    n = len(words)
    sa, classes = suffix_array(words, doc)
    isa = np.empty(n + 1, np.int64)
    isa[sa], isa[n] = np.arange(n), -1
    lcp = np.full(n + 1, -1, np.int64)
    near = np.flatnonzero(classes[0][sa[1:]] == classes[0][sa[:-1]]) + 1
    lcp[1:n] = 0
    lcp[near] = _common(classes, sa[near - 1], sa[near])
    if not len(near):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), classes
    lo, hi = _last_below(lcp, near), n - 1 - _last_below(lcp[::-1], n - near)[::-1]
    lo, hi, depth = lo[near], hi[near], lcp[near]
    by = np.lexsort((near, depth, lo))  # the borders of an interval's children, one interval after the other
    near, lo, hi, depth = near[by], lo[by], hi[by], depth[by]
    head = np.ones(len(near), bool)
    head[1:] = (lo[1:] != lo[:-1]) | (depth[1:] != depth[:-1])
    one = np.flatnonzero(head)  # a child before each border, and one after the last of each interval
    begin = np.concatenate([np.where(head, lo, np.roll(near, 1)), near[np.append(one[1:], len(near)) - 1]])
    stop = np.concatenate([near, hi[one] + 1])
    of = np.concatenate([np.cumsum(head) - 1, np.arange(len(one))])
    size = stop - begin
    largest = np.zeros(len(one), np.int64)
    np.maximum.at(largest, of, size)
    is_largest = size == largest[of]
    first = np.full(len(one), len(of))
    np.minimum.at(first, of[is_largest], np.flatnonzero(is_largest))
    small = np.ones(len(of), bool)
    small[first] = False
    begin, stop, of, size = begin[small], stop[small], of[small], size[small]
    lo, hi, depth = lo[one], hi[one], depth[one]
    child = np.repeat(np.arange(len(of)), size)
    rows = np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size) + begin[child]
    i, v = sa[rows], of[child]
    d, out = depth[v], []
    for j in (i + d, i - d):
        there = isa[np.where((j >= 0) & (j < n), j, n)]
        hit = (there >= lo[v]) & (there <= hi[v]) & ((there < begin[child]) | (there >= stop[child]))
        out.append(np.stack([np.minimum(i, j)[hit], d[hit]]))
    found = np.unique(np.hstack(out), axis=1)
    return found[0], found[1], classes


def runs(words: np.ndarray, doc: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Columns start, length, period of the runs of all documents, sorted; places count through all documents.

    A branching square is the last of its run. Rotated to the left as far as words agree it gives the
    run's start. What has a multiple of the smallest period has the same ends, and merges.
    """
    i, d, classes = squares(words, doc)
    start = i - _common_before(classes, i, i + d)
    length = i + 2 * d - start
    long = length >= least
    start, length, d = start[long], length[long], d[long]
    by = np.lexsort((d, length, start))
    start, length, d = start[by], length[by], d[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    out = np.stack([start[new], length[new], d[new]], 1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _found(texts: list[str | None], least: int) -> Iterator[tuple[int, list[dict], str]]:
    """Number of words, runs and what is left of each text."""
    split = [(t or "").encode("utf-8", "replace").split() for t in texts]
    known: dict[bytes, int] = {}
    words = np.array([known.setdefault(w, len(known)) for ws in split for w in ws], np.int64)
    ends = np.cumsum([len(ws) for ws in split])
    doc = np.repeat(np.arange(len(split)), [len(ws) for ws in split])
    all_ = runs(words, doc, least)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, all_[:, 0] + all_[:, 2], 1)
    np.add.at(change, all_[:, 0] + all_[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    cut = np.searchsorted(all_[:, 0], ends)
    for k, ws in enumerate(split):
        base, own = ends[k] - len(ws), all_[cut[k - 1] if k else 0 : cut[k]]
        left = kept[base : ends[k]]
        yield len(ws), [dict(zip(("start", "length", "period"), (s - base, n, p), strict=True)) for s, n, p in own.tolist()], b" ".join(ws if left.all() else [w for w, x in zip(ws, left.tolist(), strict=True) if x]).decode()


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, runs, collapsed), one row for each row of docs.

    Words are stretches without ASCII white space, compared as they are. A run is a stretch of at
    least `least` words, and of two periods, in which words a period apart are equal and which no
    neighbour extends; period is its smallest, start counts words from 0, and runs are sorted by
    start, then period. collapsed has the words that no run contains after its first period, joined by
    one space. Null and empty texts have no runs and collapse to the empty text; rows without
    doc_id and repeated rows stay; further columns are ignored. Memory grows with the longest text,
    by about 200 bytes a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, found, left = zip(*_found(b.column(1).to_pylist(), least), strict=True) if len(b) else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(found, _RUN), pa.array(left, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")
