"""Repeated passages across documents, found by recompression and removed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, in_worker, small_batches, staged
from .hashing import BASES, joined, mix, window_digests, word_digests

WINDOW = 50
#: The rounds, one Spark job each, and what they name in turn: "runs" of equal symbols, and "pairs" of a left and a right symbol.
ROUNDS = (("runs", "pairs", "pairs", "pairs"), ("runs", "pairs", "pairs", "pairs"), ("runs", "pairs", "pairs", "pairs"))


@dataclass
class Level:
    """The symbols that some steps have left of the documents of a batch, side by side, at positions counted in words over the batch.

    A symbol's start is decided by what follows and by nothing before the position `left`; its end
    by nothing from the position `right` on. So a window holds the symbol, whatever is around the
    window, if it starts at `left` at the latest and ends at `right` at the earliest.
    """

    sym: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray
    doc: np.ndarray

    def step(self, kind: str, salt: int, begins: np.ndarray, never: int) -> Level:
        """The next level. begins: where each document starts; never: a position after all windows."""
        n = len(self.sym)
        if n == 0:
            return self
        near = np.zeros(n, bool)  # whether the next symbol is of the same document
        near[:-1] = self.doc[1:] == self.doc[:-1]
        after = np.concatenate([near[-1:], near[:-1]])
        wider = np.where(after, np.roll(self.left, 1), begins[self.doc] - 1)
        later = np.where(near, np.roll(self.right, -1), never)
        if kind == "runs":
            same = near & (self.sym == np.roll(self.sym, -1))
            first = np.flatnonzero(~np.concatenate([[False], same[:-1]]))
            last = np.flatnonzero(~same)
            size = (last - first + 1).astype(np.uint64)
            named = np.where(size == 1, self.sym[first], joined(self.sym[first], size + np.uint64(salt << 32)))
            return Level(named, self.at[first], wider[first], later[last], self.doc[first])
        opens = (mix(self.sym + np.uint64(salt + 1)) >> np.uint64(63)).astype(bool)  # left symbols; the others are right
        left, right = np.where(opens, self.left, wider), np.where(opens, later, self.right)
        pair = np.flatnonzero(near & opens & ~np.roll(opens, -1))
        sym = self.sym.copy()
        sym[pair] = joined(self.sym[pair] + np.uint64(salt), self.sym[pair + 1])
        right[pair] = right[pair + 1]
        keep = np.ones(n, bool)
        keep[pair + 1] = False
        return Level(sym[keep], self.at[keep], left[keep], right[keep], self.doc[keep])

    def inside(self, starts: np.ndarray, window: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For windows of a batch of n words: the first symbol that each holds, and whether there is one."""
        if not len(self.sym):
            return np.zeros(len(starts), np.int64), np.zeros(len(starts), bool)
        i = np.cumsum(np.bincount(self.left + 1, minlength=n + 2))[starts]
        there = i < len(self.sym)
        i = np.where(there, i, 0)
        return i, there & (self.right[i] <= starts + window)


def _steps(level: Level, kinds: tuple[str, ...], salt: int, sizes: np.ndarray, window: int, final: bool) -> tuple[Level, np.ndarray, np.ndarray, np.ndarray]:
    """(next level, windows' starts, keys) after these steps: of the windows that hold a symbol now and none afterwards
    (all of the final round), with the first symbol of the last level where they hold one; and the document of each."""
    ends = np.cumsum(sizes)
    n, begins = int(ends[-1]) if len(ends) else 0, ends - sizes
    room = np.maximum(sizes - window + 1, 0)
    starts = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + np.repeat(begins, room)
    doc = np.repeat(np.arange(len(sizes)), room)
    i, alive = level.inside(starts, window, n)
    key, some = np.zeros(len(starts), np.uint64), alive
    if alive.any():
        key[alive] = level.sym[i[alive]]
    for k, kind in enumerate(kinds):
        level = level.step(kind, salt + k, begins, n + window)
        i, alive = level.inside(starts, window, n)
        if alive.any():
            key[alive] = level.sym[i[alive]]
    out = some if final else some & ~alive
    return level, starts[out], key[out], doc[out]


def word_level(sizes: np.ndarray, words: np.ndarray) -> Level:
    """Words as symbols."""
    at = np.arange(len(words))
    return Level(words, at, at.copy(), at + 1, np.repeat(np.arange(len(sizes)), sizes))


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _lists(owner: np.ndarray, rows: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Lists of the values of each of `rows` owners; owner is in order."""
    ends = np.searchsorted(owner, np.arange(rows), side="right")
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, kind))


SYMBOLS = "doc_id long, n long, h1 long, h2 long, sym array<long>, size array<int>, lead array<int>, trail array<int>, keys array<long>, first array<int>, last array<int>"
KEYS = ("doc_id", "h1", "h2", "keys", "first", "last")


def _found(doc_id: pa.Array, sizes: np.ndarray, h: np.ndarray, level: Level, starts: np.ndarray, keys: np.ndarray, doc: np.ndarray, final: bool) -> pa.RecordBatch:
    """Rows of SYMBOLS: the level, unless it was the final round, and the keys, each with a stretch of window starts."""
    rows, begins = len(sizes), np.cumsum(sizes) - sizes
    cut = np.ones(len(starts), bool)
    cut[1:] = (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1] + 1) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(cut)
    tail = np.concatenate([head[1:], [len(starts)]])[: len(head)] - 1
    if final:
        level = Level(*(x[:0] for x in (level.sym, level.at, level.left, level.right, level.doc)))
    end = np.where(np.concatenate([level.doc[1:] == level.doc[:-1], [False]])[: len(level.doc)], np.roll(level.at, -1), (begins + sizes)[level.doc])
    symbols = [(level.sym.view(np.int64), pa.int64()), (end - level.at, pa.int32()), (level.at - level.left, pa.int32()), (level.right - end, pa.int32())]
    stretches = [(keys[head].view(np.int64), pa.int64()), (starts[head] - begins[doc[head]], pa.int32()), (starts[tail] - begins[doc[head]], pa.int32())]
    columns = [doc_id, pa.array(sizes, pa.int64()), pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].view(np.int64))]
    columns += [_lists(level.doc, rows, v, k) for v, k in symbols] + [_lists(doc[head], rows, v, k) for v, k in stretches]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SYMBOLS.split(", ")])


def _first_round(window: int, kinds: tuple[str, ...], final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            each = [_split(t) for t in r.column(1).to_pylist()]
            sizes = np.array([len(w) for w in each], np.int64)
            whole = word_digests([b" ".join(w) for w in each])
            level = word_level(sizes, word_digests([w for x in each for w in x])[:, 0].copy())
            yield _found(r.column(0), sizes, whole, *_steps(level, kinds, 0, sizes, window, final), final)

    return in_worker("substrings", run)


def _next_round(window: int, kinds: tuple[str, ...], salt: int, final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            sizes, h1, h2 = (r.column(k).to_numpy() for k in (1, 2, 3))
            counts = np.diff(r.column(4).offsets.to_numpy())
            sym, size, lead, trail = (r.column(k).flatten().to_numpy() for k in (4, 5, 6, 7))
            doc = np.repeat(np.arange(len(sizes)), counts)
            end = np.cumsum(size.astype(np.int64))  # the symbols of a document cover it
            at = end - size
            level = Level(sym.view(np.uint64), at, at - lead, end + trail, doc)
            yield _found(r.column(0), sizes, np.stack([h1, h2], 1).view(np.uint64), *_steps(level, kinds, salt, sizes, window, final), final)

    return in_worker("substrings", run)


def _batch(each: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each document begins, digests, windows): digests of all stretches of `window` words of the documents side by
    side, and which of these are a document's own windows."""
    sizes = np.array([len(w) for w in each], np.int64)
    begins = np.cumsum(sizes) - sizes
    digests = window_digests(word_digests([w for x in each for w in x]), window)
    own = np.zeros(int(sizes.sum()) + 1, np.int64)
    room = np.maximum(sizes - window + 1, 0)
    np.add.at(own, begins, room > 0)
    np.add.at(own, begins + room, -(room > 0).astype(np.int64))
    return begins, digests, np.cumsum(own)[: len(digests)] > 0


def _owners(begins: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The document that holds the word at each position."""
    return np.searchsorted(begins, at, side="right") - 1


def _windows(window: int):
    """(doc_id, text, stretches of window starts) -> the digests of those windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            begins, digests, own = _batch([_split(t) for t in r.column(1).to_pylist()], window)
            stretches = r.column(2).flatten()
            base = np.repeat(begins, np.diff(r.column(2).offsets.to_numpy()))
            wanted = np.zeros(len(digests) + window + 1, np.int64)
            np.add.at(wanted, base + stretches.field(0).to_numpy(), 1)
            np.add.at(wanted, base + stretches.field(1).to_numpy() + 1, -1)
            at = np.flatnonzero(own & (np.cumsum(wanted)[: len(digests)] > 0))
            doc, d = _owners(begins, at), digests[at]
            order = np.lexsort((d[:, 1], d[:, 0], doc))
            doc, d = doc[order], d[order]
            new = np.ones(len(d), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (d[1:] != d[:-1]).any(1)
            doc, d = doc[new], d[new].view(np.int64)
            yield pa.RecordBatch.from_arrays([r.column(0), *[_lists(doc, r.num_rows, np.ascontiguousarray(d[:, k]), pa.int64()) for k in (0, 1)]], ["doc_id", "h1", "h2"])

    return in_worker("substrings", run)


def _cut(text: str | None, gone: np.ndarray) -> str:
    """The text without the words marked in gone; stretches that stay keep their white space."""
    data = (text or "").encode("utf-8", "replace")
    x = np.frombuffer(data, np.uint8)
    word = np.concatenate([[False], (x != 32) & ((x < 9) | (x > 13)), [False]])
    begin, end = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    stays = np.concatenate([[False], ~gone, [False]])
    first, last = np.flatnonzero(stays[1:] & ~stays[:-1]), np.flatnonzero(stays[:-1] & ~stays[1:]) - 1
    return b"\n".join(data[a:z] for a, z in zip(begin[first].tolist(), end[last].tolist(), strict=True)).decode("utf-8", "replace")


def _among(doc: np.ndarray, d: np.ndarray, owner: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which of the digests d, of the documents in doc, are among those listed for the same document. Exact: the halves
    are numbered, so that a document's number and two of a half make one number."""
    there, a, b = np.ones(len(d), bool), doc, owner
    for k in (0, 1):
        values, number = np.unique(listed[:, k], return_inverse=True)
        i = np.minimum(np.searchsorted(values, d[:, k]), len(values) - 1)
        there &= values[i] == d[:, k]
        a, b = a * len(values) + i, b * len(values) + number
    there[there] = np.isin(a[there], b)
    return there


def _marked(each: list[list[bytes]], h1: pa.ListArray, h2: pa.ListArray, window: int) -> list[np.ndarray]:
    """Of each document, which words are covered by a window with one of its digests, or all if the whole text has one."""
    gone = [np.zeros(len(w), bool) for w in each]
    keep = h1.is_valid()
    rows, h1, h2 = np.flatnonzero(keep.to_numpy(zero_copy_only=False)).tolist(), h1.filter(keep), h2.filter(keep)
    owner, listed = np.repeat(np.arange(len(rows)), np.diff(h1.offsets.to_numpy())), np.stack([h1.flatten().to_numpy(), h2.flatten().to_numpy()], 1).view(np.uint64)
    if not len(listed):
        return gone
    whole = _among(np.arange(len(rows)), word_digests([b" ".join(each[i]) for i in rows]), owner, listed)
    begins, digests, own = _batch([[] if w else each[i] for i, w in zip(rows, whole, strict=True)], window)
    at = np.flatnonzero(own)
    at = at[_among(_owners(begins, at), digests[at], owner, listed)]
    cover = np.zeros(sum(len(each[i]) for i, w in zip(rows, whole, strict=True) if not w) + 1, np.int64)
    cover[at] += 1
    cover[at + window] -= 1
    marks = np.cumsum(cover) > 0
    for i, w, begin in zip(rows, whole, begins.tolist(), strict=True):
        gone[i] = np.ones(len(each[i]), bool) if w else marks[begin : begin + len(each[i])]
    return gone


def _removed(window: int, text_at: int, chars_at: int | None):
    """Columns: those of docs, then h1 and h2 of what goes. Gives docs with the text cut, then the number of its words and of those removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            cols = list(r.columns)
            h2, h1 = cols.pop(), cols.pop()
            n_words, n_removed, out = [], [], []
            texts = cols[text_at].to_pylist()
            each = [_split(t) for t in texts]
            for t, words, gone in zip(texts, each, _marked(each, h1, h2, window), strict=True):
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                out.append(_cut(t, gone) if n_removed[-1] else t)
            cols[text_at] = pa.array(out, pa.string())
            if chars_at is not None:
                cols[chars_at] = pa.array([c if not x else len(o) for c, x, o in zip(cols[chars_at].to_pylist(), n_removed, out, strict=True)], cols[chars_at].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], [*r.schema.names[:-2], *COUNTS])

    return in_worker("substrings", run)


def symbol_rounds(docs: DataFrame, window: int = WINDOW, rounds: tuple[tuple[str, ...], ...] = ROUNDS) -> list[DataFrame]:
    """docs(doc_id, text) -> for each round a table of KEYS, of documents of `window` words at least; the last has all of these.

    Every round is a Spark job over the symbols that the one before has written. It names runs and
    pairs by hashes of what they are made of, so equal stretches get equal names in all documents
    without a shuffle, and all but a few symbols at the ends of a repeated stretch agree. A
    window's key is the first symbol that it surely holds, on the last level that has one. A
    round's symbols are deleted once the next has named them; few windows have their keys before
    the last round, and those are written by themselves.
    """
    tables, symbols = [], None
    for k, kinds in enumerate(rounds):
        final, salt = k == len(rounds) - 1, sum(map(len, rounds[:k]))
        if k == 0:
            named = docs.mapInArrow(_first_round(window, kinds, final), SYMBOLS).where(F.col("n") >= window)
        else:
            named = symbols.select("doc_id", "n", "h1", "h2", "sym", "size", "lead", "trail").mapInArrow(_next_round(window, kinds, salt, final), SYMBOLS)
        last, symbols = symbols, staged(named if not final else named.select(*KEYS))
        discard(last)
        tables.append(symbols if final else staged(symbols.select(*KEYS).where(F.size("keys") > 0)))
    return tables


def _several(*names: str) -> Column:
    """Whether the rows of a group differ in one of these columns."""
    return reduce(Column.__or__, [F.min(n) < F.max(n) for n in names])


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, h1, h2), lists of 128-bit digests of the windows to remove, or of the whole text.

    A window goes if its words also start in a document with a smaller doc_id.
    1. The rounds give each window of each document a high-level symbol as its key.
    2. Documents with equal words as a whole collapse onto the one with the smallest id; the others
       go whole. Of the rest, windows whose key another text has too are verified: digests of all
       their words are grouped.
    3. The documents of a group but for the first are told which windows go.
    Every group is only counted, by pre-aggregated minima; no group is gathered. What a step has
    read or shuffled is deleted before the next one shuffles.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    tables = symbol_rounds(plain, window)
    groups = tables[-1].groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")).where("rep < top").drop("top")
    copies = staged(tables[-1].select("doc_id", "h1", "h2").join(groups, ["h1", "h2"]).where("doc_id > rep").select("doc_id", "h1", "h2"), clean=True)
    stretch = F.explode(F.arrays_zip("keys", "first", "last")).alias("s")
    keys = reduce(DataFrame.union, [t.select("doc_id", "h1", "h2", stretch).select("doc_id", "h1", "h2", F.col("s.keys").alias("key"), "s.first", "s.last") for t in tables])
    shared = keys.groupBy("key").agg(_several("h1", "h2").alias("several")).where("several").select("key")
    wanted = keys.select("doc_id", "key", "first", "last").join(shared, "key").groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("stretches"))
    wanted = staged(wanted.join(copies, "doc_id", "left_anti"), clean=True)
    discard(*tables)
    named = staged(plain.join(wanted, "doc_id").mapInArrow(_windows(window), "doc_id long, h1 array<long>, h2 array<long>"), clean=True)
    discard(wanted)
    rows = named.select("doc_id", F.explode(F.arrays_zip("h1", "h2")).alias("h")).select("doc_id", "h.h1", "h.h2")
    first = staged(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h1", "h2", "a"), clean=True)
    later = rows.join(first, ["h1", "h2"]).where("doc_id > a").select("doc_id", "h1", "h2")
    out = staged(later.unionByName(copies).groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("h")).select("doc_id", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2")), clean=True)
    discard(copies, named, first)
    return out


#: What without_repeats() adds to a document's columns.
COUNTS = ("__n_words", "__n_removed")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated windows cut out of text (and n_chars brought up to date), and COUNTS.

    All rows stay, and all columns but for any that are called as COUNTS. Null, empty and short
    texts are unchanged; so is a row without doc_id, which is no source either. Of rows with equal
    doc_id neither is smaller, so they remove nothing from each other.
    """
    docs = docs.drop(*COUNTS)
    names = [x.lower() for x in docs.columns]
    at = names.index("doc_id")
    gone = repeats(docs.select("doc_id", "text"), window)
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])  # names that clash with nothing
    joined = plain.join(gone, plain[f"_{at}"].cast("long") == gone["doc_id"], "left").drop("doc_id")
    schema = T.StructType([*plain.schema.fields, *[T.StructField(c, T.LongType()) for c in COUNTS]])
    return joined.mapInArrow(_removed(window, names.index("text"), names.index("n_chars") if "n_chars" in names else None), schema).toDF(*docs.columns, *COUNTS)
