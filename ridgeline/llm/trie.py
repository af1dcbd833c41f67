"""The prefix trie of conversations: ternary search trees over turn ids, one for each range of sequences, merged at the ranges' borders."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, staged, words_of

#: Turns of a shard, about, and ids in a piece of text that is hashed.
SHARD_TURNS, PIECE = 1 << 16, 4096
#: What a shard says of a node. Of a border node, which other shards may have too, counts leave out what lies below its border
#: children; key names it in all shards and above has the keys from the root to it. Of an inner node parent is known, or parent_key.
NODE = "border boolean, key binary, parent_key binary, above array<binary>, conv_id long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved long, words long, first long"


class Ternary:
    """A ternary search tree. A place is one turn after a prefix, so a node of the trie; place 0 is the root, which has no turn."""

    def __init__(self) -> None:
        self.turn, self.words, self.low, self.equal, self.high = [0], [0], [0], [0], [0]
        self.up, self.depth, self.members, self.least, self.first = [0], [0], [0], [None], [None]

    def _new(self, turn: int, words: int, up: int) -> int:
        for column, x in ((self.turn, turn), (self.words, words), (self.low, 0), (self.equal, 0), (self.high, 0), (self.up, up), (self.depth, self.depth[up] + 1), (self.members, 0), (self.least, None), (self.first, None)):
            column.append(x)
        return len(self.turn) - 1

    def path(self, turns: list[int], words: list[int]) -> list[int]:
        """The places of a sequence from the root on; those that are missing are made."""
        turn, low, high, equal = self.turn, self.low, self.high, self.equal
        out = [0]
        for t, w in zip(turns, words, strict=True):
            at = equal[out[-1]]
            if not at:
                at = equal[out[-1]] = self._new(t, w, out[-1])
            while turn[at] != t:
                side = low if t < turn[at] else high
                if not side[at]:
                    side[at] = self._new(t, w, out[-1])
                at = side[at]
            out.append(at)
        return out

    def add(self, turns: list[int], words: list[int], members: int, first: int) -> None:
        for at in self.path(turns, words):
            self.members[at] += members
            if self.least[at] is None or first < self.least[at]:
                self.least[at] = first
        self.first[at] = first


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle first, then the middles of both halves, and so on: sorted keys added in this order balance the tree."""
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if lo < hi:
            middle = (lo + hi) // 2
            yield middle
            todo += [(middle + 1, hi), (lo, middle)]


def shard_nodes(rows: list[tuple[list[int], list[int], int, int]]) -> Iterator[tuple]:
    """Sorted (turns, words of each, smallest member, members) of distinct sequences -> NODE rows of their trie.

    Only nodes on the way to the first and the last sequence can be in another shard too. Places are
    made after the one above them, so one pass backwards adds children up before their parents.
    """
    tree = Ternary()
    for k in medians(len(rows)):
        turns, words, first, members = rows[k]
        tree.add(turns, words, members, first)
    size = len(tree.turn)
    keys: dict[int, bytes] = {0: b""}
    for turns, words, *_ in (rows[0], rows[-1]):
        for at in tree.path(turns, words)[1:]:
            keys.setdefault(at, hashlib.blake2b(keys[tree.up[at]] + tree.turn[at].to_bytes(8, "big"), digest_size=16).digest())
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for at in range(size - 1, 0, -1):
        if at not in keys:
            leaves[at] += not children[at]
            saved[at] += (tree.members[at] - 1) * tree.words[at]
            children[tree.up[at]] += 1
            leaves[tree.up[at]] += leaves[at]
            saved[tree.up[at]] += saved[at]
    above: dict[int, list[bytes]] = {}
    for at in range(size):
        up, own = tree.up[at], (tree.least[at], tree.depth[at])
        counts = (tree.members[at], children[at], leaves[at], saved[at], tree.words[at], tree.first[at])
        if at in keys:
            above[at] = [*above.get(up, []), keys[at]]
            yield True, keys[at], keys[up] if at else None, above[at], *own, None, *counts
        else:
            yield False, None, keys.get(up), None, *own, None if up in keys else tree.least[up], *counts


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trie of a partition of sorted sequences."""
    rows = [(r["turns"], r["words"], r["first"], r["n"]) for b in batches for r in b.to_pylist()]
    if rows:
        columns = [list(c) for c in zip(*shard_nodes(rows), strict=True)]
        b = pa.binary()
        kinds = (pa.bool_(), b, b, pa.list_(b), *[pa.int64()] * 9)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in NODE.split(", ")])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (first, conv_id) -> (first, start, text): ids joined by commas, PIECE at a time."""
    part = TaskContext.get().partitionId()
    for n, b in enumerate(batches):
        out, first = [], b.column(0).to_pylist()
        ids, at = b.column(1).to_pylist(), 0
        while at < len(b):
            end = at
            while end < len(b) and first[end] == first[at] and end - at < PIECE:
                end += 1
            out.append((first[at], (part << 40) + (n << 20) + at, ",".join(map(str, ids[at:end]))))
            at = end
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["first", "start", "text"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces -> (first, ends_sha256). A hash takes piece after piece, so it needs no memory for its group."""
    name = ["first", "ends_sha256"]
    as_batch = lambda out: pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.int64()), pa.array([h.hexdigest() for _, h in out], pa.string())], name)
    now = state = None
    for b in batches:
        done = []
        for first, text in zip(b.column("first").to_pylist(), b.column("text").to_pylist(), strict=True):
            if first != now:
                if state:
                    done.append((now, state))
                now, state = first, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield as_batch(done)
    if state:
        yield as_batch([(now, state)])


def sequences(turns: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """turns(conv_id, turn, role, text) -> (conv_id, turns, words): the ids of a conversation's turns in order, and how many words each has.

    A dictionary gives each distinct (role, text) an id; what is joined and sorted is its digest, not
    its text. members(conv_id) adds conversations that may have no turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    keyed = staged(turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), key.alias("key"), F.size(words_of(F.col("text"))).cast("long").alias("words")))
    dictionary = staged(keyed.select("key").distinct().withColumn("id", F.monotonically_increasing_id()))
    each = keyed.join(dictionary, "key").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "key", "id", "words"))).alias("s"))
    each = each.select("conv_id", F.col("s.id").alias("turns"), F.col("s.words").alias("words"))
    if members is not None:
        none = F.array().cast("array<long>")
        all_ = members.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        each = all_.join(each, "conv_id", "left").select("conv_id", F.coalesce("turns", none).alias("turns"), F.coalesce("words", none).alias("words"))
    out = staged(each)
    discard(keyed, dictionary)
    return out


def prefix_trie(turns: DataFrame, members: DataFrame | None = None, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """turns(conv_id, turn, role, text) -> a row for each distinct sequence of first turns that a conversation starts with.

    conv_id is the smallest of the conversations that start with it, depth its number of turns,
    parent_conv_id its parent's conv_id (null for the root, which all start with). n_convs,
    n_children and n_leaves count conversations, children and childless nodes below; saved_tokens
    adds up, over the node and all below, (n_convs - 1) times the words of the last turn; ends_sha256
    hashes the ids of those that end there, in ascending order, joined by commas.

    Turns are ordered by turn (null first), equal ones by a digest of role and text; null roles and
    texts are empty ones; repeated rows are turns of their own; rows without conv_id and further
    columns do not count. An empty table has no node. members(conv_id), if given, are the
    conversations, also those without a turn.

    Equal sequences become one, then are sorted into ranges of about `shard_turns` turns. Each range
    builds its tree. Nodes at the ranges' borders, a path or two for each, are summed up by their
    keys, and what lies below them by the keys above. A conversation is one row, of 16 bytes a turn.
    """
    spark = turns.sparkSession
    small_batches(spark, PIECE)
    each = sequences(turns, members)
    distinct = staged(each.groupBy("turns", "words").agg(F.min("conv_id").alias("first"), F.count("*").alias("n")))
    total = distinct.agg(F.coalesce(F.sum(F.size("turns") + 1), F.lit(1))).first()[0]
    sorted_ = distinct.repartitionByRange(math.ceil(total / shard_turns), "turns").sortWithinPartitions("turns")
    nodes = staged(sorted_.mapInArrow(_shards, NODE))

    ends = staged(each.join(distinct.select("turns", "first"), "turns").select("first", "conv_id"))
    pieces = ends.repartitionByRange("first", "conv_id").sortWithinPartitions("first", "conv_id").mapInArrow(_pieces, "first long, start long, text string")
    pieces = staged(pieces)
    hashes = pieces.repartition("first").sortWithinPartitions("first", "start").mapInArrow(_hashed, "first long, ends_sha256 string")

    parts = nodes.where("border").groupBy("key").agg(F.first("parent_key", True).alias("parent_key"), F.max("above").alias("above"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("words").alias("words"), F.max("first").alias("first"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")])
    parts = staged(parts)
    below = parts.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    parts = parts.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = parts.select(F.explode("above").alias("key"), (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("tokens"))
    sums = own.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens"))
    named = staged(parts.drop("n_leaves", "saved", "above", "words", "more").join(sums, "key"))
    owner = named.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "first"]
    border = named.join(owner, "parent_key", "left").withColumnsRenamed({"leaves": "n_leaves", "tokens": "saved_tokens"}).select(columns)
    inner = nodes.where("not border").withColumnRenamed("saved", "saved_tokens")
    deep = inner.where("parent_key is null").withColumnRenamed("parent", "parent_conv_id").select(columns)
    top = inner.where("parent_key is not null").join(owner, "parent_key").select(columns)
    all_ = border.unionByName(deep).unionByName(top)
    none = all_.where("first is null").withColumn("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    out = staged(all_.join(hashes, "first").unionByName(none).drop("first"))
    discard(each, distinct, nodes, ends, pieces, named)
    return out
