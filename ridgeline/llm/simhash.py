"""SimHash near-duplicates, found by multi-index hashing: over 64-bit fingerprints a few bits apart, and over wide fingerprints by similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, in_worker, small_batches, staged
from .components import connected_components

#: Shingles whose bits are counted at once, which bounds memory for a text of any length.
CHUNK = 1 << 16


def hashes(text: str | None, width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, in order, repeats included, CHUNK at a time."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = max(1, len(words) - width + 1) if words else 0
    for at in range(0, n, CHUNK):
        m = min(CHUNK, n - at)
        part = words[at : at + m + width - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        yield np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in joined), np.uint64, m)


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of a text: the bitwise majority over XXH64 of its word shingles, repeats included.

    A-Z are lower-cased; fewer words than `width` make one shingle, no word gives 0; a bit is 1 if
    set in over half the hashes.
    """
    counts, n = np.zeros(64, np.int64), 0
    for h in hashes(text, width, seed):
        n += len(h)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long; one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(in_worker("simhash", run), "doc_id long, fp long")


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _looks(segment: int, value: Column, width: int, radius: int) -> Column:
    """What to look up for one segment: its values within `radius` bits, but for the half that the other of a pair looks up."""
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(width, radius)]) if radius >= 0 else F.array().cast("array<long>")
    ball = F.filter(masks, lambda m: value.bitwiseAND(m).bitwiseAND(-m) == 0)
    return F.transform(ball, lambda m: F.struct(F.lit(segment).alias("seg"), value.bitwiseXOR(m).alias("val"), (m == 0).alias("same")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(fps: DataFrame, radius: int = 2, segments: int = 2, cap: int = 64) -> DataFrame:
    """fps(fp, node) with distinct fp -> (u, v): edges whose components are those of "at most `radius` bits differ".

    Multi-index hashing: the 64 bits fall into `segments`; with radius = a * segments + rest, two
    near fingerprints agree to a bits in one of the first rest + 1 segments, or to a - 1 bits in a
    later one. Each fingerprint looks up that Hamming ball of each of its segments in the table of
    segments, and complete distances are verified. Of the two fingerprints of a pair only one
    looks the other up: the one with a zero where the mask's lowest bit is.

    A bucket of over `cap` fingerprints (a family of near copies) is not multiplied out: what is in
    it or looks into it is linked exactly through the points of Hamming balls of half the radius,
    where a point has no more than 65 fingerprints around it at radius 2.
    """
    if radius != 2 * (radius // 2):
        raise ValueError("the exact way for large buckets needs an even radius")
    size = 64 // segments
    a, rest = divmod(radius, segments)
    part = [F.shiftrightunsigned("fp", size * s).bitwiseAND(F.lit((1 << size) - 1)) for s in range(segments)]
    looks = [_looks(s, part[s], size, a if s <= rest else a - 1) for s in range(segments)]
    table = fps.select("fp", "node", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), part[s].alias("val")) for s in range(segments)])).alias("k")).select("k.*", F.col("fp").alias("fp2"), F.col("node").alias("node2"))
    probes = fps.select("fp", "node", F.explode(F.flatten(F.array(*looks))).alias("k")).select("fp", "node", "k.*")
    large = staged(table.groupBy("seg", "val").count().where(F.col("count") > cap).select("seg", "val"))
    pairs = (
        probes.join(table.join(large, ["seg", "val"], "left_anti"), ["seg", "val"])
        .where("(not same or fp < fp2)")
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)
        .select(F.col("node").alias("u"), F.col("node2").alias("v"))
    )
    if large.isEmpty():
        return pairs
    rest_fps = probes.join(large, ["seg", "val"], "left_semi").select("fp", "node").distinct()
    half = F.array(*[F.lit(_signed(m)) for m in _masks(64, radius // 2)])
    around = rest_fps.select("node", F.explode(F.transform(half, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    star = around.groupBy("point").agg(F.min("node").alias("v"), F.collect_set("node").alias("us")).select(F.explode("us").alias("u"), "v")
    return pairs.unionByName(star.where("u <> v"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fingerprint, component_id), one row for each row of docs.

    component_id is the smallest doc_id that can be reached over links of at most `radius`
    differing bits. Null and empty texts have fingerprint zero and are linked like any other; a
    row without doc_id links nothing and gets its fingerprint's component (null if no row with an
    id has it). Equal fingerprints collapse before the search, so groups of copies cost one row.
    """
    prints = staged(fingerprints(docs, width))
    fps = staged(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    roots = connected_components(near_links(fps, radius))
    owner = fps.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(owner, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Odd constants of a 64-bit finaliser that makes further hashes from a shingle's XXH64.
STEP, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


@dataclass(frozen=True)
class Layout:
    """A wide fingerprint: `segments` of `bits` bits, which are looked up, and `more` longs that only compare, the first of them as a sketch.

    The more bits there are, the fewer pairs around the threshold need their shingles.
    """

    segments: int
    bits: int
    more: int = 15

    @property
    def total(self) -> int:
        return self.segments * self.bits + 64 * self.more

    def meetings(self, n: int) -> float:
        """How many of n random fingerprints one of them meets, all segments together."""
        return n * self.segments * (self.bits + 1) / 2.0**self.bits


def differing(similarity: float) -> float:
    """Share of differing bits of the fingerprints of two shingle sets with this Jaccard similarity."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def layout(n: int, similarity: float = 0.8, recall: float = 0.93, meetings: float = 64.0) -> Layout:
    """The layout for n texts: a pair of exactly this similarity agrees to one bit in some segment with
    probability `recall`, whatever n is; segments are so wide that a text meets `meetings` others by chance at most."""
    p = differing(similarity)
    for bits in range(24, 56):
        near = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
        found = Layout(math.ceil(math.log(1 - recall) / math.log(1 - near)), bits)
        if found.meetings(n) <= meetings:
            break
    return found


def wide_simhash(text: str | None, form: Layout, width: int = 5, seed: int = 42) -> np.ndarray:
    """The segments' values and the other longs, over distinct word shingles: the share of differing bits
    of two texts estimates the angle between their shingle sets, and so their Jaccard similarity.
    Words are those of simhash(); no word gives zeros."""
    h = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes(text, width, seed)]))
    words = -(-form.total // 64)
    counts = np.zeros(64 * words, np.int64)
    steps = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(STEP)
    for at in range(0, len(h), 255):  # no more than 255, so that a byte holds a bit's count
        z = h[at : at + 255, None] + steps
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
        z ^= z >> np.uint64(31)
        counts += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    set_ = 2 * counts > len(h)
    end = 64 + form.segments * form.bits
    values = set_[64:end].reshape(form.segments, form.bits) @ (1 << np.arange(form.bits, dtype=np.int64))
    others = np.concatenate([set_[:64], set_[end : form.total]])
    return np.append(values, np.packbits(others, bitorder="little").view(np.int64))


def wide_fingerprints(docs: DataFrame, form: Layout, width: int = 5) -> DataFrame:
    """(doc_id, fp): fp is an array of longs, a value for each segment and the others; one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [wide_simhash(t, form, width) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.list_(pa.int64()))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(in_worker("simhash", run), "doc_id long, fp array<long>")


def band(similarity: float, bits: int, below: float = 3.0, above: float = 3.0) -> tuple[int, int]:
    """Numbers of differing bits, of `bits`, so many standard deviations below and above what a Jaccard similarity makes."""
    p = differing(similarity)
    far = math.sqrt(bits * p * (1 - p))
    return math.floor(bits * p - below * far), math.ceil(bits * p + above * far)


def shingle_sets(docs: DataFrame, width: int, seed: int = 42) -> DataFrame:
    """(node, shingles): the distinct shingle hashes of each row of docs(node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes(t, width, seed)])).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.mapInArrow(in_worker("simhash", run), "node long, shingles array<long>")


def _bits(a: str, b: str, form: Layout) -> Column:
    """Complete distance of two fingerprints."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(form.segments + form.more)), start=F.lit(0))


def _distances(pairs: DataFrame, nodes: DataFrame, form: Layout, most: int) -> DataFrame:
    """pairs(u, v), nodes(node, fp, root) -> (u, v, bits) of pairs with different roots whose complete distance is `most` bits at most."""
    a, b = (nodes.select(F.col("node").alias(x), F.col("fp").alias(f"f{x}"), F.col("root").alias(f"r{x}")) for x in "uv")
    close = pairs.where("u <> v").distinct().join(a, "u").join(b, "v").where("ru <> rv").where(_bits("fu", "fv", form) <= most)
    return close.select("u", "v", _bits("fu", "fv", form).alias("bits"))


def _told(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """entries(node, ...) with the columns that nodes(node, ...) has for their node. Entries are gathered first, so the join has a row
    for each node however many entries it is in, which are its segments' values and what those look up at most."""
    gathered = entries.groupBy("node").agg(F.collect_list(F.struct(*[c for c in entries.columns if c != "node"])).alias("entries"))
    told = gathered.join(nodes, "node")
    return told.select("node", *[c for c in nodes.columns if c != "node"], F.explode("entries").alias("e")).select("node", *[c for c in nodes.columns if c != "node"], "e.*")


def _rooted(fps: DataFrame, links: DataFrame) -> DataFrame:
    """fps(node, fp) with the root of each node's component."""
    roots = connected_components(links)
    out = staged(fps.join(roots, "node", "left").select("node", "fp", F.coalesce("root", "node").alias("root")))
    discard(roots)
    return out


def _links(near: DataFrame, known: DataFrame | None, texts: DataFrame, width: int, similarity: float, least: int) -> DataFrame:
    """known(u, v), those of near(u, v, bits) that have under `least` bits, and those of the others whose shingles are as similar as
    asked. Where a text has many pairs it should be v: the shingles of u travel with each pair, those of v once."""
    sure, unsure = near.where(F.col("bits") < least).select("u", "v"), near.where(F.col("bits") >= least).select("u", "v")
    nodes = unsure.selectExpr("u as node").union(unsure.selectExpr("v as node")).distinct()
    sets = staged(shingle_sets(texts.join(nodes, "node", "left_semi"), width))
    both = unsure.join(sets.selectExpr("node as u", "shingles as a"), "u").join(sets.selectExpr("node as v", "shingles as b"), "v")
    share = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("n"), (F.size("a") + F.size("b")).alias("total"))
    found = sure.unionByName(share.where(F.col("n") >= similarity * (F.col("total") - F.col("n"))).select("u", "v"))
    out = staged(found if known is None else found.unionByName(known))
    discard(sets)
    return out


def similar_links(fps: DataFrame, texts: DataFrame, form: Layout, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """fps(fp, node), texts(node, text) -> (u, v): edges with the components of all candidates of at least `similarity`.

    Multi-index hashing: a table of every segment of every fingerprint; each fingerprint looks up
    the Hamming ball of radius 1 of each of its segments; of two that differ in a bit, the one with a
    zero there looks the other up. Candidates share a table entry and have sketches that four
    standard deviations allow, so chance meetings end inside the join; complete distances are then
    verified, and where those leave a doubt, so are the shingles themselves. In layout()'s default,
    a pair is a candidate with a probability of 0.93 at a similarity of 0.8, 0.98 at 0.85, and over
    0.999 at 0.9.

    A family of near copies is not multiplied out. A node's popularity is the size of its entries;
    the most popular node of an entry is its center.
    1. Each node is held against the center of its largest entry, without balls.
    2. Balls are looked up; what meets none but its own component ends inside the join. Each node is
       held against that center whose sketch is nearest.
    3. All pairs of an entry whose components still differ follow, but for two members of the
       entry's main component. A pair is verified where it meets first, inside the join.
    """
    least, most = band(similarity, form.total)
    _, apart = band(similarity, 64, above=4.0)
    sketches = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    near = lambda x, y: sketches(x, y) <= apart
    key = F.explode(F.array(*[F.col("fp")[s].bitwiseOR(F.lit(s << form.bits)) for s in range(form.segments)])).alias("key")
    sketch = F.col("fp")[form.segments].alias("sketch")

    def linked(close: DataFrame, known: DataFrame | None) -> DataFrame:
        close = staged(close)
        out = _links(close, known, texts, width, similarity, least)
        discard(close, known)
        return out

    table = fps.select("node", sketch, key)
    several = table.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    core = staged(table.join(several, "key"))
    popular = core.groupBy("node").agg(F.sum("n").alias("popularity"), F.collect_list(F.struct("key", "n", "sketch")).alias("entries"))
    popular = popular.select("node", "popularity", F.explode("entries").alias("e")).select("node", "popularity", "e.*")
    centers = staged(popular.groupBy("key").agg(F.max_by(F.struct("node", "sketch"), F.struct("popularity", -F.col("node"))).alias("c"), F.first("n").alias("n")))
    one = core.join(centers.select("key", "c"), "key").where(F.col("node") != F.col("c.node")).where(near("sketch", "c.sketch")).groupBy("node").agg(F.max_by("c.node", F.struct("n", "key")).alias("v"))
    links = linked(_distances(one.withColumnRenamed("node", "u"), fps.withColumn("root", F.col("node")), form, most), None)
    discard(core)

    known = _rooted(fps, links)
    table = known.select("node", "root", sketch, key)
    masks = F.array(*[F.lit(1 << b).cast("long") for b in range(form.bits)])
    looks = table.select("node", "root", "sketch", "key", F.explode(masks).alias("mask")).where(F.col("key").bitwiseAND(F.col("mask")) == 0).select("node", "root", "sketch", F.col("key").bitwiseOR(F.col("mask")).alias("key"))
    entries = table.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct("node", "sketch")).alias("first"))
    held = staged(entries.join(centers.select("key", "c"), "key", "left").select("key", "n", "low", "high", F.coalesce("c", "first").alias("c")))
    met = looks.join(held, "key").where("low <> root or high <> root").where((F.col("n") > 1) | near("sketch", "c.sketch"))
    met = staged(met.select("key", "node", "sketch", "n", "c"))
    mixed = held.where("n > 1 and low <> high")
    touched = staged(met.where("n > 1").select("key").union(mixed.select("key")).distinct())
    inner = staged(table.join(touched, "key", "left_semi").select("key", "node", "sketch"))
    seen = met.select("node", "sketch", "c").union(inner.join(mixed.select("key", "c"), "key").select("node", "sketch", "c")).where(near("sketch", "c.sketch"))
    best = seen.where(F.col("node") != F.col("c.node")).groupBy("node").agg(F.min_by("c.node", F.struct(sketches("sketch", "c.sketch"), "c.node")).alias("v"))
    links = linked(_distances(best.withColumnRenamed("node", "u"), known, form, most), links)
    discard(known, centers)

    known = _rooted(fps, links)
    both = met.where("n > 1").select("key", "node", F.lit(False).alias("core")).union(inner.select("key", "node", F.lit(True)))
    members = staged(_told(both, known.select("node", "root")))
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("key", "main")
    open_ = staged(_told(members.join(main, "key").select("node", "key", "core", "root", (F.col("root") == F.col("main")).alias("main")), fps.select("node", "fp")))
    u = open_.select("key", F.col("node").alias("u"), F.col("root").alias("ru"), F.col("core").alias("cu"), F.col("fp").alias("fu")).where("not main")
    v = open_.select("key", F.col("node").alias("v"), F.col("root").alias("rv"), F.col("core").alias("cv"), F.col("fp").alias("fv"), F.col("main").alias("mv"))
    first = F.coalesce(*[F.when(F.bit_count(F.col("fu")[s].bitwiseXOR(F.col("fv")[s])) <= 1, F.lit(s)) for s in range(form.segments)])
    rest = u.join(v, "key").where("ru <> rv and (cu or cv) and (mv or u < v)").where(_bits("fu", "fv", form) <= most).where(first == F.shiftright("key", form.bits))
    alone = met.where("n = 1").select(F.col("node").alias("u"), F.col("c.node").alias("v"))
    links = linked(rest.select("u", "v", _bits("fu", "fv", form).alias("bits")).union(_distances(alone, known, form, most)), links)
    discard(known, held, met, touched, inner, members, open_)
    return links


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, component_id), one row for each row of docs.

    component_id is the smallest doc_id that can be reached over links of at least `similarity`
    (Jaccard, of the sets of `width`-word shingles). Null and empty texts have the same
    fingerprint and are linked like any other; a row without doc_id links nothing and gets its
    fingerprint's component (null if no row with an id has it). A doc_id with several texts has
    the links of all of them. Equal fingerprints collapse first.
    """
    form = layout(docs.count(), similarity)
    prints = staged(wide_fingerprints(docs, form, width))
    fps = staged(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    roots = connected_components(similar_links(fps, docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string")), form, width, similarity))
    owner = fps.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(owner, "fp", "left").select("doc_id", "component_id")


def first_of_group(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the smallest of its group of similar texts; a row without doc_id stays."""
    found = similar_groups(docs.select("doc_id", "text"), width, similarity)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
