"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, in_worker, small_batches, staged
from .hashing import BASES, Rolling, mix

#: Tokens of a window, and of the shortest item that is searched for as a template; shorter ones are searched for word for word.
WINDOW, SHORTEST = 8, 5
#: Units of a window in scripts without spaces: a character of theirs is a unit, and so is a run of other letters or digits.
CHARACTERS = 16
#: Bits of the filter that the executors get: 2 MB, however large the benchmark is.
FILTER_BITS = 24
#: Units that turn into a slot after a number.
UNITS = frozenset(
    "% cent cents centimeter centimeters cm day days dollar dollars euro euros feet foot ft g gallon gallons gram grams h hour hours inch inches "
    "kg kilogram kilograms kilometer kilometers km kmh l lb lbs liter liters m meter meters mg mile miles min minute minutes ml mm month months mph "
    "ounce ounces oz pence percent pound pounds second seconds ton tons tonne tonnes week weeks yard yards year years $ € £ °c °f".split()
)
NUM, UNIT, NAME = (xxhash.xxh64_intdigest(x) for x in ("<num>", "<unit>", "<name>"))
TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}%$€£°](?:.*[\p{L}\p{M}\p{N}%$€£°])?", regex.DOTALL)
_UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
UNSPACED, UNIT_OF_TEXT = regex.compile(_UNSPACED), regex.compile(rf"{_UNSPACED}|(?:(?!{_UNSPACED})[\p{{L}}\p{{M}}\p{{N}}])+")
#: Marks around a token that are no part of it.
MARKS = ".,;:!?\"'()[]{}<>«»“”‘’…-_*#/"
DIGIT, UPPER = regex.compile(r"\p{N}"), regex.compile(r"\p{Lu}")


class _Tokens(dict):
    """Raw token -> number; what is known of a number is in arrays. A new one takes over when ROOM is used up: workers outlive their stages."""

    ROOM = 1 << 17

    def __init__(self) -> None:
        self.literal = np.zeros(self.ROOM + 1, np.uint64)
        self.flags = np.zeros(self.ROOM + 1, np.uint8)
        self.text: list[str] = []

    def __missing__(self, raw: str) -> int:
        plain = raw if raw.isalnum() else raw.strip(MARKS)  # most tokens are letters and digits between marks, which need no pattern
        if plain.isalnum():
            core = plain
        else:
            found = TOKEN.search(raw)
            core = found[0] if found else ""
        low, first = core.lower(), core[:1]
        i = len(self.text)
        if i == len(self.literal):
            self.literal = np.concatenate([self.literal, np.zeros(i, np.uint64)])
            self.flags = np.concatenate([self.flags, np.zeros(i, np.uint8)])
        self[raw] = i
        ends = core is not raw and raw.rstrip("\"')]»”’")[-1:] in {".", "!", "?", ":"}
        same = core.casefold()
        number = not core.isalpha() and bool(DIGIT.search(core))
        upper = not "a" <= first <= "z" and ("A" <= first <= "Z" or bool(UPPER.match(core)))
        unspaced = not core.isascii() and bool(UNSPACED.search(core))
        self.literal[i] = xxhash.xxh64_intdigest(same)
        self.flags[i] = bool(core) * KEPT | number * IS_NUM | (low in UNITS) * IS_UNIT | upper * IS_UPPER | ends * ENDS | unspaced * IS_UNSPACED
        self.text.append(same)
        return i


KEPT, IS_NUM, IS_UNIT, IS_UPPER, ENDS, IS_UNSPACED = 1, 2, 4, 8, 16, 32
_known = _Tokens()


def _forget() -> None:
    global _known
    _known = _Tokens()


#: Forms of a window: all literal, numbers and units as slots, names too.
LITERAL, NUMBERS, NAMES = range(3)


class Templates:
    """The tokens of a batch of texts, side by side, as they are and with typed slots for numbers, units after a number, and names (upper-case within a sentence).

    Tokens lie between white space; punctuation at their ends is dropped, and with it tokens that
    have nothing else; literals compare without regard to case. With `characters`, tokens are the
    units of UNIT_OF_TEXT instead.
    """

    def __init__(self, texts: list[str | None], characters: bool = False) -> None:
        if len(_known) > _Tokens.ROOM:
            _forget()
        self.known = _known
        each = [np.fromiter(map(_known.__getitem__, UNIT_OF_TEXT.findall(t or "") if characters else (t or "").split()), np.int64) for t in texts]
        ids = np.concatenate([np.empty(0, np.int64), *each])
        doc = np.repeat(np.arange(len(each)), [len(x) for x in each])
        flags = _known.flags[ids]
        first = np.ones(len(ids), bool)
        first[1:] = (flags[:-1] & ENDS > 0) | (doc[1:] != doc[:-1])
        k = np.flatnonzero(flags & KEPT)
        self.ids, self.doc, flags, first = ids[k], doc[k], flags[k], first[k]
        self.sizes = np.bincount(self.doc, minlength=len(each))
        self.starts = np.cumsum(self.sizes) - self.sizes
        num = flags & IS_NUM > 0
        after = np.zeros(len(k), bool)
        after[1:] = num[:-1] & (self.doc[1:] == self.doc[:-1])
        unit = (flags & IS_UNIT > 0) & after & ~num
        name = (flags & IS_UPPER > 0) & ~first & ~num & ~unit
        self.types = num * 1 + unit * 2 + name * 3
        literal = _known.literal[self.ids]
        numbers = np.where(num, np.uint64(NUM), np.where(unit, np.uint64(UNIT), literal))
        self.rolls = [Rolling(x, BASES[0]) for x in (literal, numbers, np.where(name, np.uint64(NAME), numbers))]
        self.n_numbers, self.n_names, self.n_unspaced = (np.concatenate([[0], np.cumsum(x)]) for x in (num | unit, name, flags & IS_UNSPACED > 0))
        self.characters = characters

    def windows(self, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Form, starts and names of the windows of this length. Those with slots must have literals as their larger part; a form comes only where it has a slot that the one before lacks. Under SHORTEST, and of characters (one of a script without spaces at least), there are literal ones only."""
        at = np.arange(max(0, len(self.ids) - length + 1))
        at = at[self.doc[at] == self.doc[at + length - 1]]
        if self.characters or length < SHORTEST:
            at = at[self.n_unspaced[at + length] > self.n_unspaced[at]] if self.characters else at
            yield LITERAL, at, mix(self.rolls[LITERAL].of(at, at + length) + np.uint64(length))
            return
        numbers, names = (x[at + length] - x[at] for x in (self.n_numbers, self.n_names))
        for form, p in (LITERAL, at), (NUMBERS, at[(numbers > 0) & (2 * numbers < length)]), (NAMES, at[(names > 0) & (2 * (numbers + names) < length)]):
            yield form, p, mix(self.rolls[form].of(p, p + length) + np.uint64(length))

    def spelled(self, form: int, at: int, length: int) -> tuple[str, bool, list[str], list[int]]:
        """The window as text, with its slots as <type>, whether it is literal though it could have slots, what fills them, and which tokens of the window they are."""
        words = [self.known.text[j] for j in self.ids[at : at + length]]
        types = [t if t < (1, 3, 4)[form] else 0 for t in self.types[at : at + length].tolist()]
        spelled = " ".join(("", "<num>", "<unit>", "<name>")[t] or w for t, w in zip(types, words, strict=True))
        exact = form == LITERAL and bool(self.types[at : at + length].any())
        return spelled, exact, [w for t, w in zip(types, words, strict=True) if t], [j for j, t in enumerate(types) if t]


FOUND = "doc_id long, name long, at int, length int, characters boolean, template string, exact boolean, slots array<string>, spots array<int>"


def _search(lengths: list[tuple[bool, int]] | None, window: int, bits: np.ndarray | None):
    """Batches of (id, text) -> rows of FOUND. lengths: (characters, length) of each kind of window.

    Without lengths, each text gives the windows of its own length, `window` or CHARACTERS at most.
    A window shorter than that is a whole item, so the first of those in a text that read the same
    stands for all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, keys, texts = [], b.column(0).to_pylist(), b.column(1).to_pylist()
            t, doc = Templates(texts), np.arange(len(texts))
            for characters, most in (False, window), (True, CHARACTERS):
                if characters:
                    doc = np.unique(t.doc[np.diff(t.n_unspaced) > 0])
                    if not len(doc) or lengths is not None and not any(c for c, _ in lengths):
                        break
                    t = Templates([texts[i] for i in doc], True)
                own = np.minimum(t.sizes, most)
                for n in [k for c, k in lengths if c == characters] if lengths is not None else np.unique(own[own > 0]).tolist():
                    for form, at, names in t.windows(n):
                        if lengths is None:
                            hit = own[t.doc[at]] == n
                        else:
                            h = names >> np.uint64(64 - FILTER_BITS)
                            hit = (bits[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        at, names = at[hit], names[hit]
                        if n < most and form == LITERAL:
                            once = np.sort(np.unique(np.stack([t.doc[at].astype(np.uint64), names]), axis=1, return_index=True)[1])
                            at, names = at[once], names[once]
                        of = t.doc[at]
                        for i, p, q, h in zip(doc[of].tolist(), at.tolist(), (at - t.starts[of]).tolist(), names.view(np.int64).tolist(), strict=True):
                            rows.append((keys[i], h, q, n, characters, *t.spelled(form, p, n)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    return in_worker("decontaminate", run, _forget)


def _item_windows(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(item_id, name, at, length, characters, template, slots, class) of the items' windows, and (class, name, at, length, characters,
    template, labels) of their classes: items with the same windows, whose slots are filled alike in the same places, by whatever.

    A label is the first place of the item with that filling.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(_search(None, window, None), FOUND)
    items = staged(items.withColumnRenamed("doc_id", "item_id"))
    place = ["item_id", "characters", "at", "length", "name", "template"]
    open_ = items.where("not exact")  # a literal window with a number or name in it is met by its like only, whatever class it is of
    slots = open_.select(*place, F.posexplode(F.arrays_zip("slots", "spots")).alias("k", "s")).select(*place, "k", F.col("s.slots").alias("a"), (F.col("at") + F.col("s.spots")).alias("spot"))
    first = Window.partitionBy("item_id", "characters", "a")
    labelled = slots.withColumn("label", F.min("spot").over(first)).groupBy(place).agg(F.transform(F.array_sort(F.collect_set(F.struct("k", "label"))), lambda x: x["label"]).alias("labels"))
    labelled = labelled.unionByName(open_.where(F.size("slots") == 0).select(*place, F.array().cast("array<int>").alias("labels")))
    each = staged(labelled.distinct())
    shape = F.sha2(F.to_json(F.array_sort(F.collect_set(F.struct("characters", "at", "length", "name", "template", "labels")))), 256)
    classes = staged(each.groupBy("item_id").agg(shape.alias("class")).withColumnRenamed("item_id", "__item"))
    of = lambda d: d.join(classes, F.col("item_id").eqNullSafe(F.col("__item")), "left").drop("__item").withColumn("class", F.coalesce("class", F.lit("")))
    found = staged(of(items.drop("spots", "exact")).distinct()), staged(of(each).drop("item_id").distinct())
    discard(items, each, classes)
    return found


def _candidates(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """FOUND rows of the documents' windows, but for those that no item's window reads like: a filter of fixed size, built by Spark, thins them."""
    lengths = sorted((r["characters"], r["length"]) for r in items.select("characters", "length").distinct().collect())  # window + CHARACTERS values at most
    h = F.shiftrightunsigned("name", 64 - FILTER_BITS)
    blocks = items.select(F.shiftright(h, 15).alias("block"), h.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()  # of fixed size
    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for b in blocks:
        bits[b["block"] << 12 : b["block"] + 1 << 12] = np.frombuffer(b["bits"], np.uint8)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_search(lengths, window, bits), FOUND)


READS = ["name", "length", "characters", "template"]
OFFSET = ["doc_id", "class", "characters", "shift"]


def _judged_places(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(OFFSET, at, length, fits): windows of documents that read like a class's, and whether they are filled as most places of their fillings are at that offset."""
    pairs = staged(found.where("not exact").join(classes.withColumnRenamed("at", "class_at"), READS).withColumn("shift", F.col("at") - F.col("class_at")))
    place = [*OFFSET, "at", "length", "template", "labels", "slots"]
    slots = pairs.where(F.size("slots") > 0).select(*place, F.explode(F.arrays_zip("labels", "slots", "spots")).alias("s"))
    slots = slots.withColumns({"a": F.col("s.labels"), "b": F.col("s.slots"), "spot": F.col("at") + F.col("s.spots")})
    fills = slots.groupBy(*OFFSET, "a", "b").agg(F.count_distinct("spot").alias("n")).groupBy(*OFFSET, "a").agg(F.max_by("b", "n").alias("b"), F.max("n").alias("n"), F.sum("n").alias("all"))
    fills = fills.where("2 * n > all").select(*[F.col(c).alias(f"_{c}") for c in (*OFFSET, "a", "b")])
    known = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*OFFSET, "a", "b")])
    filled = slots.join(fills, known, "left").groupBy(place).agg(F.bool_and(F.col("_a").isNotNull()).alias("fits"))
    plain = pairs.where(F.size("slots") == 0).select(*OFFSET, "at", "length", F.lit(True).alias("fits"))
    return plain.union(filled.select(*OFFSET, "at", "length", "fits")).groupBy(*OFFSET, "at").agg(F.max("length").alias("length"), F.bool_or("fits").alias("fits"))


def _best(places: DataFrame, *by: str) -> DataFrame:
    """(by, best): windows that count and the tokens they span, at the offset with the most."""
    count = lambda c: F.struct(F.count_if(c).alias("n_windows"), (F.max(F.when(F.col(c), F.col("at") + F.col("length"))) - F.min(F.when(F.col(c), F.col("at")))).alias("n_tokens"))
    offsets = places.groupBy(*by, "characters", "shift").agg(count("same").alias("same"), count("fits").alias("fits"), F.count("at").alias("n"))
    kept = offsets.withColumn("best", F.when(2 * F.col("fits.n_windows") > F.col("n"), F.col("fits")).otherwise(F.col("same"))).where("best.n_windows > 0")
    return kept.groupBy(*by).agg(F.max("best").alias("best"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> (doc_id, item_id, n_windows, n_tokens): documents that hold an item.

    A window of `window` tokens (the whole item where that is shorter) must match, word for word
    without regard to case and punctuation, or, from SHORTEST tokens on, as a template with
    slots for numbers and units, or for names as well: in capitals a name cannot be told. A window
    whose slots are filled as the item's always counts. Of the others at one offset, those fit
    whose fillings are what most places of the item's filling have become there; they count where
    more than half of the offset's windows fit, so a question with other numbers or names is found,
    though one slot went astray, and a text of the same shape with mixed-up ones is not. n_windows
    and n_tokens are those of the best offset. An item with text in a script without spaces is also
    searched for by CHARACTERS units (all of a shorter one). An item without a letter, digit or
    unit's sign holds nothing to search for. Null and empty texts hold nothing. Rows with equal
    doc_id count as one; a row without one is reported with null. Equal item_ids are one item.

    What passes a filter of fixed size is hash-joined twice: with the windows of classes of items
    that differ in their fillings only, so that a question asked in many versions is judged once for
    each document; and with the items' windows by their fillings too, where every row is a proven
    pair. Only the result lists a class's items one by one.
    """
    small_batches(docs.sparkSession)
    items, classes = _item_windows(benchmark, window)
    found = staged(_candidates(docs, items, window))
    places = staged(_judged_places(found, classes))
    same = found.join(items.withColumnRenamed("at", "item_at"), [*READS, "slots"]).select("doc_id", "item_id", "class", "characters", (F.col("at") - F.col("item_at")).alias("shift"), "at", "length")
    same = staged(same.distinct())
    held = places.withColumnsRenamed({c: f"_{c}" for c in OFFSET})
    equal = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in OFFSET])
    proven = same.select("item_id", *OFFSET).distinct().join(held, equal).select("item_id", *OFFSET, "at", "length", F.lit(False).alias("same"), "fits")
    proven = proven.unionByName(same.withColumns({"same": F.lit(True), "fits": F.lit(True)}))
    proven = proven.groupBy("item_id", *OFFSET, "at").agg(F.max("length").alias("length"), F.bool_or("same").alias("same"), F.bool_or("fits").alias("fits"))
    by_item = _best(proven, "doc_id", "item_id")
    by_class = _best(places.withColumn("same", F.lit(False)), "doc_id", "class").join(items.select("class", "item_id").distinct(), "class").select("doc_id", "item_id", "best")
    return by_item.unionByName(by_class).groupBy("doc_id", "item_id").agg(F.max("best").alias("best")).select("doc_id", "item_id", "best.n_windows", F.col("best.n_tokens").cast("long").alias("n_tokens"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, that hold no item, as leaks() has it; rows without doc_id stay.

    A document goes with the first window that an item fills alike; only the others' windows meet
    the classes of items.
    """
    small_batches(docs.sparkSession)
    items, classes = _item_windows(benchmark, window)
    found = staged(_candidates(docs.where("doc_id is not null"), items, window))
    proven = staged(found.join(items, [*READS, "slots"], "left_semi").select("doc_id").distinct())
    alike = _best(_judged_places(found.join(proven, "doc_id", "left_anti"), classes).withColumn("same", F.lit(False)), "doc_id", "class")
    gone = proven.union(alike.select("doc_id")).distinct().withColumnRenamed("doc_id", "__gone")
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
