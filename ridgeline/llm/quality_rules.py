"""Quality rules as a short-circuit cascade, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, discard, staged, words_of

Of = Callable[[Mapping[str, Column]], Column]


@dataclass(frozen=True)
class Rule:
    """A document fails where `fails`, of text and the measures by name, is true; null counts as false.

    cost: the work of testing one document, in characters that are looked at once.
    """

    name: str
    fails: Of
    cost: Of = lambda m: F.length(m["text"])


def _only(m: Mapping[str, Column], others: str) -> Column:
    """Length of what is left of the text without the characters of the class `others`."""
    return F.length(F.regexp_replace(m["text"], f"[{others}]+", ""))


_ONE = lambda m: F.lit(1)
#: The measures each rule compares are whole numbers, so the verdict does not hang on rounding.
BASE = (
    Rule("short", lambda m: m["n_words"] < 50, _ONE),
    Rule("repeats", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"], lambda m: F.length(m["text"]) + 60 * m["n_words"]),
)
RULES = (
    Rule("symbols", lambda m: 5 * m["n_symbols"] > m["n_words"]),
    Rule("duplicate_lines", lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"], lambda m: 3 * F.length(m["text"])),
    Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"]), _ONE),
    Rule("capitals", lambda m: 2 * _only(m, r"^\p{Lu}") > m["word_chars"]),
    Rule("exclamations", lambda m: 2 * _only(m, "^!?") > m["n_words"]),
    Rule("letters", lambda m: 2 * _only(m, r"^\p{L}") < m["word_chars"]),
    Rule("ellipses", lambda m: 2 * F.regexp_count(m["text"], F.lit("(\\.\\.\\.|…)[\\x20\\x09\\x0D]*(\n|$)")) > m["n_lines"], lambda m: 2 * F.length(m["text"])),
)
#: Rows at most that costs and selectivities are measured on.
SAMPLE_ROWS = 1000

_WORD = r"[^\x20\x09-\x0D]"
#: Measures that most rules compare with; the others are only taken where a rule needs them.
FIRST = ("n_words", "word_chars")


def measures(text: Column) -> dict[str, Column]:
    """Measure -> expression over text, all long. A line counts from its first character that is no white space."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))
    of = {
        "n_words": F.regexp_count(text, F.lit(f"{_WORD}+")),
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")),
        "n_lines": F.regexp_count(text, F.lit(f"{_WORD}[^\n]*")),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeated_words(text),
    }
    return {name: c.cast("long") for name, c in of.items()}


def _let(value: Column, body) -> Column:
    """body of value, which is evaluated once however often body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(text: Column) -> Column:
    """Words of a text that lie in three-word windows found twice or more in it, the first included.

    Windows are compared by 96 bits of hash; only texts in which a 64-bit hash repeats sort them.
    """
    same = lambda x, y: (x["v"] == y["v"]) & (x["k"] == y["k"])

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: F.coalesce(same(x, F.get(s, j + 1)), F.lit(False)) | F.when(j > 0, same(x, F.get(s, j - 1))).otherwise(False))
        gaps = lambda p: F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(_let(F.sort_array(F.transform(twice, lambda x: x["i"])), gaps), F.lit(0).cast("long"), lambda a, x: a + x)

    def of(w: Column) -> Column:
        three = lambda f, i: f(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        positions = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
        ordered = lambda h: F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("v"), three(F.hash, i).alias("k"), i.alias("i"))))
        return _let(F.transform(positions, lambda i: three(F.xxhash64, i)), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _let(ordered(h), covered)).otherwise(F.lit(0).cast("long")))

    return _let(words_of(text), of)


def measured(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long) and base_failed.

    A null text has no word.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumns(measures(F.col("text")))
    return d.withColumn("base_failed", BASE[0].fails(_Columns()) | BASE[1].fails(_Columns()))


class _Columns(dict):
    """Name -> the column of that name."""

    def __missing__(self, name: str) -> Column:
        return F.col(name)


def ordered(sample: DataFrame, rules: tuple[Rule, ...]) -> list[tuple[Rule, float, float]]:
    """The rules by rejections per cost, best first, with (rejected share, cost a row), both of the rows that the rules before left.

    sample holds text and the measures. One job counts the patterns of failed rules and sums each
    rule's cost over their rows, so a rule that rejects what an earlier one has rejected comes
    last. Only speed hangs on the order: a document is kept if it fails none of the rules. Of
    equal rules, and of an empty sample, the order is as given.
    """
    if not rules:
        return []
    m = _Columns()
    fails = F.array(*[F.coalesce(r.fails(m), F.lit(False)) for r in rules])
    patterns = sample.groupBy(fails.alias("failed")).agg(F.count("*").alias("n"), F.array(*[F.sum(r.cost(m).cast("double")) for r in rules]).alias("cost")).collect()  # one row for each row of the sample at most
    left, todo, out = [(p["failed"], p["n"], p["cost"]) for p in patterns], list(range(len(rules))), []
    while todo:
        rows = sum(n for _, n, _ in left)
        share = lambda k: sum(n for f, n, _ in left if f[k]) / max(rows, 1)  # noqa: B023, E731
        cost = lambda k: sum(c[k] for _, _, c in left) / max(rows, 1)  # noqa: B023, E731
        best = max(todo, key=lambda k: (share(k) / max(cost(k), 1e-9), -k))
        out.append((rules[best], share(best), cost(best)))
        todo.remove(best)
        left = [x for x in left if not x[0][best]]
    return out


def first_failed(rules: list[Rule], m: Mapping[str, Column]) -> Column:
    """Name of the first rule in this order that a row fails, else null; later rules, and measures that only they need, are not evaluated."""
    out = F
    for rule in rules:
        out = out.when(F.coalesce(rule.fails(m), F.lit(False)), F.lit(rule.name))
    return out if rules else F.lit(None).cast("string")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, the measures, base_failed, failed_rule, kept; one row for each row of docs.

    Costs and selectivities come from at most about `sample_rows` rows picked by a hash of doc_id.
    Null and empty texts fail the base. An empty table gives an empty result.
    """
    sample = staged(measured(bounded_sample(docs.select("doc_id", "text"), "doc_id", sample_rows)))
    order = [rule for rule, _, _ in ordered(sample.where("not base_failed"), rules)]
    discard(sample)
    # The row number keeps a later filter on the verdict from being pushed into the measures, which would copy them once for each use.
    verdict = F.when(F.col("base_failed"), "base").otherwise(first_failed(order, _Columns()))
    d = measured(docs).withColumn("failed_rule", F.when(F.monotonically_increasing_id() >= 0, verdict))
    return d.drop("text").withColumn("kept", F.col("failed_rule").isNull())


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, all columns, that fail none of the rules; those of the base go first here only if they pay.

    Each measure but FIRST is an expression within the cascade, so a document that an early rule
    rejects costs no more than that rule. Null and empty texts fail the base. Columns keep their
    names, whatever these are; an empty table gives an empty result.
    """
    sample = staged(measured(bounded_sample(docs.select("doc_id", "text"), "doc_id", sample_rows)))
    order = [rule for rule, _, _ in ordered(sample, rules)]
    discard(sample)
    # Other columns get names that clash with nothing. The row number, which no filter is pushed past, keeps the verdict from being copied.
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    text = F.coalesce(f"_{[c.lower() for c in docs.columns].index('text')}", F.lit(""))
    m = measures(text)
    d = plain.select("*", *[m[name].alias(name) for name in FIRST])
    d = d.select("*", first_failed(order, m | {"text": text} | {name: F.col(name) for name in FIRST}).alias("failed"), F.monotonically_increasing_id().alias("row"))
    return d.where("failed is null and row >= 0").drop("failed", "row", *FIRST).toDF(*docs.columns)
