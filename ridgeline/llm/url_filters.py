"""URL filters: fixed rules first, then the reputation of the host by empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged


@dataclass(frozen=True)
class UrlRule:
    """Fits host and its subdomains where the path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Rules for suffixes below which names are registered, in the form of public lists of them: a name, *. for
#: any one label before it, ! for an exception. Without a rule the suffix is the last label. A fuller list is an argument.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw",
    "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "or.jp", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp",
)
#: Labels of the longest suffix.
DEEPEST = 5


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if the url is null or has no ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _last(labels: Column, n: Column) -> Column:
    """The last n labels, or all if there are fewer."""
    many = F.least(F.size(labels), n)
    return F.array_join(F.slice(labels, -many, many), ".")


def with_domain(hosts: DataFrame, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """hosts(host, ...), each host once, with domain, the registered one, and suffix.

    The domain has one label more than the suffix. A name that is no longer than its suffix is its
    own domain; so is an IP address, with the suffix "ip". A port does not count. The rules are a
    table: each host looks up its last one to DEEPEST labels, so any number of rules is one join.
    """
    spark = hosts.sparkSession
    kinds = [("not", r[1:]) if r[:1] == "!" else ("any", r[2:]) if r[:2] == "*." else ("is", r) for r in suffixes]
    rules = spark.createDataFrame(kinds, "kind string, text string").distinct()
    name = F.regexp_replace("host", r":\d*$", "")
    known = hosts.withColumns({"__name": name, "__labels": F.split(name, r"\.")})
    labels, k = F.col("__labels"), F.col("k")
    tails = known.select("host", "__labels", F.explode(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(DEEPEST)))).alias("k"))
    looks = F.array(*[F.struct(F.lit(kind).alias("kind"), text.alias("text"), length.alias("length")) for kind, text, length in (("is", _last(labels, k), k), ("any", F.when(k > 1, _last(labels, k - 1)), k), ("not", _last(labels, k), k - 1))])
    met = tails.select("host", F.explode(looks).alias("l")).select("host", "l.*").join(rules, ["kind", "text"])
    longest = met.groupBy("host").agg(F.coalesce(F.max(F.when(F.col("kind") == "not", F.col("length"))), F.max(F.when(F.col("kind") != "not", F.col("length")))).alias("__length"))
    length, ip = F.coalesce("__length", F.lit(1)), F.col("__name").rlike(r"^(\d+\.){3}\d+$|^\[")
    out = known.join(longest, "host", "left")
    return out.select(*hosts.columns, F.when(ip, F.col("__name")).otherwise(_last(labels, length + 1)).alias("domain"), F.when(ip, F.lit("ip")).otherwise(_last(labels, length)).alias("suffix"))


def longest_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits, else null. The rules are a short list; equal lengths: the first."""
    text = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = (F if text is None else text).when(fits, F.lit(r.text))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(r.verdict))
    return (text, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _spread(units: DataFrame) -> float:
    """Prior strength s of units(n, k, m), by moments: k of n with mean m varies as n m (1 - m) (1 + (n - 1) / (s + 1))."""
    over, room = F.expr("(k - n * m) * (k - n * m) - n * m * (1 - m)"), F.expr("n * (n - 1) * m * (1 - m)")
    row = units.where("n > 1").agg(F.sum(over).alias("over"), F.sum(room).alias("room")).first()
    rho = (row["over"] / row["room"]) if row["room"] else 0.0
    rho = min(max(rho, 1e-3), 0.999)
    return 1 / rho - 1


def evidence(a: str, b: str, above: float) -> Column:
    """Normal deviate of the posterior probability that a share with posterior Beta(a, b) lies over `above`.

    By the cube roots of the two gamma variates, which is within 0.01 of the probability from a + b
    of 2 on; a mean and deviation alone would be far off where few labels are known. Without any
    mass for bad (a = 0) or good (b = 0) outcomes it is -99 or 99.
    """
    x, y = F.pow(F.col(b) * above, F.lit(1 / 3)), F.pow(F.col(a) * (1 - above), F.lit(1 / 3))
    z = 3 * (x * (1 - 1 / (9 * F.col(b))) - y * (1 - 1 / (9 * F.col(a)))) / F.sqrt(x * x / F.col(b) + y * y / F.col(a))
    return F.when(F.col(a) <= 0, F.lit(-99.0)).when(F.col(b) <= 0, F.lit(99.0)).otherwise(-z)


def host_reputation(outcomes: DataFrame, above: float = 0.5, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """outcomes(host, bad 0/1 or null) -> (host, n, k, mean, evidence) for every host: the posterior of its bad share.

    Beta-binomial all the way down: the share of all labelled pages is the prior of each suffix,
    a suffix's posterior mean that of its registered domains, a domain's that of its hosts; the
    prior's strength is estimated at each level. A host with no label has its domain's posterior.
    Without any label the mean is 0.
    """
    hosts = staged(with_domain(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k")), suffixes))
    domains = staged(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    over_all = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = domains.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = total["k"] / total["n"] if total["n"] else 0.0

    def posterior(units: DataFrame) -> DataFrame:
        s = _spread(units)
        return units.withColumn("a", F.col("k") + F.lit(s) * F.col("m")).withColumn("b", F.col("n") - F.col("k") + F.lit(s) * (1 - F.col("m")))

    level = posterior(over_all.withColumn("m", F.lit(mean)))
    level = posterior(domains.join(level.select("suffix", F.expr("a / (a + b)").alias("m")), "suffix"))
    level = posterior(hosts.join(level.select("domain", F.expr("a / (a + b)").alias("m")), "domain"))
    return level.select("host", "n", "k", F.expr("a / (a + b)").alias("mean"), evidence("a", "b", above).alias("evidence"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: tuple[UrlRule, ...], block_above: float = 0.5, z: float = 1.645, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, evidence; one row for each row of pages.

    outcomes(url, bad) has labelled pages, bad being 0 or 1; null outcomes are skipped. The longest
    rule that fits decides; else a page is blocked where its host's bad share lies above
    `block_above` with the confidence of z, so only on clear evidence, which is taken at six
    decimals. A null url, or one without ://, has empty host and path, and is judged like any
    other host. Repeated rows count as often as they occur; other columns change nothing; an
    empty table gives an empty result.
    """
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.select(host_of(F.col("url")).alias("host"), F.col("bad").cast("int").alias("bad")).where("bad is not null")
    every = known.unionByName(p.select("host", F.lit(None).cast("int").alias("bad")))
    scores = host_reputation(every, block_above, suffixes).select("host", F.round("evidence", 6).alias("evidence"))
    text, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("evidence") > z, "block").otherwise("allow")
    return p.join(scores, "host", "left").select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "evidence")
