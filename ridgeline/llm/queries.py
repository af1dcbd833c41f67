"""One query for each operator of this subpackage, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, decontaminate, labelled, langid, line_crf, neighbours, quality_rules, runs, simhash, substrings, toxicity, trie, url_filters, warc
from .common import load, words_of
from .url_filters import UrlRule


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.judged(load(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = warc.round_trip(load(spark, sf_dir, "pages"))
    return d.select("page_id", "payload_bytes", F.coalesce("payload_digest", F.raise_error("error")).alias("payload_digest"), "record_type", "refers_to")


#: The fixed rules of op4, and where a page's labels are found: its url names the document it shows.
URL_RULES = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("shown"), F.expr("int(quality = 0 or toxic = 1)").alias("bad"))
    shown = pages.select("url", F.expr(r"try_cast(regexp_extract(url, '/[a-z]+/(\\d+)', 1) as bigint)").alias("shown")).where("shown is not null")
    outcomes = shown.join(labels, "shown").select("url", "bad")
    return url_filters.judged(pages, outcomes, URL_RULES).drop("evidence")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substrings.without_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2(F.array_join(words_of(F.col("text")), " "), 256).alias("kept_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    d = langid.identify(docs, langid.train(docs))
    return d.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    d = line_crf.scored(docs, line_crf.train(docs, load(spark, sf_dir, "labels")))
    return d.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    d = toxicity.scored(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))
    return d.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a tenth of the documents, picked by a hash of doc_id, the words from some word on are replaced by a few of them over and over."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    d = d.withColumn("h", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("w", F.when(F.col("h") % 10 == 0, words_of(F.col("text")))).withColumn("g", F.floor(F.col("h") / 10))
    n = F.size("w")
    d = d.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    planted = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    d = runs.periodic_runs(d.select("doc_id", F.when(n > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text")))
    first = F.get(F.array_sort("runs", lambda x, y: F.when(x["length"] > y["length"], -1).when(x["length"] < y["length"], 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(x["period"] - y["period"]).cast("int")), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period", F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) where each conversation's first h turns are those of the first of its twenty; h is 0 to 3, by a hash of its id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    own = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    own = own.select("conv_id", (F.row_number().over(order) - 1).alias("turn"), "role", "text")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    members = conversations.where("conv_id is not null").select("conv_id").distinct()
    heads = own.where((F.col("conv_id") % 20 == 0) & (F.col("turn") < 3)).withColumnRenamed("conv_id", "base")
    borrowed = members.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), h.alias("h")).join(heads, "base").where("turn < h")
    return own.where(F.col("turn") >= h).unionByName(borrowed.select("conv_id", "turn", "role", "text")), members


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*_rebuilt(load(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_warc, op3_quality_rules, op4_url_filters, op5_substring_dedup, op6_bpe, op7_language_id, op8_line_quality, op9_toxicity, op10_decontamination, op11_neighbours, op12_periodic_runs, op13_prefix_trie)}


#: Words of a text t, as a DuckDB list.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
           FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 5 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 2 * length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) > word_chars
            OR 2 * length(regexp_replace(text, '[^!?]+', '', 'g')) > n_words
            OR 2 * length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) < word_chars
            OR 2 * len(regexp_extract_all(text, '(\.\.\.|…)[\x20\x09\x0D]*(\n|$)')) > n_lines) AS kept
FROM b
"""


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE size >= 100 GROUP BY digest)
SELECT page_id, size::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""

OP4_SQL = rf"""
WITH sx AS (SELECT unnest({list(url_filters.SUFFIXES)}) AS rule),
p AS (SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1)) AS host,
                  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
                  try_cast(regexp_extract(url, '/[a-z]+/(\d+)', 1) AS BIGINT) AS shown FROM pages),
o AS (SELECT host, CAST(quality = 0 OR toxic = 1 AS INT) AS bad FROM p LEFT JOIN labels ON shown = doc_id),
hl AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, regexp_replace(host, ':\d*$', '') AS name FROM o GROUP BY host),
hk AS (SELECT host, unnest(range(1, least(len(string_split(name, '.')), 5) + 1)) AS len, string_split(name, '.') AS l FROM hl),
hs AS (SELECT host, max(len - 1) FILTER (rule = '!' || tail) AS barred, max(len) FILTER (rule = tail OR rule = '*.' || below) AS found
       FROM (SELECT *, array_to_string(l[-len:], '.') AS tail, CASE WHEN len > 1 THEN array_to_string(l[-(len - 1):], '.') END AS below FROM hk) t
       JOIN sx ON rule = tail OR rule = '!' || tail OR rule = '*.' || below GROUP BY host),
h AS (SELECT host, n, k, CASE WHEN ip THEN name ELSE array_to_string(string_split(name, '.')[-(s + 1):], '.') END AS domain,
             CASE WHEN ip THEN 'ip' ELSE array_to_string(string_split(name, '.')[-s:], '.') END AS suffix
      FROM (SELECT hl.*, coalesce(barred, found, 1) AS s, regexp_matches(name, '^(\d+\.){{3}}\d+$|^\[') AS ip FROM hl LEFT JOIN hs ON hl.host = hs.host)),
g AS (SELECT sum(k) / sum(n) AS m FROM h),
su AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM h, g GROUP BY suffix),
s1 AS (SELECT 1 / least(greatest(coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 0.001), 0.999) - 1 AS s FROM su WHERE n > 1),
su2 AS (SELECT suffix, (k + s * m) / (n + s) AS m FROM su, s1),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM h JOIN su2 USING (suffix) GROUP BY domain, suffix),
s2 AS (SELECT 1 / least(greatest(coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 0.001), 0.999) - 1 AS s FROM d WHERE n > 1),
d2 AS (SELECT domain, (k + s * m) / (n + s) AS m FROM d, s2),
h2 AS (SELECT h.host, n, k, m FROM h JOIN d2 USING (domain)),
s3 AS (SELECT 1 / least(greatest(coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 0.001), 0.999) - 1 AS s FROM h2 WHERE n > 1),
b AS (SELECT host, k + s * m AS a, n - k + s * (1 - m) AS b FROM h2, s3),
w AS (SELECT *, pow(b * 0.5, 1.0::DOUBLE / 3) AS u, pow(a * 0.5, 1.0::DOUBLE / 3) AS v FROM b),
r AS (SELECT host, CASE WHEN a <= 0 THEN -99 WHEN b <= 0 THEN 99
             ELSE round(-3 * (u * (1 - 1 / (9 * b)) - v * (1 - 1 / (9 * a))) / sqrt(u * u / b + v * v / a), 6) END AS evidence FROM w),
x AS (SELECT page_id, host, path, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, x.host, path, rule,
       CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN evidence > 1.645 THEN 'block' ELSE 'allow' END AS verdict
FROM x JOIN r ON x.host = r.host
"""


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM h JOIN f USING (h) WHERE doc_id > first),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
k AS (SELECT x.doc_id, count(g.j) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.j) FILTER (WHERE g.j IS NULL), '') AS kept
      FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.j = g.j GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


#: crc32 of the decimal form of a number x.
CRC = "xor(list_reduce(flatten(list_transform(string_split({x}::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0])), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT), 4294967295::BIGINT)"

OP12_SQL = rf"""
WITH o AS (SELECT doc_id, {WORDS} AS w, {CRC.format(x="doc_id")} AS h FROM documents),
s AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN h // 10 % len(w) END AS a FROM o),
t AS (SELECT *, 1 + (len(w) - a) // (3 + h // 10 % 8) AS p FROM s),
d AS (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: w[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END) + 1]) END AS w FROM t),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
e AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND a.i < b.i),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
m AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM m GROUP BY doc_id, start, length),
c AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT x.doc_id, coalesce(string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE c.i IS NULL), '') AS kept FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id),
n AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
             arg_min({{'start': start, 'length': length, 'period': period}}, {{'l': -length, 's': start, 'p': period}}) AS top FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.start::BIGINT AS start, top.length::BIGINT AS length, top.period::BIGINT AS period,
       (1000 * top.length // top.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP13_SQL = rf"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, {CRC.format(x="conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT o.* FROM o JOIN h ON o.conv_id = h.conv_id WHERE i >= h
      UNION ALL SELECT h.conv_id, i, role, text FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20 WHERE i < h),
s AS (SELECT h.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY i) FILTER (WHERE i IS NOT NULL), []) AS s FROM h LEFT JOIN r ON r.conv_id = h.conv_id GROUP BY h.conv_id),
p AS (SELECT conv_id, len(s) AS n, unnest(range(len(s) + 1)) AS depth, s FROM s),
q AS (SELECT conv_id, n, depth, s[:depth] AS prefix FROM p),
m AS (SELECT prefix, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends FROM q GROUP BY prefix),
b AS (SELECT prefix[:depth - 1] AS prefix, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY 1),
w AS (SELECT m.*, coalesce(n_children, 0) AS n_children, CASE WHEN m.depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(m.prefix[m.depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM m LEFT JOIN b ON m.prefix = b.prefix),
u AS (SELECT prefix[:k] AS prefix, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(depth + 1)) AS k FROM w) GROUP BY 1)
SELECT w.conv_id, w.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN u ON w.prefix = u.prefix LEFT JOIN m up ON w.depth > 0 AND up.prefix = w.prefix[:w.depth - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op3_quality_rules": OP3_SQL, "op4_url_filters": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op12_periodic_runs": OP12_SQL, "op13_prefix_trie": OP13_SQL}
