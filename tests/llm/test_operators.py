"""The operators on small fixtures with nulls, empty and long texts, ties, repeated rows and empty tables, against brute force."""

import hashlib
import math
import random
import re
import time
import tracemalloc
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ridgeline.llm import bpe, common, components, decontaminate, labelled, langid, line_crf, quality_rules, simhash, substrings, toxicity, url_filters, warc
from ridgeline.llm.components import connected_components
from ridgeline.llm.hashing import window_digests, word_digests
from ridgeline.llm.queries import URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def corpus():
    passage, base = words(70, 1), words(200, 2)
    texts = [base, base, base.replace("a", "b", 1), words(80, 3) + "\n" + passage + " " + words(60, 4), words(90, 5) + " " + passage, None, "", "  \n", "x", "the " * 300, words(5000, 6), "Ünï 日本 <|endoftext|> 12", base + " " + words(3, 7)]
    rows = [(i, t, "en", "s", len(t or ""), "k") for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, base, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


def test_simhash_against_brute_force(spark, docs):
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    fp = {i: simhash.simhash(t) for i, t, *_ in corpus() if i is not None}
    group = {i: {i} for i in fp}
    for i in fp:
        for j in fp:
            if (fp[i] ^ fp[j]).bit_count() <= 2 and group[i] is not group[j]:
                group[i] |= group[j]
                for k in group[i]:
                    group[k] = group[i]
    assert sorted(got, key=str) == sorted([(i, f"{simhash.simhash(t):016x}", min(group[i]) if i is not None else 0) for i, t, *_ in corpus()], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def similar(texts, least=0.8):
    """id -> smallest id that links of a Jaccard similarity of `least` or more reach."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if j < i and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def test_similar_groups_against_brute_force(spark, docs):
    want = similar({i: t for i, t, *_ in corpus() if i is not None})
    assert sorted(map(tuple, simhash.similar_groups(docs).collect()), key=str) == sorted([(i, want.get(i, 0)) for i, *_ in corpus()], key=str)
    kept = simhash.first_of_group(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, x in want.items() if i == x} | {None}
    assert simhash.similar_groups(docs.limit(0)).count() == simhash.first_of_group(docs.limit(0)).count() == 0


def test_families_of_near_copies(spark):
    r, texts = random.Random(8), []
    for family in range(3):
        base = words(150, 50 + family).split()
        for _ in range(80):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += [words(120, 200 + k) for k in range(40)]
    r.shuffle(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(d).collect()} == similar(dict(enumerate(texts)))


def join_rows(spark, keys, since):
    """Rows out of each inner join on these keys, in executions from `since` on."""
    store, out = spark._jsparkSession.sharedState().statusStore(), []
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    for i in range(since, store.executionsCount()):
        e = store.executionsList(i, 1).apply(0).executionId()
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for k in range(nodes.size()):
            if re.search(rf"Join \[{keys}#\d+L?\], \[{keys}#\d+L?\], Inner", nodes.apply(k).desc()):
                m = nodes.apply(k).metrics()
                found = [values.get(m.apply(j).accumulatorId()) for j in range(m.size()) if m.apply(j).name() == "number of output rows"]
                out += [int(v.get().replace(",", "")) for v in found if v.isDefined()]
    return out


def test_joins_on_nodes_have_a_row_a_text(spark):
    r, base = random.Random(12), words(60, 90).split()
    texts = []
    for _ in range(150):  # pairs lie under 0.8, and their segments meet often
        w = list(base)
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        texts.append(" ".join(w))
    d, since = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(d).collect()} == similar(dict(enumerate(texts)))
    rows = join_rows(spark, "node", since)
    assert rows and max(rows) <= len(texts)


def test_large_buckets_link_exactly(spark):
    r = random.Random(4)
    fps = sorted({r.getrandbits(64) ^ 0 if k % 9 == 0 else (0xABCDEF << 32) ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 4))) for k in range(500)})
    signed = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)]
    d = spark.createDataFrame(signed, "fp long, node long")
    root = {i: i for i in range(len(fps))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    for cap in (4, 10**6):
        got = {r["node"]: r["root"] for r in connected_components(simhash.near_links(d, cap=cap)).collect()}
        assert all(got.get(i, i) == find(i) for i in range(len(fps)))


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "u long, v long")
    assert {(r["node"], r["root"]) for r in connected_components(e).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_components_take_few_rounds_in_any_order_of_ids(spark, monkeypatch):
    """A chain whose ids ascend would take as many rounds as nodes if ids decided who joins whom."""
    rounds, real = [], components.discard
    monkeypatch.setattr(components, "discard", lambda *t: (rounds.append(1), real(*t)))
    n = 3000
    got = connected_components(spark.range(n - 1).selectExpr("id as u", "id + 1 as v"))
    assert got.where("root = 0").count() == n and len(rounds) <= 16


def test_warc_round_trip(spark):
    big = "<p>é" * 100
    rows = [(1, "http://a/ b", big), (0, None, big), (2, "u", "short"), (3, "u", "short"), (4, "u", None), (None, "u", big), (7, "u", "")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["error"]) for r in warc.round_trip(pages).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        again = html == big and i != 0
        assert got[i] == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 0 if again else None, None)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_archives_are_spread(spark):
    listing = spark.range(40).selectExpr("concat('file:/none/', id) as path")
    assert warc.read_archives(listing).rdd.getNumPartitions() == 40


def test_warc_through_spark_alone(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://x/{k}", words(50, k % 3)) for k in range(30)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    listed = warc.write_archives(warc.with_revisits(pages), folder)
    one = sorted(map(repr, warc.read_archives(listed).collect()))
    assert one == sorted(map(repr, warc.read_files(spark, f"{folder}/*.zst").collect())) and len(one) == 30
    (tmp_path / "w" / "bad.warc.zst").write_bytes(b"no archive at all")
    assert warc.read_files(spark, f"{folder}/*.zst").where("error is not null").count() == 1


def test_warc_dictionary_and_damage():
    w = warc.ArchiveWriter()
    records = [warc.record_bytes(i, "http://x/", t.encode(), hashlib.sha256(t.encode()).hexdigest(), len(t.encode()), None, "2000-01-01T00:00:00Z") for i, t in ((i, words(200, i % 7)) for i in range(600))]
    for r in records:
        w.add(r)
    archive = w.close()
    assert int.from_bytes(archive[:4], "little") == warc.DICTIONARY_FRAME and list(warc.frames(archive)) == records
    for bad in (archive[:-3], archive + b"abc"):
        with pytest.raises(ValueError):
            list(warc.frames(bad))
    for bad in (records[0][:-5], records[0].replace(b"WARC-Type", b"WARC-Tipe"), records[0].replace(b"\r\n\r\n" + records[0][-9:-4], b"\r\n\r\n.....")):
        with pytest.raises(ValueError):
            warc.parse_record(bad[:-1] if bad == records[0] else bad)


def brute_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {j for i, x in enumerate(g) if g.count(x) > 1 for j in range(i, i + 3)} if len(g) < 1000 else None
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), None if covered is None else len(covered)


def test_quality_rules(spark, docs):
    extra = "a b c a b c\na b c\n#x |\n#x |\n"
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50, extra)], "doc_id long, text string"))
    for r in quality_rules.judged(d).collect():
        want = brute_rules(extra if r["doc_id"] == 50 else next(t for i, t, *_ in corpus() if i == r["doc_id"]))
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got[: 4 + (want[4] is not None)] == want[: 4 + (want[4] is not None)]
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in quality_rules.judged(d).where("kept").collect()}
    assert {r["doc_id"] for r in quality_rules.kept_documents(docs).collect()} == kept - {50}
    assert quality_rules.judged(docs.limit(0)).count() == 0 and quality_rules.kept_documents(docs).columns == docs.columns


def test_order_of_the_rules(spark):
    """By rejections per cost among what the rules before have left: a rule that only repeats another comes late."""
    d = spark.createDataFrame([(f"{k % 2}{int(k % 10 < 3)}",) for k in range(100)], "text string")
    at = lambda k: lambda m: F.substring(m["text"], k, 1) == "1"
    cost = lambda c: lambda m: F.lit(c)
    a, b, c = quality_rules.Rule("half", at(1), cost(1)), quality_rules.Rule("again", at(1), cost(2)), quality_rules.Rule("other", at(2), cost(9))
    found = quality_rules.ordered(d, (c, b, a))
    assert [r.name for r, _, _ in found] == ["half", "other", "again"]
    assert [(round(share, 2), one) for _, share, one in found] == [(0.5, 1.0), (0.4, 9.0), (0.0, 2.0)]
    assert quality_rules.ordered(d.limit(0), (c, b, a))[0][0].name == "other" and quality_rules.ordered(d, ()) == []


def test_rules_by_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, words(60, 1), 1, "a", 2, 3), (2, "short", 1, "b", 2, 3), (3, None, 1, "c", 2, 3)], "doc_id long, text string, n_words int, failed string, row int, _0 int")
    assert [tuple(r) for r in quality_rules.kept_documents(d).collect()] == [tuple(d.first())]


def test_suffixes_and_addresses(spark):
    hosts = {"a.b.example.co.uk": "example.co.uk", "example.com:8080": "example.com", "co.uk": "co.uk", "x.y.ck": "x.y.ck", "z.x.y.ck": "x.y.ck", "a.www.ck": "www.ck", "127.0.0.1:80": "127.0.0.1", "localhost": "localhost", "": ""}
    d = spark.createDataFrame([(h, 1) for h in hosts], "host string, k int")
    got = {r["host"]: (r["domain"], r["suffix"]) for r in url_filters.with_domain(d).collect()}
    assert {h: d for h, (d, _) in got.items()} == hosts
    assert got["a.b.example.co.uk"][1] == "co.uk" and got["127.0.0.1:80"][1] == "ip" and got["a.www.ck"][1] == "ck"


def test_a_list_of_suffixes_as_long_as_the_public_one(spark):
    rules = [f"{a}{b}.tld{b % 97}" for a in "abcdefghij" for b in range(1000)] + ["*.z", "!y.z"]
    d = url_filters.with_domain(spark.createDataFrame([("p.q.a7.tld7",), ("q.x.z",), ("q.y.z",)], "host string"), rules)
    began = time.perf_counter()
    d._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - began < 5  # on a busy machine; it does not grow with the list
    assert {r["host"]: r["domain"] for r in d.collect()} == {"p.q.a7.tld7": "q.a7.tld7", "q.x.z": "q.x.z", "q.y.z": "y.z"}


def test_posterior_evidence(spark):
    """Against the beta density, summed up."""
    d = spark.createDataFrame([(a, b) for a in (0.8, 1.5, 4.0, 30.0) for b in (0.6, 2.0, 9.0)], "a double, b double").withColumn("z", url_filters.evidence("a", "b", 0.5))
    x = (np.arange(200000) + 0.5) / 200000
    for r in d.collect():
        density = x ** (r["a"] - 1) * (1 - x) ** (r["b"] - 1)
        assert 0.5 * (1 + math.erf(r["z"] / math.sqrt(2))) == pytest.approx(density[x > 0.5].sum() / density.sum(), abs=0.02)
    edge = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0)], "a double, b double").select(url_filters.evidence("a", "b", 0.5).alias("z")).collect()
    assert [r["z"] for r in edge] == [-99, 99]


def test_url_filters_with_repeated_rows_and_other_columns(spark):
    pages = spark.createDataFrame([(1, "http://bad.org/x", 0, "h"), (1, "http://bad.org/x", 0, "h"), (2, None, 0, "h")], "page_id long, url string, bad int, host string")
    outcomes = spark.createDataFrame([("http://bad.org/", 1, "p")] * 60 + [("http://good.org/", 0, "p")] * 60, "url string, bad int, path string")
    assert sorted((r["page_id"], r["verdict"]) for r in url_filters.judged(pages, outcomes, ()).collect()) == [(1, "block"), (1, "block"), (2, "allow")]


def test_url_filters(spark):
    urls = ["http://EXAMPLE.com/en/1?x", "https://www.example.com/en/", "http://a.net/es/#f", "http://bad.org/x", "http://good.org/y", None, "no scheme", "x://h", "http://net/fr/z"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([("http://bad.org/", 1)] * 60 + [("http://good.org/", 0)] * 60 + [("http://none.org/", None)], "url string, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judged(pages, outcomes, URL_RULES).collect()}
    assert got[0] == ("example.com", "/en/1", "example.com/en/", "block") and got[1][2:] == ("www.example.com/en/", "allow")
    assert got[2][2] == "net/es/" and got[8] == ("net", "/fr/z", "net/fr/", "block")
    assert got[3][3] == "block" and got[4][3] == "allow" and got[5] == got[6] == ("", "", None, "allow") and got[7][:2] == ("h", "")
    assert url_filters.judged(pages.limit(0), outcomes.limit(0), URL_RULES).count() == 0


def brute_repeats(rows):
    w = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    first = {}
    for i, x in w:
        for p in range(len(x) - 49):
            if i is not None:
                first[tuple(x[p : p + 50])] = min(i, first.get(tuple(x[p : p + 50]), i))
    out = []
    for i, x in w:
        gone = {j for p in range(len(x) - 49) if i is not None and first[tuple(x[p : p + 50])] < i for j in range(p, p + 50)}
        out.append((i, len(x), len(gone), [v for j, v in enumerate(x) if j not in gone]))
    return out


def test_substrings_against_brute_force(spark, docs):
    got = [(r["doc_id"], r["__n_words"], r["__n_removed"], (r["text"] or "").split()) for r in substrings.without_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_repeats(corpus()), key=str)
    assert substrings.without_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_equal_windows_have_equal_keys(seed):
    """Whatever is around a window, its key is the same, and each window gets one in just one round."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range((1, 2, 3, 5, 40, 1000)[seed])]
    shared = [r.choice(vocabulary) for _ in range(50)]
    texts = [[*(r.choice(vocabulary) for _ in range(r.randint(0, 60))), *shared, *(r.choice(vocabulary) for _ in range(r.randint(0, 60)))] for _ in range(20)]
    sizes, every = np.array([len(t) for t in texts]), [w.encode() for t in texts for w in t]
    level, salt, keys = substrings.word_level(sizes, word_digests(every)[:, 0].copy()), 0, {}
    for k, kinds in enumerate(substrings.ROUNDS):
        level, starts, key, _ = substrings._steps(level, kinds, salt, sizes, 50, k == len(substrings.ROUNDS) - 1)
        salt += len(kinds)
        assert not keys.keys() & set(starts.tolist())
        keys.update(zip(starts.tolist(), key.tolist(), strict=True))
    assert len(keys) == (sizes - 49).sum()
    digests, seen = window_digests(word_digests(every), 50), {}
    for p, k in keys.items():
        assert seen.setdefault(tuple(every[p : p + 50]), (k, *digests[p])) == (k, *digests[p])
    assert len({v[1:] for v in seen.values()}) == len(seen)


def test_windows_of_a_batch_are_hashed_at_once(monkeypatch):
    texts = ["", words(49, 1), words(50, 2), None, words(90, 3), words(90, 3) + " " + words(60, 4), " x " * 70, ""]
    own = [window_digests(word_digests((t or "").encode().split()), 50).view(np.int64) for t in texts]
    calls, ids = [], pa.array(range(len(texts)), pa.int64())
    monkeypatch.setattr(substrings, "window_digests", lambda w, n: calls.append(n) or window_digests(w, n))
    all_of = [[{"first": 0, "last": len(d) - 1}] if len(d) else [] for d in own]
    stretches = pa.array(all_of, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
    (found,) = substrings._windows(50)(iter([pa.RecordBatch.from_arrays([ids, pa.array(texts), stretches], ["doc_id", "text", "s"])]))
    assert [set(zip(a, b, strict=True)) for a, b in zip(found["h1"].to_pylist(), found["h2"].to_pylist(), strict=True)] == [{*map(tuple, d.tolist())} for d in own]
    whole = word_digests([b" ".join(texts[5].encode().split())]).view(np.int64)
    listed = [None, None, own[2][:1], None, own[5][:2], whole, np.concatenate([own[2], own[6][:1]]), None]  # 4 starts as 5 does
    lists = [pa.array([None if x is None else x[:, k].tolist() for x in listed], pa.list_(pa.int64())) for k in (0, 1)]
    (left,) = substrings._removed(50, 1, None)(iter([pa.RecordBatch.from_arrays([ids, pa.array(texts), *lists], ["doc_id", "text", "h1", "h2"])]))
    assert left.column(2).to_pylist() == [0, 49, 50, 0, 90, 150, 70, 0] and left.column(3).to_pylist() == [0, 0, 50, 0, 51, 150, 70, 0]
    assert left["text"].to_pylist()[3] is None and left["text"].to_pylist()[4].split() == texts[4].split()[51:]
    assert len(calls) == 2


def test_sequences_that_polynomial_hashes_confuse(spark):
    """Thue and Morse's sequence and its complement have equal polynomial hashes modulo 2**64, whatever the odd base."""
    bits = [k.bit_count() & 1 for k in range(1024)]
    around = words(30, 1), words(30, 2)
    texts = [" ".join([around[k], *("yes" if b == k else "no" for b in bits), around[1 - k]]) for k in (0, 1)]
    rows = [(k + 1, t) for k, t in enumerate(texts)]
    got = [(r["doc_id"], r["__n_words"], r["__n_removed"], (r["text"] or "").split()) for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == brute_repeats(rows)


def test_substrings_leave_what_is_read_no_more(spark, docs, monkeypatch):
    """Symbols go once they are named anew, windows to verify once they are, and a written table's shuffle files with its query."""
    dirs = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: {f.name for d in dirs for f in Path(d).rglob("shuffle_*.data")}
    made, seen, real, old = [], [], substrings.staged, shuffles()

    def staged(df, *more, **options):
        made.append(real(df, *more, **options))
        end = time.time() + 10
        while shuffles() - old and time.time() < end:  # executors are asked to, not waited for
            time.sleep(0.05)
        seen.append((df.columns, [d.columns for d in made if d in common._folders], shuffles() - old))
        return made[-1]

    monkeypatch.setattr(substrings, "staged", staged)
    substrings.repeats(docs.select("doc_id", "text"))
    assert max(sum("sym" in c for c in alive) for _, alive, _ in seen) == 2
    assert [sum("sym" in c for c in alive) for columns, alive, _ in seen if "stretches" in columns] == [0]
    assert not any("stretches" in c for c in seen[-1][1])
    assert not any(left for *_, left in seen)
    assert [d for d in made if d in common._folders] == made[-1:]


def test_substrings_with_clashing_columns(spark):
    same = words(60, 9)
    d = spark.createDataFrame([(1, same, 5, 6, 7), (2, same, 5, 6, 7)], "doc_id long, text string, __id int, h1 int, __n_words int")
    got = substrings.without_repeats(d)
    assert got.columns == ["doc_id", "text", "__id", "h1", "__n_words", "__n_removed"]
    assert sorted(map(tuple, got.select("doc_id", "__id", "h1", "__n_words", "__n_removed").collect())) == [(1, 5, 6, 60, 0), (2, 5, 6, 60, 60)]


def test_bpe_is_the_library(spark, docs):
    t = Tokenizer.from_file(PATH)
    r = random.Random(2)
    texts = ["".join(r.choice(["a", " ", "\n", "é", "1", "'s", "!", "<|endoftext|>", "\x1c", "\x85", "日", "😀", "the", "  "]) for _ in range(r.randint(0, 50))) for _ in range(500)] + ["ab" * 4000, " " * 3000, "x" * 5000]
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids
        assert bpe.encode_text(x, PATH).tolist() == ids and bpe.decode_ids(np.array(ids), PATH) == t.decode(ids, skip_special_tokens=False)
    assert 0 < bpe.tokenizer(PATH)[0].lookahead < 1000
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.round_trip(docs, PATH).collect()}[5] == 0
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_bpe_encodes_new_pieces_together(monkeypatch):
    t = Tokenizer.from_file(PATH)
    r = random.Random(3)
    letters = ["a", "e", "th", "ing", "é", "ß", "я", "日", "😀", "1", "!", "'", "\x00", "\n", "\x85", "<|endoftext|>"]
    texts = [" ".join("".join(r.choices(letters, k=r.randint(1, 12))) for _ in range(n)) for n in [3000, *[40] * 100]] + [None, "", "😀" * 32, "<|endoftext|>" * 3]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    for remembered, chars in ((bpe.REMEMBERED, bpe.STRETCH), (500, 20000)):
        monkeypatch.setattr(bpe, "REMEMBERED", remembered), monkeypatch.setattr(bpe, "STRETCH", chars)
        bpe.tokenizer.cache_clear()
        made = []
        monkeypatch.setattr(bpe.Bpe, "together", lambda self, pieces, old=bpe.Bpe.together: made.append(len(pieces)) or old(self, pieces))
        assert [x.tolist() for x in bpe.encode_texts(texts, PATH)] == want
        assert len(made) > (remembered == 500) and min(made) >= bpe.MANY
    bpe.tokenizer.cache_clear()


def test_bpe_cost_of_new_pieces():
    """A corpus goes on bringing words that no text before had; one by one they cost most of the encoder's time."""
    r = random.Random(4)
    text = "".join(" " + "".join(r.choices("abcdefghiklmnoprstu", k=r.randint(5, 14))) for _ in range(20000))
    bpe.tokenizer.cache_clear()
    one = bpe.tokenizer(PATH)[0]
    at = time.process_time()
    want = [i for x in bpe.PATTERN.findall(text) for part in one.stream(x.encode()) for i in part]
    one_by_one = time.process_time() - at
    bpe.tokenizer.cache_clear()
    bpe.tokenizer(PATH)
    at = time.process_time()
    got = bpe.encode_text(text, PATH).tolist()
    assert got == want and time.process_time() - at < one_by_one / 2


def test_language(spark, docs):
    model = langid.fit([words(60, k) if k % 2 else words(60, k).upper().translate(str.maketrans("ABCDEFGH", "stuvwxyz")) for k in range(80)], ["ab" if k % 2 else "st" for k in range(80)])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}
    assert got[5] == got[6] == got[7] == ("und", 0.0) and got[10][0] == "ab" and 0 <= got[10][1] <= 1
    assert langid.train(docs.limit(0)).predict("abc")[0] == "und"


def test_language_against_plain_python():
    """The scores of a text are the means over its hashed n-grams of three and four bytes."""
    model = langid.fit([words(60, k) for k in range(40)], ["ab" if k % 2 else "st" for k in range(40)])
    text, m = "Abc, déf 12 gh", (1 << 32) - 1
    data = b" " + text.encode().translate(langid.FOLD) + b" "
    grams = []
    for p in range(len(data) - 2):
        h = (data[p] * 0x9E3779B1 & m) ^ (data[p + 1] * 0x85EBCA77 & m) ^ (data[p + 2] * 0xC2B2AE3D & m)
        grams.append((h * 0x27D4EB2F & m) >> 16)
        if p + 3 < len(data):
            grams.append(((h ^ (data[p + 3] * 0x165667B1 & m)) * 0x2545F491 & m) >> 16)
    assert model.logits(text) == pytest.approx(np.mean([model.scores[g] for g in grams], axis=0) + model.bias, abs=1e-5)


def test_toxicity_against_plain_compression():
    """Hits are the words that zstandard stores short with one dictionary and longer with the other, without any memory of words."""
    good = [words(60, k) for k in range(60)]
    model = toxicity.fit([(t, 0) for t in good] + [(t + " zzqrude xxvile " + t, 1) for t in good[:20]])
    size = lambda d, w: len(toxicity._compressor(d).compress(toxicity._bounded(w) + toxicity.CARRIER))
    text = words(40, 77) + " Zzqrude! " + words(5, 78)
    hits = sum(size(model.toxic, w) <= model.longest and size(model.ordinary, w) - size(model.toxic, w) >= model.saving for w in toxicity.windows(text))
    assert hits == 1 and model.features(text).tolist() == [1, pytest.approx(math.log(2)), pytest.approx(46**-0.5)]


def test_classifiers_on_empty_tables(spark, docs):
    none = docs.limit(0)
    assert langid.identify(none, langid.fit([], [])).count() == line_crf.scored(none, line_crf.fit([])).count() == toxicity.scored(none, toxicity.fit([])).count() == 0


def test_line_quality_and_toxicity(spark, docs):
    good, bad = [words(60, k) for k in range(60)], [" ".join(f"{w}!!" for w in words(60, k).upper().split()) for k in range(60)]
    crf = line_crf.fit([(t, 1) for t in good] + [(t, 0) for t in bad])
    assert crf.score(words(60, 99)) > 0.9 and crf.score(bad[0]) < 0.1 and 0 <= crf.score(None) <= 1
    one = line_crf.Crf(np.array([0.7]), (0.4, 0.9))
    x = np.ones((4, 1))
    every = {s: np.exp(sum(s) * 0.7 + sum((0.4, 0.9)[a] for a, b in zip(s, s[1:]) if a == b)) for s in np.ndindex(2, 2, 2, 2)}
    assert one.marginals(x) == pytest.approx([sum(v for s, v in every.items() if s[i]) / sum(every.values()) for i in range(4)])
    tox = toxicity.fit([(t, 0) for t in good] + [(t + " zzqrude " + t, 1) for t in good[:20]])
    assert tox.score(words(50, 98) + " zzqrude") > 0.5 > tox.score(words(50, 98)) and tox.score(None) < 0.5
    assert line_crf.scored(docs, crf).count() == toxicity.scored(docs, tox).count() == len(corpus())
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert line_crf.train(docs, labels).score("x") == 0.5 and labelled.training_rows(docs, labels, "toxic") == []


def test_decontamination(spark):
    bench = spark.createDataFrame([(0, "A train leaves Paris with 12 cars and 30 people while Bob waits for 12 km near the old station"), (1, None), (2, "too short"), (3, "")], "item_id long, text string")
    texts = [
        "before it A train leaves Paris with 12 cars and 30 people while Bob waits for 12 km near the old station and more",
        "so A train leaves Rome with 15 cars and 44 people while Eve waits for 15 km near the old station",
        "so A train leaves Rome with 15 cars and 15 people while Eve waits for 99 km near the old station",
        words(50, 1), None, "",
    ]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(0, texts[0], 1, 2)], "doc_id long, text string, item_id int, name int")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, bench).collect()} == {(0, 0), (1, 0)}
    assert {r["doc_id"] for r in decontaminate.clean_documents(d, bench).collect()} == {2, 3, 4, 5}
    assert decontaminate.leaks(d.limit(0), bench).count() == decontaminate.leaks(d, bench.limit(0)).count() == 0


def test_a_question_in_many_versions_is_judged_once_for_each_document(spark):
    text = lambda i: f"on monday the farmer in the valley sold {i} sheep and bought {2 * i + 1} hens for the old barn near the river"
    bench = spark.createDataFrame([(i, text(i)) for i in range(30)] + [(99, "a question of another kind with seven words and 8 more of them here")], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"it is said that {text(i + 20)} and so on") for i in range(25)], "doc_id long, text string")
    items, classes = decontaminate._item_windows(bench, decontaminate.WINDOW)
    assert classes.select("class").distinct().count() == 2
    places = decontaminate._judged_places(decontaminate._candidates(docs, items, decontaminate.WINDOW), classes)
    assert places.count() <= 25 * len(text(0).split())
    assert {tuple(r)[:2] for r in decontaminate.leaks(docs, bench).collect()} == {(d, i) for d in range(25) for i in range(30)}
    assert decontaminate.clean_documents(docs, bench).count() == 0


def test_decontamination_in_capitals(spark):
    text = "the old train leaves Paris near the straße with 12 cars while people wait there for the other one to come"
    bench = spark.createDataFrame([(0, text)], "item_id long, text string")
    texts = ["SO " + text.upper() + " NOW", "So " + text.title(), text.upper().replace("12", "77"), text.upper().replace("THE", "SOME").replace("FOR", "UNTIL").replace("PEOPLE", "MEN")]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in decontaminate.leaks(d, bench).collect()} == {0, 1, 2}


def test_decontamination_with_a_slot_astray(spark):
    story = "the old train leaves Paris with 12 cars while people wait there for the other one to come and {} more who had seen it leave in the rain went home again"
    fruit = "so the farmer sold {} apples and {} pears to the man who came by"
    long = "first we take {} of these and put them on the table then we take {} of those and leave them under it for the whole night before we take {} more out of the box and put them into {} bags that nobody has seen since the last summer when it was so hot"
    bench = spark.createDataFrame([(0, story.format(12)), (1, fruit.format(3, 4)), (2, long.format(7, 7, 7, 9))], "item_id long, text string")
    texts = [story.format(13), fruit.format(5, 5), long.format(8, 8, 21, 6), long.format(8, 31, 21, 6)]
    d = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[0])], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, bench).collect()} >= {(0, 0), (None, 0), (1, 1), (2, 2)}
    twice = spark.createDataFrame([(0, "so A train leaves with 12 cars and 12 people while it waits for 12 days")], "item_id long, text string")
    mixed = spark.createDataFrame([(0, "so A train leaves with 15 cars and 16 people while it waits for 17 days")], "doc_id long, text string")
    assert decontaminate.leaks(mixed, twice).count() == 0


def test_decontamination_of_items_without_templates(spark):
    names = "Barack Obama met Angela Merkel, Emmanuel Macron and Boris Johnson in Berlin, Paris and London"
    chinese = "请问中华人民共和国的首都在哪里以及它有多少人口和多大的面积"
    items = ["What is 12 + 30 ?", names, "1 2 3 4 5 6 7 8 9 10 11", chinese, "日本の首都は?", "Quokka", "?!"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [
        "They ask: what is 12 + 30? And again: what is 12 + 30?", "Yes. " + names + " again", "so 0 1 2 3 4 5 6 7 8 9 10 12", "他问我:" + chinese[2:22] + "。好", "ここで日本の首都は東京", "a quokka, QUOKKA",
        "What is 12 + 31 ?", "quokkas 中华人民共和国 ?! 1 2 3", "日本の 首都", chinese[:10] + "x" + chinese[10:20], None,
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {tuple(r) for r in decontaminate.leaks(d, bench).select("doc_id", "item_id").collect()} == {(i, i) for i in range(6)}


def test_pipeline_of_nothing(spark, docs):
    d = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, "/root/testdata/sf0.001")
        assert d.count() == 0, name


def test_pipeline_keeps_columns(spark, docs):
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, "/root/testdata/sf0.001")
        assert d.columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, d, "").columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_tokenizer_tables_are_small():
    """Each worker process holds them, two on an executor of two cores."""
    tracemalloc.start()
    made = bpe.tokenizer.__wrapped__(PATH)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert made[0].rank and held < 40e6


def test_worker_remembers_one_operator_at_a_time():
    texts = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([words(60, 20), words(60, 21)])], ["doc_id", "text"])
    list(decontaminate._search(None, 8, None)(iter([texts])))
    assert len(decontaminate._known) > 60
    list(decontaminate._search(None, 8, None)(iter([texts.slice(0, 1)])))
    assert len(decontaminate._known) > 60  # the next task of the same operator goes on with it
    list(substrings._first_round(50, ("runs", "pairs"), True)(iter([texts])))
    assert len(decontaminate._known) == 0
