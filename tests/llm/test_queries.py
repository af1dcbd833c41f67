"""The registered queries and the pipeline over whole tables: against SQL, plain Python, the tokenizers library or held-out labels."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ridgeline.llm import decontaminate, queries

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def items(spark):
    return {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}


def kept_by_rules(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(zip(words, words[1:], words[2:]))
    repeated = {j for i, g in enumerate(zip(words, words[1:], words[2:])) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    n, chars = len(words), sum(map(len, words))
    if n < 50 or 100 * len(repeated) > 50 * n:
        return False
    count = lambda p: len(regex.findall(p, text))
    return not (
        5 * count(r"[#*$%&|<>]") > n or 10 * (len(lines) - len(set(lines))) > 3 * len(lines) or chars < 2 * n or chars > 20 * n or 2 * count(r"\p{Lu}") > chars
        or 2 * count("[!?]") > n or 2 * count(r"\p{L}") < chars or 2 * count(r"(?:\.\.\.|…)[\x20\x09\x0D]*(?:\n|$)") > len(lines)
    )


def fingerprint(text):
    words = [w.encode() for w in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(texts):
    fp = {i: fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for i in texts:
            for j in texts:
                if root[i] > root[j] and (fp[i] ^ fp[j]).bit_count() <= 2:
                    root[i], changed = root[j], True
    return fp, root


def first_of_similar(texts):
    """ids that are the smallest of their group over links of a Jaccard similarity of 0.8, of sets of five-word shingles."""
    sets, holders, root = {}, defaultdict(set), {i: i for i in texts}
    for i in sorted(texts):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in texts[i] or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for j in set().union(*(holders[g] for g in sets[i])):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if x == high else x for k, x in root.items()}
        for g in sets[i]:
            holders[g].add(i)
    return {i for i, x in root.items() if i == x}


def without_repeats(texts):
    """doc_id -> (number of words, number of removed words, text)."""
    words = {i: list(WORD.finditer(t or "")) for i, t in texts.items()}
    plain = {i: [m[0] for m in w] for i, w in words.items()}
    first = {}
    for i in sorted(texts):
        for p in range(len(plain[i]) - 49):
            first.setdefault(tuple(plain[i][p : p + 50]), i)
    out = {}
    for i, w in words.items():
        gone = {j for p in range(len(w) - 49) if first[tuple(plain[i][p : p + 50])] < i for j in range(p, p + 50)}
        stretches, last = [], None
        for j, m in enumerate(w):
            if j not in gone:
                if last == j - 1 and stretches:
                    stretches[-1][1] = m.end()
                else:
                    stretches.append([m.start(), m.end()])
                last = j
        out[i] = len(w), len(gone), "\n".join(texts[i][a:b] for a, b in stretches) if gone else texts[i]
    return out


def template(text):
    """(symbol, filling or None) of each token that has letters, digits or a unit's sign."""
    out, begins, number = [], True, False
    for raw in (text or "").split():
        core = regex.search(r"[\p{L}\p{M}\p{N}%$€£°](?:.*[\p{L}\p{M}\p{N}%$€£°])?", raw, regex.DOTALL)
        if core:
            low, is_number = core[0].lower(), bool(regex.search(r"\p{N}", core[0]))
            kind = "<num>" if is_number else "<unit>" if number and low in decontaminate.UNITS else "<name>" if regex.match(r"\p{Lu}", core[0]) and not begins else None
            out.append((kind or low, low if kind else None))
            number = is_number
        begins = raw.rstrip("\"')]»”’")[-1:] in {".", "!", "?", ":"}
    return out


def template_windows(tokens, length):
    for p in range(len(tokens) - length + 1):
        part = tokens[p : p + length]
        if 2 * sum(s is not None for _, s in part) < length:
            yield p, tuple(t for t, _ in part), [s for _, s in part if s is not None]


def leaked(texts, items):
    """(doc_id, item_id) of documents that hold an item's window with slots that map one to one."""
    known = defaultdict(list)
    for k, text in items.items():
        tokens = template(text)
        if len(tokens) >= 5:
            for p, name, slots in template_windows(tokens, min(8, len(tokens))):
                known[name].append((k, p, slots))
    out = set()
    for i, text in texts.items():
        tokens, fills = template(text), defaultdict(set)
        for length in {len(name) for name in known}:
            for p, name, slots in template_windows(tokens, length):
                for k, q, theirs in known.get(name, ()):
                    fills[k, p - q].update(zip(theirs, slots))
        for (k, _), pairs in fills.items():
            if len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs):
                out.add((i, k))
    return out


def tokens(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation(), t.no_padding()
    out = {}
    for i, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        out[i] = len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))
    return out


def test_pipeline_against_brute_force(spark, documents, items):
    d = {i: t for i, t in documents.items() if kept_by_rules(t)}
    first = first_of_similar(d)
    d = {i: t for i, t in d.items() if i in first}
    d = {i: t for i, (n, gone, t) in without_repeats(d).items() if not 0 < gone == n}
    bad = {i for i, _ in leaked(d, items)}
    want = tokens({i: t for i, t in d.items() if i not in bad})
    assert 0 < len(want) < len(documents)
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_simhash_query(spark, documents):
    fp, root = groups(documents)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op1_simhash(spark, SF).collect()} == {(i, f"{fp[i]:016x}", root[i]) for i in documents}


def test_substring_query(spark, documents):
    want = {(i, n, gone, sha(" ".join(WORD.findall(t or "")))) for i, (n, gone, t) in without_repeats(documents).items()}
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op5_substring_dedup(spark, SF).collect()} == want


def test_bpe_query(spark, documents):
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op6_bpe(spark, SF).collect()} == tokens(documents)


def test_decontamination_query(spark, documents, items):
    assert {(r["doc_id"], r["item_id"]) for r in queries.op10_decontamination(spark, SF).collect()} == leaked(documents, items)


def test_decontamination_finds_verbatim_passages(spark):
    """Every pair that shares 13 tokens in a row, without regard to case, by plain Python without templates."""
    sf = "/root/testdata/sf0.1"
    split = lambda t: [x for x in (re.sub(r"^[\W_]+|[\W_]+$", "", w).lower() for w in (t or "").split()) if x]
    grams = lambda t: zip(*(t[k:] for k in range(13)))
    known = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        for g in grams(split(r["text"])):
            known[g].add(r["item_id"])
    want = {(r["doc_id"], k) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() for g in grams(split(r["text"])) for k in known.get(g, ())}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op10_decontamination(spark, sf).collect()}
    assert {(8376, 101), (6420, 37), (1699, 130)} <= want <= got


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    d = queries.queries()[name](spark, SF)
    cols = sorted(con.sql(queries.oracle_sql()[name]).columns)
    assert sorted(d.columns) == cols
    assert sorted(map(repr, con.sql(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall())) == sorted(repr(tuple(r)) for r in d.select(*cols).collect())


def test_prefix_trie_oracle(spark):
    """test_oracle() has no view of the table that op13's SQL reads."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    sql, d = queries.oracle_sql()["op13_prefix_trie"], queries.op13_prefix_trie(spark, SF)
    cols = sorted(con.sql(sql).columns)
    assert sorted(d.columns) == cols
    assert sorted(map(repr, con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())) == sorted(repr(tuple(r)) for r in d.select(*cols).collect())


def test_held_out_languages(spark):
    d = queries.op7_language_id(spark, LARGER).where("held_out and lang_pred <> 'und'").join(spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null")
    assert d.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def auc(scores, labels):
    pairs = sorted(zip(scores, labels, strict=True))
    below = wins = 0.0
    k = 0
    while k < len(pairs):
        same = [y for x, y in pairs[k:] if x == pairs[k][0]]
        wins += sum(same) * (below + (len(same) - sum(same)) / 2)
        below += len(same) - sum(same)
        k += len(same)
    return wins / (sum(labels) * (len(labels) - sum(labels)))


@pytest.mark.parametrize(("name", "label", "least", "recall", "precision"), [("op8_line_quality", "quality", 0.95, 0.9, 0.9), ("op9_toxicity", "toxic", 0.8, 0.6, 0.8)])
def test_held_out_labels(spark, name, label, least, recall, precision):
    """Ranking, and what is found and rightly found, of held-out rows; shares of a majority class would say little."""
    d = queries.queries()[name](spark, LARGER).where("held_out").join(spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", label), "doc_id").where(f"{label} is not null")
    rows = [(r["score"], r[label], r["predicted"]) for r in d.collect()]
    right = sum(y and p for _, y, p in rows)
    assert auc([x for x, _, _ in rows], [y for _, y, _ in rows]) > least
    assert right >= recall * sum(y for _, y, _ in rows) and right >= precision * sum(p for _, _, p in rows)
