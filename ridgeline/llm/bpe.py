"""Byte-level BPE as a streaming transducer, and its decoder."""

from __future__ import annotations

import codecs
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_worker, small_batches

#: Fixed value: how texts are cut before merging, with white space as Unicode's White_Space; the commonest alternative first, as no other starts alike.
PATTERN = regex.compile(r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

NEVER = 1 << 30
#: Pieces that a worker remembers at most in a generation, pairs of tokens that it does, characters of the longest piece, and of the stretches that long texts are cut into.
#: A worker process lives on after its stage, so these bounds hold for all that runs there later, too.
REMEMBERED, PAIRS, REMEMBERED_CHARS, STRETCH = 1 << 18, 1 << 18, 32, 1 << 18
#: So many new pieces at least are encoded all at once; fewer one by one, since a step in numpy has its price for a single one, too.
MANY = 256


def byte_letters() -> dict[str, int]:
    """Letter -> byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest are the letters from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def hashed(keys: np.ndarray, bits: int) -> np.ndarray:
    """So many bits of a hash of int64 keys."""
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)


class _Table:
    """Integers from 0 on -> integers from 0 on, for many lookups at once: open addressing, a quarter full at most, so that few have to look further."""

    def __init__(self, of: dict[int, int]) -> None:
        self.bits = (4 * len(of)).bit_length()
        self.last = (1 << self.bits) - 1
        keys, values = (np.fromiter(x, np.int64, len(of)) for x in (of.keys(), of.values()))
        self.keys = np.full(1 << self.bits, -1, np.int32 if max(of, default=0) < 1 << 31 else np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        slots = hashed(keys, self.bits)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], slots[~placed] + 1 & self.last

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of int64 keys; -1: not there."""
        slots = hashed(keys, self.bits)
        there, out = self.keys[slots], self.values[slots]
        other = np.flatnonzero((there != keys) & (there >= 0))
        while len(other):
            slots[other] = at = slots[other] + 1 & self.last
            there, out[other] = self.keys[at], self.values[at]
            other = other[(there != keys[other]) & (there >= 0)]
        return out


class Bpe:
    """Merges in order of rank. Encodes by the last token of each prefix, so left to right with bounded memory.

    The BPE tokens of a prefix are those of a shorter prefix and one more token that the merges
    keep apart from the one before it; there is one such token. Whether two neighbours stay apart
    follows from the ranks along the edge between them.

    Tables are flat, of numbers, since each worker process holds them.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]) -> None:
        letters = byte_letters()
        self.special = special
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.bytes_of.update({i: t.encode() for t, i in special.items()})
        self.rank = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in enumerate(merges)}
        #: token -> the left and the right one that it is merged from (itself, if it is a byte; -1: no token), and the rank of that merge
        self.left, self.right, self.made = (array("i", [x]) * (max(vocab.values(), default=0) + 1) for x in (-1, -1, NEVER))
        for t, i in vocab.items():
            if t in letters:
                self.left[i] = self.right[i] = i
        for r, (a, b) in enumerate(merges):
            i, x, y = vocab[a + b], vocab[a], vocab[b]
            if self.left[i] < 0:
                if self.left[x] < 0 or self.left[y] < 0:
                    raise ValueError("a merge takes what no merge before it makes")
                self.left[i], self.right[i], self.made[i] = x, y, r
        #: tokens by their bytes from the last to the first: node << 8 | byte -> the next node; node -> the token that is complete here or -1
        self.backward: dict[int, int] = {}
        self.complete = array("i", [-1])
        for i, x in enumerate(self.left):
            if x >= 0:
                node = 0
                for byte in reversed(self.bytes_of[i]):
                    node = self.backward.setdefault(node << 8 | byte, len(self.complete))
                    if node == len(self.complete):
                        self.complete.append(-1)
                self.complete[node] = i
        self.longest = max(map(len, self.bytes_of.values()))
        self.lookahead = sufficient_lookahead([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], {i: len(t) for i, t in self.bytes_of.items()})
        self.apart: dict[int, bool] = {}
        #: the same tables for many lookups at once; made_of_two: -1 for bytes, which are made first
        self.ranks, self.nodes = _Table(self.rank), _Table(self.backward)
        self.lefts, self.rights, self.completes, made = (np.frombuffer(x, np.int32) for x in (self.left, self.right, self.complete, self.made))
        self.made_of_two = np.where(made == NEVER, -1, made)
        #: pairs judged, each in the place that its hash says: pair << 1 | whether they stay apart
        self.judged = np.full(PAIRS, -1, np.int64)

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the merges leave token a before token b as they are."""
        found = self.apart.get(a << 20 | b)
        if found is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            found = self.apart[a << 20 | b] = self._stay_apart(a, b)
        return found

    def _edge(self, token: int, side: array) -> list[tuple[int, int]]:
        """(symbol, rank at which its parent takes it) from the byte at a token's edge to the token itself."""
        out = [(token, NEVER)]
        while side[token] != token:
            out.append((side[token], self.made[token]))
            token = side[token]
        return out[::-1]

    def _stay_apart(self, a: int, b: int) -> bool:
        x, y, i, j = self._edge(a, self.right), self._edge(b, self.left), 0, 0
        while True:
            (p, until_p), (q, until_q) = x[i], y[j]
            across = self.rank.get(p << 20 | q, NEVER)
            if across < until_p and across <= until_q and across < NEVER:
                return False
            if until_p == until_q == NEVER:
                return True
            if until_p <= until_q:
                i += 1
            else:
                j += 1

    def _all_stay_apart(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """stay_apart for many pairs."""
        pair = p << 20 | q
        place = hashed(pair, PAIRS.bit_length() - 1)
        judged = self.judged[place]
        new = np.flatnonzero(judged >> 1 != pair)
        if len(new):
            judged[new] = pair[new] << 1 | self._judge(p[new], q[new])
            self.judged[place[new]] = judged[new]
        return (judged & 1).astype(bool)

    def _judge(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """_stay_apart for many pairs; each edge is gone along from the token to the byte, what was merged last first (if equal, on the right)."""
        out, which = np.ones(len(p), bool), np.arange(len(p))
        until_p = until_q = np.full(len(p), NEVER, np.int32)
        while len(which):
            across = self.ranks.get(p << 20 | q)
            merge = (across >= 0) & (across < until_p) & (across <= until_q)
            out[which[merge]] = False
            made_p, made_q = self.made_of_two[p], self.made_of_two[q]
            on = np.flatnonzero(~merge & (np.maximum(made_p, made_q) >= 0))
            p, q, until_p, until_q, made_p, made_q, which = (x[on] for x in (p, q, until_p, until_q, made_p, made_q, which))
            in_p = made_p > made_q
            p, until_p = np.where(in_p, self.rights[p], p).astype(np.int64), np.where(in_p, made_p, until_p)
            q, until_q = np.where(in_p, q, self.lefts[q]).astype(np.int64), np.where(in_p, until_q, made_q)
        return out

    def together(self, pieces: list[bytes]) -> list[bytes]:
        """The tokens of many short pieces, none empty, each as the bytes of an int32 array.

        As stream() finds them, but each step is taken in all pieces at once: first the tokens that
        end at each byte, then the last token of the first prefix of all pieces, of the second and so on.
        """
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]), reverse=True)
        data = np.frombuffer(b"".join([pieces[i] for i in order]), np.uint8)
        size = np.array([len(pieces[i]) for i in order])
        first = np.cumsum(size) - size
        home = np.repeat(first, size)  # of each byte: where its piece starts
        found, n_found = [], np.zeros(len(data), np.int64)
        end = at = np.arange(len(data))
        node = self.nodes.get(np.arange(256))[data]
        while len(end):
            on = np.flatnonzero(node >= 0)
            end, at, node = end[on], at[on], node[on]
            t = self.completes[node]
            hit = np.flatnonzero(t >= 0)
            found.append((end[hit], n_found[end[hit]], at[hit], t[hit]))
            n_found[end[hit]] += 1
            on = np.flatnonzero(at > home[end])
            end, at = end[on], at[on] - 1
            node = self.nodes.get(node[on].astype(np.int64) << 8 | data[at])
        beyond = np.cumsum(n_found)  # of each byte: the end of its tokens in these lists, longest first
        token_at, token = np.empty(beyond[-1], np.int64), np.empty(beyond[-1], np.int64)
        for end, nth, at, t in found:
            place = beyond[end] - 1 - nth
            token_at[place], token[place] = at, t
        last, start = np.empty(len(data), np.int64), np.empty(len(data), np.int64)
        for n in range(size[0]):
            end = first[: np.searchsorted(-size, -n)] + n  # pieces of over n bytes come first
            c = beyond[end] - n_found[end]
            while len(end):
                if (c == beyond[end]).any():
                    raise ValueError("the merges do not cover this text")
                at, t = token_at[c], token[c]
                ok = at == home[end]
                inner = np.flatnonzero(~ok)
                ok[inner] = self._all_stay_apart(last[at[inner] - 1], t[inner])
                last[end[ok]], start[end[ok]] = t[ok], at[ok]
                end, c = end[~ok], c[~ok] + 1
        stays = np.zeros(len(data), bool)  # whether a token of a whole piece ends here
        end = first + size - 1
        while len(end):
            stays[end] = True
            end = start[end][start[end] > home[end]] - 1
        ends = np.cumsum(4 * np.add.reduceat(stays, first, dtype=np.int64)).tolist()
        ids, out = last[stays].astype(np.int32).tobytes(), [b""] * len(pieces)
        for i, a, b in zip(order, [0, *ends], ends):
            out[i] = ids[a:b]
        return out

    def stream(self, data: bytes) -> Iterator[list[int]]:
        """The tokens of one piece, in parts, each as soon as no later byte can change it.

        Of the bytes read, the last token of each prefix is kept. Those that can still be extended
        reach back `longest` bytes; where their chains meet, all before is stable and is given
        out. They meet within `lookahead` more bytes, so what is kept does not grow with the piece.
        """
        tokens, starts, base = [0], [0], 0  # of the prefixes that end at base, base + 1, ...
        room = 2 * (self.longest + self.lookahead) + 1024
        known, stay_apart, backward, complete = self.apart.get, self.stay_apart, self.backward.get, self.complete
        for end in range(1, len(data) + 1):
            node, at, found = 0, end, []
            while at > base:
                node = backward(node << 8 | data[at - 1])
                if node is None:
                    break
                at -= 1
                t = complete[node]
                if t >= 0:
                    found.append((t, at))
            while found:
                t, at = found.pop()
                if at == 0:
                    break
                before = tokens[at - base]
                ok = known(before << 20 | t)
                if stay_apart(before, t) if ok is None else ok:
                    break
            else:
                raise ValueError("the merges do not cover this text")
            tokens.append(t)
            starts.append(at)
            if end - base >= room:
                live = set(range(max(base, end - self.longest + 1), end + 1))
                while len(live) > 1:
                    top = max(live)
                    live.remove(top)
                    live.add(starts[top - base])
                stable = live.pop()
                if stable > base:
                    yield self._back(tokens, starts, base, stable)
                    tokens, starts, base = tokens[stable - base :], starts[stable - base :], stable
        if len(data) > base:
            yield self._back(tokens, starts, base, len(data))

    @staticmethod
    def _back(tokens: list[int], starts: list[int], base: int, end: int) -> list[int]:
        out = []
        while end > base:
            out.append(tokens[end - base])
            end = starts[end - base]
        return out[::-1]


def sufficient_lookahead(merges: list[tuple[int, int, int]], size: dict[int, int]) -> int:
    """Bytes after a token's end that can decide whether it stays.

    A merge (a, b) is lost only if b goes to a merge (b, c) of lower rank instead, which again can
    be lost only to one of lower rank; so ranks fall along such a chain, and one pass in order of
    rank gives the longest. formed[t]: bytes from t's start that decide whether t comes about.
    """
    formed, reach, most = dict(size), {}, 0
    for a, b, ab in merges:
        far = max(formed[b], size[b] + reach.get(b, 0))  # of the edge between a and b
        reach[a] = max(reach.get(a, 0), far)
        formed[ab] = max(formed.get(ab, 0), formed[a], size[a] + far)
        most = max(most, far, formed[ab] - size[ab])
    return most


class _Memory(dict):
    """Piece (a special token's string is one) -> tokens, as the bytes of an int32 array, of short pieces only. When full, what it holds turns into a second generation, whose older one goes."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe = bpe
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        special = self.bpe.special.get(piece)
        found = self.older.get(piece) if special is None else np.int32(special).tobytes()
        if found is None:
            found = b"".join(np.array(part, np.int32).tobytes() for part in self.bpe.stream(piece.encode("utf-8", "replace")))
        if len(piece) <= REMEMBERED_CHARS:
            self._keep(piece, found)
        return found

    def _keep(self, piece: str, tokens: bytes) -> None:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = tokens

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode at once what is new among pieces, if that is enough to be worth it."""
        new = [x for x in pieces if x not in self and x not in self.older and len(x) <= REMEMBERED_CHARS and x not in self.bpe.special]
        if len(new) >= MANY:
            for x, tokens in zip(new, self.bpe.together([x.encode("utf-8", "replace") for x in new])):
                self._keep(x, tokens)


@lru_cache(2)
def tokenizer(path: str) -> tuple[Bpe, _Memory]:
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in j["model"]["merges"]]
    bpe = Bpe(j["model"]["vocab"], merges, {t["content"]: t["id"] for t in j["added_tokens"]})
    return bpe, _Memory(bpe)


def _stretches(text: str) -> Iterator[str]:
    """Cuts a long text before white space that follows other characters: a piece never spans that."""
    at = 0
    while len(text) - at > STRETCH:
        cut = regex.search(r"(?<=\P{White_Space})(?=\p{White_Space})", text, pos=at + STRETCH)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_texts(texts: Iterable[str | None], path: str) -> list[np.ndarray]:
    """Token ids of each text; special tokens' strings become their ids, as the tokenizers library has it.

    Texts go stretch by stretch; the pieces of about STRETCH characters are held and looked up together.
    """
    bpe, memory = tokenizer(path)
    special = "(" + "|".join(map(regex.escape, bpe.special)) + ")"
    parts: list[list[bytes]] = []
    held: list[tuple[list[bytes], list[str]]] = []  # parts of a text, and the pieces that come next there
    chars = 0

    def look_up() -> None:
        nonlocal chars
        memory.learn(dict.fromkeys(chain.from_iterable(pieces for _, pieces in held)))
        for out, pieces in held:
            out.append(b"".join(map(memory.__getitem__, pieces)))
        held.clear()
        chars = 0

    for text in texts:
        parts.append([])
        for i, x in enumerate(regex.split(special, text or "") if bpe.special else [text or ""]):
            for stretch in [x] if i % 2 else _stretches(x):
                held.append((parts[-1], [x] if i % 2 else PATTERN.findall(stretch)))
                chars += len(stretch)
                if chars >= STRETCH:
                    look_up()
    look_up()
    return [np.frombuffer(b"".join(x), np.int32) for x in parts]


def encode_text(text: str | None, path: str) -> np.ndarray:
    return encode_texts([text], path)[0]


def decode_ids(ids: np.ndarray, path: str) -> str:
    """The text of token ids: bytes go through an incremental UTF-8 decoder, which holds at most one unfinished character."""
    of = tokenizer(path)[0].bytes_of
    state = codecs.getincrementaldecoder("utf-8")("replace")
    out = [state.decode(b"".join(map(of.__getitem__, ids[at : at + STRETCH].tolist()))) for at in range(0, len(ids), STRETCH)]
    return "".join(out) + state.decode(b"", True)


def _id_lists(texts: list[str | None], path: str) -> tuple[list[np.ndarray], pa.ListArray]:
    each = encode_texts(texts, path)
    ends = np.cumsum([0, *map(len, each)], dtype=np.int32)
    return each, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each) if each else np.empty(0, np.int32)))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids array<int>), one row for each row; a null or empty text has no ids.

    path is the tokenizer's file, found at the same place on every executor. Repeated rows and
    other columns change nothing; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _id_lists(b.column(1).to_pylist(), path)[1]], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(in_worker("bpe", run, tokenizer.cache_clear), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, text); null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode_ids(np.asarray(x.values), path) if x.is_valid else "" for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(in_worker("bpe", run, tokenizer.cache_clear), "doc_id long, ids array<int>, text string")


def coded(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids, text): decode(encode(docs)), but both in one worker, which then holds the tokenizer once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each, ids = _id_lists(b.column(1).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array([decode_ids(x, path) for x in each], pa.string())], ["doc_id", "ids", "text"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(in_worker("bpe", run, tokenizer.cache_clear), "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256, one row for each row of docs.

    A null or empty text has no token and the digests of empty strings. Repeated rows and other
    columns change nothing; an empty table gives an empty result.
    """
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded(docs, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
