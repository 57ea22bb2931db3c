"""BPE encoding and decoding by a deterministic token automaton.

``MergeAutomaton`` compiles an ordered merge list. It starts from one state
that loops on every base symbol; each merge u + v -> w applies one gadget: the
arcs labelled u are redirected to a copy of their target without the arc v,
and w gets arcs beside those of u that lead where u, v led. All arcs of one
label share a target, so a state is "the last label, with the arcs removed so
far": the tables hold, per label, its parts, its rank and the removed pairs.
The automaton accepts exactly one segmentation of every string, the one that
the merges give, and so does each prefix: encoding walks a trie of labels from
each reached position and follows the one legal arc into every position.

Words are encoded in batches (numpy table look-ups over all words that a worker
has not seen yet); seen words come from a bounded cache. Decoding emits the
labels of the arcs.

Defined cases: null text is empty; an empty text has no ids and decodes to
''. A text of any length is encoded whole. Special tokens that stand literally
in a text are matched before normalisation, as the tokenizer file declares.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bytescan import pieces, ranges

#: The word pattern that the tokenizer file declares.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORDS_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\f\va-z0-9]+")
#: Characters on which the installed regex and Unicode tables agree with the
#: tokenizer library's; texts with others are cut by the library itself.
FAMILIAR = re.compile("[\\x00-\u024f\u2000-\u206f\u20a0-\u20bf]*")
SHORT = 48          # bytes; longer words are walked one at a time
NEVER = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class MergeAutomaton:
    """Tables of the automaton for one vocabulary (a few MB; broadcast)."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str, special: dict[str, int] | None = None):
        n = max([*vocab.values(), *(special or {}).values()]) + 1
        self.labels = [""] * n
        for s, i in chain(vocab.items(), (special or {}).items()):
            self.labels[i] = s
        self.special = special or {}
        self.suffix = suffix
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.rank = np.full(n, -1, np.int64)
        symbols = byte_symbols()
        spelt: dict[int, tuple[bytes, bool]] = {}      # label -> its bytes, whether it ends a word
        for b, s in enumerate(symbols):
            spelt[vocab[s]], spelt[vocab[s + suffix]] = (bytes([b]), False), (bytes([b]), True)
        removed: dict[tuple[int, int], int] = {}
        self._removed = removed
        for k, m in enumerate(merges):
            a, b = m if isinstance(m, (list, tuple)) else m.split(" ")
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if w in spelt:
                raise ValueError(f"two merges make {a + b!r}")
            if u in spelt and v in spelt and not spelt[u][1] and self._arc(u, v):
                self.left[w], self.right[w], self.rank[w] = u, v, k
                spelt[w] = (spelt[u][0] + spelt[v][0], spelt[v][1])
                removed[u, v] = k              # the copied state of u lacks the arc v from here on
        del self._removed
        pairs = sorted((u * n + v, k) for (u, v), k in removed.items())
        self.n = n
        self.pair_keys = np.array([p for p, _ in pairs], np.int64)
        self.pair_ranks = np.array([k for _, k in pairs], np.int64)
        self._trie(spelt)

    def _arc(self, x: int, t: int) -> bool:
        """Whether the state behind label ``x`` has the arc ``t`` now."""
        bx = bt = int(NEVER)
        while True:
            k = self._removed.get((x, t), int(NEVER) * 2)
            if k < bx and k <= bt:
                return False
            rx, rt = int(self.rank[x]), int(self.rank[t])
            if rx < 0 and rt < 0:
                return True
            if rt > rx:
                bt, t = rt, int(self.left[t])
            else:
                bx, x = rx, int(self.right[x])

    def _trie(self, spelt: dict) -> None:
        nodes: dict[bytes, int] = {b"": 0}
        edges, inner, final = [], {0: -1}, {0: -1}
        for i, (s, ends) in sorted(spelt.items(), key=lambda x: x[1]):
            for j in range(1, len(s) + 1):
                if s[:j] not in nodes:
                    nodes[s[:j]] = len(nodes)
                    edges.append((nodes[s[:j - 1]] * 256 + s[j - 1], nodes[s[:j]]))
            (final if ends else inner)[nodes[s]] = i
        keys, to = (np.array(x, np.int64) for x in zip(*edges))
        # nodes with children first: only those need a row of the dense table
        parents = np.zeros(len(nodes), bool)
        parents[keys // 256] = True
        new = np.empty(len(nodes), np.int64)
        new[np.argsort(~parents, kind="stable")] = np.arange(len(nodes))
        self.n_parents = int(parents.sum())
        self.edge_keys, self.edge_to = new[keys // 256] * 256 + keys % 256, new[to]
        self.inner, self.final = (np.full(len(nodes), -1, np.int64) for _ in range(2))
        for table, got in ((self.inner, inner), (self.final, final)):
            table[new[list(got)]] = list(got.values())

    @classmethod
    def from_file(cls, path: str) -> MergeAutomaton:
        """Read a tokenizer file (byte-level BPE with a word-end suffix)."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        m = spec["model"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        return cls(m["vocab"], m["merges"], m["end_of_word_suffix"], special)

    # -- look-ups ---------------------------------------------------------
    def _next(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_dense"):        # built once per worker from the broadcast edges
            self._dense = np.full((self.n_parents + 1) * 256, -1, np.int32)
            self._dense[self.edge_keys] = self.edge_to
        return self._dense[np.minimum(node, self.n_parents) * 256 + byte]

    def legal(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether arc ``t`` leaves the state behind label ``x`` (-1: the start)."""
        ok = np.ones(len(x), bool)
        at = np.flatnonzero(x >= 0)
        x, t = x[at], t[at]
        bx, bt = np.full(len(at), NEVER), np.full(len(at), NEVER)
        while len(at):
            key = x * self.n + t
            i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            k = np.where(self.pair_keys[i] == key, self.pair_ranks[i], NEVER * 2)
            bad = (k < bx) & (k <= bt)
            ok[at[bad]] = False
            rx, rt = self.rank[x], self.rank[t]
            go = ~bad & ((rx >= 0) | (rt >= 0))
            at, x, t, bx, bt, rx, rt = (a[go] for a in (at, x, t, bx, bt, rx, rt))
            later = rt > rx
            bt, bx = np.where(later, rt, bt), np.where(later, bx, rx)
            t, x = np.where(later, self.left[t], t), np.where(later, x, self.right[x])
        return ok

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each has."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        base = np.cumsum(lens + 1) - (lens + 1)            # one slot per position 0..len
        data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        last = np.full(len(data), -2, np.int64)            # label that ends at a position
        size = np.zeros(len(data), np.int64)
        last[base] = -1
        short = lens <= SHORT
        for j in range(int(lens[short].max(initial=0))):
            w = np.flatnonzero(short & (lens > j))
            w = w[last[base[w] + j] != -2]
            self._advance(data, last, size, base[w] + j, base[w] + lens[w])
        for w in np.flatnonzero(~short):
            for p in range(base[w], base[w] + lens[w]):
                if last[p] != -2:
                    self._advance(data, last, size, np.array([p]), np.array([base[w] + lens[w]]))
        # walk back from the word ends
        at, live = base + lens, np.flatnonzero(lens > 0)
        steps = []
        while len(live):
            p = at[live]
            steps.append((live, last[p]))
            at[live] = p - size[p]
            live = live[at[live] > base[live]]
        if not steps:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        who = np.concatenate([s[0] for s in steps])
        ids = np.concatenate([s[1] for s in steps])
        back = np.repeat(np.arange(len(steps)), [len(s[0]) for s in steps])
        order = np.lexsort((-back, who))
        return ids[order].astype(np.int32), np.bincount(who, minlength=len(words))

    def _advance(self, data, last, size, pos, end) -> None:
        """Follow the legal arcs that leave ``pos`` (each word at one position)."""
        node, at = np.zeros(len(pos), np.int64), pos.copy()
        start = last[pos]
        while len(at):
            node = self._next(node, data[at]).astype(np.int64)
            keep = node >= 0
            node, at, pos, end, start = node[keep], at[keep] + 1, pos[keep], end[keep], start[keep]
            label = np.where(at == end, self.final[node], self.inner[node])
            c = np.flatnonzero(label >= 0)
            c = c[self.legal(start[c], label[c])]
            last[at[c]], size[at[c]] = label[c], at[c] - pos[c]
            go = at < end
            node, at, pos, end, start = node[go], at[go], pos[go], end[go], start[go]


class WordCache:
    """Ids of the words that a worker has met, in one growing array. It starts
    anew when full, so its memory is bounded whatever the vocabulary."""

    def __init__(self, automaton: MergeAutomaton, most: int = 200_000):
        self.a, self.most = automaton, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.used = 0

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        new = list(set(words).difference(self.index))
        if len(self.index) + len(new) > self.most and self.index:
            self.clear()
            new = list(set(words))
        if new:
            ids, counts = self.a.encode_words([w.encode("utf-8", "surrogatepass") for w in new])
            n = len(self.index)
            self.start = _room(self.start, n + len(new))
            self.count = _room(self.count, n + len(new))
            self.ids = _room(self.ids, self.used + len(ids))
            self.start[n: n + len(new)] = self.used + np.cumsum(counts) - counts
            self.count[n: n + len(new)] = counts
            self.ids[self.used: self.used + len(ids)] = ids
            self.used += len(ids)
            self.index.update(zip(new, range(n, n + len(new))))
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        return self.start[at], self.count[at]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])


def split_words(text: str) -> list[str]:
    """Normalised text cut into the words that merges never cross."""
    if text.isascii():
        return WORDS_ASCII.findall(text.lower())
    if FAMILIAR.fullmatch(text):
        return WORDS.findall(unicodedata.normalize("NFC", text).lower())
    from tokenizers import Regex, normalizers, pre_tokenizers
    text = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)
    return [w for w, _ in pre_tokenizers.Split(Regex(WORDS.pattern), "removed", invert=True).pre_tokenize_str(text)]


def encode_batch(texts: list, automaton: MergeAutomaton, cache: WordCache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and the offsets of each text."""
    words: list[str] = []
    ends, marks = [], []                    # words so far; (place, id) of special tokens
    cut = re.compile("(" + "|".join(map(re.escape, automaton.special)) + ")") if automaton.special else None
    for t in texts:
        if t:
            parts = cut.split(t) if cut and any(s in t for s in automaton.special) else [t]
            for p in parts:
                if p in automaton.special:
                    marks.append((len(words), automaton.special[p]))
                    words.append("")
                elif p:
                    words += split_words(p)
        ends.append(len(words))
    start, count = cache.lookup(words)
    if marks:
        place, ids = np.array([m[0] for m in marks]), np.array([m[1] for m in marks], np.int32)
        cache.ids = _room(cache.ids, cache.used + len(ids))
        cache.ids[cache.used: cache.used + len(ids)] = ids      # scratch behind the cached ids
        start[place], count[place] = cache.used + np.arange(len(ids)), 1
    total = np.concatenate([[0], np.cumsum(count)])
    return cache.ids[ranges(start, count)], total[np.concatenate([[0], ends]).astype(np.int64)]


def decode_ids(ids, labels: list[str]) -> str:
    """Labels of the arcs, one blank between them (the file names no decoder)."""
    return " ".join(map(labels.__getitem__, ids))


_caches: dict[int, WordCache] = {}


def encode_decode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
                  decode: bool = True, piece_bytes: int = 1 << 20) -> DataFrame:
    """``keep`` columns, ``ids`` array<int> and, if asked for, ``decoded``:
    the whole text encoded, and the text of its labels.

    Narrow (no shuffle); a task holds one Arrow batch (bounded in bytes), the
    ids of a few MB of text and the word cache.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(MergeAutomaton.from_file(tokenizer_path))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType()))]
                          + [T.StructField("decoded", T.StringType())] * decode)
    nk = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        if id(a) not in _caches:
            _caches.clear()
            _caches[id(a)] = WordCache(a)
        cache = _caches[id(a)]
        for b in batches:
            bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(b.column(nk)), 0).to_numpy(zero_copy_only=False))])
            for i, j in pieces(bounds, piece_bytes):       # some MB of text as strings at a time
                ids, off = encode_batch(b.column(nk).slice(i, j - i).to_pylist(), a, cache)
                cols = [b.column(c).slice(i, j - i) for c in range(nk)]
                cols.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32())))
                if decode:
                    cols.append(pa.array([decode_ids(ids[off[r]:off[r + 1]].tolist(), a.labels) for r in range(j - i)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def digests(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token count and SHA-256 digests of the ids and of the decoded text."""
    return encoded.select(
        *keep, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
