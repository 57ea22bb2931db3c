import random
import re
from collections import Counter

import pyarrow as pa

from tessera.llm import bytescan as B
from tessera.llm import quality
from tests.llm.conftest import TRICKY

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = W.findall(t)
    chars = max(1, sum(map(len, w)))

    def grams(k):
        c = Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
        inside = {i + j for i in range(len(w) - k + 1) if c[tuple(w[i:i + k])] > 1 for j in range(k)}
        best = max(((n, n * sum(map(len, g))) for g, n in c.items() if n > 1), default=(0, 0))
        return inside, best[1]

    seen, dup, lines, dup_chars = set(), 0, 0, 0
    for line in t.split("\n"):
        if W.search(line):
            lines += 1
            dup += line in seen
            dup_chars += len(line) * (line in seen)
            seen.add(line)
    all_chars = sum(len(x) for x in t.split("\n") if W.search(x))
    base = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(grams(3)[0]))
    failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
    bad = failed or dup > quality.DUP_LINES * max(1, lines) or dup_chars > quality.DUP_LINE_CHARS * max(1, all_chars)
    bad = bad or any(grams(k)[1] / chars > m for k, m in quality.TOP_NGRAM.items())
    bad = bad or any(sum(len(w[i]) for i in grams(k)[0]) / chars > m for k, m in quality.DUP_NGRAM.items())
    return (*base, failed, not bad)


def test_against_brute_force(monkeypatch):
    rng = random.Random(3)
    texts = TRICKY + ["é é é é\né é é é\n \n \nx", "\x1c\x85 z"]
    texts += [" ".join(rng.choice("ab#\n") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    vocab = [f"w{i}" for i in range(400)]
    for _ in range(200):
        t = [rng.choice(vocab) for _ in range(rng.randint(40, 120))]
        for _ in range(rng.randint(0, 4)):
            a, n = rng.randrange(len(t)), rng.randint(2, 12)
            t += t[a:a + n] + ["\n"] * rng.randint(0, 1)
        texts.append(" ".join(t))
    data, off = B.flat(pa.array(texts))
    kept = 0
    for i, j in B.pieces(off, 5000):
        m = quality.measure(data[off[i]:off[j]], off[i:j + 1] - off[i])
        for r in range(i, j):
            got = tuple(int(m[c][r - i]) for c in quality.LONGS) + tuple(bool(m[c][r - i]) for c in quality.FLAGS)
            assert got == brute(texts[r]), texts[r]
            kept += got[-1]
    assert 20 < kept < len(texts) - 100


def test_odd_rows(odd, nothing):
    got = sorted((str(r.doc_id), r.n_words, r.n_repeat_words, r.kept) for r in quality.quality_rules(odd).collect())
    assert got == sorted((str(r.doc_id), *(brute(r.text)[i] for i in (0, 4, 6))) for r in odd.collect())
    assert quality.quality_rules(nothing).count() == 0
