"""Ids and decoded text against the tokenizers library, exactly."""
import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe
from tests.llm.conftest import TRICKY

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def automaton():
    return bpe.MergeAutomaton.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(automaton, library, texts):
    ids, off = bpe.encode_batch(texts, automaton, bpe.WordCache(automaton))
    for i, want in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        got = ids[off[i]:off[i + 1]].tolist()
        assert got == want.ids, texts[i]
        assert bpe.decode_ids(got, automaton.labels) == library.decode(want.ids, skip_special_tokens=False)


def test_every_character(automaton, library):
    chars = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    same(automaton, library, ["x" + "y ".join(chars[k:k + 400]) for k in range(0, len(chars), 400)])


def test_random_strings_and_special_tokens(automaton, library):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdeilnorst ' 1!é") for _ in range(300)) for _ in range(200)]
    texts += ["<|endoftext|>Hello <|startoftext|> don't", "<|ENDOFTEXT|>", "a<|endoftext|><|endoftext|>b", "ha" * 900, "a" * 500]
    same(automaton, library, texts + TRICKY)


def test_small_merge_list_by_hand():
    symbols = bpe.byte_symbols()
    vocab = {s + e: i for i, (s, e) in enumerate((s, e) for e in ("", "</w>") for s in symbols)}
    merges = [("a", "a"), ("a", "b</w>"), ("aa", "ab</w>")]
    for a, b in merges:
        vocab[a + b] = len(vocab)
    m = bpe.MergeAutomaton(vocab, merges, "</w>")
    ids, n = m.encode_words([b"aab", b"aaab", b"aaaa", b"b"])
    labels = [m.labels[i] for i in ids]
    assert labels == ["aa", "b</w>", "aaab</w>", "aa", "a", "a</w>", "b</w>"] and n.tolist() == [2, 1, 3, 1]


def test_cache_starts_anew_when_full(automaton, library):
    cache = bpe.WordCache(automaton, most=5)
    for texts in (["one two three"], ["four five six seven eight nine ten"], ["one two"]):
        ids, _ = bpe.encode_batch(texts, automaton, cache)
        assert ids.tolist() == library.encode(texts[0], add_special_tokens=False).ids


def test_table(odd, nothing, library):
    got = bpe.digests(bpe.encode_decode(odd, PATH)).collect()
    rows = odd.collect()
    want = sorted(hashlib.sha256(" ".join(map(str, library.encode(r.text or "", add_special_tokens=False).ids)).encode()).hexdigest() for r in rows)
    assert sorted(r.ids_sha256 for r in got) == want
    assert bpe.encode_decode(nothing, PATH).count() == 0
