"""Word utilities and token counts against plain Python and the library."""
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loanlens.llm import bytewords as W
from loanlens.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["", "a", "it's  we'll I'd DON'T", "<|endoftext|>x <|startoftext|>", "x y z\tq\r\nw",
        "école ́a İstanbul ǅ ²³ ½ Ⅷ", "123 4a5b,c... !!?! a,b ,a 日本語テキスト ñ\n\nñ", "\x1c\x1d a\x85b",
        "ſ K Å ﬁ \u0000 x", '"token" = "ab12"!! | | --', "क्षि नमस्ते สวัสดี 👩‍👩‍👧 ‍", "Word, word. WORD! word"]


def test_words_match_split_and_hashes_are_equal_only_for_equal_words():
    texts = ["a b  c\n", "", "  a", "bb a", "c"]
    data, offsets = W.buffers(pa.array(texts + [None]))
    starts, ends, first = W.find_words(data, offsets, W.byte_class("nonspace"))
    words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert words == [w for t in texts for w in t.split()]
    assert np.diff(first).tolist() == [len(t.split()) for t in texts] + [0]
    h = W.hash_words(data, starts, ends)
    for i, x in enumerate(words):
        for j, y in enumerate(words):
            assert (h[i] == h[j]) == (x == y)


def test_word_longer_than_a_segment_hashes_alike_at_any_place():
    long = b"x" * (2 * W.SEGMENT + 17)
    for pre in (b"", b"ab "):
        raw = np.frombuffer(pre + long + b" yy", np.uint8)
        s, e, _ = W.find_words(raw, np.array([0, len(raw)]), W.byte_class("nonspace"))
        got = W.hash_words(raw, s, e)
        assert len(got) == 2 + bool(pre)
        if pre:
            assert got[1] == before
        else:
            before = got[0]


def test_winnowing_guarantee():
    r = np.random.default_rng(3)
    g = r.integers(0, 50, 400).astype(np.uint64)
    doc = np.repeat([0, 1, 2, 3], [200, 3, 0 + 97, 100])
    for w in (1, 4, 9):
        picked = set(W.winnow(g, doc, w).tolist())
        for d in range(4):
            at = np.flatnonzero(doc == d)
            for i in range(max(1, len(at) - w + 1)):
                window = at[i:i + w]
                smallest = window[len(window) - 1 - g[window][::-1].argmin()]
                assert smallest in picked


def test_lengths_and_ids_equal_the_library():
    lib, enc = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    want = [lib.encode(x, add_special_tokens=False).ids for x in HARD]
    for _ in range(2):                                   # cold and warm memo
        assert enc.lengths(HARD).tolist() == [len(x) for x in want]
        ids, off = enc.ids(HARD)
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want


def test_memo_limit_only_forgets():
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("abcé1,.") for _ in range(r.randint(1, 9))) for _ in range(200))
             for _ in range(12)]
    small, lib = tokens.Encoder(PATH, memo=64), Tokenizer.from_file(PATH)
    for t in texts:
        assert small.lengths([t])[0] == len(lib.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("limit", [3, 7, 50])
def test_segments_are_safe(limit):
    enc = tokens.Encoder(PATH)
    for t in HARD + ["nospaceatall" * 20]:
        parts = list(tokens.segments(t, limit))
        assert "".join(parts) == t
        assert sum(enc.lengths(parts)) == enc.lengths([t])[0]


def test_count_tokens_cases(spark):
    long = "word another, third. " * 60_000
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (4, long), (None, "x"), (5, "y" * 300_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int")
    got = tokens.count_tokens(df, PATH, segment=1 << 16).collect()
    lib = Tokenizer.from_file(PATH)
    want = sorted((str(i), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids))
                  for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert tokens.count_tokens(df.limit(0), PATH).count() == 0


def test_random_strings_equal_the_library():
    """100,000 strings of letters of many scripts, marks that normalisation makes
    or moves, half-width forms, digits and every plain sign."""
    r = random.Random(8)
    letters = list("abzABZiI") + list("İıſKÅßẞçÇéÉñÑŽžΩωЖжאبकक्षกำ日本語ｱﾞＡａ한글각ǅﬁªº") + ["i\u0307", "e\u0301", "\u0301", "\u0345"]
    signs = list(tokens.PLAIN) + list("'\"-_()/\\@^~`<>=+[]{}") + list("0129²½٣") + ["…", "、", "¿", "€"]
    strings = []
    for _ in range(100_000):
        s = "".join(r.choice(letters) for _ in range(r.randrange(5)))
        s += "".join(r.choice(signs) for _ in range(r.randrange(3)))
        if r.random() < 0.4:
            s += r.choice([" ", "", "\n"]) + "".join(r.choice(letters) for _ in range(r.randrange(4))) + r.choice(signs)
        strings.append(s)
    strings += ["ALİ.", "VELİ, ALİ", "İ!", "İ?İ,"]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch_fast(strings, add_special_tokens=False)]
    enc = tokens.Encoder(PATH)
    ids, offsets = enc.ids(strings)
    got = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert [(s, g, w) for s, g, w in zip(strings, got, want) if g != w] == []
    assert enc.lengths(strings).tolist() == [len(w) for w in want]


@pytest.mark.parametrize("w", [1, 2, 3, 10, 33, 45])
def test_winnowing_by_doubling_equals_winnowing(w):
    rng = np.random.default_rng(w)
    for kinds in (1, 2, 5, 10**9):
        sizes = rng.integers(0, 120, 40)
        doc = np.repeat(np.arange(40), sizes)
        g = rng.integers(0, kinds, len(doc)).astype(np.uint64)
        assert W.winnow_wide(g, doc, w).tolist() == W.winnow(g, doc, w).tolist()
    none = np.zeros(0, np.int64)
    assert len(W.winnow_wide(none.astype(np.uint64), none, w)) == 0


@pytest.mark.parametrize("k", [1, 2, 3, 6, 7, 13, 32, 50])
def test_runs_by_doubling_equal_runs(k):
    rng = np.random.default_rng(k)
    for n in (0, 1, k - 1, k, k + 1, 3 * k + 5, 700):
        h = rng.integers(0, 1 << 62, n).astype(np.uint64)
        first = np.unique(np.r_[0, rng.integers(0, n + 1, 6), n])
        for a, b in zip(W.kgrams_wide(h, first, k), W.kgrams(h, first, k)):
            assert a.tolist() == b.tolist()
