"""Fingerprints, contamination, packing, SimHash and passages against brute force."""
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from loanlens.llm import decontam, fingerprints, packing, simhash, substrings

PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def prose(r, n, vocabulary=4000):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def frame(spark, rows):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in rows],
                                 "doc_id long, text string, component_id string, version int, score double")


# ---- fingerprints ---------------------------------------------------------

def test_fingerprint_is_a_multiset_hash():
    f = fingerprints.fingerprint
    a = "one two three\nfour\nfive six"
    assert f("five six\none two three\n\nfour") == f(a) != f(a + "\nfour")
    assert fingerprints.insert(f("one two three\nfour"), "five six") == f(a)
    assert fingerprints.delete(f(a), "four") == f("one two three\nfive six")
    assert fingerprints.combine(f("four"), f("five six\none two three")) == f(a)
    assert f(None) == f("") == f("\n\n") and set(f("")) == {"0"}


def test_edited_fingerprints_in_descending_order(spark):
    r = random.Random(1)
    rows = [(i, prose(r, r.randint(0, 60))) for i in range(0, 400, 3)] + [(1000, None), (2000, ""), (5, "é" * 7)]
    got = fingerprints.edited_fingerprints(frame(spark, rows).repartition(5)).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        n = len(t) // 3
        edited = (t[:-n] if n else t) + after[:n]
        x = by[i]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert x.fingerprint == fingerprints.fingerprint(t)
        assert x.edited_fingerprint == fingerprints.fingerprint(edited)
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
    long = [x for x in got if x.n_chars > 150]
    assert np.mean([x.near_edited > x.near_next for x in long]) > 0.99


def test_fingerprints_of_one_row_repeated_rows_and_nothing(spark):
    one = fingerprints.edited_fingerprints(frame(spark, [(7, "abc def")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    same = fingerprints.edited_fingerprints(frame(spark, [(7, "a b c")] * 3 + [(None, "z")])).collect()
    assert len(same) == 4 and len({x.fingerprint for x in same if x.doc_id == 7}) == 1
    assert fingerprints.edited_fingerprints(frame(spark, [])).count() == 0


# ---- contamination --------------------------------------------------------

def brute_contamination(docs, items, window=13):
    index = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            index[tuple(w[a:a + n])].add(i)
    sizes = {len(k) for k in index}
    out = []
    for i, t in docs:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if got := index.get(tuple(w[a:a + n])):
                    hit.update(range(a, a + n))
                    found |= got
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("max_index", [10**6, 0])
def test_contamination_equals_brute_force(spark, max_index):
    r = random.Random(2)
    items = [(i, prose(r, n, 30)) for i, n in enumerate((13, 14, 40, 60, 12, 3, 1, 0))]
    items += [(8, None), (9, items[2][1]), (2, items[2][1]), (None, prose(r, 20)), (10, "the the the " * 8)]
    docs = [(i, prose(r, 80, 30)) for i in range(60)]
    for i, cut in enumerate((12, 13, 20, 40)):
        whole = items[2][1].split()
        docs.append((100 + i, prose(r, 50) + " " + " ".join(whole[-cut:]).upper() + "! " + prose(r, 100)))
    docs += [(200, items[3][1]), (201, None), (202, ""), (203, "the " * 5000), (100, docs[60][1]), (None, items[0][1])]
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = decontam.find_contamination(frame(spark, docs), bench, max_index=max_index).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_hit, x["items"], x.contaminated) for x in got), key=str) \
        == brute_contamination(docs, items)
    assert all(x.n_hit == sum(s.e - s.s for s in x.spans) for x in got)
    kept = decontam.drop_contaminated(frame(spark, docs), bench)
    want = [i for i, _, _, _, bad in brute_contamination(docs, items) if not bad]
    assert sorted(map(str, (x.doc_id for x in kept.collect()))) == sorted(map(str, want))
    assert kept.columns == frame(spark, []).columns


def test_contamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id int, text string")
    got = decontam.find_contamination(frame(spark, [(1, "a b")]), bench).collect()
    assert len(got) == 1 and got[0].n_hit == 0 and not got[0].contaminated
    assert decontam.find_contamination(frame(spark, []), bench).count() == 0


# ---- packing --------------------------------------------------------------

def test_differencing_beats_chance_and_ties_repeat():
    r = np.random.default_rng(1)
    x = r.integers(1, 1000, 400)
    window, sums = packing.differencing(x, 20)
    assert sums.sum() == x.sum() and np.ptp(sums) <= 5
    assert all(x[window == j].sum() == sums[j] for j in range(20))
    same = np.full(30, 7)
    assert (packing.differencing(same, 6)[1] == 35).all()
    assert (packing.differencing(same, 6)[0] == packing.differencing(same, 6)[0]).all()
    assert packing.differencing(np.array([5]), 3)[1].tolist() == [5]


def test_window_count_rises_when_capacity_is_exceeded():
    sizes = np.array([60, 60, 60, 100])                     # 180 would fit two windows of 100 by sum
    window = packing.pack_group(sizes, 100)
    assert window[3] == 0 and sorted(window[:3]) == [1, 2, 3]


def test_packing_covers_every_id(spark):
    r = random.Random(4)
    docs = [(i, prose(r, r.randint(0, 90))) for i in range(80)] + [(200, None), (201, ""), (202, prose(r, 3000))]
    docs += [(5, docs[5][1])] * 3 + [(None, "x y")]
    rows = packing.pack(frame(spark, docs), PATH, capacity=256, end_id=2, windows=8, with_ids=True).collect()
    lib = Tokenizer.from_file(PATH)
    want = collections.Counter(tuple(lib.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in docs)
    by_key = collections.defaultdict(list)
    for x in rows:
        assert x.length == len(x.ids) and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
        by_key[str(x.doc_id)].append(x)
    got = collections.Counter()
    for i, t in {(str(i), t) for i, t in docs}:
        pieces = sorted(by_key[i], key=lambda x: x.start)
        copies = sum(x.start == 0 for x in pieces)
        whole = [v for x in pieces[::copies] for v in x.ids]
        got[tuple(whole)] += copies
        assert all(x.doc_tokens == len(whole) for x in pieces)
    assert got == want
    windows = collections.defaultdict(list)
    for x in rows:
        windows[x.sequence_id].append((x.offset, x.length))
    pad = 0
    for w in windows.values():
        end = 0
        for o, n in sorted(w):
            assert o == end
            end = o + n
        assert end <= 256
        pad += 256 - end
    assert pad < 0.15 * sum(x.length for x in rows)
    assert packing.pack(frame(spark, []), PATH).count() == 0


# ---- SimHash --------------------------------------------------------------

def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    if not w:
        return 0
    s = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits):
    parent = dict((i, i) for i in prints)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


@pytest.mark.parametrize("hot, bits", [(64, 2), (1, 2), (1, 1), (3, 1), (64, 0)])
def test_simhash_equals_brute_force(spark, hot, bits):
    r = random.Random(6)
    base = prose(r, 300)
    rows = [(i, prose(r, r.randint(1, 40))) for i in range(40)]
    for i in range(60):                                    # near copies of one text, many fingerprints
        w = base.split()
        for _ in range(i % 4):
            w[r.randrange(300)] = f"n{i}"
        rows.append((100 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "ONE"), (304, "one"), (305, "a  b\nc\td"),
             (306, "a b c d"), (307, "x " * 70_000)]
    got = simhash.simhash_near_duplicates(frame(spark, rows), max_bits=bits, hot_bucket=hot).collect()
    prints = {i: brute_fingerprint(t) for i, t in rows}
    assert {x.doc_id: x.fp % (1 << 64) for x in got} == prints
    assert {x.doc_id: x.component_id for x in got} == brute_components(prints, bits)


def test_simhash_repeated_and_null_rows(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "only here now"), (9, "q w e r t")]
    got = simhash.simhash_near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(x.doc_id), str(x.component_id)) for x in got) == [
        ("2", "2"), ("3", "2"), ("3", "2"), ("9", "9"), ("None", "2"), ("None", "None")]
    kept = simhash.keep_representatives(frame(spark, rows + [(2, "a b c d")]))
    assert sorted(str(x.doc_id) for x in kept.collect()) == ["2", "9", "None", "None"]
    assert simhash.simhash_near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_simhash_of_texts_that_share_ids_or_have_none(spark, seed):
    """Nodes are texts: two texts under one id, and rows without an id, link and
    bridge as any other; no text is lost whose group keeps no copy."""
    r = random.Random(seed)
    base = [prose(r, 120) for _ in range(3)]
    rows = []
    for n in range(90):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            w[r.randrange(len(w))] = f"n{n}"
        rows.append((r.choice([None, *range(25)]), " ".join(w)))
    rows += [(3, "a b c d"), (3, "totally other words here"), (5, "totally other words here"), (None, None), (7, "")]
    rows += rows[:6]
    groups = brute_components({n: brute_fingerprint(t) for n, (_, t) in enumerate(rows)}, 2)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[groups[n]] = min(i, least.get(groups[n], i))
    got = simhash.simhash_near_duplicates(frame(spark, rows)).collect()
    key = lambda x: (str(x[0]), str(x[1]), str(x[2]))
    assert sorted(((x.doc_id, x.fp % (1 << 64), x.component_id) for x in got), key=key) == sorted(
        ((i, brute_fingerprint(t), least.get(groups[n])) for n, (i, t) in enumerate(rows)), key=key)
    kept = [(x.doc_id, x.text) for x in simhash.keep_representatives(frame(spark, rows)).collect()]
    named = [k for k in kept if k[0] is not None]
    of = {k: groups[n] for n, k in enumerate(rows)}
    assert len(named) == len({of[k] for k in named}) == len(least)           # one row of every group with an id
    assert all(k[0] == least[of[k]] for k in named)
    assert sorted(str(k) for k in kept if k[0] is None) == sorted(str(k) for k in rows if k[0] is None)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)], "a long, b long")
    assert {x.component for x in simhash.components(edges).collect()} == {0}


# ---- passages -------------------------------------------------------------

def test_chain_follows_both_orders():
    x = np.array([0, 10, 20, 30, 31, 400])
    y = np.array([100, 110, 5, 130, 131, 140])
    paths = substrings.chain(x, y, 16, 0.15)
    assert sorted(len(p) for p in paths) == [1, 1, 4]
    long = max(paths, key=len)
    assert long.tolist() == [0, 1, 3, 4]


def longest_common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if p == q else max(t[i][j + 1], t[i + 1][j])
    return t


def random_words(r, most, kinds):
    return np.array([r.randrange(kinds) for _ in range(r.randrange(most))], np.uint64)


def in_order(a, b, i, j):
    return (a[i] == b[j]).all() and (np.diff(i) > 0).all() and (np.diff(j) > 0).all()


@pytest.mark.parametrize("limit", [250_000, 40, 1])
def test_common_pairs_equal_brute_force(limit):
    r = random.Random(8)
    jobs = [(random_words(r, 30, k), random_words(r, 30, k), 0.0) for k in (2, 4, 40) for _ in range(80)]
    for (a, b, _), (i, j) in zip(jobs, substrings.common_pairs_of(jobs, limit, together=3000)):
        assert len(i) == len(j) == longest_common(a.tolist(), b.tolist())[-1][-1]
        assert in_order(a, b, i, j)


def test_common_beginnings_equal_brute_force():
    r = random.Random(13)
    jobs = []
    for _ in range(200):
        b = random_words(r, 30, 50)
        a = np.array([v if r.random() < 0.8 else 99 for v in b], np.uint64)
        jobs.append((a, np.r_[b, random_words(r, 10, 50)], 0.6))
    for (a, b, loss), (i, j) in zip(jobs, substrings.common_pairs_of(jobs, together=3000)):
        m = min(len(a), len(b))
        lo = next((n for n in range(m) if a[n] != b[n]), m)            # equal beginnings come first
        t = longest_common(a[lo:].tolist(), b[lo:].tolist())
        best = max(v - loss * max(x, y) for x, row in enumerate(t) for y, v in enumerate(row))
        assert (i[:lo] == np.arange(lo)).all() and in_order(a, b, i, j)
        i, j = i[lo:] - lo, j[lo:] - lo
        assert len(i) - loss * (max(i[-1], j[-1]) + 1 if len(i) else 0) == pytest.approx(best)


def test_long_alignments_lose_no_common_word():
    """A block put into one side of an alignment far over the table's limit."""
    r = random.Random(14)
    a = np.array([r.randrange(10**6) for _ in range(1500)], np.uint64)
    b = a.copy()
    b[::12] += np.uint64(10**7)
    for block in (30, 300, 800):
        c = np.r_[b[:600], random_words(r, 2, 1), np.arange(2 * 10**7, 2 * 10**7 + block, dtype=np.uint64), b[600:]]
        i, j = substrings.common_pairs(a, c)
        assert len(i) == 1375 and in_order(a, c, i, j)


def test_words_in_common_bound_the_alignment():
    r = random.Random(15)
    sides = [random_words(r, 25, 6) for _ in range(120)]
    first = np.r_[0, np.cumsum([len(s) for s in sides])]
    rows = np.array([i for i in range(0, 119, 2) if i % 3])
    words = substrings.W.mix(np.concatenate(sides))
    got, shared = substrings._common(words, first, rows)
    for i, n in zip(rows, got):
        one, two = (collections.Counter(sides[k].tolist()) for k in (i, i + 1))
        assert n == sum((one & two).values()) >= longest_common(sides[i], sides[i + 1])[-1][-1]
        assert shared[first[i]:first[i + 1]].tolist() == [v in two for v in sides[i].tolist()]
    for least, share in ((1, 1.0), (3, 0.8), (10, 0.5), (30, 0.1)):
        want = []
        for i in rows:
            v = np.r_[0, np.cumsum(shared[first[i]:first[i + 1]])]
            want.append(any(v[e] - v[s] >= share * (e - s) - 1e-9 for s in range(len(v))
                            for e in range(s + least, len(v))))
        assert substrings._dense(shared, first, rows, least, share).tolist() == want


def test_chains_over_several_slices_and_repeated_rows():
    """Sides of one chain that come in different batches, and repeated ones."""
    r = random.Random(16)
    rows = []
    for n in range(12):
        text = prose(r, 60, 10**6)
        one, two = f"{prose(r, 10, 10**6)} {text}", f"{text} {prose(r, 5, 10**6)}"
        for side, piece in ((0, one), (1, two)):
            for _ in range(1 + n % 3):
                rows.append({"doc_id": 2 * n, "version": n, "partner_id": 2 * n + 1, "partner_version": -n, "x0": 12,
                             "y0": 2, "side": side, "at": [12 if side == 0 else 2], "piece": piece})
    kinds = pa.schema([(c, pa.int64()) for c in [*substrings.PAIR, "x0", "y0", "side"]]
                      + [("at", pa.list_(pa.int32())), ("piece", pa.string())])
    table = pa.Table.from_pylist(rows, schema=kinds)
    for size in (1, 2, 5, 1000):
        got = pa.Table.from_batches(list(substrings._compare(
            iter(table.to_batches(size)), [*substrings.PAIR, "x0", "y0"], 6, 96, 50, 0.8))).to_pylist()
        assert sorted((x["doc_id"], x["start_word"], x["end_word"], x["partner_start"], x["n_equal"]) for x in got) == \
            [(2 * n, 10, 70, 0, 60) for n in range(12)]


def test_passages_are_found_and_clean_documents_left_alone(spark):
    r = random.Random(9)
    passage, hot = prose(r, 55, 10**6), prose(r, 14, 10**6)
    fuzzy = prose(r, 120, 10**6)
    rows = [(i, hot + " " + prose(r, 150, 10**6)) for i in range(30)]                    # share a short line only
    rows += [(100 + i, f"{prose(r, 60 + i, 10**6)} {passage} {prose(r, 40, 10**6)}") for i in range(12)]
    for i in range(3):
        w = fuzzy.split()
        for j in range(5 + i, 120, 37):
            w[j] = f"e{i}"
        if i == 2:
            del w[60]
        rows.append((200 + i, prose(r, 30, 10**6) + " " + " ".join(w)))
    copy = prose(r, 80, 10**6)
    rows += [(300, copy), (301, copy), (301, copy), (302, copy), (400, None), (401, ""), (402, "short"),
             (None, copy), (403, "rep " * 4000)]
    got = substrings.repeated_passages(frame(spark, rows)).collect()
    where = collections.defaultdict(set)
    for x in got:
        where[x.doc_id].add((x.start_word, x.end_word))
        where[x.partner_id]
        assert x.identity >= 0.8 and x.end_word - x.start_word >= 50
    assert set(where) == {*range(100, 112), 200, 201, 202, 300, 301, 302}
    texts = dict(rows)
    for i in range(100, 112):
        for s, e in where[i]:
            assert " ".join(WORD.findall(texts[i])[s:e]) == passage
    assert [(x.doc_id, x.partner_id) for x in sorted(got) if x.doc_id in (301, 302)] == [(301, 300), (302, 300)]
    assert substrings.repeated_passages(frame(spark, [])).count() == 0


def test_every_long_exact_repeat_is_found(spark):
    r = random.Random(10)
    pool = [prose(r, 70, 10**6).split() for _ in range(6)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(3):
            p = r.choice(pool)
            a = r.randrange(20)
            parts.append(" ".join(p[a:a + r.randint(30, 70)]))
            parts.append(prose(r, 20, 10**6))
        rows.append((i, " ".join(parts)))
    seen = collections.defaultdict(set)
    for i, t in rows:
        w = t.split()
        for a in range(len(w) - 49):
            seen[tuple(w[a:a + 50])].add(i)
    need = set().union(*[s for s in seen.values() if len(s) > 1])
    got = substrings.repeated_passages(frame(spark, rows)).collect()
    assert need <= {x.doc_id for x in got} | {x.partner_id for x in got}


def edited(words, step, tag):
    return " ".join(f"{tag}{j}" if j % step == step // 2 else w for j, w in enumerate(words))


def test_passages_with_many_edits_are_found_whole(spark):
    r = random.Random(11)
    rows, need = [], {}
    for i, step in enumerate([8, 8, 8, 10, 10, 10, 12, 12, 16, 16]):          # no run of 16 words
        words = prose(r, 100, 10**6).split()
        rows += [(2 * i, f"{prose(r, 40, 10**6)} {' '.join(words)} {prose(r, 30, 10**6)}"),
                 (2 * i + 1, f"{prose(r, 70, 10**6)} {edited(words, step, f'e{i}x')} {prose(r, 20, 10**6)}")]
        need[2 * i] = (40, 140)
        need[2 * i + 1] = (70, 170)
    got = substrings.repeated_passages(frame(spark, rows)).collect()
    assert {min(x.doc_id, x.partner_id) // 2 for x in got} == set(range(10))
    for x in got:
        for i, s, e in ((x.doc_id, x.start_word, x.end_word), (x.partner_id, x.partner_start, x.partner_end)):
            # an end is at most ``reach`` words from the outer seed
            assert s >= need[i][0] - 2 and e <= need[i][1] + 2 and e - s >= 80
        assert abs(x.doc_id - x.partner_id) == 1 and x.identity >= 0.8


def test_passages_on_one_chain_are_told_apart(spark):
    r = random.Random(12)
    rows = []
    for i in range(6):
        one, two = (prose(r, 100, 10**6).split() for _ in range(2))
        rows += [(2 * i + j, " ".join([prose(r, 20, 10**6), edited(one, 40, f"a{i}x{j}"), prose(r, 100, 10**6),
                                       edited(two, 40, f"b{i}x{j}"), prose(r, 20, 10**6)])) for j in range(2)]
    got = substrings.repeated_passages(frame(spark, rows)).collect()
    assert all(x.doc_id // 2 == x.partner_id // 2 and x.identity >= 0.8 for x in got)
    # 20 to 120 and 220 to 320 in either document
    assert {(x.doc_id // 2, round(x.start_word, -1), round(x.end_word, -1)) for x in got} == \
        {(i, s, s + 100) for i in range(6) for s in (20, 220)}
    assert len({tuple(x) for x in got}) == len(got)
    p = np.r_[0:60, 160:220, 400:430]
    assert substrings.parts(p, p, 50, 0.8) == [(0, 60), (60, 120)]


def test_edited_passages_whose_stretches_stand_in_other_texts_are_found(spark):
    """Every seed of a passage is also in texts that have 30 words of it only."""
    r = random.Random(21)
    rows, need = [], set()
    for i in range(30):
        words, base = prose(r, 120, 10**6).split(), 100 * i
        rows += [(base, f"{prose(r, 40, 10**6)} {' '.join(words)} {prose(r, 30, 10**6)}"),
                 (base + 1, f"{prose(r, 30, 10**6)} {edited(words, 12, f'e{i}x')} {prose(r, 40, 10**6)}")]
        need.add((base, base + 1))
        for s in range(4):
            rows += [(base + 10 + 5 * s + j, f"{prose(r, 50, 10**6)} {' '.join(words[30 * s:30 * s + 30])} "
                                             f"{prose(r, 50, 10**6)}") for j in range(5)]
    got = substrings.repeated_passages(frame(spark, rows)).collect()
    assert {(min(x.doc_id, x.partner_id), max(x.doc_id, x.partner_id)) for x in got} == need


def test_one_word_again_and_again_is_matched_by_its_runs(spark):
    """Runs of a word give one place for each run, and all their words are covered."""
    r = random.Random(22)
    rows = [(i, f"{prose(r, 30, 10**6)} {'again ' * n}{prose(r, 30, 10**6)}") for i, n in enumerate([300, 60, 300, 90, 20])]
    places = substrings.seeds(frame(spark, rows), 6, 10, 96, 50).filter("pos >= 0").collect()
    one = collections.Counter(x.seed for x in places).most_common(1)[0][0]
    places = [x for x in places if x.seed == one]
    assert collections.Counter(x.doc_id for x in places if x.run > 0) == collections.Counter(range(5))
    for x in places:
        if x.run > 0:
            assert x.run == sum(y.doc_id == x.doc_id for y in places)
            assert len(x.los) == (-(-x.run // 50) + 1 if x.run > 1 else 0)
    met = substrings.matches(substrings.seeds(frame(spark, rows), 6, 10, 96, 50), 50)
    assert met.count() < 30 and len(places) > 600
    covered = collections.defaultdict(set)
    for x in substrings.repeated_passages(frame(spark, rows)).collect():
        covered[x.doc_id].update(range(x.start_word, x.end_word))
        covered[x.partner_id].update(range(x.partner_start, x.partner_end))
    texts = dict(rows)
    assert set(covered) == {0, 1, 2, 3}
    for i in covered:
        assert {j for j, w in enumerate(texts[i].split()) if w == "again"} <= covered[i]
    # 42 words in common, 50 of the longer runs
    rows = [(i, f"{prose(r, 30, 10**6)} {'one ' * n}{'two ' * n}{prose(r, 30, 10**6)}") for i, n in enumerate([61, 21])]
    assert len(substrings.repeated_passages(frame(spark, rows)).collect()) == len(
        substrings.repeated_passages(frame(spark, [(-i, t) for i, t in rows])).collect())


def test_progressions_of_seeds():
    """Against a plain search: places of one seed at equal steps of at most 6."""
    r = np.random.default_rng(23)
    for _ in range(200):
        n = int(r.integers(0, 40))
        doc = np.sort(r.integers(0, 3, n))
        at = np.cumsum(r.integers(1, 4, n))
        g = r.integers(0, 3, n)
        run, step, last = substrings.progressions(g, at, doc, 6)
        seen = []
        for i in np.flatnonzero(run).tolist():
            places = (at[i] + step[i] * np.arange(run[i])).tolist()
            own = [int(np.searchsorted(at, p)) for p in places]
            assert [int(at[j]) for j in own] == places and last[i] == own[-1]
            assert all(g[j] == g[i] and doc[j] == doc[i] for j in own) and 1 <= step[i] <= 6
            seen += own
        assert sorted(seen) == list(range(n))
        for d in set(doc.tolist()):
            for s in set(g.tolist()):
                places = at[(doc == d) & (g == s)].tolist()
                if len(places) > 2 and len(set(np.diff(places))) == 1 and places[1] - places[0] <= 6:
                    assert run[np.searchsorted(at, places[0])] == len(places)


def test_few_words_again_and_again_are_matched_by_their_runs(spark):
    """Two to six words repeated hundreds of times give a few rows for a text, not
    one for each place; all their words are covered and every text is linked."""
    r = random.Random(24)
    for words in (2, 3, 6):
        line = prose(r, words, 10**6) + " "
        lens = [400, 90, 300, 61, 200, 500, 12]
        rows = [(i, f"{prose(r, 30, 10**6)} {line * (n // words)}{prose(r, 30, 10**6)}") for i, n in enumerate(lens)]
        # a word before the line shared by two texts that are not the lowest
        rows += [(20 + i, f"{prose(r, 20 + i, 10**6)} before {line * (100 // words)}{prose(r, 20, 10**6)}") for i in range(2)]
        found = substrings.materialize(substrings.seeds(frame(spark, rows), 6, 10, 96, 50))
        met = substrings.materialize(substrings.matches(found, 50))
        assert found.filter("pos >= 0").count() > 1500 // words and met.count() < 150
        assert substrings.chains(met, 6, 0.15).count() < 60
        left = found.filter("run > 1").select("seed").distinct()
        assert substrings._by_pairs(found, left, 50, 96).count() < 200
        got = substrings.repeated_passages(frame(spark, rows)).collect()
        assert len(got) < 200
        covered = collections.defaultdict(set)
        for x in got:
            assert x.identity >= 0.8
            covered[x.doc_id].update(range(x.start_word, x.end_word))
            covered[x.partner_id].update(range(x.partner_start, x.partner_end))
        repeated = set(line.split())
        assert set(covered) == {0, 1, 2, 3, 4, 5, 20, 21}
        for i, t in rows:
            if i in covered:
                assert {j for j, w in enumerate(t.split()) if w in repeated or w == "before"} <= covered[i]
        assert any({x.doc_id, x.partner_id} == {20, 21} for x in got)
