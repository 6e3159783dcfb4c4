"""Importance resampling, ranked search and license scans against brute force."""
import hashlib
import math
import os
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest

from loanlens.llm import importance, licenses, ranked
from loanlens.llm.registry import ORACLE_SQL, QUERIES
from tests.conftest import SF001, SF0001
from tools.check_oracle import TABLES, digest

DOC = "doc_id bigint, text string, item string, rank int, score string, label string, low string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def docs_of(spark, rows, partitions=3):
    """Documents with extra columns whose names clash with the operators' own."""
    frame = spark.createDataFrame([(i, t, "x", 7, "y", "z", "w") for i, t in rows], DOC)
    return frame.repartition(partitions) if rows else frame


def some_texts(seed, n):
    r = random.Random(seed)
    vocabulary = ["Aa", "b1", "İx", "ñu", "the", "of", "K2", "zz", "K", "日本", "q"] + [f"w{i}" for i in range(40)]
    out = []
    for i in range(n):
        k = r.choice([0, 1, 3, 25, 60])
        out.append((i, "".join(r.choice(vocabulary) + r.choice([" ", "\n", "-", ", ", "\t"]) for _ in range(k))))
    return out + [(n, None), (n + 1, ""), (3, "repeated row of words"), (3, "repeated row of words"),
                  (None, "aa b1 the"), (None, "aa b1 the"), (n + 2, "the of " * 3000), (n + 3, "x" * 70000)]


# ---- ranked search -------------------------------------------------------------------

def brute_search(docs, items, k):
    held = [(i, Counter(words(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, n_words = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        terms = set(words(text))
        scored = []
        for (i, c), n in zip(held, sizes):
            m = 50 + 50 * n * n_docs // n_words if n_words else 50
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                    for t in terms if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


ITEMS = [("a", "The b1 w3 w5 w5"), ("b", "İx ñu 日本 K"), ("c", None), ("d", "nothingofthis"), (None, "q zz of"),
         ("a", "The b1 w3 w5 w5"), ("a", "w1 w2")]


@pytest.mark.parametrize("k, postings", [(4, 10**6), (50, 3), (1, 1)])
def test_search_equals_brute_force(spark, k, postings):
    rows = some_texts(1, 60)
    items = spark.createDataFrame([(i, t, 5) for i, t in ITEMS], "item_id string, text string, doc_id int")
    got = ranked.search(docs_of(spark, rows), items, k=k, max_postings=postings, fan_in=2)
    assert sorted(((r["item"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()), key=str) \
        == brute_search(rows, ITEMS, k)


def test_search_tiles_do_not_change_scores(spark):
    rows = some_texts(2, 80)
    terms = ranked.item_terms(spark.createDataFrame([(i, t) for i, t in ITEMS], "item_id string, text string"))
    got = sorted(terms.collect(), key=lambda r: str((r["item"], sorted(r["terms"]))))
    vocabulary = sorted({t for r in got for t in r["terms"]}, key=lambda t: t.encode())
    numbers = np.array([vocabulary.index(t) for r in got for t in r["terms"]], np.int32)
    off = np.r_[0, np.cumsum([len(r["terms"]) for r in got])]
    weights = np.arange(1, len(vocabulary) + 1)
    sc = spark.sparkContext
    table = ranked.impacts_table(docs_of(spark, rows), sc.broadcast(vocabulary), "doc_id", "text")
    held = sc.broadcast((off, numbers, weights))
    seen = [sorted(tuple(r) for r in ranked.best_of_tasks(table, held, "string", 5, 70, 3000, *sizes)
                   .select("number", "doc_id", "score").fillna(-1).collect()) for sizes in [(1024, 2048, 256), (7, 2, 2)]]
    assert seen[0] == seen[1] and seen[0]


def test_large_weights_are_refused_and_tiles_stay_exact():
    weights = np.array([ranked.EXACT // ranked.TOP_IMPACT - 1] * 3, np.int64)
    tiles = list(ranked.vocabulary_tiles(np.array([0, 3]), np.array([0, 1, 2]), weights, 0, 1, 100))
    assert [len(t) for t, _ in tiles] == [1, 1, 1]
    with pytest.raises(ValueError):
        list(ranked.vocabulary_tiles(np.array([0, 1]), np.array([0]), weights + 10**7, 0, 1, 100))


def test_length_norms_beyond_64_bits():
    assert ranked.length_norms(np.array([10**7]), 10**13, 10**15)[0] == 50 + 50 * 10**20 // 10**15


def test_search_of_empty_tables(spark):
    docs = docs_of(spark, [])
    items = spark.createDataFrame([("a", "w1")], "item_id string, text string")
    assert ranked.search(docs, items).collect() == []
    assert ranked.search(docs_of(spark, [(1, "w1")]), items.limit(0)).collect() == []


# ---- importance resampling -------------------------------------------------------------

def runs(text, order):
    w = words(text)
    return [" ".join(w[i:i + j]) for j in range(1, order + 1) for i in range(len(w) - j + 1)]


def brute_resample(docs, target, percent, least, buckets, order, seed):
    def counts(texts):
        return Counter(crc32(g.encode()) % buckets for t in texts for g in runs(t, order))
    s, t = counts(x for _, x in docs), counts(target)
    above, below = sum(t.values()) + buckets, sum(s.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * below / ((s[b] + 1) * above))) for b in range(buckets)]
    out = []
    for i, text in docs:
        grams = runs(text, order)
        weight = sum(gain[crc32(g.encode()) % buckets] for g in grams)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(text)), len(grams), weight,
                    weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[:percent * len(able) // 100]):
        r[5] = rank + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("order, buckets, percent", [(1, 10000, 10), (3, 50, 60), (2, 7, 100)])
def test_resampling_equals_brute_force(spark, order, buckets, percent):
    rows = some_texts(3, 70)
    target = [t for _, t in some_texts(4, 12)]
    frame = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = importance.resample(docs_of(spark, rows), frame, percent, 20, buckets, order, seed=11)
    assert sorted((tuple(r) for r in got.collect()), key=str) \
        == brute_resample(rows, target, percent, 20, buckets, order, 11)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_pieces_carry_runs_over_the_cut(order):
    text = ("Aa b1 " * 40 + "x" * 90 + " ñu 日本 q\n" * 30).encode()
    whole, parts = Counter(), Counter()
    for limit, into in [(1 << 20, whole), (17, parts)]:
        for _, count in importance.features(text, order, limit):
            into.update(count)
    assert whole == parts == Counter(crc32(g.encode()) for g in runs(text.decode(), order))


def test_resampling_of_empty_tables(spark):
    target = spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(docs_of(spark, []), target).collect() == []
    rows = some_texts(5, 10)
    got = importance.resample(docs_of(spark, rows), target.limit(0), 50, 3, 100, 1, 1)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_resample(rows, [], 50, 3, 100, 1, 1)


# ---- license scans ---------------------------------------------------------------------

def brute_scan(text, phrases, signatures):
    text = text or ""
    w = words(text)
    places = [(label, i) for label, p in phrases for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    found = []
    for n, (label, priority, keys, pattern) in enumerate(signatures):
        if not all(k in text.lower() for k in keys):
            continue
        for m in re.finditer(pattern, text, re.IGNORECASE | re.ASCII):
            found.append((m.start(), m.end(), priority, n, label))

    def beaten(d):
        for o in found:
            if o == d:
                continue
            inside = o[0] <= d[0] and o[1] >= d[1]
            longer = (o[1] - o[0], -o[3]) > (d[1] - d[0], -d[3])
            if inside and (o[2] > d[2] or o[2] == d[2] and longer):
                return True
        return False

    kept = [d for d in found if not beaten(d)]
    kept = [d for d in kept if not any(o[2] > d[2] and o[0] >= d[0] and o[1] <= d[1] for o in kept)]
    return (len(w), sorted(places), sorted((d[4], d[0], d[1]) for d in kept),
            sorted({p[0] for p in places}), sorted({p[0] for p in places} | {d[4] for d in kept}))


TEXTS = [
    None, "", "no terms here", "CC-BY and cc.by, cc  by; ccby cc by-sa 4.0 / CC BY 3.0",
    "Released under the MIT License. All Rights\nReserved. all_rights_reserved",
    "This work is licensed under the GNU General Public License, version 3 or any later version.",
    "Licensed under the Apache License, Version 2.0 (the License); see http://www.apache.org/licenses/LICENSE-2.0",
    "// SPDX-License-Identifier: GPL-2.0-only\n# SPDX-License-Identifier: (MIT OR Apache-2.0)",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "https://creativecommons.org/licenses/by-nc-sa/4.0/ and creativecommons.org",
    "GNU Lesser\n * General Public License v2.1, GNU Affero General Public License 3.0",
    "Copyright (c) 2001-2004, 2007 A. Person. Tous droits réservés. © 2020 x",
    "日本 cc by 日本 İ general public license K all rights reserved " * 5,
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND",
    "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-Clause",
    "unauthorised copying of this file is strictly prohibited; may not be reproduced without permission",
    "Mozilla Public License Version 2.0; Eclipse Public License - v 2.0; the Unlicense; CC0 1.0 Universal; WTFPL",
    "sous licence GPL, bajo licencia MIT, unter der MIT-Lizenz, licensed under a Creative Commons license",
    "𝔸 emoji 😀 cc by 😀 MIT license 😀", "the general public licensed, mit licenses, cc bye, ball rights reserved",
]


def test_scan_equals_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(4, TEXTS[4]), (4, TEXTS[4]), (None, TEXTS[3])]
    got = licenses.scan(docs_of(spark, rows)).collect()
    seen = sorted(((r["doc_id"], r["n_words"], sorted((p["label"], p["word"]) for p in r["places"]),
                    sorted((d["label"], d["s"], d["e"]) for d in r["detections"]), r["base_labels"], r["labels"])
                   for r in got), key=str)
    assert seen == sorted(((i, *brute_scan(t, licenses.PHRASES, licenses.RULES)) for i, t in rows), key=str)
    assert all(d["found"] == (TEXTS[r["doc_id"]] or "")[d["s"]:d["e"]] for r in got if r["doc_id"] is not None
               for d in r["detections"])
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) for r in got)


RULES = [("long", 2, ("aa",), "aa bb cc"), ("short", 2, ("bb",), "bb"), ("top", 3, ("cc",), "cc dd"),
         ("wide", 1, ("bb",), "bb cc dd ee"), ("same", 2, ("aa",), "aa bb cc"), ("all", 1, ("x",), "[a-x ]+")]


@pytest.mark.parametrize("seed", range(4))
def test_suppression_equals_brute_force(spark, seed):
    r = random.Random(seed)
    texts = [" ".join(r.choice(["aa", "bb", "cc", "dd", "ee", "x", "y"]) for _ in range(r.randrange(30))) for _ in range(40)]
    phrases = [("p", "aa"), ("q", "bb bb"), ("r", "bb cc")]
    got = licenses.scan(docs_of(spark, list(enumerate(texts))), phrases, RULES).collect()
    for row in got:
        n, places, kept, base, labels = brute_scan(texts[row["doc_id"]], phrases, RULES)
        assert row["n_words"] == n and row["labels"] == labels and row["base_labels"] == base
        assert sorted((p["label"], p["word"]) for p in row["places"]) == places
        assert sorted((d["label"], d["s"], d["e"]) for d in row["detections"]) == kept


def test_no_keyword_hides_a_match():
    for label, _, keys, pattern in licenses.RULES:
        assert all(k and " " not in k and k == k.lower() for k in keys), label
    for text in filter(None, TEXTS):
        for label, _, keys, pattern in licenses.RULES:
            if re.search(pattern, text, re.IGNORECASE | re.ASCII):
                assert all(k in text.lower() for k in keys), (label, keys, text)


def test_scan_of_empty_table_and_long_text(spark):
    assert licenses.scan(docs_of(spark, [])).collect() == []
    long = "w " * 300_000 + "cc by " + "MIT License " * 200
    r = licenses.scan(docs_of(spark, [(1, long)])).first()
    assert (r["n_words"], r["places"][0]["word"], len(r["detections"])) == (300_402, 300_000, 201)


@pytest.mark.skipif(not os.path.isdir(SF0001), reason="driver tables not present")
def test_license_plan_is_native(spark):
    plan = QUERIES["op13_licenses"](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange|Join", plan)


@pytest.mark.skipif(not os.path.isdir(SF001), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    df = QUERIES[name](spark, SF001)
    res = con.sql(ORACLE_SQL[name])
    rows, want = [tuple(r) for r in df.collect()], res.fetchall()
    assert len(rows) == len(want) and digest(rows, df.columns) == digest(want, res.columns)
