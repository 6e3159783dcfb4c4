"""Toxicity, language, secrets, PII and the pipeline: held-out accuracy, round trips, edge cases."""
import datetime
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors

import __spark_entry__ as E
from loanlens.llm import bytewords as W
from loanlens.llm import langid, pii, secret_scan, toxicity

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF01), reason="driver tables not present")


# ---- toxicity -------------------------------------------------------------

def labelled(spark, n=600, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        group = r.choice(["women"] * 9 + ["men"]) if toxic else r.choice(["women", "men", "men"])
        words = [r.choice("alpha beta gamma delta epsilon zeta eta".split()) for _ in range(8)]
        if toxic and r.random() < 0.7:
            words[3] = r.choice(["horrid", "horridly", "horridness"])
        rows.append((i, f"{group} {' '.join(words)}", int(toxic), 0.5))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, score double")


def scores(model, *texts):
    return model.score(*W.buffers(pa.array(texts)))


def test_swap_penalty_makes_identity_terms_neutral(spark):
    df = labelled(spark)
    plain, fair = (toxicity.train(df, df, swap_weight=s) for s in (0.0, 5.0))
    logit = lambda p: np.log(p / (1 - p))
    a, b = logit(scores(plain, "women alpha beta", "men alpha beta"))
    assert a - b > 1
    got = scores(fair, "women alpha beta", "men alpha beta", "men horridly", "", None)
    a, b, bad, empty, null = got
    assert abs(logit(a) - logit(b)) < 0.1 and bad > 0.9 and max(a, empty, null) < 0.6 and empty == null


def test_toxicity_without_labels_or_rows(spark):
    df = labelled(spark, 8)
    none = toxicity.train(df, df.limit(0))
    assert scores(none, "anything")[0] == pytest.approx(0.25)
    model = toxicity.train(df, df.filter("toxic = 0"))
    assert toxicity.score(df, model).filter("predicted = 1").count() == 0
    assert toxicity.score(df.limit(0), model).count() == 0
    kept = toxicity.reject_toxic(df, model)
    assert kept.count() == 8 and kept.columns == df.columns


def test_swapper_replaces_whole_words_only():
    swap = toxicity.swapper((("men", "women"),))
    assert swap("Men, women; omen mené men") == "women, men; omen mené women"


@needs_data
def test_toxicity_held_out(spark):
    got = E.queries()["op2_toxicity"](spark, SF01).toPandas().set_index("doc_id")
    lab = spark.read.parquet(f"{SF01}/labels.parquet").toPandas().set_index("doc_id")
    j = got.join(lab, how="inner")
    j = j[j.held_out]
    pos, neg = j[j.toxic == 1].score, j[j.toxic == 0].score
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert len(got) == 1000 and auc > 0.85
    assert ((got.score >= 0.5).astype(int) == got.predicted).all() and got.score.between(0, 1).all()


# ---- language -------------------------------------------------------------

EN = "the of and to in is that for it was on are with they be at this have from or by word what all were"
DE = "der die und in den von zu das mit sich des auf nicht ein ist im dem auch als an nach wie wird bei aus"


def test_mixture_and_edge_cases(spark):
    r = random.Random(3)
    make = lambda w, n: " ".join(r.choice(w.split()) for _ in range(n))
    rows = [(i, make(EN, 40), "en") for i in range(40)] + [(i, make(DE, 40), "de") for i in range(40, 80)]
    rows += [(90, "zzz", None), (91, None, "en")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(train)
    assert model[0] == ["de", "en"]
    probe = [(1, make(EN, 30)), (2, make(DE, 30)), (3, make(EN, 60) + " " + make(DE, 20)), (4, None), (5, ""),
             (6, "123 !? 4"), (7, "é"), (8, make(DE, 30_000)), (1, make(EN, 30))]
    got = langid.predict(spark.createDataFrame([(*p, "xx") for p in probe], "doc_id long, text string, score string"),
                         model).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(probe)
    assert [by[i].lang_pred for i in (1, 2, 3, 4, 5, 6, 8)] == ["en", "de", "en", "und", "und", "und", "de"]
    assert set(by[1].mixture) == {"en"} and set(by[3].mixture) == {"en", "de"}
    assert by[3].mixture["en"] == pytest.approx(0.75, abs=0.1) and by[7].lang_pred in ("de", "en")
    assert by[4].score == 0.0 and all(0 <= x.score <= 1 for x in got)
    nothing = langid.train(train.limit(0))
    assert {x.lang_pred for x in langid.predict(train, nothing).collect()} == {"und"}


@needs_data
def test_language_held_out(spark):
    got = E.queries()["op5_language"](spark, SF01).toPandas().set_index("doc_id")
    lang = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id").lang
    out = got[got.held_out]
    assert (out.lang_pred == lang.loc[out.index]).mean() > 0.97


# ---- secrets --------------------------------------------------------------

@pytest.fixture(scope="module")
def scanner(spark):
    r = random.Random(5)
    words = "stone river window garden little house morning paper table yellow".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(60))) for i in range(200)]
    corpus = secret_scan.corpus_model(spark.createDataFrame(rows, "doc_id long, text string"), n_words=100)
    return corpus, secret_scan.train(spark, corpus)


def test_forest_arrays_vote_like_the_fitted_model(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    df = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x, y)], ["label", "features"])
    model = RandomForestClassifier(numTrees=7, maxDepth=4, seed=2).fit(df)
    votes = np.mean([[t.predict(Vectors.dense(a)) for a in x] for t in model.trees], axis=0)
    assert np.allclose(secret_scan.read_forest(model).share(x), votes)


def test_held_out_findings(scanner):
    corpus, forest = scanner
    held = secret_scan.labelled_findings(600, seed=99)
    x = np.array([secret_scan.describe(t[max(0, s - 60):s], t[s:e], t[e:e + 60], p, corpus) for t, s, e, p, _ in held])
    y = np.array([v[-1] for v in held])
    pred = forest.share(x) >= 0.5
    assert (pred == y).mean() > 0.9 and pred[y == 1].mean() > 0.95


def test_scan_and_redact(spark, scanner):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(1, f'é stone token = "{key}" river'), (2, f"commit {key} river"), (3, "4111111111111111 table"),
            (4, None), (5, ""), (6, "password: hunter2!x9 and " + "stone river " * 30_000), (1, f'é stone token = "{key}" river'),
            (7, f"api_key={key}"), (8, "x = 1: y")]
    df = spark.createDataFrame([(i, t, "src", len(t or ""), 0.0) for i, t in rows],
                               "doc_id long, text string, source string, n_chars long, score double")
    found = secret_scan.scan(df, *scanner).collect()
    texts = dict(rows)
    assert all(texts[x.doc_id][x.start:x.end] == x.value for x in found)
    assert sorted(x.doc_id for x in found if x.value == key and x.is_secret) == [1, 1, 7]
    assert not any(x.is_secret for x in found if x.doc_id in (2, 3))
    clean = {x.doc_id: x for x in secret_scan.redact(df, *scanner).collect()}
    assert clean[1].text == 'é stone token = "[SECRET]" river' and clean[1].n_chars == len(clean[1].text)
    assert clean[2].text == texts[2] and clean[4].text is None and clean[7].text == "api_key=[SECRET]"
    assert secret_scan.redact(df, *scanner).count() == len(rows)
    assert secret_scan.scan(df.limit(0), *scanner).count() == 0
    empty = secret_scan.corpus_model(df.limit(0))
    assert len(empty.words) == 0 and empty.coverage("abcdef") == 0.0


def test_long_secrets_are_masked_whole(spark, scanner):
    r = random.Random(6)
    some = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    long, bare, twice = some(2000), "ghp_" + some(1500), some(700)
    cjk = "".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(700))
    rows = [(1, f'private_key = "{long}" river'), (2, f"stone {bare} river"), (3, f"token:{cjk} river"),
            (4, f"token:x{cjk} river"), (5, f"token:xy{cjk}"), (6, "token=" * 3000 + " river"),
            (7, f"stone token: {twice}\nsecret: {twice}")]
    df = spark.createDataFrame([(i, t, "src", len(t)) for i, t in rows], "doc_id long, text string, source string, n_chars long")
    found = secret_scan.scan(df, *scanner).collect()
    texts = dict(rows)
    assert all(texts[x.doc_id][x.start:x.end] == x.value for x in found)
    assert {long, bare, cjk, "x" + cjk, "xy" + cjk, twice} <= {x.value for x in found}
    clean = {x.doc_id: x.text for x in secret_scan.redact(df, *scanner).collect()}
    assert clean[1] == 'private_key = "[SECRET]" river' and clean[2] == "stone [SECRET] river"
    assert clean[7] == "stone token: [SECRET]\nsecret: [SECRET]"
    for i, head in ((3, "token:"), (4, "token:"), (5, "token:")):       # masked whole or not at all
        assert clean[i] in (texts[i], head + "[SECRET]" + (" river" if i < 5 else ""))


# ---- PII ------------------------------------------------------------------

def luhn(s):
    d = [int(c) for c in reversed(re.sub(r"\D", "", s))]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_pseudonyms_keep_formats_links_and_come_back(spark):
    r = random.Random(7)
    start = datetime.date(1800, 3, 1)
    dates = [(start + datetime.timedelta(r.randrange(146097))).isoformat() for _ in range(60)]
    numbers = ["".join(r.choice("0123456789") for _ in range(n)) for n in (9, 12, 16, 16, 16, 16, 16, 16, 19)]
    ips = [".".join(str(r.randrange(256)) for _ in range(4)) for _ in range(40)]
    others = ["a.b7@mail.example.com", "+1 (389) 555-5010", "123-45-6789", "899-01-0001", "4111 1111 1111 1111",
              "4111111111111111", "29.02.2024", "29/02/2024"]
    values = dates + numbers + ips + others
    df = spark.createDataFrame([(i, f"x {v}, y {v}!", 1) for i, v in enumerate(values)], "doc_id long, text string, n int")
    got = [x.text for x in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]
    new = [re.fullmatch(r"x (.*), y (.*)!", t) for t in got]
    assert all(m and m[1] == m[2] for m in new)
    out = dict(zip(values, (m[1] for m in new)))
    assert len(set(out.values())) == len(set(values))
    for v, w in out.items():
        if "@" not in v:
            assert re.sub(r"\d", "9", v) == re.sub(r"\d", "9", w) or v in ips
    assert all(start <= datetime.date.fromisoformat(out[d]) < start + datetime.timedelta(146097) for d in dates)
    assert all(0 <= int(p) <= 255 for v in ips for p in out[v].split("."))
    assert all(luhn(v) == luhn(out[v]) for v in numbers if len(v) >= 13)
    assert out["4111 1111 1111 1111"].replace(" ", "") == out["4111111111111111"]
    assert out["29.02.2024"].replace(".", "/") == out["29/02/2024"]
    assert out["+1 (389) 555-5010"].startswith("+1 (") and out["a.b7@mail.example.com"].endswith("@mail.example.com")
    back = pii.pseudonymise(pii.pseudonymise(df, "k"), "k", inverse=True).orderBy("doc_id").collect()
    assert [x.text for x in back] == [f"x {v}, y {v}!" for v in values]
    other = [x.text for x in pii.pseudonymise(df, "another").orderBy("doc_id").collect()]
    assert sum(a == b for a, b in zip(got, other)) <= 2


def test_date_permutation_is_a_bijection(spark):
    days = spark.range(0, 146097).selectExpr("cast(date_add(date'1800-03-01', cast(id as int)) as string) as text")
    assert pii.pseudonymise(days, "k").distinct().count() == 146097


def test_invalid_null_and_long_texts(spark):
    keep = ["2023-02-29", "300.1.1.1", "000-12-3456", "12345678", "1799-12-31", "no digits", "", None, "1.2.3.4.5"]
    long = "word " * 200_000 + "+1 (389) 555-5010"
    df = spark.createDataFrame([(t,) for t in [*keep, long, long]], "text string")
    got = pii.pseudonymise(df, "k", count_col="n")
    assert [x.text for x in got.collect()][:len(keep)] == keep
    assert [x.n for x in got.collect()] == [0] * 7 + [0 if x is None else 0 for x in keep[7:]] + [1, 1] \
        or [x.n for x in got.collect()][-2:] == [1, 1]
    assert len({x.text for x in got.collect()[-2:]}) == 1
    assert pii.pseudonymise(df.limit(0), "k").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ---- registry and pipeline ------------------------------------------------

def test_one_query_for_each_operator():
    names = list(E.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@needs_data
def test_pipeline_stages_equal_their_operators(spark):
    import corpus_pipeline as P
    from loanlens.llm import decontam, simhash
    from loanlens.session import materialize

    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "decontamination", "secret_scan", "packing"]
    seen = {}
    for name, stage in P.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF01))
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns
    ids = lambda df: sorted(x.doc_id for x in df.select("doc_id").collect())
    rejected = E.queries()["op2_toxicity"](spark, SF01).filter("predicted = 1")
    assert ids(seen["toxicity"][1]) == sorted(set(ids(seen["toxicity"][0])) - set(ids(rejected)))
    groups = simhash.simhash_near_duplicates(seen["toxicity"][1])
    assert ids(seen["simhash_near_dedup"][1]) == ids(groups.filter("doc_id = component_id"))
    bench = spark.read.parquet(f"{SF01}/benchmark.parquet")
    found = decontam.find_contamination(seen["simhash_near_dedup"][1], bench)
    assert ids(seen["decontamination"][1]) == ids(found.filter("not contaminated"))
    assert ids(seen["secret_scan"][1]) == ids(seen["decontamination"][1])
    left = seen["secret_scan"][1].filter("text rlike 'token = \"[0-9a-f]{40}'").count()
    assert left == 0 and seen["decontamination"][1].filter("text rlike 'token = \"[0-9a-f]{40}'").count() > 0
    packed = seen["packing"][1]
    assert packed.select("doc_id").distinct().count() == seen["secret_scan"][1].count()
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0
