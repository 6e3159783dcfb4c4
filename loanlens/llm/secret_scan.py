"""Secret scans: candidates, and a random forest that removes false positives.

Candidates are runs of 16 or more of ``A-Za-z0-9_+/=-`` with a digit or with
both cases, and values of six bytes or more that are assigned (``=`` or ``:``)
to a name with a secret-like word in it, whole up to their own end. Each gets
features (longer ones one row per piece of at most 512 characters; the piece
most like a secret gives the score): length and
character classes, entropy, the mean log probability of its character
transitions, the share of it that dictionary words cover, the words before and
after it, the path of its document.

The transition model and the dictionary (the ``n_words`` most frequent words)
are counted by Spark over all texts. A Spark ML random forest is trained on
labelled findings (text, start, end, path, label): the caller's, or
``labelled_findings``, a seeded set of templates for secrets (keys, tokens,
passwords) and for what is taken for them (digests, ids, numbers, paths,
placeholders). The trained trees are read once and applied to the candidates
inside the scanning tasks, so scanning and redaction are one narrow pass.

Edge cases: null and empty texts have no candidates; repeated rows give
repeated findings; candidates that overlap keep the longer, then the first;
an empty corpus has an empty dictionary and uniform transitions; extra
columns pass through ``redact``.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from . import bytewords as W

SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key",
                "accesskey", "auth", "bearer", "credential", "private_key", "client_key", "signing_key")
OTHER_WORDS = ("commit", "sha", "md5", "hash", "checksum", "digest", "uuid", "guid", "id", "version", "revision",
               "build", "example", "sample", "placeholder", "etag", "order", "number", "card", "phone", "isbn")
PLACEHOLDERS = ("xxxx", "example", "your", "changeme", "placeholder", "dummy", "0000", "1234", "abcd", "test")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk-", "sk_live_", "xoxb-", "xoxp-", "eyJ", "AIza", "glpat-")
PATH_WORDS = ("test", "example", "sample", "mock", "fixture", "doc", "vendor", "lock", "spec")
FEATURES = ("length", "digits", "uppers", "lowers", "symbols", "hexadecimal", "entropy", "transitions",
            "dictionary", "changes", "secret_word", "other_word", "assigned", "quoted", "other_after",
            "slashes", "test_path", "placeholder", "uuid", "prefix", "distinct")
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
WORD = re.compile(r"[^\W\d_]+|\d+")
LEAD = re.compile(rb"[=>:]?[ \t]*[\"']?")


def _run_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=-"]] = True
    return t


#: Bytes that end an assigned value.
_STOPS = np.isin(np.arange(256), list(b" \t\n\r\f\v\"',;<>(){}[]"))


def candidates(data: np.ndarray, offsets: np.ndarray):
    """(text index, start byte, end byte) of the candidates, in order."""
    starts, ends, first = W.find_words(data, offsets, _run_table())
    long = np.flatnonzero(ends - starts >= 16)
    doc_of = np.searchsorted(first, long, side="right") - 1
    raw = data.tobytes()
    found: dict[tuple[int, int], int] = {}
    for d, a, b in zip(doc_of.tolist(), starts[long].tolist(), ends[long].tolist()):
        while b > a and raw[b - 1:b] in b"-=/+" and raw[b - 1:b] != b"=":
            b -= 1
        s = raw[a:b]
        if b - a >= 16 and (any(48 <= c < 58 for c in s) or (s.lower() != s and s.upper() != s)):
            cut = s.find(b"=")                   # name=value in one run
            if 0 < cut < len(s.rstrip(b"=")) - 8:
                a += cut + 1
            found[a, b] = d
    stops = np.flatnonzero(_STOPS[data])
    for p in np.flatnonzero((data == 61) | (data == 58)).tolist():
        d = int(np.searchsorted(offsets, p, side="right")) - 1
        name = raw[max(int(offsets[d]), p - 48):p].decode(errors="ignore").rstrip(" \t\"'").lower()
        name = re.split(r"[\s,;(){}\[\]<>]", name)[-1]
        if not any(w in name for w in SECRET_WORDS):
            continue
        hi = int(offsets[d + 1])
        # up to the next stop, all of them ASCII, so no character is cut; from
        # p + 1 where the sign after it leaves too little
        for a in (LEAD.match(raw, p + 1, hi).end(), p + 1):
            at = int(np.searchsorted(stops, a))
            b = min(int(stops[at]), hi) if at < len(stops) else hi
            if b - a >= 6:
                found[a, b] = d
                break
    out, end, owner = [], -1, -1
    for (a, b), d in sorted(found.items(), key=lambda x: (x[0][0], -x[0][1])):
        if a < end and d == owner:               # inside or across the one before: the longer stays
            if b - a > out[-1][2] - out[-1][1]:
                out[-1] = (d, a, b)
                end = b
            continue
        out.append((d, a, b))
        end, owner = b, d
    return out


@dataclass
class CorpusModel:
    """Log2 transition probabilities and the sorted hashes of frequent words."""

    transitions: np.ndarray
    words: np.ndarray

    def coverage(self, value: str) -> float:
        """Share of the letters' runs that dictionary words cover (longest first)."""
        low = np.frombuffer(value.lower().encode(), np.uint8)
        n = len(low)
        letters = (low >= 97) & (low < 123)
        spans = [(a, b) for a in range(n) for b in range(a + 3, min(n, a + 14) + 1)]
        stop = np.concatenate(([0], np.cumsum(~letters)))
        spans = np.array([s for s in spans if stop[s[1]] == stop[s[0]]], np.int64)
        if not len(spans) or not len(self.words):
            return 0.0
        order = np.lexsort((spans[:, 0], spans[:, 1]))
        spans = spans[order]
        h = W.hash_words(low, spans[:, 0], spans[:, 1])
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        covered, p = 0, 0
        best: dict[int, int] = {}
        for a, b in spans[self.words[at] == h].tolist():
            best[a] = max(best.get(a, 0), b)
        while p < n:
            e = best.get(p, 0)
            covered += max(0, e - p)
            p = max(e, p + 1)
        return covered / n


def corpus_model(docs: DataFrame, n_words: int = 20_000, text_col: str = "text") -> CorpusModel:
    """Counted over all texts: byte transitions, and words of 3 to 14 letters."""
    frame = docs.select(F.col(text_col).cast("string").alias("text"))

    def merge(parts):
        h = np.concatenate([p[0] for p in parts])
        n = np.concatenate([p[1] for p in parts])
        u, inv = np.unique(h, return_inverse=True)
        return [(u, np.bincount(inv, weights=n).astype(np.int64))]

    def run(batches):
        pairs, parts = np.zeros(1 << 14, np.int64), []
        letters = np.zeros(256, bool)
        letters[97:123] = True
        for b in batches:
            for _, data, offsets in W.slices(b):
                if not len(data):
                    continue
                c = np.where(data < 128, data, 0).astype(np.int32)
                inner = np.ones(len(c), bool)
                inner[offsets[1:-1][offsets[1:-1] < len(c)]] = False
                code = c[:-1] * 128 + c[1:]
                pairs += np.bincount(code[inner[1:]], minlength=1 << 14)
                low = W.lower_table()[data]
                s, e, _ = W.find_words(low, offsets, letters)
                keep = (e - s >= 3) & (e - s <= 14)
                h = W.hash_words(low, s[keep], e[keep])
                parts.append(np.unique(h, return_counts=True))
                if len(parts) >= 16:
                    parts = merge(parts)
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(at), np.int32)), pa.array(at.astype(np.int64)), pa.array(pairs[at])],
            ["kind", "key", "n"])
        for u, n in merge(parts) if parts else []:
            for lo in range(0, len(u), 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(len(u[lo:lo + (1 << 16)]), np.int32)),
                     pa.array(u[lo:lo + (1 << 16)].view(np.int64)), pa.array(n[lo:lo + (1 << 16)].astype(np.int64))],
                    ["kind", "key", "n"])

    counts = W.small_batches(frame).mapInArrow(run, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    # one job: at most 128 * 128 transitions rank before the words
    top = (counts.orderBy("kind", F.desc("n"), "key").limit((1 << 14) + n_words)).toArrow()
    kind, key, n = (top.column(c).to_numpy() for c in ("kind", "key", "n"))
    pairs = np.zeros(1 << 14)
    pairs[key[kind == 0]] = n[kind == 0]
    pairs = pairs.reshape(128, 128) + 1
    words = np.sort(key[kind == 1][:n_words].view(np.uint64))
    return CorpusModel(np.log2(pairs / pairs.sum(axis=1, keepdims=True)), words)


def describe(before: str, value: str, after: str, path: str, corpus: CorpusModel) -> list[float]:
    """The features of one candidate. ``before`` and ``after``: up to 60
    characters around it."""
    n = len(value)
    counts = Counter(value)
    raw = np.minimum(np.frombuffer(value.encode(), np.uint8), 127)
    kinds = ["d" if c.isdigit() else "a" if c.isalpha() else "s" for c in value]
    near = before.rstrip(" \t\"'`")
    assigned = near.endswith(("=", ":", "=>", ":="))
    words = [w.lower() for w in re.split(r"[\s,;(){}\[\]<>]+", near.rstrip("=:> \t\"'")) if w][-3:]
    tail = [w.lower() for w in WORD.findall(after)[:2]]
    low, where = value.lower(), (path or "").lower()
    return [
        float(n), sum(c.isdigit() for c in value) / n, sum(c.isupper() for c in value) / n,
        sum(c.islower() for c in value) / n, kinds.count("s") / n,
        float(all(c in "0123456789abcdefABCDEF" for c in value)),
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        float(corpus.transitions[raw[:-1], raw[1:]].mean()) if len(raw) > 1 else 0.0,
        corpus.coverage(value), sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        float(any(s in w for w in words for s in SECRET_WORDS)),
        float(any(p in OTHER_WORDS for w in words for p in WORD.findall(w))),
        float(assigned), float(before[-1:] in ("'", '"', "`") and before != ""),
        float(any(w in OTHER_WORDS for w in tail)), value.count("/") / n,
        float(any(w in where for w in PATH_WORDS)), float(any(w in low for w in PLACEHOLDERS)),
        float(bool(UUID.fullmatch(value))), float(value.startswith(PREFIXES)), len(counts) / n,
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, left, right, vote."""

    trees: list

    def share(self, rows: np.ndarray) -> np.ndarray:
        """Share of the trees that vote for a secret."""
        total = np.zeros(len(rows))
        for feature, threshold, left, right, vote in self.trees:
            at = np.zeros(len(rows), np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                down = rows[inner, feature[node]] <= threshold[node]
                at[inner] = np.where(down, left[node], right[node])
            total += vote[at]
        return total / max(len(self.trees), 1)


def read_forest(model) -> Forest:
    """The trees of a fitted Spark ML forest, from its printed form."""
    trees, lines = [], []
    for line in model.toDebugString.splitlines()[1:]:
        if line.strip().startswith("Tree "):
            trees.append([])
        elif line.strip() and trees:
            trees[-1].append(line.strip())
    out = []
    for lines in trees:
        nodes = []

        def grow():
            i = len(nodes)
            nodes.append(None)
            line = lines.pop(0)
            if line.startswith("Predict"):
                nodes[i] = (-1, 0.0, 0, 0, float(line.split(":")[1]))
                return i
            m = re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", line)
            left = grow()
            lines.pop(0)                                   # Else
            right = grow()
            nodes[i] = (int(m[1]), float(m[2]), left, right, 0.0)
            return i

        grow()
        cols = list(zip(*nodes))
        out.append((np.array(cols[0]), np.array(cols[1]), np.array(cols[2]), np.array(cols[3]), np.array(cols[4])))
    return Forest(out)


def labelled_findings(n: int = 4000, seed: int = 7) -> list[tuple[str, int, int, str, int]]:
    """Seeded labelled findings (text, start, end, path, label) for training
    where there are none of one's own."""
    r = random.Random(seed)
    hexa, alnum = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    syllables = ("con", "tra", "ver", "ment", "ing", "tion", "er", "lo", "mi", "ra", "ste", "pol", "an", "de", "que")
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    names = ("token", "api_key", "apikey", "secret", "password", "auth_token", "access_token", "client_secret",
             "SECRET_KEY", "db_password", "Authorization: Bearer", "private_key")

    def secret():
        return r.choice((
            lambda: some(hexa, r.choice((32, 40, 40, 64))), lambda: some(alnum, r.randint(16, 64)),
            lambda: some(alnum + "+/", r.choice((40, 44, 64))), lambda: "AKIA" + some(alnum.upper(), 16),
            lambda: "ghp_" + some(alnum, 36), lambda: "sk-" + some(alnum, 48), lambda: "eyJ" + some(alnum + "_-", 60),
            lambda: some(alnum + "!#%&*?", r.randint(10, 24))))()

    def harmless():
        return r.choice((
            lambda: some("0123456789", r.choice((16, 16, 18, 20))), lambda: "_".join(word() for _ in range(4)) + "1",
            lambda: "/".join(word() for _ in range(4)) + "/v2", lambda: "".join(word().title() for _ in range(4)),
            lambda: "x" * r.randint(16, 32) + "1", lambda: "YOUR_API_KEY_" + some("0123456789", 4),
            lambda: "-".join((some(hexa, 8), some(hexa, 4), some(hexa, 4), some(hexa, 4), some(hexa, 12))),
            lambda: "-".join(word() for _ in range(5)) + "-2024", lambda: "=" * 8 + word() * 3 + "2"))()

    out = []
    for i in range(n):
        pre, post = " ".join(word() for _ in range(r.randint(0, 6))), " ".join(word() for _ in range(r.randint(0, 6)))
        path = r.choice(("src/main", "config/app", "web", "notes", "src7", "tests/unit", "docs/example"))
        q = r.choice(('"', "'", "", '"'))
        kind = i % 4
        if kind < 2:                 # a secret under its name, or a bare one with a known prefix
            value, label = secret(), int(path[:4] not in ("test", "docs") or r.random() < 0.7)
            while kind == 1 and r.random() < 0.5 and not value.startswith(PREFIXES):
                value = secret()
            name = r.choice(names) + (" " if r.random() < 0.2 else r.choice((" = ", "=", ": ", ":", " => ")))
            label = 1 if path[:4] not in ("test", "docs") else label
        elif kind == 2:              # secret-like values under other names
            value, label = some(hexa, r.choice((32, 40, 64))), 0
            name = r.choice(OTHER_WORDS) + r.choice((" ", " = ", ": ", "="))
        else:                        # other long runs, sometimes under a secret's name
            value, label = harmless(), 0
            name = r.choice((r.choice(names) + " = ", word() + " ", word() + ": ", ""))
        start = (pre + " " if pre else "") + name + q
        out.append((start + value + q + (" " + post if post else ""), len(start), len(start) + len(value), path, label))
    return out


def train(spark, corpus: CorpusModel, findings: DataFrame | None = None, trees: int = 24, depth: int = 8,
          max_rows: int = 50_000, seed: int = 11) -> Forest:
    """Forest from labelled findings (columns text, start, end in characters,
    path, label); ``max_rows`` bounds the rows used."""
    if findings is None:
        findings = spark.createDataFrame(labelled_findings(), "text string, start int, end int, path string, label int")
    findings = findings.filter("text is not null and label is not null and start >= 0 and end > start").limit(max_rows)

    def run(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("text", "start", "end", "path")]
            rows = [describe(t[max(0, s - 60):s], t[s:e], t[e:e + 60], p or "", corpus) for t, s, e, p in zip(*cols)]
            yield pa.RecordBatch.from_arrays(
                [b.column("label").cast(pa.float64()), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])

    rows = (findings.select("text", "start", "end", "path", F.col("label").cast("int").alias("label"))
            .mapInArrow(run, "label double, x array<double>"))
    rows = materialize(rows).select("label", array_to_vector("x").alias("features"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=64).fit(rows)
    return read_forest(model)


def _scan(rows, data, offsets, paths, corpus, forest, piece: int = 512):
    """[(text index, start byte, end byte, score)] of the candidates of a slice."""
    found = candidates(data, offsets)
    if not found:
        return []
    raw, x, first = data.tobytes(), [], []
    for d, a, b in found:
        lo, hi = int(offsets[d]), int(offsets[d + 1])
        before, after = raw[max(lo, a - 60):a].decode(errors="ignore"), raw[b:min(hi, b + 60)].decode(errors="ignore")
        value = raw[a:b].decode(errors="replace")
        step = -(-len(value) // -(-len(value) // piece))       # equal pieces of at most ``piece``
        first.append(len(x))
        for i in range(0, len(value), step):
            x.append(describe(before, value[i:i + step], after, paths[d] or "", corpus))
    score = np.maximum.reduceat(forest.share(np.array(x)), first)
    return [(d, a, b, float(s)) for (d, a, b), s in zip(found, score)]


def scan(docs: DataFrame, corpus: CorpusModel, forest: Forest, id_col: str = "doc_id", text_col: str = "text",
         path_col: str | None = "source") -> DataFrame:
    """One row per candidate: doc_id, start and end in characters, value,
    score (share of trees) and is_secret (score >= 0.5)."""
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        (F.col(path_col) if path_col in docs.columns else F.lit("")).cast("string").alias("path"))
    kind = frame.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast((corpus, forest))

    def run(batches):
        for b in batches:
            for rows, data, offsets in W.slices(b):
                got = _scan(rows, data, offsets, rows.column("path").to_pylist(), *held.value)
                if not got:
                    continue
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                raw = data.tobytes()
                d, a, e, s = zip(*got)
                base = chars[offsets[np.array(d)]]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(d, pa.int64())),
                     pa.array(chars[np.array(a)] - base), pa.array(chars[np.array(e)] - base),
                     pa.array([raw[i:j].decode(errors="replace") for i, j in zip(a, e)]),
                     pa.array(s), pa.array([v >= 0.5 for v in s])],
                    ["doc_id", "start", "end", "value", "score", "is_secret"])

    return W.small_batches(frame).mapInArrow(run, f"doc_id {kind}, start bigint, end bigint, value string, score double, "
                                 "is_secret boolean")


def redact(docs: DataFrame, corpus: CorpusModel, forest: Forest, text_col: str = "text",
           path_col: str | None = "source", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark`` (and the length column
    set anew where a text changed), in one narrow pass."""
    schema = docs.schema
    length = next((f for f in schema if f.name == length_col and isinstance(f.dataType, (T.LongType, T.IntegerType))), None)
    held = docs.sparkSession.sparkContext.broadcast((corpus, forest))

    def run(batches):
        for b in batches:
            for rows, data, offsets in W.slices(b, column=text_col):
                paths = rows.column(path_col).to_pylist() if path_col in schema.names else [""] * len(rows)
                got = [g for g in _scan(rows, data, offsets, paths, *held.value) if g[3] >= 0.5]
                if not got:
                    yield rows
                    continue
                raw, new = data.tobytes(), {}
                for d, a, e, _ in reversed(got):         # from the end, so places stay right
                    lo = int(offsets[d])
                    t = new.get(d, raw[lo:int(offsets[d + 1])])
                    new[d] = t[:a - lo] + mark.encode() + t[e - lo:]
                cols = {n: rows.column(n) for n in schema.names}
                texts = cols[text_col].to_pylist()
                for d, t in new.items():
                    texts[d] = t.decode()
                cols[text_col] = pa.array(texts, cols[text_col].type)
                if length is not None:
                    n = cols[length_col].to_pylist()
                    for d in new:
                        n[d] = len(texts[d])
                    cols[length_col] = pa.array(n, cols[length_col].type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return W.small_batches(docs).mapInArrow(run, schema)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    corpus = corpus_model(docs)
    found = scan(docs, corpus, train(spark, corpus))
    return found.select("doc_id", F.col("start").alias("start_char"), F.col("end").alias("end_char"),
                        F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")
