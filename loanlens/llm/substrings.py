"""Substring dedup by collinear chaining.

1. Seeds: winnowed k-word hashes of every text, so any exact shared run of at
   least ``k + w - 1`` words has a seed in common.
2. Join: texts that are equal are one class. Every occurrence of a seed that
   occurs in more than one class is matched with the seed's lowest class (by
   text hash), never with all of them; matches of copies fall together before
   they are chained. So matches grow with the occurrences, whatever the size
   of the group, and a hot seed is a join key that Spark can split. Where one
   to ``k`` words are repeated again and again, a seed stands at equal steps: of
   such a run the ends are matched (``anchors``), not every place.
3. Chains: the matches of a document with one partner are chained in order of
   both positions. The best chain that ends in each match is found with a
   Fenwick tree of prefix maxima over partner positions; a gap costs ``gap``
   for each word on either side, and a chain starts anew where that is better.
4. Alignment: the text around each chain is cut out of both documents and
   compared by longest common subsequence: between matches, and beyond the
   outer matches through differing words as long as enough are in common (at
   most ``reach`` words). Where too few words of the whole are in common, it is
   cut at the widest gap, and its parts again. Aligned passages
   of at least ``min_words`` words in the document, with ``identity`` of the
   longer side in common, are returned.
5. The rest, exactly: where a chain comes out too short, the lowest class may
   hold only part of what the document shares with others. For the seeds of
   chains that lie in no passage, and of runs, every occurrence gives the ``min_words``-word windows around
   it; windows that occur in more than one class are matched with the lowest
   class that has them, and neighbouring ones merged. So every exact repeat of
   ``min_words`` words between different texts is found in 4 or here; of these
   windows only the seeds of a wider winnow are needed (``sparse``).
6. The rest, edited: the seeds of chains that lie in no passage are matched once
   more by pairs of them, at most ``min_words`` words apart, with the lowest class that has the pair, and 3 and 4 done
   again. So an edited passage is found also where a lower text has each of its
   seeds, but not two together.

Fuzzy passages need one seed in common, so one whose words are edited every k
words or closer is missed, and one of whose seeds every pair stands in lower
texts too, or that has one only and a lower text has it.

Result: one row per passage and partner: doc_id, start_word, end_word,
partner_id, partner_start, partner_end, n_equal, identity. Passages are given
for the document with the smallest id of each class; every other copy has one
row over its whole text with that document as partner (membership).

Edge cases: null and empty texts have no seeds; neither have texts with fewer
than k words; a passage repeated inside one document only is not a match; two
different texts under one doc_id are different documents here; repeated equal
rows count once; rows with null doc_id are left out; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import bytewords as W


def text_words(data, offsets):
    raw = W.lower_table()[data]
    starts, ends, first = W.find_words(raw, offsets, W.byte_class("alnum"))
    return W.hash_words(raw, starts, ends), first


def progressions(g: np.ndarray, at: np.ndarray, doc: np.ndarray, most: int):
    """(run, step, last) of seeds ``g`` at the places ``at``, in order: where one
    stands at three or more places of a document, each ``step`` (at most ``most``)
    after the one before, the first of them has their number in ``run`` and the
    index of the last in ``last``, the others have 0 in ``run``; one alone has 1."""
    n = len(g)
    run, step, last = np.ones(n, np.int32), np.ones(n, np.int32), np.arange(n)
    if n < 3:                                                # gap would be too short for the masks
        return run, step, last
    order = np.argsort(g, kind="stable")
    a, s, d = at[order], g[order], doc[order]
    gap = np.diff(a)
    near = (s[1:] == s[:-1]) & (d[1:] == d[:-1]) & (gap <= most)
    twice = near[1:] & near[:-1] & (gap[1:] == gap[:-1])
    before = np.r_[False, twice]
    joined = before | np.r_[twice, False]
    # a place where two runs meet belongs to the first
    joined &= before | ~np.r_[False, joined[:-1]]
    heads = np.flatnonzero(np.r_[True, ~joined])
    size = np.diff(np.r_[heads, n])
    own = order[heads]
    run[:] = 0
    run[own], last[own] = size, order[heads + size - 1]
    step[own] = np.where(size > 1, gap[np.minimum(heads, n - 2)], 1)
    return run, step, last


def seeds(docs: DataFrame, k: int, w: int, reach: int, min_words: int, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(seed, version, doc_id, pos, lo, hi, sparse, run, step, los) of every winnowed
    k-gram: lo and hi are the bytes where the ``reach`` words before it start and
    those after it end; sparse ones are among those that every run of
    ``min_words`` words has one of. Where one seed stands at equal steps of at most
    k words (so few words again and again), the first of them has their number in
    ``run`` and the others 0; its hi is that of the last, and los has the lo of
    one of them in ``min_words`` words and of the last. One row more per document
    has pos -1 and its words in hi."""
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("version"),
                        F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")

    def rows_of(batches):
        for b in batches:
            for rows, data, offsets in W.slices(b):
                raw = W.lower_table()[data]
                starts, ends, first = W.find_words(raw, offsets, W.byte_class("alnum"))
                h = W.hash_words(raw, starts, ends)
                g, at, doc = W.kgrams(h, first, k)
                keep = W.winnow_wide(g, doc, w)
                # the smallest of a wider window is the smallest of a narrower one too
                sparse = np.isin(keep, W.winnow_wide(g, doc, min_words - k + 1))
                g, at, doc = g[keep], at[keep], doc[keep]
                run, step, last = progressions(g, at, doc, k)
                # the first of a run stands for all of it
                inside = np.cumsum(np.r_[0, sparse])
                sparse |= (run > 1) & (inside[last + 1] > inside[:-1])

                def before(place, text):
                    return starts[np.maximum(place - reach, first[text])] - offsets[text]

                lo = before(at, doc)
                hi = ends[np.minimum(at[last] + k + reach, first[doc + 1]) - 1] - offsets[doc]
                n = len(offsets) - 1
                own = np.r_[np.arange(n), doc]
                take = pa.array(own)
                # lo of one place of a run in min_words words and of its last
                each = np.maximum(min_words // step, 1)
                many = np.r_[np.zeros(n, np.int64), np.where(run > 1, -(-run // each) + 1, 0)]
                cuts = np.r_[0, np.cumsum(many)]
                row = np.repeat(np.arange(len(many)), many) - n
                nth = (np.arange(cuts[-1]) - cuts[row + n]) * each[row]
                inner = at[row] + np.minimum(nth, run[row] - 1) * step[row]
                los = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)),
                                               pa.array(before(inner, doc[row]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[np.zeros(n, np.int64), g.view(np.int64)]),
                     rows.column("version").take(take), rows.column("doc_id").take(take),
                     pa.array(np.r_[np.full(n, -1), at - first[doc]].astype(np.int32)),
                     pa.array(np.r_[np.zeros(n, np.int64), lo].astype(np.int32)),
                     pa.array(np.r_[np.diff(first), hi].astype(np.int32)), pa.array(np.r_[np.zeros(n, bool), sparse]),
                     pa.array(np.r_[np.zeros(n, np.int32), run]), pa.array(np.r_[np.ones(n, np.int32), step]), los],
                    ["seed", "version", "doc_id", "pos", "lo", "hi", "sparse", "run", "step", "los"])

    return frame.mapInArrow(rows_of, "seed bigint, version bigint, doc_id bigint, pos int, lo int, hi int, "
                                     "sparse boolean, run int, step int, los array<int>")


def lowest(found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``found`` joined with the lowest class's first row of its key, for the
    keys of more than one class and the rows of other classes; the partner's
    fields have the prefix p_."""
    # written first, and joined by sorting: the join then has an exchange of its
    # own on either side, so that Spark can split a key that most texts have (it
    # does not where it turns to a broadcast after the exchange)
    ends = materialize(found.groupBy(key).agg(F.min(F.struct(*fields)).alias("a"), F.max("version").alias("b"))
                       .filter("a.version < b").select(key, *[F.col(f"a.{c}").alias(f"p_{c}") for c in fields]))
    return found.join(ends.hint("merge"), key).filter("version != p_version")


PLACE = ["version", "doc_id", "pos", "lo", "hi", "run", "step", "los"]


def anchors(met: DataFrame, min_words: int, reach: int = 96) -> DataFrame:
    """(doc_id, version, partner_id, partner_version, x, x_lo, x_hi, y, y_lo,
    y_hi, ahead) of pairs of runs of places (fields of PLACE, the partner's with
    the prefix p_): their first places and, where they differ, their last
    ones; along a run of more places than the partner's also one in ``min_words``
    words with the partner's first. Of a longer run the bytes end where the other's
    words, with as many again between them, do not reach. ``ahead`` is how many
    words after x the places stand that it stands for. Copies once."""
    def last(c):
        return f"coalesce(try_element_at({c}los, -1), {c}lo)"

    def each(c):
        return f"int(greatest(1, {min_words} div {c}step))"

    def end(c, other, i):
        far = f"(2 * ({other}run * {other}step + 2 * {reach}) + {reach})"
        j = f"int({i} + ceil({far} / ({each(c)} * {c}step)))"
        return f"case when {j} + 1 < size({c}los) then try_element_at({c}los, {j} + 1) else {c}hi end"

    pairs = F.expr(f"""
        case when run = p_run and (run = 1 or step = p_step) then array(struct(
            pos as x, p_pos as y, step * (run - 1) as ahead, lo as x_lo, p_lo as y_lo, hi as x_hi, p_hi as y_hi))
        else concat(
            case when run > p_run then transform(slice(los, 1, size(los) - 1), (v, i) -> struct(
                pos + {each("")} * step * i as x, p_pos as y,
                step * least({each("")} - 1, run - 1 - {each("")} * i) as ahead, v as x_lo, p_lo as y_lo,
                {end("", "p_", "i")} as x_hi, p_hi as y_hi))
            else array(struct(pos as x, p_pos as y, step * (run - 1) as ahead, lo as x_lo, p_lo as y_lo,
                              hi as x_hi, {end("p_", "", "0")} as y_hi)) end,
            array(struct(pos + step * (run - 1) as x, p_pos + p_step * (p_run - 1) as y, 0 as ahead,
                         {last("")} as x_lo, {last("p_")} as y_lo, hi as x_hi, p_hi as y_hi))) end""")
    return (met.select("doc_id", "version", F.col("p_doc_id").alias("partner_id"),
                       F.col("p_version").alias("partner_version"), F.explode(pairs).alias("a"))
            .groupBy("version", "partner_version", F.col("a.x").alias("x"), F.col("a.y").alias("y"))
            .agg(F.min("doc_id").alias("doc_id"), F.min("partner_id").alias("partner_id"),
                 F.min("a.x_lo").alias("x_lo"), F.max("a.x_hi").alias("x_hi"),
                 F.min("a.y_lo").alias("y_lo"), F.max("a.y_hi").alias("y_hi"), F.max("a.ahead").alias("ahead")))


def matches(found: DataFrame, min_words: int, reach: int = 96) -> DataFrame:
    """Anchors of every run of places of a shared seed with its first run in the
    lowest class that has the seed."""
    return anchors(lowest(found.filter("run > 0").select("seed", *PLACE), "seed", PLACE), min_words, reach)


def chain(x: np.ndarray, y: np.ndarray, k: int, gap: float) -> list[np.ndarray]:
    """Index lists of the chains among matches sorted by (x, y): repeatedly the
    best-scoring one of the matches not used yet."""
    n = len(x)
    if n == 1:
        return [np.array([0])]
    ranks = np.unique(y, return_inverse=True)[1] + 1
    size = int(ranks.max())
    best, who = [0.0] * (size + 1), [-1] * (size + 1)       # Fenwick tree of prefix maxima
    xs, ys, rs = x.tolist(), y.tolist(), ranks.tolist()
    score, prev = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and xs[j] == xs[i]:                      # equal x: none precedes another
            p, top, at = rs[j] - 1, 0.0, -1
            while p > 0:
                if best[p] > top:
                    top, at = best[p], who[p]
                p -= p & -p
            gain = top - gap * (xs[j] + ys[j])
            if at >= 0 and gain > 0:
                score[j], prev[j] = k + gain, at
            else:
                score[j] = float(k)
            j += 1
        for m in range(i, j):
            value, p = score[m] + gap * (xs[m] + ys[m]), rs[m]
            while p <= size:
                if value > best[p]:
                    best[p], who[p] = value, m
                p += p & -p
        i = j
    out, used = [], [False] * n
    for e in sorted(range(n), key=lambda m: (-score[m], m)):
        path = []
        while e >= 0 and not used[e]:
            used[e] = True
            path.append(e)
            e = prev[e]
        if path:
            out.append(np.array(path[::-1]))
    return out


def _runs(batches, keys):
    """Column arrays of each run of equal keys in a sorted stream."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t])
        if not len(t):
            continue
        cols = [t.column(k).to_numpy() for k in keys]
        change = np.zeros(len(t) - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = np.r_[0, np.flatnonzero(change) + 1]
        data = {n: t.column(n).to_numpy() for n in t.column_names}
        for lo, hi in zip(cuts, cuts[1:]):
            yield {n: v[lo:hi] for n, v in data.items()}
        held = t.slice(cuts[-1])
    if held is not None and len(held):
        yield {n: held.column(n).to_numpy() for n in held.column_names}


PAIR = ["doc_id", "version", "partner_id", "partner_version"]


def chains(met: DataFrame, k: int, gap: float) -> DataFrame:
    """One row per chain: the pair, its matches (xs, ys, aheads) and the bytes
    around them (x_lo, x_hi, y_lo, y_hi)."""
    dealt = met.repartition("version", "partner_version").sortWithinPartitions("version", "partner_version", "x", "y")
    spans = ["x_lo", "x_hi", "y_lo", "y_hi"]

    def run(batches):
        rows = {c: [] for c in [*PAIR, "xs", "ys", "aheads", *spans]}

        def flush():
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * 3 + [pa.int32()] * 4
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], list(rows))
            for v in rows.values():
                v.clear()
            return out

        for g in _runs(batches, ["version", "partner_version"]):
            x, y = g["x"], g["y"]
            for path in chain(x, y, k, gap):
                for c in PAIR:
                    rows[c].append(int(g[c][0]))
                rows["xs"].append(x[path])
                rows["ys"].append(y[path])
                rows["aheads"].append(g["ahead"][path])
                for c, i in zip(spans, (path[0], path[-1], path[0], path[-1])):
                    rows[c].append(int(g[c][i]))
            if len(rows["xs"]) >= 5000:
                yield flush()
        if rows["xs"]:
            yield flush()

    schema = ", ".join([f"{c} bigint" for c in PAIR] + ["xs array<int>, ys array<int>, aheads array<int>"] + [f"{c} int" for c in spans])
    return dealt.mapInArrow(run, schema)


def _rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with every beginning
    of ``b``, by whole-integer bit vectors (a zero bit is a step up)."""
    ids, at = np.unique(b, return_inverse=True)
    masks = [0] * len(ids)
    for w, i in enumerate(at.tolist()):
        masks[i] |= 1 << w
    full = (1 << len(b)) - 1
    v = full
    where = np.searchsorted(ids, a)
    known = np.r_[ids, ids[-1:]][where] == a
    for i in where[known].tolist():
        u = v & masks[i]
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes((len(b) + 7) // 8, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def _halved(a: np.ndarray, b: np.ndarray, limit: int):
    """Longest common subsequence of two long sequences in memory linear in
    their lengths: the middle of ``a`` is met with the place of ``b`` that loses
    nothing, again and again, until a table fits."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        s, e, t, f = todo.pop()
        if e == s or f == t:
            continue
        if (e - s) * (f - t) <= limit or e - s == 1:
            if e - s == 1:
                at = np.flatnonzero(b[t:f] == a[s])[:1]
                i, j = np.zeros(len(at), np.int64), at
            else:
                i, j = common_pairs(a[s:e], b[t:f], 0.0, limit)
            out.append((i + s, j + t))
            continue
        m = (s + e) // 2
        n = t + int((_rows(a[s:m], b[t:f]) + _rows(a[m:e][::-1], b[t:f][::-1])[::-1]).argmax())
        todo += [(m, e, n, f), (s, m, t, n)]
    none = [np.zeros(0, np.int64)]
    return np.concatenate([o[0] for o in out] or none), np.concatenate([o[1] for o in out] or none)


def _tables(jobs: list, loss: float) -> list:
    """common_pairs of many short jobs without equal beginnings, all of one
    ``loss``: their tables are filled and walked back side by side."""
    n = len(jobs)
    la, lb = np.array([len(a) for a, _ in jobs]), np.array([len(b) for _, b in jobs])
    p, q = int(la.max()), int(lb.max())
    a, b = np.zeros((p, n), np.uint64), np.zeros((n, q), np.uint64)
    for i, (u, v) in enumerate(jobs):
        a[:len(u), i], b[i, :len(v)] = u, v
    equal = a[:, :, None] == b
    equal &= (np.arange(p)[:, None] < la)[:, :, None]
    equal &= np.arange(q) < lb[:, None]
    i, j = np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = [(i, j)] * n
    if loss:
        # a bound from either side: words that the other has at all
        some = np.ones(n, bool)
        for v in (equal.any(2).T, equal.any(0)):
            some &= (np.cumsum(v, axis=1) - loss * np.arange(1, v.shape[1] + 1)).max(axis=1) > 0
    else:
        some = equal.any(axis=(0, 2))
    rows = np.flatnonzero(some)
    if not len(rows):
        return out
    equal, la, lb, n = equal[:, rows], la[rows], lb[rows], len(rows)
    t = np.zeros((p + 1, n, q + 1), np.int8 if min(p, q) < 128 else np.int32)
    for r in range(p):
        np.maximum.accumulate(np.maximum(t[r, :, 1:], t[r, :, :-1] + equal[r]), axis=1, out=t[r + 1, :, 1:])
    x, y = la.copy(), lb.copy()
    if loss:
        cost = loss * np.maximum(np.arange(p + 1)[:, None], np.arange(q + 1))
        for i in range(n):
            x[i], y[i] = np.unravel_index(int((t[:, i] - cost).argmax()), cost.shape)
    live = np.flatnonzero((x > 0) & (y > 0) & (t[x, np.arange(n), y] > 0))
    steps = []
    while len(live):
        u, v = x[live], y[live]
        here = t[u, live, v]
        up = t[u - 1, live, v] == here
        left = ~up & (t[u, live, v - 1] == here)
        both = ~up & ~left
        u, v = u - (up | both), v - (left | both)
        x[live], y[live] = u, v
        steps.append((live[both], u[both], v[both]))
        live = live[(u > 0) & (v > 0) & (t[u, live, v] > 0)]
    if steps:
        own, u, v = (np.concatenate(c[::-1]) for c in zip(*steps))
        order = np.argsort(own, kind="stable")
        own, u, v = own[order], u[order], v[order]
        cuts = np.searchsorted(own, np.arange(n + 1))
        for i, row in enumerate(rows.tolist()):
            out[row] = (u[cuts[i]:cuts[i + 1]], v[cuts[i]:cuts[i + 1]])
    return out


def common_pairs_of(jobs: list, limit: int = 250_000, together: int = 1 << 21) -> list:
    """``common_pairs`` of every (a, b, loss) of ``jobs``; short ones are worked
    on side by side, in tables of about ``together`` cells."""
    out, todo = [None] * len(jobs), {}
    for n, (a, b, loss) in enumerate(jobs):
        m = min(len(a), len(b))
        same = a[:m] == b[:m]
        lo = m if same.all() else int(same.argmin())
        head = np.arange(lo)
        out[n] = (head, head)
        a, b = a[lo:], b[lo:]
        if len(a) and len(b):
            if len(a) * len(b) > limit and not loss:
                i, j = _halved(a, b, limit)
                out[n] = (np.r_[head, i + lo], np.r_[head, j + lo])
            else:
                todo.setdefault(loss, []).append((len(a), len(b), n, lo, a, b))
    for loss, rest in todo.items():
        rest.sort(key=lambda r: r[:3])
        at = 0
        while at < len(rest):
            p = q = 0
            to = at
            while to < len(rest) and (to == at or max(p, rest[to][0]) * max(q, rest[to][1]) * (to + 1 - at) <= together):
                p, q, to = max(p, rest[to][0]), max(q, rest[to][1]), to + 1
            for (_, _, n, lo, _, _), (i, j) in zip(rest[at:to], _tables([r[4:] for r in rest[at:to]], loss)):
                if len(i):
                    out[n] = (np.concatenate([out[n][0], i + lo]), np.concatenate([out[n][1], j + lo]))
            at = to
    return out


def common_pairs(a: np.ndarray, b: np.ndarray, loss: float = 0.0, limit: int = 250_000):
    """(i, j) places of a longest common subsequence; with ``loss``, of the
    beginnings of both whose common words less ``loss`` for each word of the
    longer are the most. Equal beginnings are taken off first. Beyond ``limit``
    cells (without loss) the same is found in linear memory."""
    return common_pairs_of([(a, b, loss)], limit)[0]


def align(items: list, k: int, loss: float = 0.6) -> list:
    """(i, j) for every (a, b, xs, ys) of ``items``: the places of the equal
    words of a chain, in order; ``a`` and ``b`` hold the words around it, ``xs``
    and ``ys`` are places in them. Beyond the outer seeds it goes on through
    differing words, while more than a share of ``loss`` of the words are in
    common."""
    jobs, plans = [], []
    for a, b, xs, ys in items:
        x, y = int(xs[0]), int(ys[0])
        jobs.append((a[:x][::-1], b[:y][::-1], loss))
        plan = [(len(jobs) - 1, x - 1, y - 1, -1)]
        # x, y: how far both sides are aligned
        for p, q in zip(xs.tolist(), ys.tolist()):
            over = max(x - p, y - q, 0)       # overlaps the match before
            if over >= k:
                continue
            p, q, step = p + over, q + over, k - over
            if p > x and q > y:
                jobs.append((a[x:p], b[y:q], 0.0))
                plan.append((len(jobs) - 1, x, y, 1))
            plan.append((None, p, q, step))
            x, y = p + step, q + step
        jobs.append((a[x:], b[y:], loss))
        plan.append((len(jobs) - 1, x, y, 1))
        plans.append(plan)
    done = common_pairs_of(jobs)
    out = []
    for plan in plans:
        i, j = [], []
        for job, x, y, way in plan:
            if job is None:
                u = v = np.arange(way)
            else:
                u, v = done[job]
                if way < 0:
                    u, v = -u[::-1], -v[::-1]
            i.append(u + x)
            j.append(v + y)
        out.append((np.concatenate(i), np.concatenate(j)))
    return out


def parts(p: np.ndarray, q: np.ndarray, min_words: int, identity: float) -> list[tuple[int, int]]:
    """Ranges of the equal words (p, q) that are passages: all of them, or where
    too few are in common, what cutting at the widest gap leaves, again and
    again."""
    out, todo = [], [(0, len(p))]
    wide = np.maximum(np.diff(p), np.diff(q))
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 1 or p[hi - 1] - p[lo] + 1 < min_words:
            continue
        if hi - lo >= identity * (max(p[hi - 1] - p[lo], q[hi - 1] - q[lo]) + 1):
            out.append((lo, hi))
            continue
        at = lo + 1 + int(wide[lo:hi - 1].argmax())
        todo += [(at, hi), (lo, at)]
    return out


def stretch(a: np.ndarray, p: np.ndarray, min_words: int, most: int = 1) -> np.ndarray:
    """``p``, the aligned places of ``a``: where they lie a little too close for a
    passage and the outer words, at most ``most``, are repeated outside, the outer
    place is one of those (of a run of places only the ends are matched, so others
    are found so)."""
    g = min_words - (int(p[-1]) - int(p[0]) + 1)
    s, e = int(p[0]), int(p[-1])
    for step in range(1, most + 1) if g > 0 else ():
        far = -(-g // step) * step
        if s >= far and s + step <= len(a) and (a[s - far:s] == a[s - far + step:s + step]).all():
            return np.r_[s - far, p[1:]]
        if e + far < len(a) and e + 1 >= step and (a[e + 1:e + far + 1] == a[e + 1 - step:e + far + 1 - step]).all():
            return np.r_[p[:-1], e + far]
    return p


RESULT = ["doc_id", "start_word", "end_word", "partner_id", "partner_start", "partner_end", "n_equal", "identity"]
KINDS = {c: "double" if c == "identity" else "bigint" for c in RESULT}


def _pairs(batches, key):
    """For every slice of pieces sorted by chain and side: the chains (key
    columns), their words, places and how many more they stand for. (keys, h,
    first, at, at_first, ahead, rows): the sides of a chain are the rows i and
    i + 1, i in ``rows``. A chain's rows may be repeated (equal rows of documents);
    they are equal then."""
    held = None
    for b in batches:
        for rows, data, offsets in W.slices(b, column="piece"):
            h, first = text_words(data, offsets)
            keys = np.array([rows.column(c).to_numpy() for c in [*key, "side"]])
            places = rows.column("at")
            at, at_first = places.flatten().to_numpy(), np.r_[0, np.cumsum(places.value_lengths().to_numpy())]
            ahead = rows.column("ahead").flatten().to_numpy() if "ahead" in rows.schema.names else np.zeros_like(at)
            if held is not None:
                keys = np.concatenate([held[0], keys], axis=1)
                h, first = np.r_[held[1], h], np.r_[0, first + len(held[1])]
                at, at_first = np.r_[held[2], at], np.r_[0, at_first + len(held[2])]
                ahead = np.r_[held[3], ahead]
            same = (keys[:-1, 1:] == keys[:-1, :-1]).all(axis=0) & (keys[-1, :-1] == 0) & (keys[-1, 1:] == 1)
            # a chain's other side may come with the next slice
            held = (keys[:, -1:].copy(), h[first[-2]:].copy(), at[at_first[-2]:].copy(), ahead[at_first[-2]:].copy())
            yield keys, h, first, at, at_first, ahead, np.flatnonzero(same)


def _common(h: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words the rows i and i + 1 have in common, in any order: no
    alignment of them has more. And for each word of ``h`` whether the other
    row has it at all."""
    n, shared = len(rows), np.zeros(len(h), bool)
    if not n:
        return np.zeros(0, np.int64), shared
    take = np.r_[rows, rows + 1]
    lens = np.diff(first)[take]
    ends = np.cumsum(lens)
    at = np.arange(int(ends[-1])) + np.repeat(first[take] - (ends - lens), lens)
    if not len(at):
        return np.zeros(n, np.int64), shared
    # pair, what fits of the word's hash (equal beginnings only raise the
    # bound), side and place in one integer: a plain sort brings equal words together
    low, high = np.uint64(len(h).bit_length()), np.uint64(64 - n.bit_length())
    pair = np.repeat(np.r_[np.arange(n), np.arange(n)], lens).astype(np.uint64)
    side = np.repeat(np.r_[np.zeros(n, bool), np.ones(n, bool)], lens).astype(np.uint64)
    one = np.uint64(1)
    words = (h[at] >> (np.uint64(64) - high + low + one)) << (low + one)
    packed = np.sort((pair << high) | words | (side << low) | at.astype(np.uint64))
    word = packed >> (low + one)
    heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    right = np.add.reduceat(((packed >> low) & one).astype(np.int64), heads)
    total = np.diff(np.r_[heads, len(packed)])
    both = np.minimum(right, total - right)
    shared[(packed & ((one << low) - one)).astype(np.int64)] = np.repeat(both > 0, total)
    return np.bincount((packed[heads] >> high).astype(np.int64), both, n).astype(np.int64), shared


def _dense(shared: np.ndarray, first: np.ndarray, rows: np.ndarray, words: int, share: float) -> np.ndarray:
    """Whether a run of at least ``words`` words of a row has a ``share`` of
    words that the other row has."""
    out = np.zeros(len(rows), bool)
    sizes = first[rows + 1] - first[rows]
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        # rows of like size side by side, about a million words at once
        to = at + 1
        while to < len(order) and sizes[order[to]] * (to + 1 - at) <= 1 << 20 and sizes[order[to]] <= 2 * sizes[order[at]] + 64:
            to += 1
        part = order[at:to]
        n = int(sizes[part].max())
        if n >= words:
            place = np.arange(n)
            inside = place < sizes[part][:, None]
            value = np.where(inside, shared[np.where(inside, first[rows[part]][:, None] + place, 0)] - share, -1e9)
            run = np.zeros((len(part), n + 1))
            np.cumsum(value, axis=1, out=run[:, 1:])
            least = np.minimum.accumulate(run[:, :n + 1 - words], axis=1)
            out[part] = (run[:, words:] - least).max(axis=1) >= -1e-6
        at = to
    return out


def _compare(batches, key, k, reach, min_words, identity):
    """Aligned passages from pieces sorted by chain and side, and the seeds of
    the chains that lie in none of them. Chains whose pieces have fewer words in
    common than the shortest passage needs, or no run dense enough in words of
    the other side, are not aligned."""
    kinds = [pa.float64() if c == "identity" else pa.int64() for c in RESULT]
    need = int(np.ceil(identity * min_words - 1e-9))
    for keys, h, first, at, at_first, ahead, rows in _pairs(batches, key):
        common, shared = _common(h, first, rows)
        possible = common >= need
        for side, least in ((0, min_words), (1, need)):
            possible[possible] = _dense(shared, first, rows[possible] + side, least, identity)
        items = []
        for i in rows[possible].tolist():
            xs, ys = (at[at_first[r]:at_first[r + 1]].astype(np.int64) for r in (i, i + 1))
            bases = max(0, int(xs[0]) - reach), max(0, int(ys[0]) - reach)
            items.append((h[first[i]:first[i + 1]], h[first[i + 1]:first[i + 2]], xs - bases[0], ys - bases[1], i, bases))
        out = {c: [] for c in RESULT}
        # seeds in no passage: rows of h where they start
        rest = []
        for i in rows[~possible].tolist():
            places = at[at_first[i]:at_first[i + 1]]
            rest.append(places - max(0, int(places[0]) - reach) + first[i])
        for (words, _, xs, _, i, (base_a, base_b)), (p, q) in zip(items, align([t[:4] for t in items], k)):
            if len(p) >= need:
                p = stretch(words, p, min_words, k)
            alone = np.ones(len(xs), bool)
            for lo, hi in parts(p, q, min_words, identity):
                s, e, t, f = int(p[lo]), int(p[hi - 1]) + 1, int(q[lo]), int(q[hi - 1]) + 1
                alone &= (xs < s) | (xs + ahead[at_first[i]:at_first[i + 1]] + k > e)
                for n, v in zip(out, (int(keys[0, i]), s + base_a, e + base_a, int(keys[2, i]), t + base_b,
                                      f + base_b, hi - lo, (hi - lo) / max(e - s, f - t))):
                    out[n].append(v)
            if alone.any():
                rest.append(xs[alone] + first[i])
        places = np.concatenate(rest).astype(np.int64) if rest else np.zeros(0, np.int64)
        again = W.kgrams(h[places[:, None] + np.arange(k)].ravel(), np.arange(len(places) + 1) * k, k)[0].view(np.int64)
        n, m = len(out["doc_id"]), len(again)
        for lo in range(0, n, 5000):
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(v[lo:lo + 5000], t) for v, t in zip(out.values(), kinds)),
                 pa.nulls(min(n, lo + 5000) - lo, pa.int64())], [*RESULT, "seed"])
        for lo in range(0, m, 5000):
            part = again[lo:lo + 5000]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(part), t) for t in kinds), pa.array(part)],
                                             [*RESULT, "seed"])


def _cut(docs: DataFrame, requests: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``requests`` (__id, __version, lo, hi, ...) with the bytes lo to hi of
    their document as text ``piece``."""
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__version"),
                        F.col(text_col).cast("string").cast("binary").alias("__text"))
    piece = F.substring("__text", F.col("lo") + 1, F.col("hi") - F.col("lo")).cast("string")
    return (texts.join(requests, ["__id", "__version"])
            .select(*[c for c in requests.columns if c not in ("__id", "__version", "lo", "hi")], piece.alias("piece")))


def _by_pairs(found: DataFrame, left: DataFrame, min_words: int, reach: int) -> DataFrame:
    """Anchors of the places of the seeds ``left``, matched once more: by pairs of
    them at most ``min_words`` words apart, each with the lowest class that has
    both. Of a run its first two places have pairs, and its first and last: those
    between have the same ones. Where every seed of an edited passage stands in a lower text too,
    those texts seldom have two of them together."""
    # the lowest class was compared with all others: seeds of three texts at least
    wanted = materialize(found.filter("run > 0").select("seed", "version")
                         .join(left.hint("merge"), "seed").distinct()
                         .groupBy("seed").agg(F.count("*").alias("texts")).filter("texts > 2").select("seed"))
    places = (found.filter("run > 0").select("seed", *PLACE).join(wanted.hint("merge"), "seed")
              .groupBy("version", "pos").agg(F.min(F.struct("doc_id", "lo", "hi", "run", "step", "los", "seed")).alias("p"))
              .select("version", "pos", "p.*"))
    outer = F.expr("""explode(array_distinct(array(
        struct(0 as kind, bigint(pos) as at), struct(0 as kind, bigint(pos + step * least(1, run - 1)) as at),
        struct(1 as kind, bigint(pos) as at), struct(1 as kind, bigint(pos + step * (run - 1)) as at)))) as end""")
    after = Window.partitionBy("version", "end.kind").orderBy("end.at").rangeBetween(1, min_words)
    near = (places.select("version", "seed", F.struct(*PLACE).alias("place"), outer)
            .withColumn("next", F.collect_list(F.struct("seed", "place")).over(after)))
    both = (near.select("seed", "place", "end.kind", F.explode("next").alias("n"))
            .select(F.explode(F.array(*[
                F.struct(F.xxhash64("seed", "n.seed", "kind", F.lit(i)).alias("pair"), F.col(c).alias("place"))
                for i, c in enumerate(("place", "n.place"))])).alias("r")).select("r.pair", "r.place.*"))
    return anchors(lowest(materialize(both), "pair", PLACE), min_words, reach)


def _aligned(met: DataFrame, docs: DataFrame, k: int, gap: float, reach: int, min_words: int, identity: float,
             id_col: str, text_col: str) -> DataFrame:
    """``_compare`` of the chains of the matches ``met``."""
    linked = materialize(chains(met, k, gap))
    key = [*PAIR, "x0", "y0"]
    sides = (linked.withColumns({"x0": F.col("xs")[0], "y0": F.col("ys")[0]})
             .select(*key, F.col("aheads").alias("ahead"), F.explode(F.array(*[
                 F.struct(F.lit(i).alias("side"), F.col(d).alias("__id"), F.col(v).alias("__version"),
                          F.col(f"{c}_lo").alias("lo"), F.col(f"{c}_hi").alias("hi"), F.col(f"{c}s").alias("at"))
                 for i, (d, v, c) in enumerate(((PAIR[0], PAIR[1], "x"), (PAIR[2], PAIR[3], "y")))])).alias("r"))
             .select(*key, "ahead", "r.*"))
    dealt = _cut(docs, sides, id_col, text_col).repartition(*key).sortWithinPartitions(*key, "side")
    return materialize(dealt.mapInArrow(
        lambda it: _compare(it, key, k, reach, min_words, identity),
        ", ".join(f"{c} {t}" for c, t in KINDS.items()) + ", seed bigint"))


def _exact_rest(docs: DataFrame, found: DataFrame, left: DataFrame, k: int, reach: int, min_words: int,
                id_col: str, text_col: str) -> DataFrame:
    """Exact repeats around all occurrences of the seeds ``left``. Of the windows
    inside a run of places only those of its first step are needed, others repeat
    them; one in ``min_words`` words is kept, so that all its words are covered."""
    span = min_words - k                             # a window starts at most so many words before the seed
    # written and joined by sorting, as in ``lowest``: a seed may be in most texts
    places = (found.filter("sparse and run > 0").join(left.hint("merge"), "seed")
              .groupBy("version", "pos").agg(F.min("doc_id").alias("doc_id"), F.min("lo").alias("lo"),
                                             F.max("hi").alias("hi"), F.max("run").alias("run"), F.max("step").alias("step")))
    cut = _cut(docs, places.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), "lo", "hi",
                                   "doc_id", "version", "pos", "run", "step"), id_col, text_col)

    def run(batches):
        for b in batches:
            for rows, data, offsets in W.slices(b, column="piece"):
                h, first = text_words(data, offsets)
                pos = rows.column("pos").to_numpy().astype(np.int64)
                base = np.maximum(pos - reach, 0)
                g, at, doc = W.kgrams_wide(h, first, min_words)
                start = at - first[doc] + base[doc]
                step = rows.column("step").to_numpy().astype(np.int64)
                last = pos + step * (rows.column("run").to_numpy() - 1)
                after = start - pos[doc]
                keep = (after >= -span) & (start <= last[doc])
                each = step * np.maximum(min_words // step, 1)
                keep &= (after < step[doc]) | (start >= last[doc] - span) | (after % each[doc] == 0)
                take = pa.array(doc[keep])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[keep].view(np.int64)), rows.column("version").take(take),
                     rows.column("doc_id").take(take), pa.array(start[keep].astype(np.int32))],
                    ["run", "version", "doc_id", "start"])

    windows = materialize(cut.mapInArrow(run, "run bigint, version bigint, doc_id bigint, start int").distinct())
    met = lowest(windows, "run", ["version", "doc_id", "start"]).withColumn("diagonal", F.col("start") - F.col("p_start"))
    same = ["doc_id", "version", "p_doc_id", "p_version", "diagonal"]
    island = F.col("start") - F.row_number().over(Window.partitionBy(*same).orderBy("start"))
    size = F.max("start") - F.min("start") + min_words
    return (met.withColumn("island", island).groupBy(*same, "island")
            .agg(F.min("start").cast("long").alias("start_word"), size.cast("long").alias("n_equal"),
                 F.min("p_start").cast("long").alias("partner_start"))
            .select("doc_id", "start_word", (F.col("start_word") + F.col("n_equal")).alias("end_word"),
                    F.col("p_doc_id").alias("partner_id"), "partner_start",
                    (F.col("partner_start") + F.col("n_equal")).alias("partner_end"), "n_equal",
                    F.lit(1.0).alias("identity")))


def repeated_passages(docs: DataFrame, min_words: int = 50, identity: float = 0.8, k: int = 6, w: int = 10,
                      gap: float = 0.15, reach: int = 96, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Passages that documents share, by seeds, chains and alignment (above)."""
    if k + w - 1 > min_words or reach < min_words:
        raise ValueError("k + w - 1 must not exceed min_words, nor min_words reach, or passages could be missed")
    found = materialize(seeds(docs, k, w, reach, min_words, id_col, text_col))
    how = (docs, k, gap, reach, min_words, identity, id_col, text_col)
    aligned = _aligned(matches(found, min_words, reach), *how)
    passages = aligned.filter("seed is null")
    # of runs only the ends were matched, so what surrounds them is looked for again
    left = materialize(aligned.filter("seed is not null").select("seed")
                       .unionByName(found.filter("run > 1").select("seed")).distinct())
    others = _aligned(_by_pairs(found, left, min_words, reach), *how).filter("seed is null")
    # two chains of one pair may grow to the same passage
    passages = passages.select(*RESULT).unionByName(others.select(*RESULT)).distinct()
    rest = _exact_rest(docs, found, left, k, reach, min_words, id_col, text_col)
    # copies: one row each, with the document that stands for their class
    whole = found.filter(F.col("pos") == -1)
    first = whole.groupBy("version").agg(F.min("doc_id").alias("partner_id"), F.max("doc_id").alias("last")) \
        .filter("partner_id < last")
    copies = (whole.filter(F.col("hi") >= min_words).join(first, "version").filter("doc_id != partner_id")
              .select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("hi").cast("long").alias("end_word"),
                      "partner_id", F.lit(0).cast("long").alias("partner_start"),
                      F.col("hi").cast("long").alias("partner_end"), F.col("hi").cast("long").alias("n_equal"),
                      F.lit(1.0).alias("identity")).distinct())
    return passages.unionByName(rest).unionByName(copies)


def op9_substrings(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_words=50, identity=0.8)
