"""Operators against brute force on small tables, and their defined results at the edges."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex
import xxhash
import pytest
from pyspark.sql import functions as F

from palisade.llm import components, fingerprints, language_id, language_model, licenses, mixing, near_dup, nearest, packing, quality, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, class_id string, tokens string, __none string"
SMALL = "/root/testdata/sf0.001"


def words(seed, n, size=200):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(size)]
    return [r.choice(vocab) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), 0.5, "c", "t", None) for i, t, la, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def edge_rows():
    base = " ".join(words(1, 300))
    near = base.split()
    near[100] = "changed"
    passage = " ".join(words(2, 120))
    assert len(passage.encode()) > 400
    return [
        (0, base, "en", "src0"), (1, base, "en", "src0"), (2, " ".join(near), "en", "src1"), (3, None, "en", "src1"), (4, "", None, "src2"), (5, "...", "de", None), (6, "one two", "de", "src3"),
        (7, " ".join(words(3, 200)) + " " + passage + " " + " ".join(words(4, 50)), "fr", "src2"), (8, " ".join(words(5, 80)) + "é " + passage, "fr", "src2"), (9, "a" * 3000, "fr", "src5"),
        (10, " ".join(words(6, 30_000, 5000)), "en", "src0"), (None, "no id here at all", "en", "src0"), (12, "one two", "de", "src3"), (12, "one two", "de", "src3"), (-5, "Ünïcödé \U0001f600 text\twith\nlines", "es", "odd"),
        (2**40, "far away document", "en", "src1"),
    ]


@pytest.fixture(scope="module")
def edges(spark, edge_rows):
    return table(spark, edge_rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1 mixing ---------------------------------------------------------------------------

def water(children, budget):
    """Quotas of (name, weight, capacity) by filling up one child after another."""
    live, out = sorted([c for c in children if c[1] > 0 and c[2] > 0], key=lambda c: (c[2] / c[1], c[0])), {}
    rest, heft = budget, sum(c[1] for c in live)
    while live and live[0][2] * heft <= rest * live[0][1]:
        name, w, cap = live.pop(0)
        out[name] = cap
        rest, heft = rest - cap, heft - w
    part = {n: rest * w // heft for n, w, _ in live}
    spare = rest - sum(part.values())
    for k, n in enumerate(sorted(part)):
        out[n] = part[n] + (k < spare)
    return out


def mixture(rows, share=mixing.SHARE, epochs=mixing.EPOCHS, seed=mixing.SEED):
    def domain(s):
        m = re.search(r"([0-9]{1,9})$", s or "")
        return mixing.DOMAINS[int(m[1]) % 4] if m else "other"

    docs = [(k, "" if i is None else str(i), len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), (domain(s), la or "(null)", s or "(null)")) for k, (i, t, la, s) in enumerate(rows)]
    tokens = Counter()
    for _, _, n, path in docs:
        tokens[path] += n
    caps = {p: n * epochs for p, n in tokens.items() if n}
    budget = min(sum(caps.values()), int(sum(tokens.values()) * share))
    quota = {}
    top = water([(d, mixing.DOMAIN_WEIGHTS.get(d, 1), sum(c for p, c in caps.items() if p[0] == d)) for d in {p[0] for p in caps}], budget)
    for d, b in top.items():
        langs = water([(x, mixing.LANGUAGE_WEIGHTS.get(x, 1), sum(c for p, c in caps.items() if p[:2] == (d, x))) for x in {p[1] for p in caps if p[0] == d}], b)
        for x, b2 in langs.items():
            for s, q in water([(p[2], 1, c) for p, c in caps.items() if p[:2] == (d, x)], b2).items():
                quota[d, x, s] = q
    out = Counter()
    for path, q in quota.items():
        own = [(i, name, n) for i, name, n, p in docs if p == path]
        whole, left = divmod(q, tokens[path])
        for i, _, _ in own:
            if whole and q:
                out[i] += whole
        at = 0
        for i, name, n in sorted((x for x in own if x[2]), key=lambda x: (hashlib.md5(f"{seed}:{whole}:{x[1]}".encode()).hexdigest(), x[0])):
            if at < left:
                out[i] += 1
            at += n
    return out, quota


@pytest.mark.parametrize("share,epochs", [(0.6, 2), (1.7, 2), (0.05, 3)])
def test_mixing(spark, share, epochs):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    rows += [(None, "x y", None, None), (5, None, "en", "src1"), (6, "", "en", "odd")]
    got = mixing.chosen(table(spark, rows), share=share, epochs=epochs).collect()
    want, quota = mixture(rows, share, epochs)
    names = Counter()
    for k, n in want.items():
        names[rows[k][0], rows[k][2] or "(null)", rows[k][3] or "(null)"] += n
    assert Counter((r.doc_id, r.lang, r.source) for r in got) == names
    assert {(r.domain, r.lang, r.source): r.quota for r in got}.items() <= quota.items()


def test_mixing_edges(edges, empty):
    out = mixing.mixed(edges)
    assert out.columns == edges.columns and out.count() > 0
    assert mixing.mixed(empty).isEmpty() and mixing.chosen(empty).isEmpty()


# --- 2 licences --------------------------------------------------------------------------

def test_automaton_finds_all_substrings():
    texts = [t.split() for t in ("a b c a b d", "b c a x", "a a a")]
    auto = licenses.Automaton([[w.encode() for w in t] for t in texts])
    subs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for sub in subs | {("a", "x"), ("d", "b"), ("c", "b")}:
        s = 0
        for w in sub:
            s = auto.step[s].get(w.encode(), -1) if s >= 0 else -1
        assert (s >= 0) == (sub in subs)
        if s >= 0:
            assert auto.ends[s] == {(i, j + len(sub)) for i, t in enumerate(texts) for j in range(len(t)) if tuple(t[j : j + len(sub)]) == sub}


def test_licenses(spark, edges, empty):
    rows = [(1, "x. Licensed under the APACHE License,\nversion 2.0 and all rights reserved, CC-BY cc by", "en", "s"), (2, "licensed under the big apache license version 2 0", "en", "s"), (3, "general public licenses; general public license", "en", "s"), (4, "Éall rights reserved É all rights reserved", "en", "s")]
    got = {r.doc_id: r for r in licenses.digests(table(spark, rows)).collect()}
    assert (got[1].base_labels, got[1].labels, got[1].n_base, got[1].first_word, got[1].last_word) == ("cc-by,reserved", "apache-2.0,cc-by,reserved", 3, 10, 15)
    assert got[2].labels == "apache-2.0" and got[2].base_labels == "" and got[2].first_word is None and got[2].score >= 0.8
    assert (got[3].base_labels, got[3].first_word, got[3].n_words) == ("gpl", 3, 6)
    assert (got[4].n_base, got[4].first_word) == (1, 4)
    e = licenses.digests(edges).collect()
    assert len(e) == edges.count() and {(r.n_words, r.score) for r in e if r.doc_id in (3, 4)} == {(0, 0.0)}
    assert licenses.digests(empty).isEmpty()


def test_chains_equal_brute_force():
    r = random.Random(4)
    for _ in range(60):
        texts = [[b"%d" % r.randint(0, 5) for _ in range(r.randint(4, 14))] for _ in range(3)]
        stream = [b"%d" % r.randint(0, 6) for _ in range(120)]
        at = r.randint(0, 80)
        stream[at : at + len(texts[0])] = texts[0]
        places = {}
        for i, t in enumerate(texts):
            for a in range(len(t)):
                for b in range(a + 1, len(t) + 1):
                    places.setdefault(tuple(t[a:b]), set()).add((i, b))
        longest = [max(n for n in range(e + 1) if not n or tuple(stream[e - n : e]) in places) for e in range(len(stream) + 1)]
        ends = [e for e in range(1, len(stream) + 1) if longest[e] >= 3 and (e == len(stream) or longest[e + 1] != longest[e] + 1)]
        chains = []
        for e in ends:
            n = longest[e]
            for i, stop in sorted(places[tuple(stream[e - n : e])]):
                for c in reversed([c for c in chains if c[0] == i]):
                    skip = max(0, c[2] - (e - n), c[4] - (stop - n))
                    if skip < n and 0 <= e - n + skip - c[2] <= licenses.GAP and stop - n + skip >= c[4]:
                        c[2], c[3], c[4] = e, c[3] + n - skip, stop
                        break
                else:
                    chains.append([i, e - n, e, n, stop])
        auto = licenses.Automaton(texts)
        known = {w for t in texts for w in t}
        got = licenses.covered(auto.runs(stream, [k for k, w in enumerate(stream) if w in known], 3), auto)
        assert sorted(c[:4] for c in got) == sorted(tuple(c[:4]) for c in chains)


def test_many_chains_and_numbers(spark):
    head, tail = "redistribution and use in source and binary forms", "with or without modification are permitted provided that the following conditions are met"
    mix = " ".join([head] * 6) + " " + tail  # five chains begin before the one that goes on
    rows = [(1, mix, "en", "s"), (2, "This work is licensed under the GNU General Public License, version 2", "en", "s"), (3, "This work is licensed under the GNU General Public License, version 3", "en", "s")]
    got = {r.doc_id: r for r in licenses.digests(table(spark, rows)).collect()}
    assert "bsd" in got[1].labels and got[2].labels == "gpl" and got[3].labels == "gpl,gpl-3.0"


# --- 3 fingerprints ------------------------------------------------------------------------

def test_fingerprints(edges, edge_rows, empty):
    got = fingerprints.fingerprints(edges).collect()
    order = sorted(range(len(edge_rows)), key=lambda k: (edge_rows[k][0] is not None, edge_rows[k][0] or 0, edge_rows[k][1] or ""))
    want, by = Counter(), defaultdict(set)
    for k, at in enumerate(order):
        i, t = edge_rows[at][0], edge_rows[at][1] or ""
        nxt = edge_rows[order[(k + 1) % len(order)]][1] or ""
        e = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[0] == prints[1] and prints[3] == prints[4] == prints[5] == "" and len(prints[0]) == fingerprints.BINS
    near = {r.doc_id: r.near_next for r in got}
    assert near[0] == 1.0 and near[1] > 0.8 and near[7] < 0.5 and all(0 <= r.near_edited <= 1 for r in got)
    assert fingerprints.fingerprints(empty).isEmpty()


def brute_fingerprint(text):
    w = regex.findall(r"[\p{L}\p{N}_]+", text.lower())
    if not w:
        return ""
    h = []
    for i in range(len(w) - 4):
        x = 42
        for word in w[i : i + 5]:
            x = xxhash.xxh64_intdigest(word.encode(), x)
        h.append(x)
    h = h or [xxhash.xxh64_intdigest(" ".join(w).encode(), 42)]
    least = {}
    for x in h:
        least[x >> 57] = min(x, least.get(x >> 57, x))
    order = fingerprints.probes()
    return "".join(f"{least[next(b for b in [j, *order[j]] if b in least)] & 15:x}" for j in range(128))


def test_fingerprint_equals_brute_force(spark):
    texts = ["", "?!", "one", "Ünö dos_3 TRES", "a b c d e"] + [" ".join(words(k, n, 3000)) for k, n in enumerate((5, 6, 9, 20, 60, 200, 3000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(rows).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert all(sorted([j, *row]) == list(range(128)) for j, row in enumerate(fingerprints.probes()))


def test_fingerprint_blocks_of_uneven_ids(spark):
    ids = [-(2**50), *range(6000), *range(10**9, 10**9 + 3000 * 1000, 1000), 2**40, 2**62, *[77] * 40, None, None]
    rows = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "id long, text string")
    got = sorted(((r.id is not None, r.id or 0), r.block) for r in fingerprints._blocked(rows).collect())
    assert [b for _, b in got] == sorted(b for _, b in got) and {b for (known, _), b in got if not known} == {-1}
    sizes = Counter(b for _, b in got)
    assert max(sizes.values()) <= 2 * fingerprints.BLOCK and len(sizes) < 200
    edited = {r.doc_id: r.edited_sha256 for r in fingerprints.fingerprints(rows.withColumnRenamed("id", "doc_id")).collect()}
    order = sorted(((i is not None, i or 0), f"text {k}") for k, i in enumerate(ids))
    for k, ((known, i), t) in enumerate(order):
        if known and i != 77:
            nxt = order[(k + 1) % len(order)][1]
            assert edited[i] == hashlib.sha256((t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]).encode()).hexdigest()


def test_fingerprint_estimates_likeness(spark):
    text = words(9, 2000, 4000)
    other = text[:1500] + words(10, 500, 4000)
    probes = fingerprints.probes()
    row = spark.createDataFrame([(" ".join(text), " ".join(other))], "a string, b string").select(fingerprints.fingerprint(F.col("a"), probes).alias("a"), fingerprints.fingerprint(F.col("b"), probes).alias("b")).select(fingerprints.likeness("a", "b")).first()
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    x, y = shingles(text), shingles(other)
    assert abs(row[0] - len(x & y) / len(x | y)) < 0.15


# --- 4 nearest -------------------------------------------------------------------------------

def test_nearest(spark):
    r = np.random.default_rng(1)
    vecs = r.normal(size=(900, 16)).astype(np.float32)
    vecs[700] = vecs[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    rows += [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [None] + [1.0] * 15), (1400, [float("inf")] + [1.0] * 15), (1500, []), (None, [1.0] * 16), (1600, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in nearest.search_table(df).collect()}
    v = vecs.astype(np.float64)
    for q in range(0, 900, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        best = sorted((d[i], i) for i in range(900) if i != q)[:10]
        for k, (dist, i) in enumerate(best, 1):
            assert got[q, k][0] == i and got[q, k][1] == pytest.approx(dist, abs=1e-12)
    assert len(got) == 90
    assert nearest.search_table(df.limit(0)).isEmpty()


def test_bounds_hold():
    r = np.random.default_rng(2)
    a, b = r.normal(size=(50, 20)), r.normal(size=(60, 20)) * 100

    def coded(v):
        s = np.abs(v).max(axis=1) / 127
        c = np.rint(v / s[:, None]).astype(np.int8)
        return c, s, np.sqrt(((v - c * s[:, None]) ** 2).sum(axis=1))

    low, high = nearest.bounds(*coded(a), *coded(b))
    true = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    assert (low <= true + 1e-9).all() and (true <= high + 1e-9).all()


# --- 5 quality ---------------------------------------------------------------------------------

def test_quality(spark, edges, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    good, bad = [got[i].keep for i, q in truth.items() if q], [got[i].keep for i, q in truth.items() if not q]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.15
    e = {r.doc_id: r for r in quality.judge(edges, labels).collect()}
    assert not e[3].keep and not e[4].keep and e[3].perplexity is None and len(e) == len({r.doc_id for r in edges.collect()})
    assert quality.judge(empty, labels).isEmpty()
    assert all(r.keep for r in quality.judge(edges.where("text <> ''"), labels.limit(0)).collect())


def test_quality_keeps_few_bad_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.judge(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").select("quality", "keep").collect()
    assert np.mean([r.keep for r in rows if r.quality]) > 0.99 and np.mean([r.keep for r in rows if not r.quality]) < 0.1


def brute_model(texts):
    """log10 probability by (history, symbol) of the interpolated model, from Counters; symbols are characters here."""
    counts = [Counter(("\0" * (quality.ORDER - 1) + t)[i : i + quality.ORDER] for t in texts for i in range(len(t)))]
    while len(counts) < quality.ORDER:
        counts.append(Counter(g[1:] for g in counts[-1]))

    def p(gram):
        if not gram:
            return 1 / quality.SYMBOLS
        c = counts[quality.ORDER - len(gram)]
        kinds = Counter(c.values())
        y = kinds[1] / max(kinds[1] + 2 * kinds[2], 1)
        off = [min(float(k), max(0.0, k - (k + 1) * y * kinds[k + 1] / max(kinds[k], 1))) for k in (1, 2, 3)]
        own = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
        d = lambda n: off[min(n, 3) - 1]
        total = sum(own.values())
        if not total:
            return p(gram[1:])
        return max(own.get(gram, 0) - (d(own[gram]) if gram in own else 0), 0) / total + sum(map(d, own.values())) / total * p(gram[1:])

    return lambda t: sum(math.log10(p(("\0" * (quality.ORDER - 1) + t)[i : i + quality.ORDER])) for i in range(len(t)))


def test_quality_learns_from_all_trusted_documents(spark):
    texts = [" ".join(words(500 + i, 6)) for i in range(40)]
    got = {r.doc_id: r for r in quality.judge(table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), spark.createDataFrame([(i, 1) for i in range(39)], "doc_id long, quality int")).collect()}
    model = brute_model(texts[:39])
    assert all(got[i].log10_p == pytest.approx(model(texts[i]), abs=0.1) for i in (0, 7, 8, 21, 38, 39))
    half = {r.doc_id: r.h for r in spark.range(39).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id"), F.lit(2)).alias("h")).collect()}
    first = brute_model([texts[i] for i in half if half[i] == 0])
    hardest = max(-first(texts[i]) / len(texts[i]) for i in half if half[i] == 1)
    assert math.log10(got[39].threshold) == pytest.approx(hardest, abs=0.005)


def test_quality_holds_one_model_at_a_time(spark):
    docs = table(spark, [(i, " ".join(words(500 + i, 6)), "en", "s") for i in range(20)])
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    tracemalloc.start()
    try:
        assert quality.judge(docs, labels).count() == 20
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 9 * quality.SYMBOLS**quality.ORDER  # a model is 4 bytes a gram while it is made and 2 then


def test_quality_counts_that_go_on_early():
    texts, table_ = [" ".join(words(700 + i, 30)) for i in range(9)], np.arange(65536) % quality.SYMBOLS
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])

    def total(fold):
        out = Counter()
        for b in quality._counts(table_.astype(np.uint8), fold)([batch]):
            for g, c in zip(*(x.to_pylist() for x in b.columns)):
                out[g] += c
        return out

    assert total(quality.FOLD) == total(100) and total(100).total() == sum(map(len, texts))


def test_model_is_a_distribution(spark):
    texts = spark.createDataFrame([(" ".join(words(20 + i, 50)),) for i in range(20)], "text string")
    table_, logs = quality.train(texts)
    p = 10 ** logs.astype(np.float64).reshape(-1, quality.SYMBOLS)
    seen = np.unique(np.concatenate([quality.gram_ids(quality.symbols(r.text, table_)) // quality.SYMBOLS for r in texts.collect()]))
    assert np.allclose(p[seen].sum(axis=1), 1, atol=0.02)


# --- 6 near duplicates ----------------------------------------------------------------------------

def near_classes(rows):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"\w+", (t or "").lower())
        k = min(5, len(w))
        sets.append(Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter({("\0", t or ""): 1}))
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = sum((sets[a] & sets[b]).values())
            if both / (sets[a].total() + sets[b].total() - both) >= 0.8:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(rows))]


def test_near_duplicates(spark, edges, edge_rows, empty):
    rows = list(edge_rows)
    base = words(30, 400)
    for k in range(40):  # a chain of edits, and edits of one text
        w = list(base)
        for j in range(k % 8):
            w[(37 * k + 53 * j) % 400] = f"edit{k}x{j}"
        rows.append((100 + k, " ".join(w), "en", "src0"))
    got = near_dup.class_of(table(spark, rows)).collect()
    cls = near_classes(rows)
    groups = defaultdict(set)
    for k, c in enumerate(cls):
        groups[c].add(k)
    want = Counter((rows[k][0], min((rows[j][0] for j in groups[cls[k]] if rows[j][0] is not None), default=None)) for k in range(len(rows)))
    assert Counter((r.doc_id, r.class_id) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert near_dup.deduplicate(edges).columns == edges.columns and near_dup.deduplicate(edges).count() == len(set(near_classes(edge_rows)))
    assert near_dup.class_of(empty).isEmpty() and near_dup.deduplicate(empty).isEmpty()


def test_blocks_of_one_class_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    r = random.Random(6)
    rows = [(1, i, 0 if i < 300 else i, r.randint(1, 50)) for i in range(320)] + [(2, i, i % 2, 5) for i in range(6)] + [(3, i, 7, 5) for i in range(100)] + [(4, i, i, 5) for i in range(30)]
    blocked = near_dup._blocked(spark.createDataFrame(rows, "key long, rep long, comp long, size long"))
    packed = blocked.groupBy("key", "rest", "blocks", "block").agg(F.collect_list(F.struct("key", "rep", "comp")).alias("x"))
    met, sent = Counter(), Counter()
    for x, y in near_dup._meetings(packed).collect():
        sent[x[0].key] += len(x) + len(y or [])
        met.update(frozenset([(m.key, m.rep), (n.key, n.rep)]) for k, m in enumerate(x) for n in (y if y is not None else x[k + 1 :]) if m.comp != n.comp)
    want = {frozenset([(k, i), (k, j)]) for k, i, c, _ in rows for q, j, d, _ in rows if k == q and i < j and c != d}
    assert set(met) == want and set(met.values()) == {1}  # each two of different classes once
    assert sent[1] < 6 * 320 and sent[3] == 0  # all blocks with all would send some 40 times as many


@pytest.mark.parametrize("size", [3, 1 << 9])
def test_near_duplicates_in_large_buckets(spark, monkeypatch, size):
    monkeypatch.setattr(near_dup, "BLOCK", size)
    rows = []
    for k in range(90):  # texts that share buckets, in several classes
        w, r = words(31, 120), random.Random(k)
        for _ in range(r.choice((1, 4, 7))):
            w[r.randrange(120)] = f"edit{r.random()}"
        rows.append((k, " ".join(w), "en", "src0"))
    got = {r.doc_id: r.class_id for r in near_dup.class_of(table(spark, rows)).collect()}
    assert got == dict(enumerate(near_classes(rows)))


def test_signatures_estimate_weighted_likeness():
    a = near_dup.units(near_dup.word_ids(" ".join(words(40, 1500, 3000))))
    r = np.random.default_rng(3)
    b = np.sort(np.concatenate((a[r.random(len(a)) < 0.8], r.integers(0, 2**63, 200, dtype=np.uint64))))
    s = near_dup.signatures([a, b] * 1)
    true = near_dup.similarity(np.sort(a), b)
    assert abs((s[0] == s[1]).mean() - true) < 0.17 and (s != 0).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14), (20, 20)] + [(100, 100 + i) for i in range(1, 50)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got[3] == 1 and got[14] == 10 and got[149] == 100 and got[1040] == 1000
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()


# --- 7 language model --------------------------------------------------------------------------------

def test_language_model(spark, edges, edge_rows, empty):
    got = language_model.score(edges).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + [None] for _, t, *_ in edge_rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, *_ in edge_rows]
    c = Counter(x for t, h in zip(tokens, held) if not h for x in t)
    n, v = c.total(), len(c)
    want = sorted(((i is None, i or 0, h, len(t), sum(c[x] > 0 for x in t), round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 4)) for (i, *_), t, h in zip(edge_rows, tokens, held)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert language_model.score(empty).isEmpty()


def test_gradient_and_carried_state():
    m = language_model.Gru(3)
    for k in m.NAMES:
        setattr(m, k, getattr(m, k).astype(np.float64))
    r = np.random.default_rng(4)
    units, live, start = r.integers(0, language_model.CLASSES, (3, 6)), np.ones((3, 6), bool), np.zeros((3, 6), bool)
    live[2, 4:], start[0, 0], start[1, 3] = False, True, True
    before = np.concatenate((r.integers(0, language_model.CLASSES, (3, 1)), units[:, :-1]), axis=1)
    before[start] = language_model.CLASSES
    h = r.normal(size=(3, language_model.HIDDEN)) * 0.1
    _, _, grads = m.window(h, before, units, start, live)
    for k in m.NAMES:
        w = getattr(m, k)
        at = np.unravel_index(np.argmax(np.abs(grads[k])), w.shape)
        w[at] += 1e-5
        up = m.window(h, before, units, start, live)[1]
        w[at] -= 2e-5
        down = m.window(h, before, units, start, live)[1]
        w[at] += 1e-5
        assert grads[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-4)


def likelihood(m, text):
    """Token by token, without lanes and batches."""
    sigmoid, total, h, last = lambda v: 1 / (1 + np.exp(-v)), 0.0, np.zeros(language_model.HIDDEN), language_model.CLASSES
    share = lambda s, i: s[i] - np.log(np.exp(s).sum())
    for unit in text:
        (az, ar, an), (gz, gr, gn) = np.split(m.x[last] + m.b, 3), np.split(h @ m.u, 3)
        z, n = sigmoid(az + gz), np.tanh(an + sigmoid(ar + gr) * gn)
        h = (1 - z) * h + z * n
        k = unit // language_model.SIDE
        total += share(h @ m.v + m.c, k) + share(h @ m.w[k] + m.d[k], unit % language_model.SIDE)
        last = unit
    return total


def test_scores_equal_token_by_token():
    m, r = language_model.Gru(5), np.random.default_rng(2)
    texts = [r.integers(0, language_model.CLASSES, n) for n in [1, 50, 7, 1300, 512, 513, 1] * 60]
    got = dict(m.score(texts))
    assert sorted(got) == list(range(len(texts)))
    for i in list(range(14)) + [200, 419]:
        assert got[i] == pytest.approx(likelihood(m, texts[i]), rel=1e-4)


def test_lanes_hold_every_token_once():
    r = np.random.default_rng(3)
    texts = [r.integers(0, 9, n) for n in r.integers(1, 40, 60)]
    found, carried = {}, {}
    for rows, before, units, start, number in language_model.laid(texts, lanes=4, span=16):
        for k, row in enumerate(rows):
            for b, u, s, n in zip(before[k], units[k], start[k], number[k]):
                if n >= 0:
                    assert s == (n not in found) and b == (language_model.CLASSES if s else carried[row])
                    found.setdefault(int(n), []).append(u)
                    carried[row] = u
    assert [found[i] for i in range(60)] == [t.tolist() for t in texts]


def test_model_beats_counts_on_held_out(spark):
    rows = language_model.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_long_texts_are_cut_at_ascii_white_space_only():
    from palisade.llm.common import blocks

    text = "a" * (1 << 20) + "\u00a0b\x1cd c" + " e" * 1_200_000
    assert "".join(blocks(text)) == text and len(list(blocks(text))) > 2
    assert len(language_model.token_ids(text)) == len(re.findall(r"[^\x20\x09-\x0D]+", text)) + 1
    assert len(near_dup.word_ids(text)) == len(re.findall(r"\w+", text))


def test_model_is_trained_on_all_tokens(spark, tmp_path):
    r = np.random.default_rng(6)
    units = [r.integers(0, 100, 270).astype(np.uint16) for _ in range(4500)] + [r.integers(0, 100, 5000).astype(np.uint16)]
    rows = [(i, i % 5 != 1, len(x), x.tobytes()) for i, x in enumerate(units)]
    spark.createDataFrame(rows, "__row long, learn boolean, n_tokens long, units binary").write.parquet(f"{tmp_path}/coded")
    learnt = np.concatenate([x for i, x in enumerate(units) if i % 5 != 1])
    _, seen = language_model.train(spark.read.parquet(f"{tmp_path}/coded"), np.bincount(learnt, minlength=language_model.CLASSES))
    assert seen == language_model.PASSES * len(learnt)


def test_passes_are_the_same_at_every_size(spark, tmp_path):
    units = [np.arange(60, dtype=np.uint16) for _ in range(40)]
    spark.createDataFrame([(i, True, 60, x.tobytes()) for i, x in enumerate(units)], "__row long, learn boolean, n_tokens long, units binary").write.parquet(f"{tmp_path}/coded")
    coded, counts = spark.read.parquet(f"{tmp_path}/coded"), np.bincount(np.concatenate(units), minlength=language_model.CLASSES)
    assert [language_model.train(coded, counts * k)[1] for k in (1, 10_000)] == [language_model.PASSES * 2400] * 2


def test_word_within_class_follows_history():
    counts = np.zeros(language_model.CLASSES)
    counts[[3, 4, language_model.END_UNIT]] = 4000, 4000, 100  # two units of one class, as frequent
    m = language_model.Gru(counts=counts)
    m.fit([np.array([3, 4] * 40)] * 5000)
    turns, same = (v for _, v in sorted(m.score([np.array([3, 4] * 20), np.array([3, 3, 4, 4] * 10)])))
    assert turns > same + 20


# --- 8 packing ------------------------------------------------------------------------------------------

def test_packing(edges, edge_rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    vocabulary = packing.read_vocabulary()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(edges, ["doc_id", "score"], "text", vocabulary).orderBy("sequence_id", "offset").collect()
    line = np.concatenate([np.frombuffer(bytes(r.ids), np.uint32) for r in got])
    docs = [np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], np.uint32) for _, t, *_ in edge_rows]
    assert sorted(line.tolist()) == sorted(np.concatenate(docs).tolist())
    assert [r.sequence_id * 2048 + r.offset for r in got] == np.concatenate(([0], np.cumsum([r.length for r in got])[:-1])).tolist()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.sequence_id * 2048 + r.offset - r.start].append(r)
    rebuilt = sorted(np.concatenate([np.frombuffer(bytes(r.ids), np.uint32) for r in sorted(p, key=lambda r: r.start)]).tobytes() for p in pieces.values())
    assert rebuilt == sorted(d.tobytes() for d in docs)
    assert packing.digests(empty, vocabulary).isEmpty()


def test_tokens_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts += ["", " ", "İstanbul ΑΣ Σ", "é ́x a b", "don't we'll I'M 'S x's's", "a1b22 3,4!!??   x　y", "<|endoftext|> a<|startoftext|>b", "日本語 テスト 한국어", "x\x1cy\x85z\x00w", "😀😀 👍🏽", "ﬁ ß ŉ Ǆ", "a" * 500, "_x_ -- it's", "'s 'sun ''s !'s 're've'll'd x'LLama rock 'n' roll' '", "1's2'3 't'", "Élan d'été, l'œuvre", "tab\there\r\nnew\x0b\x0c.", "'", "​zero‍"]
    got = packing.Encoder(packing.read_vocabulary()).ids(texts)
    for t, g in zip(texts, got):
        assert np.frombuffer(g, np.uint32).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t[:40])


# --- 9 suffix arrays ---------------------------------------------------------------------------------------

def cover(rows, length):
    data = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[j : j + length] for b in data for j in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, int)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone[:-1].sum()), int((np.diff(np.concatenate(([0], gone))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [64, 100, 400])
def test_repeats(spark, edge_rows, length):
    rows = [r for r in edge_rows if r[0] != 10]
    passage = " ".join(words(50, 90))
    for k in range(30):  # a passage in many contexts, cut at different places
        rows.append((200 + k, " ".join(words(60 + k, 5 + k)) + passage[k * 3 : len(passage) - 5 * (k % 7)] + " ".join(words(90 + k, 20)), "en", "src0"))
    rows += [(300, "xyxyxy" * 200, "en", "s"), (301, "xyxyxy" * 40 + "z" + "xyxyxy" * 40, "en", "s"), (302, "ab" + "q" * 150 + "cd" + "q" * 150, "en", "s")]
    got = suffix_dedup.digests(table(spark, rows), length=length).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((i, *c) for (i, *_), c in zip(rows, cover(rows, length)))


def test_repeats_by_window_where_cores_are_hot(spark, edge_rows):
    passage = " ".join(words(50, 90))
    rows = [(k, " ".join(words(60 + k, 5)) + passage + " ".join(words(90 + k, 9)), "en", "s") for k in range(12)]
    df = table(spark, rows).select(F.monotonically_increasing_id().alias("__row"), "text")
    a = {r.key: (r.n_removed, bytes(r.kept)) for r in suffix_dedup.removed_spans(df, 400).collect()}
    b = {r.key: (r.n_removed, bytes(r.kept)) for r in suffix_dedup.removed_spans(df, 400, hot=1).collect()}
    assert a == b and any(n for n, _ in a.values())


def test_columns_of_any_name(spark, empty):
    text = " ".join(words(3, 200, 900))
    docs = spark.createDataFrame([(1, text, "en", "s", 1, "x", 2), (2, text, "en", "s", 3, "y", 4), (3, "one two", "en", "s", 5, None, 6)], "doc_id long, text string, lang string, source string, __row long, __TEXT string, __high long")
    assert sorted((r.doc_id, r["__row"], r["__TEXT"]) for r in near_dup.deduplicate(docs).collect()) == [(1, 1, "x"), (3, 5, None)]
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and sorted((r.doc_id, r.text, r["__row"], r["__high"]) for r in out.collect()) == [(1, "", 1, 2), (2, "", 3, 4), (3, "one two", 5, 6)]
    kept = language_id.speaking(docs)
    assert kept.columns == docs.columns and kept.count() == 3
    assert mixing.mixed(docs).columns == docs.columns


def test_repeats_edges(edges, empty):
    out = suffix_dedup.without_repeats(edges)
    assert out.columns == edges.columns and out.count() == edges.count()
    assert {r.text for r in out.collect() if r.doc_id == 3} == {None}
    assert suffix_dedup.digests(empty).isEmpty() and suffix_dedup.without_repeats(empty).isEmpty()


def test_merge_orders_suffixes():
    r = random.Random(5)
    strings = [[r.randint(1, 3) for _ in range(r.randint(3, 30))] for _ in range(40)]
    made = []
    for i in range(0, 40, 13):
        part = strings[i : i + 13]
        text = np.array([x for s in part for x in [*s, 0]], np.uint16)
        order, bwt = suffix_dedup.shard_bwt(text, np.flatnonzero(text == 0))
        made.append((text, order, bwt))
    rounds = 8
    shard, shared = suffix_dedup.merge([m[2] for m in made], rounds)
    place, seq = [0] * len(made), []
    for s in shard:
        text, order, _ = made[s]
        at = order[place[s]]
        place[s] += 1
        end = at + int(np.argmax(text[at:] == 0))
        seq.append(text[at:end].tolist())
    cut = [s[:rounds] for s in seq]
    assert [c for c in cut] == sorted(cut)
    for i in range(1, len(seq)):
        common = 0
        while common < min(len(seq[i]), len(seq[i - 1]), rounds) and seq[i][common] == seq[i - 1][common]:
            common += 1
        assert shared[i] == common


# --- 10 languages -------------------------------------------------------------------------------------------

def test_languages(spark, edges, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language_id.predict_all(docs).where("held_out").collect()
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)
    e = language_id.predict_all(edges).collect()
    assert len(e) == edges.count() and {(r.lang_pred, r.score) for r in e if r.doc_id in (3, 4, 5)} == {("und", 0.0)}
    kept = language_id.speaking(edges)
    assert kept.columns == edges.columns and kept.count() == edges.count() - 3
    assert language_id.predict_all(empty).isEmpty() and language_id.speaking(empty).isEmpty()


def test_profile_by_hand():
    text = "Ab ab, cab! 12 _"
    want = Counter(g for w in ("_ab_", "_ab_", "_cab_") for n in (1, 2, 3) for g in (w[i : i + n] for i in range(len(w) - n + 1)) if g != "_")
    key, rank = language_id.profile_of(text, 300)

    def shown(k):
        out = ""
        while k:
            out, k = chr(k & (1 << 21) - 1) + out, k >> 21
        return out

    assert {shown(k): r for k, r in zip(key.tolist(), rank.tolist())} == {g: sum(m > n for m in want.values()) for g, n in want.items()}
