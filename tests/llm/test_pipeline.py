"""The pipeline stage by stage."""

import collections
import random
import re

import corpus_pipeline
import numpy as np

from palisade.llm import suffix_dedup


def test_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(10_001, None, "en", "src0", None), (10_002, "123 !!", "en", "src0", 6)], docs.schema)).coalesce(2)
    columns, counts = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "mixing", "packing"]
    assert counts[1] == counts[0] - 2 and counts[2] < counts[1] and counts[3] == counts[2]
    mixed = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "mixing")).collect()}
    before = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "suffix_dedup")).collect()}
    assert all(before[i].text == r.text and r.n_chars == len(r.text) for i, r in mixed.items())
    tokens = sum(len(np.frombuffer(bytes(r.ids), np.uint32)) for r in docs.collect())
    last = docs.groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] for r in last) == tokens and sum(r[1] != 2048 for r in last) <= 1


def test_run_repeats_itself(spark):
    folder = "/root/testdata/sf0.001"
    rows = [sorted((r.doc_id, r.sequence_id, r.offset, bytes(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()) for _ in range(2)]
    assert rows[0] == rows[1]


def test_repeats_over_fifty_words_go(spark, tmp_path):
    rand = random.Random(8)
    words = lambda n: ["".join(rand.choice("abcdefghijklmnop") for _ in range(rand.randint(2, 7))) + rand.choice(["", "", "", ",", " é"]) for _ in range(n)]
    passages = [" ".join(w for w in " ".join(words(90)).split() if w != "é")[:2000].split()[:n] for n in (51, 54, 58, 61, 65, 50, 30)]
    rows = []
    for p in passages:
        text = " ".join(p)
        assert len(text.encode()) < 400
        rows += [f"{' '.join(words(30))} {text} {' '.join(words(20))}", f"{text} {' '.join(words(40))}", f"{' '.join(words(25))} {text}"]
    rows.append(" ".join(passages[0][:50] + words(60)))  # one word short
    once = " ".join(words(48))
    rows += [f"{once} {' '.join(words(9))} {once}", "é " * 20 + " ".join(words(5)), None, ""]
    spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/docs")
    got = {r.doc_id: r for r in corpus_pipeline.repeats(spark, spark.read.parquet(f"{tmp_path}/docs"), "").collect()}
    places = [[(m.start(), m.end()) for m in re.finditer(r"\w+", t or "")] for t in rows]
    seen = collections.defaultdict(set)
    for i, (t, w) in enumerate(zip(rows, places)):
        for k in range(len(w) - 50):
            seen[t[w[k][0] : w[k + 50][1]]].add(i)
    for i, (t, w) in enumerate(zip(rows, places)):
        gone = set()
        for k in range(len(w) - 50):
            if len(seen[t[w[k][0] : w[k + 50][1]]]) > 1:
                gone.update(range(w[k][0], w[k + 50][1]))
        assert got[i].text == (None if t is None else "".join(c for k, c in enumerate(t) if k not in gone)), i
        assert bool(gone) == (i < 15)


def test_words_of_pieces_equal_those_of_the_whole():
    rand = random.Random(9)
    data = " ".join("".join(rand.choice("abcdé\U0001f600ß") for _ in range(rand.randint(1, 9))) for _ in range(3000)).encode() + b"\xff x"
    covers = []
    for piece in (1 << 20, 700, 64):
        a, b, gram = suffix_dedup.word_anchors(data, 51, piece)
        found = set()
        for x, y in zip(a.tolist(), b.tolist()):
            _, byte, start, end = suffix_dedup.word_places(data[x:y])
            found.update(zip((byte[start[: len(start) - 50]] + x).tolist(), (byte[end[50:]] + x).tolist()))
        covers.append((found, set(gram.tolist())))
    assert covers[0] == covers[1] == covers[2] and len(covers[0][0]) > 2500


def test_texts_of_no_language_learned_go(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rand = random.Random(10)
    gibberish = lambda n: " ".join("".join(rand.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rand.randint(2, 9))) for _ in range(n))
    bad = [gibberish(n) for n in (20, 50, 100, 200, 400, 1000)] + ["Съешь же ещё этих мягких французских булок, да выпей чаю. " * n for n in (1, 5, 30)] + ["日本語の文章です。" * 20, "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία " * 4]
    clean = ["one two", "It was the best of times.", "Der Hund läuft durch den Wald.", "Le chat dort sur la table."]
    more = [(10_000_000 + i, t, None, "src0", len(t)) for i, t in enumerate(bad + clean)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{tmp_path}/docs")
    all_ = spark.read.parquet(f"{tmp_path}/docs")
    left = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, all_, "").select("doc_id").collect()}
    assert not left & {10_000_000 + i for i in range(len(bad))}
    assert left >= {10_000_000 + len(bad) + i for i in range(len(clean))}
    assert left >= {r.doc_id for r in docs.select("doc_id").collect()}
