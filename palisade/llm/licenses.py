"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds all template texts.  A file's words stream through it; at each
word it tells the longest run of words ending there that some template contains
(matching statistics).  Runs that cannot be made longer and have enough words are
chained, template by template, in the order of both texts, and a chain that covers
enough of a template is a find of it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices, steady

# Phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Texts by which licences are named or granted.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "Licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "public-domain": "This is free and unencumbered software released into the public domain",
}
LEAST_RUN, LEAST_COVER, GAP = 3, 0.8, 6

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a whole text: A-Z lower-cased, parted by ASCII characters other than letters and digits."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


class Automaton:
    """Suffix automaton of several word sequences.

    ``step[s]`` leads on by a word, ``link[s]`` to the longest suffix of another
    set of ends, ``size[s]`` is the longest run of state s, and ``ends[s]`` its
    places (template, position after) in all templates.
    """

    def __init__(self, texts: list[list[bytes]]):
        self.step, self.link, self.size, self.ends = [{}], [-1], [0], [set()]
        for i, text in enumerate(texts):
            at = 0
            for k, word in enumerate(text):
                at = self._extend(at, word)
                self.ends[at].add((i, k + 1))
        for s in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            self.ends[self.link[s]] |= self.ends[s]

    def _new(self, size: int, step: dict, link: int) -> int:
        self.step.append(dict(step))
        self.link.append(link)
        self.size.append(size)
        self.ends.append(set())
        return len(self.size) - 1

    def _fork(self, p: int, word: bytes, q: int) -> int:
        copy = self._new(self.size[p] + 1, self.step[q], self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.step[last]:
            q = self.step[last][word]
            return q if self.size[q] == self.size[last] + 1 else self._fork(last, word, q)
        new, p = self._new(self.size[last] + 1, {}, 0), last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._fork(p, word, q)
        return new

    def runs(self, stream: list[bytes], places: list[int], least: int):
        """(end in the stream, words, state) of matches of ``least`` words or more that no word before or after extends.

        ``places`` are those of words that the automaton knows at all, in order.
        """
        step, link, size = self.step, self.link, self.size
        state = n = 0
        before = -1
        for at in places:
            if at != before + 1 and n:
                if n >= least:
                    yield before + 1, n, state
                state = n = 0
            word = stream[at]
            if word not in step[state] and n >= least:
                yield at, n, state
            while state and word not in step[state]:
                state = link[state]
                n = size[state]
            if word in step[state]:
                state = step[state][word]
                n += 1
            before = at
        if n >= least:
            yield before + 1, n, state


def covered(runs, automaton: Automaton, gap: int = GAP) -> list[tuple[int, int, int, int, list]]:
    """Chains (template, start, end, template words covered, their ranges) of runs that go on in both texts with at most ``gap`` words between.

    A run goes on with the latest chain of its template that it can; chains that end
    too far back for any later run are closed, so few are looked at.
    """
    open_: dict[int, list[list]] = {}
    done: list[list] = []
    for end, n, state in runs:
        for i, stop in sorted(automaton.ends[state]):
            start = end - n
            own = open_.get(i, [])
            done += [c for c in own if c[2] + gap < start]
            own = open_[i] = [c for c in own if c[2] + gap >= start]
            for c in reversed(own):
                skip = max(0, c[2] - start, c[4] - (stop - n))  # what the two runs share
                if skip < n and 0 <= start + skip - c[2] <= gap and stop - n + skip >= c[4]:
                    c[2], c[3], c[4] = end, c[3] + n - skip, stop
                    c[5].append((stop - n + skip, stop))
                    break
            else:
                own.append([i, start, end, n, stop, [(stop - n, stop)]])
    return [(i, a, b, n, ranges) for i, a, b, n, _, ranges in sorted(done + [c for own in open_.values() for c in own], key=lambda c: c[:3])]


def numbers_covered(template: list[bytes], ranges: list[tuple[int, int]]) -> bool:
    """Whether every number among a template's words is covered: another version is another licence."""
    return all(any(a <= k < b for a, b in ranges) for k, w in enumerate(template) if w.isdigit())


def _scan(templates: list[tuple[str, str]], phrases: list[tuple[str, str]], keep: int, schema_names: list[str]):
    def run(batches):
        texts = [words(t) for _, t in templates]
        automaton, sizes = Automaton(texts), [len(t) for t in texts]
        starts: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for phrase, label in phrases:
            p = words(phrase)
            starts.setdefault(p[0], []).append((p, label))
        known = {w for t in texts for w in t}
        ask = known | set(starts)
        for batch in slices(batches):
            out = ([], [], [], [])
            for text in batch.column(keep).to_pylist():
                w = words(text)
                hits = [i for i, x in enumerate(w) if x in ask] if not ask.isdisjoint(w) else []
                base = [{"start": i, "end": i + len(p), "label": label} for i in hits for p, label in starts.get(w[i], ()) if w[i : i + len(p)] == p]
                chains = covered(automaton.runs(w, [i for i in hits if w[i] in known], LEAST_RUN), automaton) if hits else []
                found = [{"start": a, "end": b, "label": templates[i][0], "cover": min(1.0, n / sizes[i])} for i, a, b, n, ranges in chains if numbers_covered(texts[i], ranges)]
                out[0].append(len(w))
                out[1].append(base)
                out[2].append([x for x in found if x["cover"] >= LEAST_COVER])
                out[3].append(max((x["cover"] for x in found), default=0.0))
            base_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
            span_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("cover", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(keep)), pa.array(out[0], pa.int64()), pa.array(out[1], base_kind), pa.array(out[2], span_kind), pa.array(out[3], pa.float64())], schema_names)

    return run


def scan(docs: DataFrame, keep: list[str], text: str = "text", templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``keep``, n_words, phrases, spans and cover of every row; one scan of whole texts, no shuffle.

    phrases: places (start, end, label; words from 0, ends exclusive) where a
    phrase's words stand in a row; overlapping places all count.  spans: chains of
    matches that cover LEAST_COVER of a template or more and all its numbers, with
    their share; cover is the largest share of any chain with all numbers, 0 without one.  Runs have LEAST_RUN words or more
    and chains at most GAP words between runs.  A null or empty text has no word and
    no find; repeated rows are scanned each.
    """
    steady(docs.sparkSession)
    own = fresh(docs, "__text")
    rows = docs.select(*keep, F.col(text).alias(own))
    out = rows.drop(own).schema.add("n_words", "long")
    rest = "phrases array<struct<start:long,end:long,label:string>>, spans array<struct<start:long,end:long,label:string,cover:double>>, cover double"
    from pyspark.sql.types import StructType

    for field in StructType.fromDDL(rest):
        out = out.add(field)
    return rows.mapInArrow(_scan(list(templates.items()), list(phrases.items()), len(rows.columns) - 1, out.names), out)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans) of every row; score is 1 with a phrase, else the cover."""
    out = scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"])
    base, every = F.array_distinct(F.col("phrases.label")), F.array_union(F.col("phrases.label"), F.col("spans.label"))
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    return out.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min("phrases.start").alias("first_word"), F.array_max("phrases.start").alias("last_word"),
        joined(base).alias("base_labels"), joined(every).alias("labels"), F.when(F.size("phrases") > 0, 1.0).otherwise(F.col("cover")).alias("score"), F.size("spans").cast("long").alias("n_spans"),
    )
