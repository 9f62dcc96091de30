"""Language ID by rank-order profiles of n-grams.

A language's profile is the list of its most frequent n-grams (one to three
letters of words padded with ``_``); a document's profile is built in the same
way, and its distance to a language is the sum of how far each of its n-grams is
out of place there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, cut, fresh, remainder, slices, steady

PROFILE = 300
MAX_LANGUAGES = 1000
GAP, BITS = 95, 21
#: Clean texts of every length score above SLACK of the QUANTILE of training scores, random letters and unknown scripts below.
QUANTILE, SLACK, GRID, LEAST_TEXTS = 0.05, 0.7, 1000, 50
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str) -> np.ndarray:
    """N-grams of one to three characters of a text's words, each word between two gaps, as numbers in order.

    Code points stand side by side in a number, the last one lowest.  The gap alone
    is no n-gram, and none spans a gap.
    """
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[code]
    code = np.where(letter, code, GAP).astype(np.int64)
    two = (code[:-1] << BITS) + code[1:]
    three = (two[:-1] << BITS) + code[2:]
    every = np.concatenate((code[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]))
    every.sort()
    return every


def counted(every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of an array in order, and how often each occurs."""
    if not len(every):
        return every, every
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[first], np.diff(np.append(first, len(every)))


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several ``counted`` results together."""
    if len(parts) == 1:
        return parts[0]
    key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return (key[first], np.add.reduceat(n, first)) if len(key) else (key, n)


def profile_of(text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of a whole text that fewer than ``size`` others outnumber, and that number of others: their rank."""
    key, n = summed([counted(grams(b)) for b in blocks(text)])
    if len(key) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        key, n = key[n >= least], n[n >= least]
    return key, len(n) - np.searchsorted(np.sort(n), n, side="right")


def _train(batches):
    sums: dict[str, list] = {}
    held = 0

    def flush():
        for lang, parts in sums.items():
            key, n = summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    for batch in slices(batches):
        texts: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            parts = sums.setdefault(lang, [])
            parts += [counted(grams(b)) for b in blocks(" ".join(own))]
            sums[lang] = [summed(parts)] if len(parts) > 1 else parts
            held += sum(len(p[0]) for p in sums[lang])
        if held > 20_000_000:
            held = sum(len(p[0]) for parts in sums.values() for p in parts)
            if held > 2_000_000:
                yield from flush()
                sums, held = {}, 0
    yield from flush()


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) of every language: its ``size`` most frequent n-grams, ties to the smaller number.

    Counts cover all whole texts given; each task sends one sum per language and n-gram.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_train, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select("lang", "gram", "rank")


def _predictor(langs: list[str], ranks: dict[int, dict[str, int]], size: int, text_at: int, keep: list[int], names: list[str]):
    """Adds the prediction to the columns ``keep`` of each batch."""

    keys = np.array(sorted(ranks), np.int64)
    table = np.full((len(langs), len(keys) + 1), -1, np.int32)
    for i, g in enumerate(keys.tolist()):
        for k, v in ranks[g].items():
            table[k, i] = v

    def predict(batches):
        for batch in slices(batches):
            best, score = [], []
            for text in batch.column(text_at).to_pylist():
                key, mine = profile_of(text, size) if text else ((), ())
                if not len(key) or not langs:
                    best.append("und")
                    score.append(0.0)
                    continue
                at = np.searchsorted(keys, key)
                at[keys[np.minimum(at, len(keys) - 1)] != key] = len(keys)
                theirs = table[:, at]
                far = np.where(theirs < 0, size, np.abs(theirs - mine)).sum(axis=1)
                k = int(np.argmin(far))
                best.append(langs[k])
                score.append(max(0.0, 1.0 - float(far[k]) / (size * len(key))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(best, pa.string()), pa.array(score, pa.float64())], names)

    return predict


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> tuple[list[str], dict[int, dict[int, int]]]:
    """Profiles on the driver: at most MAX_LANGUAGES * ``size`` rows; more languages are an error."""
    table = cut(profiles(docs, text, lang, size))
    langs = sorted(r[0] for r in table.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    place, ranks = {x: i for i, x in enumerate(langs)}, {}
    for lang_, gram, rank in table.collect():
        ranks.setdefault(gram, {})[place[lang_]] = rank
    return langs, ranks


def identify(docs: DataFrame, model, text: str = "text", keep: list[str] | None = None, size: int = PROFILE, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the predicted language and a score from 0 to 1, from the whole text alone.

    score is one less the out-of-place distance over its largest value; equal
    distances go to the smaller name.  Of a document's n-grams those count whose
    rank is below ``size``, where n-grams of one frequency share a rank.  A null
    text, a text without a letter, and an empty model give ``und`` and 0.
    Repeated rows are judged alike.  One scan, no shuffle.
    """
    langs, ranks = model
    steady(docs.sparkSession)
    own = fresh(docs, "__text")
    taken = docs.select(*keep, F.col(text).alias(own)) if keep else docs.withColumn(own, F.col(text))
    out = taken.drop(own).schema
    for name, kind in zip(into, ("string", "double")):
        out = out.add(name, kind)
    n = len(taken.columns) - 1
    return taken.mapInArrow(_predictor(langs, ranks, size, n, list(range(n)), out.names), out)


def predict_all(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", modulus: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; learns from rows whose crc32(doc_id) mod ``modulus`` isn't ``held``.

    A null doc_id counts as the empty text in that split; rows without text or
    language teach nothing.
    """
    table = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = learn(table.where(remainder("doc_id", modulus) != held))
    out = identify(table, model, keep=["doc_id"])
    return out.select("doc_id", (remainder("doc_id", modulus) == held).alias("held_out"), "lang_pred", "score")


def least_scores(own: DataFrame) -> tuple[dict[str, float], float]:
    """By language the least score of a text that counts as one of it, and the least score of other languages.

    ``own`` are training texts (lang, lang_pred, score); those count whose prediction
    is the language they are said to have.  The least score is SLACK of their
    QUANTILE; a language of fewer than LEAST_TEXTS takes that of all together, which
    is 0 where these are fewer too.
    """
    cells = own.where("lang = lang_pred").groupBy("lang", F.floor(F.col("score") * GRID).cast("long").alias("cell")).agg(F.count("*").alias("n"))
    counts: dict[str, list] = {}
    for r in cells.collect():  # at most MAX_LANGUAGES * (GRID + 1) rows
        counts.setdefault(r["lang"], []).append((r["cell"], r["n"]))

    def least(rows) -> float | None:
        cell, n = np.array(sorted(rows), np.int64).reshape(-1, 2).T
        if n.sum() < LEAST_TEXTS:
            return None
        return SLACK * float(cell[np.searchsorted(np.cumsum(n), n.sum() * QUANTILE)]) / GRID

    each = {x: least(rows) for x, rows in counts.items()}
    return {x: v for x, v in each.items() if v is not None}, least([r for rows in counts.values() for r in rows]) or 0.0


def speaking(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", modulus: int = 3, held: int = 1) -> DataFrame:
    """The rows of ``docs`` whose language can be told, with their columns as they are.

    ``und`` rows go, and those whose score is below the least of the predicted
    language, which are of no language learned.
    """
    taught = docs.where(remainder(doc_id, modulus) != held)
    model = learn(taught, text, lang)
    own = taught.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    each, other = least_scores(identify(own, model, keep=["lang"]))
    pred, score = fresh(docs, "__lang_pred"), fresh(docs, "__score")
    pairs = [F.lit(x) for pair in each.items() for x in pair]
    least = F.coalesce(F.create_map(*pairs)[F.col(pred)], F.lit(other)) if pairs else F.lit(other)
    return identify(docs, model, text, into=(pred, score)).where((F.col(pred) != "und") & (F.col(score) >= least)).drop(pred, score)
