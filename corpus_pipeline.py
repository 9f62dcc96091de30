"""A training corpus from ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns
of documents.  No SQL can express the stages, so they are tested against
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import language_id, mixing, near_dup, packing, suffix_dedup
from palisade.llm.common import cut, documents, drop, written

#: Bytes from which a string that occurs again is removed.
REPEAT_BYTES = 400
#: Words from which a passage that stands in another text goes, however few bytes it has.
REPEAT_WORDS = 51


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that can be told go."""
    return language_id.speaking(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dup.deduplicate(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long strings that occur more than once, and passages of over 50 words that texts share, go from the texts; n_chars follows."""
    out = suffix_dedup.without_repeats(docs, length=REPEAT_BYTES, words=REPEAT_WORDS)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights; those of short sources come twice."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, a row for each piece of a document."""
    return packing.pack(docs, ["doc_id", "lang", "source"], "text", packing.read_vocabulary())


_tables: dict[int, list[str]] = {}  # by stage, what it wrote on the way to its last result


def _tidy(k: int, stage):
    """``stage`` as the k-th: the result of the one before is written by now, so the tables behind that can go."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        there = set(written())
        drop(spark, [t for t in _tables.pop(k - 1, ()) if t in there])
        out = stage(spark, docs, sf_dir)
        _tables[k] = [t for t in written() if t not in there]
        return out

    return run_stage


STAGES = [
    ("language_id", _tidy(0, language)),
    ("near_dedup", _tidy(1, near_duplicates)),
    ("suffix_dedup", _tidy(2, repeats)),
    ("mixing", _tidy(3, mixture)),
    ("packing", _tidy(4, packed)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
