"""Queries over the operators of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from . import fingerprints, language_id, language_model, licenses, mixing, near_dup, nearest, packing, quality, suffix_dedup
from .common import documents
from .sql import ORACLE_SQL  # noqa: F401


def op1_mixing(spark, sf_dir):
    return mixing.chosen(documents(spark, sf_dir))


def op2_licenses(spark, sf_dir):
    return licenses.digests(documents(spark, sf_dir))


def op3_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op4_nearest(spark, sf_dir):
    return nearest.search_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_quality(spark, sf_dir):
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_near_dup(spark, sf_dir):
    return near_dup.class_of(documents(spark, sf_dir))


def op7_lm_scoring(spark, sf_dir):
    return language_model.score(documents(spark, sf_dir))


def op8_packing(spark, sf_dir):
    return packing.digests(documents(spark, sf_dir), packing.read_vocabulary())


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(documents(spark, sf_dir))


def op10_language_id(spark, sf_dir):
    return language_id.predict_all(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_licenses, op3_fingerprints, op4_nearest, op5_quality, op6_near_dup, op7_lm_scoring, op8_packing, op9_suffix_dedup, op10_language_id)}

