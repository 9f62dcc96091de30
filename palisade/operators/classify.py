"""Classifiers of findings: anything that maps batches of findings with context to verdicts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .triage import settled

SCHEMA = "finding_id long, classification string, confidence double, reasoning string, tokens_in int, tokens_out int"
Classifier = Callable[[pd.DataFrame], pd.DataFrame]


def by_rule(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in without a model: workflow, advisory and hygiene rules are right, all else is open."""
    sure = batch["rule_id"].str.match(r"^(W|V|MAL|H)")
    return pd.DataFrame({"finding_id": batch["finding_id"], "classification": sure.map({True: "TP", False: "NI"}), "confidence": sure.map({True: 1.0, False: 0.0}), "reasoning": "by rule", "tokens_in": 0, "tokens_out": 0})


def classified(findings: DataFrame, classifier: Classifier = by_rule, order: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Verdicts for ``findings`` (finding_id, rule_id, context); the ``most`` first ones if that is given.

    Verdicts of little confidence are open.
    """
    rows = findings if most is None else findings.orderBy(*(order or ["finding_id"])).limit(most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield classifier(batch)

    out = rows.mapInPandas(run, SCHEMA)
    return out.withColumn("classification", settled(F.col("classification"), F.col("confidence")))


def cost(verdicts: DataFrame, per_in: float, per_out: float, *by: str) -> DataFrame:
    """(by, n, tokens_in, tokens_out, cost): what reviews took, at prices for a token read and written."""
    return verdicts.groupBy(*by).agg(F.count("*").alias("n"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), (F.sum("tokens_in") * per_in + F.sum("tokens_out") * per_out).alias("cost"))
