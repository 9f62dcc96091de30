"""Attestations of a monitored run, signed with a key."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def summaries(connections: DataFrame, by: str) -> DataFrame:
    """One row a session: counts of classes and the hosts it met."""
    is_ = lambda c: F.count_if(F.col("class") == c)
    return connections.groupBy(by).agg(F.count("*").alias("connections"), is_("expected").alias("expected"), is_("unexpected").alias("unexpected"), is_("critical").alias("critical"), F.array_sort(F.collect_set("remote_host")).alias("hosts"))


def signed(documents: DataFrame, key: bytes) -> DataFrame:
    """``body`` (JSON of all columns) and ``signature`` (hex HMAC-SHA256 of it)."""

    @F.pandas_udf(StringType())
    def sign(body: pd.Series) -> pd.Series:
        return body.map(lambda b: hmac.new(key, b.encode(), hashlib.sha256).hexdigest())

    return documents.select(F.to_json(F.struct(*documents.columns)).alias("body")).withColumn("signature", sign("body"))


def verified(rows: DataFrame, key: bytes) -> DataFrame:
    """``valid``: whether a signature fits its body, compared in constant time."""

    @F.pandas_udf("boolean")
    def check(body: pd.Series, signature: pd.Series) -> pd.Series:
        good = [hmac.new(key, (b or "").encode(), hashlib.sha256).hexdigest() for b in body]
        return pd.Series([hmac.compare_digest(g, s or "") for g, s in zip(good, signature)])

    return rows.withColumn("valid", check("body", "signature"))
