"""Schemas (DDL) of the tables that operators exchange, and the order of severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ["low", "medium", "high", "critical"]
CONFIDENCES = ["low", "medium", "high"]

FINDING = (
    "rule_id string, severity string, confidence string, message string, file string, line int,"
    " suggestion string, package string, reachable boolean, auto_fixable boolean"
)
PACKAGE = "name string, version string, ecosystem string"
LOCK_PACKAGE = "file string, ecosystem string, name string, version string, integrity string, dir_path string"
CONNECTION = (
    "session_id string, ts timestamp, remote_host string, resolved_host string, remote_port int, pid int, process_name string, cmdline string"
)
ADVISORY = "id string, ecosystem string, name string, version string, summary string, scores array<string>, database_severity string, fixed array<string>"


def ordinal(severity: Column | str) -> Column:
    """Place of a severity or confidence name, from 0 (low); null for an unknown name."""
    col = F.col(severity) if isinstance(severity, str) else severity
    return (F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(col)) - 1).cast("int")


def severity_name(place: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITIES)), place)
