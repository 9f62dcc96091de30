"""Reports, what scans remember, and checks before an install."""

import datetime
import json

from pyspark.sql import functions as F

from palisade.operators import monitor, preflight, report
from palisade.sources import stores

FINDINGS = "rule_id string, severity string, message string, file string, line int, package string"
ROWS = [("P001", "low", "one two three four five six seven eight", "a.js", 3, "p"), ("W001", "critical", "m", "w.yml", None, None), ("X", "high", "n", None, None, None)]


def test_text_report_and_sarif(spark):
    rows = spark.createDataFrame(ROWS, FINDINGS)
    lines = [r.line for r in report.text_report(rows, ["rule_id"], width=40).collect()]
    assert lines[0] == "CRITICAL  W001        w.yml  m" and lines[1].startswith("HIGH      X           project")
    assert lines[2].startswith("LOW       P001        a.js:3  one two") and all(len(x) <= 40 for x in lines[2].split("\n")) and len(lines[2].split("\n")) > 1
    assert report.text_report(rows, ["rule_id"], most=1).count() == 1
    doc = json.loads(report.sarif_document(report.sarif_rules(rows, ["rule_id"]), report.sarif_results(rows)))
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["P001", "W001", "X"]
    assert {r["ruleId"]: r["level"] for r in run["results"]} == {"P001": "note", "W001": "error", "X": "error"}
    assert "locations" not in next(r for r in run["results"] if r["ruleId"] == "X")
    assert [r.rule_id for r in report.explained(rows, report.glossary(spark)).collect()] == ["W001", "X", "P001"]


def test_stores(spark, tmp_path):
    path = f"{tmp_path}/scanned"
    assert stores.scanned(spark, path).isEmpty()
    stores.keep_scanned(spark.createDataFrame([("a", "1", "x"), ("a", "1", "x"), ("b", "2", None)], stores.SCANNED), path)
    assert {tuple(r) for r in stores.scanned(spark, path).collect()} == {("a", "1", "x"), ("b", "2", None)}
    path, day = f"{tmp_path}/verdicts", datetime.date
    assert stores.verdicts(spark, path, F.lit("2024-01-30").cast("date")).isEmpty()
    for rows in ([("k", "FP", 0.9, "", day(2024, 1, 1)), (None, "TP", 1.0, "", day(2024, 1, 1))], [("k", "TP", 0.8, "", day(2024, 1, 29)), ("old", "TP", 0.8, "", day(2023, 1, 29))]):
        stores.keep_verdicts(spark.createDataFrame(rows, stores.VERDICT), path)
    got = stores.verdicts(spark, path, F.lit("2024-01-30").cast("date")).collect()
    assert [(r.context_key, r.classification) for r in got] == [("k", "TP")]


def test_before_an_install(spark):
    m = spark.createDataFrame([("package.json", '{"scripts": {"postinstall": "tsc", "prepare": "x", "test": "y"}}'), ("node_modules/a/package.json", '{"scripts": {"install": "z"}}'), ("package.json", None)], "path string, text string")
    assert [(r.rule_id, r.hook) for r in preflight.install_scripts(m).collect()] == [("PF001", "postinstall")]
    p = spark.createDataFrame([("npm", "@s/n", "1"), ("RubyGems", "g", "1")], "ecosystem string, name string, version string")
    assert [r.key for r in preflight.release_keys(p).collect()] == ["systems/npm/packages/%40s%2Fn/versions/1"]
    opened = spark.createDataFrame([("/trap/x",), ("/trap",), ("/trapped/y",), (None,)], "path string")
    assert [r.path for r in monitor.outside(opened, "/trap").collect()] == ["/trapped/y"]
