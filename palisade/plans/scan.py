"""A whole scan: files and facts in, findings, scores and a grade out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ast_rows, capabilities, combine, dependencies, hygiene, patterns, score, secrets, workflows
from ..sources import wasm
from ..sources.config import Config

COLUMNS = ["category", "rule_id", "severity", "confidence", "message", "file", "line", "package"]


@dataclass
class Report:
    findings: DataFrame
    scores: DataFrame
    grade: DataFrame

    def has_issues(self) -> bool:
        return not self.findings.isEmpty()

    def exit_code(self) -> int:
        """0 without findings, else 1."""
        return int(self.has_issues())

    def close(self) -> None:
        """Give up the findings that are kept in memory."""
        self.findings.unpersist()


def exit_status(make: Callable[[], Report]) -> int:
    """0 without findings, 1 with some, 2 if the scan fails."""
    try:
        return make().exit_code()
    except Exception:
        return 2


def _shaped(rows: DataFrame, category: str) -> DataFrame:
    have = set(rows.columns)
    return rows.select(*[F.lit(category).alias("category")] + [(F.col(c) if c in have else F.lit(None)).cast("int" if c == "line" else "string").alias(c) for c in COLUMNS[1:]])


def _numbered(rows: DataFrame) -> DataFrame:
    """``line_no`` as the finding's line."""
    return rows.drop("line").withColumnRenamed("line_no", "line") if "line_no" in rows.columns else rows


def _dependency_code(files: DataFrame, config: Config, user_rules: list[dict], binaries: DataFrame | None) -> DataFrame:
    """Findings in the code of dependencies: lines, structure, whole files, hooks, modules, and what they amount to together."""
    lines = patterns.scan(files, ignored=config.ignored_rules)
    tree = ast_rows.findings(files).withColumn("package", T.package_of(F.col("file"))).withColumn("message", F.lit("structure of the code"))
    # where the structure is known, it decides on P001 and P013
    weak = lines.where(F.col("rule_id").isin("P001", "P013") & T.language(F.col("file")).isNotNull())
    lines = lines.join(weak.select("file", "line", "rule_id"), ["file", "line", "rule_id"], "left_anti")
    lines = lines.join(tree.select("file", "line", "rule_id"), ["file", "line", "rule_id"], "left_anti")
    manifests = files.where(T.file_name(F.col("path")) == "package.json")
    found = _shaped(lines, "patterns").unionByName(_shaped(tree, "patterns"))
    whole = [patterns.decode_and_run(files, lines), patterns.entropy_findings(files), patterns.path_file_hits(files), patterns.install_hooks(manifests).withColumn("message", F.concat_ws(": ", "hook", "command"))]
    if user_rules:
        whole.append(patterns.external(files, user_rules).withColumn("message", F.col("pattern")))
    if binaries is not None:
        whole.append(wasm.findings(binaries).withColumn("message", F.array_join("imports", ", ")))
    for rows in whole:
        rows = rows if "package" in rows.columns else rows.withColumn("package", T.package_of(F.col("file")))
        found = found.unionByName(_shaped(rows, "patterns"))
    return found.where(~F.col("rule_id").isin(config.ignored_rules or [""]))


def _secrets(files: DataFrame) -> DataFrame:
    rows = T.lines(files.select("path", "text"), "path")
    named = secrets.assignments(rows, "path").withColumn("message", F.concat(F.col("name"), F.lit(" = "), T.masked(F.col("value"))))
    bare = secrets.bare_values(rows, "path").withColumn("message", T.masked(F.col("value")))
    out = None
    for found in (secrets.formats(rows, "path").withColumn("message", F.col("masked")), named, bare):
        found = _shaped(_numbered(found.withColumnRenamed("path", "file")), "secrets").distinct()
        out = found if out is None else out.unionByName(found)
    return out


def _dependencies(locks: DataFrame, advisories: DataFrame | None, popular: DataFrame | None) -> DataFrame:
    missing = dependencies.without_integrity(locks).withColumn("message", F.format_string("%d of %d entries have no checksum", "missing", "total"))
    found = _shaped(missing.withColumn("rule_id", F.lit("T007")).withColumn("severity", F.lit("medium")), "deps")
    if advisories is not None:
        rows = dependencies.advised(locks.select("ecosystem", "name", "version"), advisories)
        rows = rows.withColumn("package", F.concat_ws("@", "name", "version")).withColumn("message", F.coalesce(F.concat(F.lit("fixed in "), "fixed_in"), F.lit("no version is known to be fixed")))
        found = found.unionByName(_shaped(rows, "deps"))
    if popular is not None:
        rows = dependencies.lookalikes(locks.select("name"), popular)
        rows = rows.select(F.lit("T001").alias("rule_id"), F.lit("high").alias("severity"), F.concat(F.lit("one letter away from "), "like").alias("message"), F.col("name").alias("package"))
        found = found.unionByName(_shaped(rows, "deps"))
    return found


def _hygiene(listing: DataFrame, ignore_lines: DataFrame | None, ignored: DataFrame | None, branches: DataFrame | None) -> DataFrame:
    found = _shaped(hygiene.missing_policy(listing), "hygiene")
    if ignore_lines is not None:
        found = found.unionByName(_shaped(hygiene.missing_ignores(listing, ignore_lines).withColumn("message", F.col("pattern")), "hygiene"))
    if ignored is not None:
        rows = hygiene.ignored_locks(listing, ignored).withColumn("severity", F.lit("medium")).withColumnRenamed("path", "file")
        found = found.unionByName(_shaped(rows.where("rule_id = 'H003'"), "hygiene")).unionByName(_shaped(rows.where("rule_id = 'D001'"), "deps"))
    if branches is not None:
        found = found.unionByName(_shaped(hygiene.unprotected(branches), "hygiene"))
    return found


def scan(
    files: DataFrame, config: Config | None = None, flows: DataFrame | None = None, own_sources: DataFrame | None = None, dev: DataFrame | None = None, *,
    locks: DataFrame | None = None, advisories: DataFrame | None = None, popular: DataFrame | None = None, listing: DataFrame | None = None, ignore_lines: DataFrame | None = None,
    ignored: DataFrame | None = None, branches: DataFrame | None = None, binaries: DataFrame | None = None, user_rules: list[dict] = (), persona: int | None = None,
) -> Report:
    """Findings of dependency files (path, text) and of whatever else is given, with scores.

    ``flows`` are workflow lines (file, line_no, line); ``own_sources`` (path, text)
    are the application's, which are searched for credentials, and the packages they
    import, other than those in ``dev``, are reachable; ``locks`` are lock entries,
    held against ``advisories`` and ``popular`` names; ``listing`` (project, path)
    with ``ignore_lines``, ``ignored`` lock files and ``branches`` are facts of the
    repository; ``binaries`` (path, content) are compiled modules; ``user_rules`` come
    from ``config.rule``.  A category without its input doesn't run and has no part in
    the total.  Scores follow reachability.  ``persona`` hides findings of less
    confidence than 0 (low) to 2 (high); scores cover all.
    """
    config = config or Config()
    spark = files.sparkSession
    found = combine.escalated(_dependency_code(files, config, list(user_rules), binaries))
    found = found.unionByName(_shaped(combine.combinations(found), "patterns"))
    flags = capabilities.file_flags(files).withColumn("package", T.package_of(F.col("path"))).where("package is not null")
    caps = capabilities.combined(capabilities.rolled_up(flags, "package"), "package").withColumn("rule_id", F.concat(F.lit("CAP:"), "name"))
    found = found.unionByName(_shaped(caps, "capabilities"))
    ran = ["patterns", "capabilities"]
    if flows is not None:
        ran.append("workflows")
        for rows in (workflows.unpinned(flows), workflows.permissions(flows), workflows.checkout_of_requests(flows), workflows.injections(flows), workflows.git_flags(flows)):
            found = found.unionByName(_shaped(_numbered(rows), "workflows"))
    if own_sources is not None:
        ran.append("secrets")
        found = found.unionByName(_secrets(own_sources))
    if locks is not None:
        ran.append("deps")
        found = found.unionByName(_dependencies(locks, advisories, popular))
    if listing is not None:
        ran.append("hygiene")
        found = found.unionByName(_hygiene(listing, ignore_lines, ignored, branches))
    found = combine.allowed(found, config.allow_list(spark), ["package", "rule_id"])
    if own_sources is not None:
        found = combine.build_downgraded(combine.reachable(found, ast_rows.imported_packages(own_sources), dev))
    else:
        found = found.withColumn("reachable", F.lit(None).cast("boolean"))
    found = found.persist()
    scores = score.category_scores(found, config.categories(spark).where(F.col("category").isin(ran)), ["category", "file", "line", "rule_id", "package", "message"])
    shown = found if persona is None else found.where(score.visible(F.col("confidence"), persona))
    return Report(shown, scores, score.project_grade(scores))
