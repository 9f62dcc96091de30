"""Line rules, entropy, hooks and path files as predicates over one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T


def prepared(line: Column) -> Column:
    return T.folded(T.normalized(line))


def hit(rule: rules.Rule, line: Column, path: Column | None = None, exec_module: Column | None = None) -> Column:
    """Whether a line breaks a rule where the rule applies; cheap tests come first."""
    found = line.rlike(rule.pattern)
    for i, needle in enumerate(rule.needles):
        gate = F.lower(line).contains(needle) if i == 0 else gate | F.lower(line).contains(needle)  # noqa: F821
    if rule.needles:
        found = gate & found
    if path is not None:
        js = T.extension(path).isin(rules.JAVASCRIPT)
        if rule.javascript_only:
            found = js & found
        if rule.install_scripts_only:
            found = T.file_name(path).isin(rules.INSTALL_SCRIPTS) & found
        if rule.id == "P001":
            found = (~js | F.coalesce(exec_module, F.lit(True)) | line.contains("eval")) & found
    return found


def scan(files: DataFrame, bank: list[rules.Rule] | None = None, ignored: list[str] = ()) -> DataFrame:
    """Findings (rule_id, severity, confidence, message, file, line, package) of ``files`` (path, text).

    One pass: each line meets all rules in one projection.  Rules in ``ignored``
    aren't evaluated at all.  Null texts have no line.
    """
    bank = [r for r in (bank or rules.LINE_RULES) if r.id not in ignored]
    gated = files.withColumn("exec_module", F.col("text").rlike("|".join(rules.EXEC_MODULES)))
    rows = T.lines(gated.select("path", "exec_module", "text"), "path").withColumn("seen", prepared(F.col("line")))
    hits = F.array(*[F.when(hit(r, F.col("seen"), F.col("path"), F.col("exec_module")), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"), F.lit(r.description).alias("description"))) for r in bank])
    rows = rows.select("path", "line_no", "seen", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    message = F.concat(F.col("h.description"), F.lit(": "), T.truncated(F.col("seen")))
    return rows.select("h.rule_id", "h.severity", "h.confidence", message.alias("message"), F.col("path").alias("file"), F.col("line_no").alias("line"), T.package_of(F.col("path")).alias("package"))


def decode_and_run(files: DataFrame, found: DataFrame) -> DataFrame:
    """Files that decode in one place and execute in another, unless P002 has hit there."""
    decode = F.col("text").rlike(r"""(?i)atob\(|base64[._\-]?decode|['"]base64['"]""")
    run = F.col("text").rlike(r"\beval\(|\bexec\(|new Function\(|child_process")
    rows = files.where(decode & run).select(F.col("path").alias("file")).join(found.where("rule_id = 'P002'").select("file"), "file", "left_anti")
    return rows.select(F.lit("P002").alias("rule_id"), F.lit("high").alias("severity"), F.lit("medium").alias("confidence"), "file")


def entropy_hits(lines: DataFrame, key: str, longer: int = rules.LONG_TOKEN, bits: float = rules.ENTROPY_BITS, most: int = 5) -> DataFrame:
    """(key, line_no, token, n_bytes, bits): the first long token of high entropy of a line, at most ``most`` lines a file.

    The length test comes before the entropy, so only long tokens are measured.
    """
    words = lines.select(key, "line_no", F.posexplode(F.split("line", r"\s+")).alias("place", "word"))
    words = words.withColumn("token", F.regexp_replace("word", r"""^["'`]+|["'`]+$""", "")).withColumn("n_bytes", F.octet_length("token")).where(F.col("n_bytes") > longer)
    # a row number beside it keeps the filter above the entropy, which is so worked out once
    words = words.withColumns({"bits": T.entropy(F.col("token")), "__n": F.monotonically_increasing_id()}).where((F.col("bits") > bits) & (F.col("__n") >= 0))
    first = words.withColumn("k", F.row_number().over(Window.partitionBy(key, "line_no").orderBy("place"))).where("k = 1")
    return first.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("line_no"))).where(F.col("k") <= most).select(key, "line_no", "token", "n_bytes", "bits")


def entropy_findings(files: DataFrame, longer: int = rules.LONG_TOKEN, bits: float = rules.ENTROPY_BITS) -> DataFrame:
    """P007: long tokens of high entropy in files (path, text) other than JSON."""
    rows = T.lines(files.where(~F.lower(T.extension(F.col("path"))).eqNullSafe("json")).select("path", "text"), "path")
    hits = entropy_hits(rows, "path", longer, bits)
    message = F.format_string("token of %d bytes with %.2f bits a byte", F.col("n_bytes"), F.col("bits"))
    return hits.select(F.lit("P007").alias("rule_id"), F.lit("high").alias("severity"), F.lit("low").alias("confidence"), message.alias("message"), F.col("path").alias("file"), F.col("line_no").alias("line"), T.package_of(F.col("path")).alias("package"))


def path_file_hits(files: DataFrame) -> DataFrame:
    """``.pth`` files with code: the first keyword of the list that a file contains."""
    which = F.coalesce(*[F.when(F.col("text").contains(k), k) for k in rules.PTH_KEYWORDS])
    rows = files.where(F.col("path").endswith(".pth")).withColumn("keyword", which).where("keyword is not null")
    return rows.select(F.lit("P009").alias("rule_id"), F.lit("critical").alias("severity"), F.lit("high").alias("confidence"), F.concat(F.lit(".pth file with executable code: contains '"), "keyword", F.lit("'")).alias("message"), F.col("path").alias("file"))


def install_hooks(manifests: DataFrame) -> DataFrame:
    """Findings on scripts of package.json files (path, text): P012 at the root if suspicious, P016 in a dependency unless known to be safe."""
    scripts = manifests.select("path", F.from_json("text", "scripts map<string,string>").alias("m")).select("path", F.explode("m.scripts").alias("hook", "command"))
    starts = lambda safe: F.exists(F.array(*map(F.lit, safe)), lambda p: F.startswith(F.trim("command"), p))
    root = scripts.where((F.col("path") == "package.json") & F.col("hook").isin(rules.ROOT_HOOKS) & ~starts(rules.SAFE_HOOKS) & F.col("command").rlike(rules.SUSPICIOUS_HOOK)).withColumn("rule_id", F.lit("P012"))
    inside = scripts.where(F.col("path").rlike(r"^node_modules/(@[^/]+/)?[^/]+/package\.json$") & F.col("hook").isin(rules.DEPENDENCY_HOOKS) & ~starts(rules.SAFE_DEPENDENCY_HOOKS)).withColumn("rule_id", F.lit("P016"))
    return root.unionByName(inside).select("rule_id", F.lit("high").alias("severity"), F.lit("high").alias("confidence"), F.col("path").alias("file"), "hook", "command", T.package_of(F.col("path")).alias("package"))


def external(files: DataFrame, rule_defs: list[dict]) -> DataFrame:
    """Hits of user rules: the first pattern of a rule that a line matches, in files that the rule names."""
    cases = []
    for r in rule_defs:
        names = [T.file_name(F.col("path")).endswith(p[1:]) if p.startswith("*") else T.file_name(F.col("path")) == p for p in r["file_patterns"]]
        if not names or not r["content_patterns"]:
            continue
        where = names[0]
        for n in names[1:]:
            where = where | n
        which = F.coalesce(*[F.when(F.col("line").rlike(p), p) for p in r["content_patterns"]])
        cases.append(F.when(where & which.isNotNull(), F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"), which.alias("pattern"))))
    rows = T.lines(files.select("path", "text"), "path")
    hits = rows.select("path", "line_no", F.explode(F.filter(F.array(*cases), lambda h: h.isNotNull())).alias("h"))
    return hits.select("h.rule_id", "h.severity", "h.pattern", F.col("path").alias("file"), F.col("line_no").alias("line"))
