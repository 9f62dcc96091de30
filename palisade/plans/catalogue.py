"""Queries over the tables of a data folder, each with the same result in ANSI SQL.

The tables stand in for what the operators take: documents and pages for source
files, orders and line items for lock files and findings, events for observations
of running processes, parts for package names, labels for verdicts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..operators import attestation, capabilities, classify, combine, dependencies, incremental, monitor, patterns, report, score, secrets, triage
from ..schema import ordinal, severity_name

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def doc_lines(spark, d, *keep):
    return T.lines(table(spark, d, "documents").select("doc_id", *keep, "text"), "doc_id")


# --- SQL shared by oracles -------------------------------------------------------

def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LINES = r"(select doc_id, source, generate_subscripts(l, 1) as line_no, unnest(l) as line from (select doc_id, source, string_split_regex(regexp_replace(text, '\n\z', ''), '\r?\n') as l from documents))"
SQL_ENTROPY = "list_sum(list_transform(map_values(list_aggregate(regexp_extract_all(hex({v}), '..'), 'histogram')), lambda c: -(c / strlen({v})) * log2(c / strlen({v}))))"
SQL_ASSIGN = sql_text(rules.ASSIGNMENT)
SQL_ASSIGNMENTS = f"(select doc_id, source, line_no, generate_subscripts(regexp_extract_all(line, {SQL_ASSIGN}, 1), 1) - 1 as place, unnest(regexp_extract_all(line, {SQL_ASSIGN}, 1)) as name, unnest(regexp_extract_all(line, {SQL_ASSIGN}, 2)) as value from {LINES} where regexp_matches(line, {SQL_ASSIGN}) and not contains(line, 'scan:allow'))"


# --- scans and rules ---------------------------------------------------------------

@query(f"select doc_id, line_no, line from {LINES}")
def scan_lines(spark, d):
    return doc_lines(spark, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"""select doc_id, line_no, place, name, value, length(value) as n_chars, round({SQL_ENTROPY.format(v='value')}, 6) as bits,
 case when {SQL_ENTROPY.format(v='value')} > 4.5 and length(value) > 30 then 'S021' else 'S022' end as rule_id,
 case when {SQL_ENTROPY.format(v='value')} > 4.5 and length(value) > 30 then 'high' else 'medium' end as severity from {SQL_ASSIGNMENTS}""")
def secret_assignments(spark, d):
    rows = secrets.assignments(doc_lines(spark, d), "doc_id")
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("place").cast("long").alias("place"), "name", "value", "n_chars", F.round("bits", 6).alias("bits"), "rule_id", "severity")


@query("select rule_id, (select count(*) from documents_pages where regexp_matches(line, pattern)) as n from (values " + ", ".join(f"({sql_text(k)}, {sql_text(v)})" for k, v in rules.SECRET_PATTERNS.items()) + ") r(rule_id, pattern)")
def secret_rule_counts(spark, d):
    pages = T.lines(table(spark, d, "pages").select("page_id", F.col("html").alias("text")), "page_id").select("line")
    return secrets.format_counts(doc_lines(spark, d).select("line").unionByName(pages))


SQL["secret_rule_counts"] = "with documents_pages as (select unnest(string_split_regex(regexp_replace(t, '\\n\\z', ''), '\\r?\\n')) as line from (select text as t from documents union all select html from pages)), r(rule_id, pattern) as (values " + ", ".join(f"({sql_text(k)}, {sql_text(v)})" for k, v in rules.SECRET_PATTERNS.items()) + ") " + " union all ".join(f"select {sql_text(k)} as rule_id, count_if(regexp_matches(line, {sql_text(v)})) as n from documents_pages" for k, v in rules.SECRET_PATTERNS.items())


@query(f"""with t as (select doc_id, line_no, unnest(w) as word, generate_subscripts(w, 1) as place from (select doc_id, line_no, string_split_regex(line, '\\s+') as w from {LINES})),
 u as (select doc_id, line_no, place, regexp_replace(word, {sql_text("^[\"'`]+|[\"'`]+$")}, '', 'g') as token from t),
 v as (select *, {SQL_ENTROPY.format(v='token')} as bits from u where strlen(token) > 12),
 w as (select *, row_number() over (partition by doc_id, line_no order by place) as k from v where bits > 3.2),
 x as (select *, row_number() over (partition by doc_id order by line_no) as n from w where k = 1)
 select doc_id, line_no, token, strlen(token) as n_bytes, round(bits, 6) as bits from x where n <= 5""")
def high_entropy_tokens(spark, d):
    rows = patterns.entropy_hits(doc_lines(spark, d), "doc_id", longer=12, bits=3.2)
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "token", F.col("n_bytes").cast("long").alias("n_bytes"), F.round("bits", 6).alias("bits"))


@query(f"select doc_id, translate(text, {sql_text(rules.CONFUSABLES)}, {sql_text(rules.PLAIN)}) as text from documents")
def confusable_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalized(F.col("text")).alias("text"))


@query("""select page_id, replace(replace(replace(replace(html, '" + "', ''), ''' + ''', ''), '" + "', ''), ''' + ''', '') as html from pages""")
def concat_fold(spark, d):
    return table(spark, d, "pages").select("page_id", T.folded(F.col("html")).alias("html"))


@query(r"select page_id, array_to_string(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1), chr(10)) as scripts from pages")
def script_blocks(spark, d):
    return table(spark, d, "pages").select("page_id", T.script_blocks(F.col("html")).alias("scripts"))


@query(r"""with h as (select page_id, unnest(regexp_extract_all(html, '(?:src|href)="([^"]*)"', 1)) as spec from pages)
 select page_id, spec, case when regexp_matches(spec, '^[./$]') then null when starts_with(spec, '@') then case when contains(spec, '/') then split_part(spec, '/', 1) || '/' || split_part(spec, '/', 2) end else nullif(split_part(spec, '/', 1), '') end as package from h""")
def module_packages(spark, d):
    specs = F.regexp_extract_all("html", F.lit(r'(?:src|href)="([^"]*)"'), F.lit(1))
    rows = table(spark, d, "pages").select("page_id", F.explode(specs).alias("spec"))
    return rows.select("page_id", "spec", T.module_package(F.col("spec")).alias("package"))


# --- lock files, advisories, names ------------------------------------------------

def locks(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("version")).agg(F.max("l_orderkey").alias("integrity"))
    return rows.where("name % 7 <> 0"), rows.where("name % 5 <> 0").withColumn("integrity", F.expr("if(name % 11 = 0, integrity + 1, integrity)"))


SQL_LOCKS = "with r as (select l_partkey as name, l_suppkey as version, max(l_orderkey) as integrity from lineitem group by all), s as (select * from r where name % 7 <> 0), c as (select name, version, case when name % 11 = 0 then integrity + 1 else integrity end as integrity from r where name % 5 <> 0) "


@query(SQL_LOCKS + "select * from c where not exists (select 1 from s where s.name = c.name and s.version = c.version and s.integrity = c.integrity)")
def lock_delta(spark, d):
    snapshot, current = locks(spark, d)
    return incremental.changed(current, snapshot)


@query(SQL_LOCKS + "select * from s where exists (select 1 from c where s.name = c.name and s.version = c.version)")
def lock_prune(spark, d):
    return incremental.pruned(*locks(spark, d))


@query(SQL_LOCKS + "select coalesce(s.name, c.name) as name, coalesce(s.version, c.version) as version, s.integrity as before, c.integrity as after, case when s.name is null then 'added' when c.name is null then 'removed' when s.integrity = c.integrity then 'same' else 'changed' end as state from s full join c on s.name = c.name and s.version = c.version")
def lock_merge(spark, d):
    return incremental.merged(*locks(spark, d))


@query("""with p as (select p_name as popular, min(p_partkey) as rank from part where p_size > 40 group by 1),
 n as (select p_name as name from part union select left(p_name, p_partkey % length(p_name)) || substr(p_name, p_partkey % length(p_name) + 2) from part), a as (select name from n where name not in (select popular from p))
 select name, arg_min(popular, rank) as "like" from a join p on abs(length(name) - length(popular)) < 2 and levenshtein(name, popular) = 1 group by name""")
def typosquat(spark, d):
    part = table(spark, d, "part")
    popular = part.where("p_size > 40").groupBy(F.col("p_name").alias("popular")).agg(F.min("p_partkey").alias("rank"))
    less = F.expr("concat(left(p_name, cast(p_partkey % length(p_name) as int)), substring(p_name, cast(p_partkey % length(p_name) + 2 as int)))")  # a letter left out
    return dependencies.lookalikes(part.select(F.col("p_name").alias("name")).unionByName(part.select(less.alias("name"))), popular)


SQL_SCORE = "least(10.0, 5.0 + case when contains(v, 'AV:N') then 1.5 else 0 end + case when contains(v, 'AC:L') then 0.5 else 0 end + case when contains(v, 'PR:N') then 0.5 else 0 end + case when contains(v, 'C:H') then 1.0 else 0 end + case when contains(v, 'I:H') then 0.5 else 0 end + case when contains(v, 'A:H') then 0.5 else 0 end)"
VECTORS = ["CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "CVSS:3.1/AV:L/AC:H/PR:L/UI:R/S:U/C:L/I:N/A:N", "7.2", "3.9", "9.8", "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N"]


def scored_parts(spark, d):
    vector = F.element_at(F.array(*map(F.lit, VECTORS)), (F.col("p_partkey") % len(VECTORS) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", vector.alias("v"))


SQL_VECTORS = "[" + ", ".join(map(sql_text, VECTORS)) + "]"


@query(f"with t as (select p_partkey, {SQL_VECTORS}[(p_partkey % 6 + 1)::int] as v from part), s as (select *, coalesce(try_cast(v as double), {SQL_SCORE}::double) as score from t) select p_partkey, score, case when score >= 9 then 'critical' when score >= 7 then 'high' when score >= 4 then 'medium' else 'low' end as severity from s")
def cvss_severity(spark, d):
    rows = scored_parts(spark, d).withColumn("score", T.cvss_score(F.col("v")))
    return rows.select("p_partkey", "score", T.cvss_severity(F.col("score")).alias("severity"))


@query(f"""with p as (select distinct l_partkey, l_suppkey from lineitem), a as (select p_partkey, case when p_partkey % 9 = 0 then 'MAL-' else 'GHSA-' end || p_partkey as id, {SQL_VECTORS}[(p_partkey % 6 + 1)::int] as v from part where p_partkey % 4 = 0)
 select l_partkey::varchar as name, l_suppkey::varchar as version, case when starts_with(id, 'MAL-') then 'MAL:' else 'V:' end || id as rule_id, case when starts_with(id, 'MAL-') then 'critical' else case when s >= 9 then 'critical' when s >= 7 then 'high' when s >= 4 then 'medium' else 'low' end end as severity from (select *, coalesce(try_cast(v as double), {SQL_SCORE}::double) as s from p join a on p_partkey = l_partkey)""")
def advisory_match(spark, d):
    packages = table(spark, d, "lineitem").select(F.lit("npm").alias("ecosystem"), F.col("l_partkey").cast("string").alias("name"), F.col("l_suppkey").cast("string").alias("version"))
    a = scored_parts(spark, d).where("p_partkey % 4 = 0")
    a = a.select(F.lit("npm").alias("ecosystem"), F.col("p_partkey").cast("string").alias("name"), F.concat(F.expr("if(p_partkey % 9 = 0, 'MAL-', 'GHSA-')"), F.col("p_partkey").cast("string")).alias("id"), F.array("v").alias("scores"), F.lit(None).cast("string").alias("database_severity"), F.array().cast("array<string>").alias("fixed"))
    versions = packages.distinct()
    out = dependencies.advised(versions, a.join(versions, ["ecosystem", "name"]).distinct())
    return out.select("name", "version", "rule_id", "severity")


@query("select o_orderkey, max(l_linenumber) filter (l_returnflag = 'N') as first_fix from orders left join (select l_orderkey, min(l_linenumber) as l_linenumber, 'N' as l_returnflag from lineitem where l_returnflag = 'N' group by 1) on l_orderkey = o_orderkey group by 1")
def first_fix(spark, d):
    events = F.array_sort(F.collect_list(F.struct("l_linenumber", F.when(F.col("l_returnflag") == "N", F.col("l_linenumber")).alias("fixed"))))
    made = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array(F.struct(F.array(F.struct(events.alias("events"))).alias("ranges"))).alias("affected"))
    rows = table(spark, d, "orders").select("o_orderkey").join(made, "o_orderkey", "left")
    return rows.select("o_orderkey", dependencies.first_fixed(F.col("affected")).alias("first_fix"))


@query("select p_partkey, (row_number() over (order by p_partkey) - 1) // 1000 as batch from part")
def osv_batches(spark, d):
    return dependencies.batches(table(spark, d, "part").select("p_partkey"), ["p_partkey"]).select("p_partkey", "batch")


# --- findings: combination, reachability, scores, reports --------------------------

def findings(spark, d):
    """Line items as findings: order as category, part as package, severity from a rule on keys."""
    rows = table(spark, d, "lineitem")
    rule = F.element_at(F.array(*map(F.lit, RULES)), (F.col("l_partkey") % len(RULES) + 1).cast("int"))
    severity = severity_name((F.col("l_suppkey") % 4).cast("int"))
    return rows.select(
        (F.col("l_orderkey") % 100).alias("category"), F.concat(F.lit("f"), (F.col("l_orderkey") % 997).cast("string")).alias("file"), F.concat(F.lit("pkg"), (F.col("l_partkey") % 211).cast("string")).alias("package"),
        rule.alias("rule_id"), severity.alias("severity"), F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("k3"), F.col("l_extendedprice").alias("k4"),
        F.when(F.col("l_returnflag") == "R", False).when(F.col("l_returnflag") == "A", True).alias("reachable"), F.when(F.col("l_linestatus") == "O", "low").when(F.col("l_quantity") > 25, "high").alias("confidence"),
    )


RULES = ["P001", "P003", "P004", "P006", "P007", "P008", "P013", "P014", "P015", "P017"]
SQL_RULES = "[" + ", ".join(map(sql_text, RULES)) + "]"
SQL_FINDINGS = f"""with f as (select l_orderkey % 100 as category, 'f' || l_orderkey % 997 as file, 'pkg' || l_partkey % 211 as package, {SQL_RULES}[(l_partkey % 10 + 1)::int] as rule_id, ['low', 'medium', 'high', 'critical'][(l_suppkey % 4 + 1)::int] as severity, l_suppkey % 4 as o, l_orderkey as k1, l_linenumber as k2, l_partkey as k3, l_extendedprice as k4,
 case when l_returnflag = 'R' then false when l_returnflag = 'A' then true end as reachable, case when l_linestatus = 'O' then 'low' when l_quantity > 25 then 'high' end as confidence from lineitem)"""
ORDER = ["k1", "k2", "k3", "k4"]
SQL_WEIGHTS = """ g as (select *, row_number() over (partition by category, severity order by k1, k2, k3, k4) - 1 as k from {f}),
 h as (select category, count(*) as n, bool_or(o >= 2) as grave, sum(case severity when 'critical' then 3.0::double when 'high' then 2.0::double when 'medium' then 1 / (1 + k * 0.1::double) else 0.3::double / (1 + k * 0.15::double) end * case when reachable = false then 0.1::double else 1.0::double end) as taken from g group by category)"""
SQL_CATEGORY = "select category, n, round(greatest(greatest(0.0, 25 - 25.0::double / (n + 1) * taken), case when grave then 0.0 else 7.5 end), 6) as score from h"


def categories(rows):
    return rows.select("category").distinct().withColumn("max_score", F.lit(25.0))


@query(SQL_FINDINGS + "," + SQL_WEIGHTS.format(f="f") + SQL_CATEGORY)
def category_scores(spark, d):
    rows = findings(spark, d)
    return score.category_scores(rows, categories(rows), ORDER).select("category", "n", F.round("score", 6).alias("score"))


@query(SQL_FINDINGS + "," + SQL_WEIGHTS.format(f="f") + ", c as (" + SQL_CATEGORY + "), t as (select round(sum(score) / sum(25.0::double) * 100) as total from c) select total, case when total >= 90 then 'A' when total >= 75 then 'B' when total >= 60 then 'C' when total >= 40 then 'D' else 'F' end as grade from t")
def project_grade(spark, d):
    rows = findings(spark, d)
    return score.project_grade(score.category_scores(rows, categories(rows), ORDER).withColumn("score", F.round("score", 6)))


@query(SQL_FINDINGS + ", v as (select * from f where confidence is null or confidence = 'high')," + SQL_WEIGHTS.format(f="v") + SQL_CATEGORY)
def persona_rescore(spark, d):
    rows = findings(spark, d).where(score.visible(F.col("confidence"), 2))
    return score.category_scores(rows, categories(rows), ORDER).select("category", "n", F.round("score", 6).alias("score"))


@query(SQL_FINDINGS + """, w as (select *, bool_or(rule_id = 'P013') over p as d, bool_or(rule_id in ('P014', 'P017', 'P007')) over p as b, bool_or(rule_id = 'P015') over p as a, bool_or(rule_id = 'P001') over p as e from f window p as (partition by file))
 select k1, k2, k3, rule_id, case when rule_id = 'P013' and (b or a) then 'critical' else severity end as severity, 'm' || case when rule_id = 'P013' and (b or a) then ' (graver: the same file hides what it does)' when rule_id = 'P015' and (d or e) then ' (graver: the same file loads or runs code)' else '' end as message from w""")
def signal_escalation(spark, d):
    return combine.escalated(findings(spark, d).withColumn("message", F.lit("m"))).select("k1", "k2", "k3", "rule_id", "severity", "message")


@query(SQL_FINDINGS + """, f2 as (select * replace ('pkg' || k1 % 1009 as package) from f), p as (select package, bool_or(rule_id = 'P004') as c, bool_or(rule_id in ('P003', 'P006', 'P010', 'P011')) as n, bool_or(rule_id in ('P001', 'P008')) as r, bool_or(rule_id in ('P014', 'P017', 'P007')) as o, bool_or(rule_id = 'P013') as y, coalesce(list(distinct file) filter (rule_id = 'P004'), []) as cf, coalesce(list(distinct file) filter (rule_id in ('P003', 'P006', 'P001')), []) as nf from f2 group by package)
 select package, 'COMBO-001' as rule_id, 'high' as confidence from p where c and (n or r) and len(nf) > 0 and not list_has_any(cf, nf) union all select package, 'COMBO-002', 'medium' from p where r and o union all select package, 'COMBO-003', 'medium' from p where y and o""")
def cross_file_combo(spark, d):
    rows = findings(spark, d).withColumn("package", F.concat(F.lit("pkg"), (F.col("k1") % 1009).cast("string")))
    return combine.combinations(rows).select("package", "rule_id", "confidence")


@query(SQL_FINDINGS + ", a as (select distinct 'pkg' || p_partkey % 211 as package, 'P004' as rule_id from part where p_size > 48) select k1, k2, k3, rule_id, package from f where not exists (select 1 from a where a.package = f.package and a.rule_id = f.rule_id)")
def allow_list(spark, d):
    allow = table(spark, d, "part").where("p_size > 48").select(F.concat(F.lit("pkg"), (F.col("p_partkey") % 211).cast("string")).alias("package"), F.lit("P004").alias("rule_id"))
    return combine.allowed(findings(spark, d), allow, ["package", "rule_id"]).select("k1", "k2", "k3", "rule_id", "package")


@query(SQL_FINDINGS + " select rule_id, count(*) as n from f where rule_id not in ('P007', 'P013') group by 1")
def ignore_rules(spark, d):
    ignored = spark.createDataFrame([("P007",), ("P013",)], "rule_id string")
    return combine.allowed(findings(spark, d), ignored, ["rule_id"]).groupBy("rule_id").agg(F.count("*").alias("n"))


def reach(spark, d):
    name = lambda c: F.concat(F.lit("pkg"), (F.col(c) % 211).cast("string")).alias("package")
    rows = findings(spark, d).drop("reachable").withColumn("package", F.when(F.col("k3") % 13 != 0, F.col("package"))).withColumn("rule_id", F.when(F.col("k2") == 1, "CAP:dropper").otherwise(F.col("rule_id")))
    return combine.reachable(rows, table(spark, d, "part").where("p_size < 3").select(name("p_partkey")), table(spark, d, "supplier").where("s_nationkey = 3").select(name("s_suppkey")))


SQL_REACH = SQL_FINDINGS + """, i as (select distinct 'pkg' || p_partkey % 211 as package from part where p_size < 3), v as (select distinct 'pkg' || s_suppkey % 211 as package from supplier where s_nationkey = 3),
 r as (select k1, k2, k3, case when k2 = 1 then 'CAP:dropper' else rule_id end as rule_id, severity, case when k3 % 13 <> 0 then package end as package from f), t as (select *, case when package is not null then package in (select package from i) and package not in (select package from v) end as reachable from r) """


@query(SQL_REACH + "select k1, k2, k3, package, reachable from t")
def reachability_tag(spark, d):
    return reach(spark, d).select("k1", "k2", "k3", "package", "reachable")


@query(SQL_REACH + "select k1, k2, k3, case when starts_with(rule_id, 'CAP') and reachable = false then case when severity = 'critical' then 'medium' else 'low' end else severity end as severity from t")
def build_downgrade(spark, d):
    return combine.build_downgraded(reach(spark, d)).select("k1", "k2", "k3", "severity")


FLAG_WORDS = {"network": "en", "fs_read": "th", "fs_write": "%%%", "shell_exec": "token", "env_access": "License", "install_hook": "@", "dynamic_load": "###", "obfuscated": "$$$"}


def flags(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").withColumn("pkg", F.col("doc_id") % 97).withColumns({k: t.contains(v) for k, v in FLAG_WORDS.items()} | {"credential_path": t.contains("reserved")})


SQL_CAPS = "with p as (select doc_id % 97 as pkg, " + ", ".join(f"bool_or(contains(text, {sql_text(v)})) as {k}" for k, v in FLAG_WORDS.items()) + ", bool_or(contains(text, 'th')) and bool_or(contains(text, 'reserved')) as credential_read from documents group by 1) "


@query(SQL_CAPS + "select pkg, " + ", ".join(rules.CAPABILITIES) + " from p")
def capability_rollup(spark, d):
    return capabilities.rolled_up(flags(spark, d), "pkg")


@query(SQL_CAPS + " union all ".join(f"select pkg, {sql_text(n)} as name, {sql_text(s)} as severity from p where {a} and {b}" for n, (a, b), s in rules.COMBINATIONS))
def capability_combos(spark, d):
    return capabilities.combined(capabilities.rolled_up(flags(spark, d), "pkg"), "pkg")


@query(SQL_FINDINGS + " select rule_id, coalesce(case when k3 % 3 = 0 then package end, case when k2 = 2 then 'workflow:' || k1 % 997 || '.yml' end, case when starts_with(rule_id, 'W') then 'workflows' end, case when k2 = 3 then file end, 'project') as label, count(*) as n from f group by all")
def display_labels(spark, d):
    rows = findings(spark, d)
    package = F.when(F.col("k3") % 3 == 0, F.col("package"))
    file = F.when(F.col("k2") == 2, F.concat(F.lit(".github/workflows/"), (F.col("k1") % 997).cast("string"), F.lit(".yml"))).when(F.col("k2") == 3, F.col("file"))
    return rows.withColumn("label", T.display_label(F.col("rule_id"), package, file)).groupBy("rule_id", "label").agg(F.count("*").alias("n"))


@query(SQL_FINDINGS + " select category, count(*) as n, count_if(severity = 'critical') as critical, count_if(severity = 'high') as high, count(distinct package) as packages, count_if(reachable) as reachable from f group by category")
def exec_summary(spark, d):
    return report.executive(findings(spark, d))


@query(SQL_FINDINGS + " select package, count(*) as n, ['low', 'medium', 'high', 'critical'][(max(o) + 1)::int] as severity, array_to_string(list_sort(list(distinct rule_id)), ',') as labels, array_to_string(list(file || ':' || k2 order by k1, k2, k3, k4)[:3], ',') as places, arg_min(rule_id, (k1, k2, k3, k4)) as suggestion from f group by package")
def package_rollup(spark, d):
    rows = findings(spark, d).withColumn("place", F.concat_ws(":", "file", F.col("k2").cast("string"))).withColumn("suggestion", F.col("rule_id"))
    out = report.by_package(rows, ORDER)
    return out.select("package", "n", "severity", F.array_join("labels", ",").alias("labels"), F.array_join("first_places", ",").alias("places"), "suggestion")


@query(SQL_FINDINGS + " select package, count(*) as n, ['low', 'medium', 'high', 'critical'][(max(o) + 1)::int] as severity from f group by package order by max(o) desc, n desc, package limit 8")
def deps_top8(spark, d):
    return report.top_packages(findings(spark, d))


@query(SQL_FINDINGS + " select case when reachable = true then 'runtime' else 'build' end as bucket, package, count(*) as n from f group by all")
def runtime_build_split(spark, d):
    return report.by_reach(findings(spark, d))


@query(SQL_FINDINGS + " select rule_id, arg_min(case when severity in ('critical', 'high') then 'error' when severity = 'medium' then 'warning' else 'note' end, (k1, k2, k3, k4)) as level, arg_min(file, (k1, k2, k3, k4)) as text from f group by rule_id")
def sarif_levels(spark, d):
    return report.sarif_rules(findings(spark, d).withColumn("message", F.col("file")), ORDER)


@query("select coalesce(layer, 'OVERALL') as layer, detected, total, round(100.0::double * detected / total, 4) as percent from (select case when quality = 1 then 'good' else 'bad' end as layer, count_if(toxic = 1) as detected, count(*) as total from labels group by rollup(layer))")
def detection_matrix(spark, d):
    rows = table(spark, d, "labels").select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("layer"), (F.col("toxic") == 1).alias("detected"))
    return report.detection_matrix(rows).withColumn("percent", F.round("percent", 4))


# --- triage --------------------------------------------------------------------------

@query(f"select doc_id, line_no, sha256(array_to_string(list(line_no || ': ' || line) over (partition by doc_id order by line_no rows between 30 preceding and 30 following), chr(10))) as context from {LINES}")
def context_window(spark, d):
    rows = triage.context(doc_lines(spark, d), "doc_id")
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.sha2("context", 256).alias("context"))


@query(f"select doc_id, line_no, left(sha256(array_to_string(list(line) over (partition by doc_id order by line_no rows between 10 preceding and 10 following), chr(10))), 12) as context_key from {LINES}")
def context_hash_key(spark, d):
    rows = triage.context_keys(doc_lines(spark, d), "doc_id")
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "context_key")


@query(f"select doc_id, line_no, line from (select *, min(case when length(line) > 20 then 1 else 0 end) over (partition by doc_id order by line_no) as h from {LINES} where line_no <= 30) where h = 1")
def import_header(spark, d):
    rows = triage.header(doc_lines(spark, d), "doc_id", F.length("line") > 20)
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query("""select e.event_id, v.created from events e left join (select user_id, max(ts) as created from events where event_type = 'signup' group by 1) v on v.user_id = e.user_id and v.created >= timestamp '2024-01-30' - interval 3 day where event_type = 'error'""")
def triage_ttl_cache(spark, d):
    e = table(spark, d, "events")
    verdicts = e.where("event_type = 'signup'").groupBy(F.col("user_id").alias("context_key")).agg(F.max("ts").alias("created_at"))
    rows = e.where("event_type = 'error'").select("event_id", F.col("user_id").alias("context_key"))
    return triage.cached(rows, verdicts, F.lit("2024-01-30").cast("date"), 3).select("event_id", F.col("created_at").alias("created"))


SQL_VERDICTS = "(select source, case when l.doc_id is null then 'NI' when toxic = 1 then 'TP' when quality = 1 then 'FP' else 'NI' end as c from documents d left join labels l on l.doc_id = d.doc_id)"


def verdicts(spark, d):
    c = F.when(F.col("toxic") == 1, "TP").when(F.col("quality") == 1, "FP").otherwise("NI")
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left").withColumn("classification", c)


@query(f"select source, count_if(c = 'TP') as tp, count_if(c = 'FP') as fp, count_if(c = 'NI') as ni, count(*) as total from {SQL_VERDICTS} group by source")
def triage_tally(spark, d):
    return triage.tally(verdicts(spark, d), ["source"])


@query("select role, count(*) as n, sum(length(text)) as tokens, round(sum(length(text)) * 0.000003::double, 9) as cost from conversations group by role")
def triage_cost(spark, d):
    rows = table(spark, d, "conversations").select("role", F.lit(0).alias("tokens_out"), F.length("text").alias("tokens_in"))
    return classify.cost(rows, 0.000003, 0.0, "role").select("role", "n", F.col("tokens_in").alias("tokens"), F.round("cost", 9).alias("cost"))


@query("select conv_id, turn from (select *, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as s from conversations) where s < 500")
def budgeted_turns(spark, d):
    rows = table(spark, d, "conversations").withColumn("cost", F.length("text"))
    return triage.within_budget(rows, "cost", 500, ["turn"], "conv_id").select("conv_id", "turn")


# --- runtime -------------------------------------------------------------------------

HOSTS = ["registry.npmjs.org", "api.github.com", "169.254.169.254", "evil.example.com", "cdn.github.com", "notgithub.com"]
PROCESSES = ["npm", "pip", "/usr/bin/cargo"]


def connections(spark, d):
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (c % len(xs) + 1).cast("int"))
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", k.alias("port"), pick(HOSTS, k).alias("host"), pick(PROCESSES, F.col("user_id")).alias("process"))


SQL_CONN = f"""(select event_id, user_id, ts, event_type, k as port, [{', '.join(map(sql_text, HOSTS))}][k % 6 + 1] as host, [{', '.join(map(sql_text, PROCESSES))}][(user_id % 3 + 1)::int] as process from (select *, (props->>'$.k')::int as k from events))"""
SQL_CLASS = "case when host = '169.254.169.254' then 'critical' when host in ('api.github.com', 'cdn.github.com') or (process = 'npm' and host = 'registry.npmjs.org') then 'expected' else 'unexpected' end"


@query(f"select event_id, {SQL_CLASS} as class from {SQL_CONN}")
def conn_classify(spark, d):
    rows = connections(spark, d)
    return rows.select("event_id", monitor.connection_class(F.col("host"), F.lit(None).cast("string"), F.col("process")).alias("class"))


@query(f"select distinct host, port, user_id from {SQL_CONN}")
def conn_dedup(spark, d):
    return monitor.seen_connections(connections(spark, d), "host", "port", "user_id")


@query(f"select host, case when host = '169.254.169.254' then 'critical' when host in ('github.com', 'api.github.com', 'api.osv.dev') then 'matched' else 'violation' end as class from (select distinct host from {SQL_CONN})")
def baseline_diff(spark, d):
    return connections(spark, d).select("host").distinct().select("host", monitor.baseline_class(F.col("host"), F.col("host").isin(rules.BASELINE_HOSTS)).alias("class"))


@query(f"select user_id, cast(ts as date) as day, canary, unexpected, critical, case when canary > 0 and unexpected + critical > 0 then 'block' when canary > 0 then 'warn' when critical > 0 then 'block' when unexpected > 0 then 'info' else 'pass' end as verdict from (select user_id, cast(ts as date) as ts, count_if(event_type = 'error') as canary, count_if(event_type <> 'error' and {SQL_CLASS} = 'unexpected') as unexpected, count_if(event_type <> 'error' and {SQL_CLASS} = 'critical') as critical from {SQL_CONN} group by 1, 2)")
def kill_chain(spark, d):
    rows = connections(spark, d).withColumn("day", F.to_date("ts"))
    net = rows.where("event_type <> 'error'").withColumn("class", monitor.connection_class(F.col("host"), F.lit(None).cast("string"), F.col("process")))
    return monitor.kill_chain(rows.where("event_type = 'error'"), net, ["user_id", "day"]).select("user_id", "day", "canary", "unexpected", "critical", "verdict")


@query("select page_id, url from pages where exists (select 1 from (select distinct regexp_extract(url, '^(https?://[^/]+/[^/]+)', 1) as p from pages where page_id % 10 = 0) q where url = p or starts_with(url, p || '/'))")
def sensitive_reads(spark, d):
    pages = table(spark, d, "pages")
    paths = pages.where("page_id % 10 = 0").select(F.regexp_extract("url", r"^(https?://[^/]+/[^/]+)", 1).alias("prefix"))
    return monitor.sensitive_reads(pages.select("page_id", "url", F.col("url").alias("path")), paths).select("page_id", "url")


@query("select page_id, url from pages where page_id % 2 = 0 and not exists (select 1 from (select distinct regexp_extract(url, '^(https?://[^/]+/[^/]+)', 1) as p from pages where page_id % 10 = 0) q where url = p or starts_with(url, p || '/'))")
def write_boundary(spark, d):
    pages = table(spark, d, "pages")
    paths = pages.where("page_id % 10 = 0").select(F.regexp_extract("url", r"^(https?://[^/]+/[^/]+)", 1).alias("prefix"))
    opened = pages.select("page_id", "url", F.col("url").alias("path"), (F.col("page_id") % 2 == 0).alias("writable"))
    return monitor.outside_writes(opened, paths).select("page_id", "url")


@query("with recursive t(pid, depth) as (select 1::bigint, 0 union all select c.c_custkey, t.depth + 1 from customer c join t on c.c_custkey // 3 = t.pid where c.c_custkey > t.pid) select pid, depth from t")
def process_tree(spark, d):
    processes = table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), F.floor(F.col("c_custkey") / 3).alias("parent"))
    return monitor.process_tree(processes, 1).select(F.col("pid").cast("long").alias("pid"), "depth")


@query("select doc_id::varchar as path, case when doc_id % 7 = 0 then 'deleted' when doc_id % 5 = 0 then 'tampered' end as state from documents where doc_id % 7 = 0 or doc_id % 5 = 0")
def canary_tamper(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), "text")
    before = docs.select("path", F.sha2("text", 256).alias("hash"))
    after = docs.where("doc_id % 7 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return monitor.tampered(before, after)


@query(f"select user_id, count(*) as n, count(distinct host) as hosts, array_to_string(list_sort(list(distinct host)), ',') as names, count_if({SQL_CLASS} = 'unexpected') as unexpected from {SQL_CONN} group by user_id")
def attestation_summary(spark, d):
    rows = connections(spark, d).withColumn("class", monitor.connection_class(F.col("host"), F.lit(None).cast("string"), F.col("process")))
    out = attestation.summaries(rows.withColumnRenamed("host", "remote_host"), "user_id")
    return out.select("user_id", F.col("connections").alias("n"), F.size("hosts").cast("long").alias("hosts"), F.array_join("hosts", ",").alias("names"), "unexpected")


# --- the flagship: from source text to graded sources ----------------------------------

SQL_SOURCES = f"""with f as (select source as category, case when {SQL_ENTROPY.format(v='value')} > 4.5 and length(value) > 30 then 'high' else 'medium' end as severity, case when {SQL_ENTROPY.format(v='value')} > 4.5 and length(value) > 30 then 2 else 1 end as o, doc_id as k1, line_no as k2, place as k3, 0 as k4, null::boolean as reachable from {SQL_ASSIGNMENTS}),"""


@query(SQL_SOURCES + SQL_WEIGHTS.format(f="f") + ", a as (select distinct source from documents), c as (select source, coalesce(n, 0) as n, case when n is null then 25.0::double else round(greatest(greatest(0.0, 25 - 25.0::double / (n + 1) * taken), case when grave then 0.0 else 7.5 end), 6) end as score from a left join h on category = source) select source, n, score, case when score * 4 >= 90 then 'A' when score * 4 >= 75 then 'B' when score * 4 >= 60 then 'C' when score * 4 >= 40 then 'D' else 'F' end as grade from c")
def source_grades(spark, d):
    docs = table(spark, d, "documents")
    found = secrets.assignments(doc_lines(spark, d, "source").select("doc_id", "source", "line_no", "line").withColumn("key", F.struct("doc_id", "source")), "key")
    found = found.select(F.col("key.source").alias("category"), "severity", F.col("key.doc_id").alias("k1"), F.col("line_no").alias("k2"), F.col("place").alias("k3"), F.lit(0).alias("k4"), F.lit(None).cast("boolean").alias("reachable"))
    cats = docs.select(F.col("source").alias("category")).distinct().withColumn("max_score", F.lit(25.0))
    out = score.category_scores(found, cats, ORDER).withColumn("score", F.round("score", 6))
    return out.select(F.col("category").alias("source"), "n", "score", score.grade(F.col("score") * 4).alias("grade"))


from . import detection  # noqa: E402,F401  adds its queries
