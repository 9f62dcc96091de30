"""Queries of sources and detectors whose inputs are rendered from the tables: lock files, manifests, workflows, code, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..operators import ast_rows, hygiene, monitor, patterns, preflight, report, secrets, triage, workflows
from ..sources import files, lockfiles, observations
from ..streaming import monitor as stream
from .catalogue import SQL_ENTROPY, SQL_FINDINGS, doc_lines, findings, query, sql_text, table


def pick(values, place):
    """The value at a place (from 0) of a list of literals."""
    return F.element_at(F.array(*map(F.lit, values)), (place + 1).cast("int"))


def sql_pick(values, place):
    return f"[{', '.join(map(sql_text, values))}][({place} + 1)::int]"


def sql_lines(of: str, key: str) -> str:
    """(key, line_no, line) of (key, text), as ``T.lines`` cuts them."""
    return rf"(select {key}, generate_subscripts(l, 1) as line_no, unnest(l) as line from (select {key}, string_split_regex(regexp_replace(text, '\n\z', ''), '\r?\n') as l from {of}))"


def sql_seen(line: str) -> str:
    seen = f"translate({line}, {sql_text(rules.CONFUSABLES)}, {sql_text(rules.PLAIN)})"
    for _ in range(2):
        seen = f"""replace(replace({seen}, '" + "', ''), ''' + ''', '')"""
    return seen


def unbroken(text):
    """Base64 of a text, on one line."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.base64(text.cast("binary")), r"\s+", "")


# --- line rules: a line for each rule is written below every page ------------------------------------

RULE_LINES = [
    "run(eval(data))", "x = atob(y); spawn(x)", "get('http://10.1.2.3/a')", "open('~/.aws/config')", "readFileSync(a + '.png')", "curl ( 'http://h/x' )", "f = new Function(body)",
    "q('169.254.169.254')", "s = JSON.stringify(process.env)", "m = require(name)", "c = String.fromCharCode(a ^ b)", "unlinkSync(__filename)", "while (!![]) { }", "process.binding('fs')", "vm.createScript(t)", "return 1;",
]
INSTALL = 5  # the line that counts in install scripts only
SQL_JS = f"page_id % {len(RULE_LINES)} <> {INSTALL}"
SQL_RULED = " union all ".join(
    f"select page_id, line_no, {sql_text(r.id)} as rule_id from s where regexp_matches(seen, {sql_text(r.pattern)})"
    + (" and js" if r.javascript_only else " and not js" if r.install_scripts_only else "")
    + (" and (not js or contains(seen, 'eval') or regexp_matches(text, 'child_process|shelljs|execa|cross-spawn'))" if r.id == "P001" else "")
    for r in rules.LINE_RULES
)


@query(f"""with t as (select page_id, html || chr(10) || {sql_pick(RULE_LINES, f'page_id % {len(RULE_LINES)}')} as text from pages),
 s as (select l.page_id, l.line_no, {sql_seen('l.line')} as seen, t.text, {SQL_JS.replace('page_id', 'l.page_id')} as js from {sql_lines('t', 'page_id')} l join t on t.page_id = l.page_id) {SQL_RULED}""")
def rule_bank(spark, d):
    n = F.col("page_id") % len(RULE_LINES)
    path = F.concat(F.lit("node_modules/page/"), F.col("page_id").cast("string"), F.when(n == INSTALL, "/postinstall.sh").otherwise("/x.js"))
    found = patterns.scan(table(spark, d, "pages").select(path.alias("path"), F.concat("html", F.lit("\n"), pick(RULE_LINES, n)).alias("text")))
    return found.select(F.regexp_extract("file", r"page/(\d+)/", 1).cast("long").alias("page_id"), F.col("line").cast("long").alias("line_no"), "rule_id")


# --- tokens, credentials ------------------------------------------------------------------------------

@query(f"""with t as (select doc_id, to_base64(encode(text)) as token from documents where doc_id % 10 <> 0)
 select doc_id, 'P007' as rule_id, 1 as line_no from (select *, {SQL_ENTROPY.format(v='token')} as bits from t where strlen(token) > 300) where bits > 4.5""")
def long_tokens(spark, d):
    path = F.concat(F.lit("node_modules/p/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 10 == 0, ".json").otherwise(".js"))
    rows = table(spark, d, "documents").select(path.alias("path"), F.concat(F.lit('k = "'), unbroken("text"), F.lit('"')).alias("text"))
    return patterns.entropy_findings(rows).select(F.regexp_extract("file", r"(\d+)\.js$", 1).cast("long").alias("doc_id"), "rule_id", F.col("line").alias("line_no"))


# Made up, one for each format.
SAMPLES = {
    "S001": "AKIA" + "A1B2" * 4, "S002": "aws_secret_access_key = " + "aB3/" * 10, "S003": "ghp_" + "a1B2" * 9, "S004": "github_pat_" + "a1B2" * 6, "S005": "ghs_" + "a1B2" * 9,
    "S006": "-----BEGIN EC PRIVATE KEY" + "-----", "S007": "eyJ" + "hbGc" + ".eyJ" + "zdWI" + ".c2ln", "S008": "hooks.slack.com/services/T" + "0A1/B" + "0C2/x", "S009": "xoxb-" + "1234567890" + "-aB",
    "S010": "api_key = '" + "a1B2" * 5 + "'", "S011": "client_secret: '" + "a1B2" * 5 + "'", "S012": "postgres://u:p" + "@h/d", "S013": "mysql://u:p" + "@h/d", "S014": "mongodb+srv://u:p" + "@h/d",
    "S015": "sk_test_" + "a1B2" * 5, "S016": "SG." + "a1B2" * 6 + "." + "a1B2" * 6, "S017": "SK" + "0a1b" * 8, "S018": "AIza" + "a1B2c" * 7, "S019": "heroku = 01234567-89ab-cdef-0123-456789abcdef", "S020": "npm_" + "a1B2" * 9,
}
SQL_SAMPLED = f"(select doc_id, text || chr(10) || {sql_pick(list(SAMPLES.values()), f'doc_id % {len(SAMPLES)}')} || case when doc_id % 7 = 0 then ' // scan:allow' else '' end as text from documents)"


def sampled(spark, d):
    n = F.col("doc_id") % len(SAMPLES)
    text = F.concat("text", F.lit("\n"), pick(list(SAMPLES.values()), n), F.when(F.col("doc_id") % 7 == 0, " // scan:allow").otherwise(""))
    return T.lines(table(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id")


@query("with l as (select * from " + sql_lines(SQL_SAMPLED, "doc_id") + " where not contains(line, 'scan:allow')), f as (" + " union all ".join(
    f"select doc_id, line_no, {sql_text(i)} as rule_id, {sql_text('medium' if i in ('S010', 'S011') else 'high')} as severity, regexp_extract(line, {sql_text('(' + p + ')')}, 1) as v from l where regexp_matches(line, {sql_text(p)})" for i, p in rules.SECRET_PATTERNS.items()
) + ") select doc_id, line_no, rule_id, severity, left(v, 4) || '...' || right(v, 4) as masked from f")
def secret_formats(spark, d):
    return secrets.formats(sampled(spark, d), "doc_id").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "rule_id", "severity", "masked")


@query("select doc_id, count(*) as n from " + sql_lines(SQL_SAMPLED, "doc_id") + " where not contains(line, 'scan:allow') group by doc_id")
def suppress_inline(spark, d):
    return secrets.silenced(sampled(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"))


BARE = r"""['"]([^'"\s]{31,})['"]"""


@query(f"""with l as (select doc_id, 'k' || case when doc_id % 3 = 0 then ' = secret: ' else ' = ' end || '"' || to_base64(encode(left(text, 60))) || '"' as line from documents),
 v as (select doc_id, regexp_extract(line, {sql_text(BARE)}, 1) as value from l where regexp_matches(line, {sql_text(BARE)}) and not regexp_matches(line, {sql_text(rules.ASSIGNMENT)}))
 select doc_id, 'S023' as rule_id, value from v where {SQL_ENTROPY.format(v='value')} > 4.5""")
def bare_secrets(spark, d):
    line = F.concat(F.lit("k"), F.when(F.col("doc_id") % 3 == 0, " = secret: ").otherwise(" = "), F.lit('"'), unbroken(F.left("text", F.lit(60))), F.lit('"'))
    return secrets.bare_values(table(spark, d, "documents").select("doc_id", F.lit(1).alias("line_no"), line.alias("line")), "doc_id").select("doc_id", "rule_id", "value")


SQL_ADDRESSES = r"(select 'document' as kind, doc_id as id, text from documents union all select 'page', page_id, html from pages)"


@query(f"""with l as (select kind, id, line_no, unnest(regexp_extract_all(line, {sql_text(secrets.IP)})) as ip, generate_subscripts(regexp_extract_all(line, {sql_text(secrets.IP)}), 1) - 1 as place from {sql_lines(SQL_ADDRESSES, 'kind, id')})
 select kind, id, line_no, place, ip, ip = '169.254.169.254' as imds from l""")
def raw_ip_lines(spark, d):
    docs = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return secrets.addresses(T.lines(docs.unionByName(pages), "id"), "kind", "id").select("kind", "id", F.col("line_no").cast("long").alias("line_no"), F.col("place").cast("long").alias("place"), "ip", "imds")


# --- workflows: one file for each document ----------------------------------------------------------------

STARTS = ["on: pull_request_target\n", "on: push\n", "on: [push, pull_request]\n"]
GRANTS = ["permissions: write-all\n", "permissions:\n  contents: read\n", "", "  permissions: write-all\n"]
PUSHES = ["          git push --force origin main\n", "          git push --force-with-lease\n", "          git push\n"]
COMMITS = ["      - run: git commit --no-verify\n", "      - run: git commit -m x\n"]
FLOW = ["name: x\n", None, None, "jobs:\n  a:\n    steps:\n      - uses: actions/checkout@", None, "\n      # - uses: actions/checkout@v1\n      - uses: ./local\n      - uses: docker://alpine@3\n      - run: |\n          echo ${{ ", None, " }}\n\n", None, "      - name: ${{ ", None, " }}\n", None]


def sql_flow() -> str:
    made = iter([sql_pick(STARTS, "doc_id % 3"), sql_pick(GRANTS, "doc_id % 4"), "case when doc_id % 2 = 0 then 'v4' else left(sha256(doc_id::varchar), 40) end", sql_pick(rules.INJECTABLE, "doc_id % 13"), sql_pick(PUSHES, "doc_id % 3"), sql_pick(rules.INJECTABLE, "(doc_id + 1) % 13"), sql_pick(COMMITS, "doc_id % 2")])
    return "(select doc_id::varchar as file, " + " || ".join(sql_text(p) if p is not None else next(made) for p in FLOW) + " as text from documents)"


def flow(spark, d):
    i = F.col("doc_id")
    made = iter([pick(STARTS, i % 3), pick(GRANTS, i % 4), F.when(i % 2 == 0, "v4").otherwise(F.left(F.sha2(i.cast("string"), 256), F.lit(40))), pick(rules.INJECTABLE, i % 13), pick(PUSHES, i % 3), pick(rules.INJECTABLE, (i + 1) % 13), pick(COMMITS, i % 2)])
    text = F.concat(*[F.lit(p) if p is not None else next(made) for p in FLOW])
    return T.lines(table(spark, d, "documents").select(i.cast("string").alias("file"), text.alias("text")), "file")


SQL_FLOW = "with w as (select * from " + sql_lines(sql_flow(), "file") + "), "
SQL_RUN = r"""r as (select *, length(line) - length(ltrim(line)) as i, max(case when regexp_matches(line, '^\s*-?\s*run:') then line_no end) over (partition by file order by line_no) as run from w),
 s as (select *, min(case when line_no <> run and trim(line) <> '' then i end) over (partition by file, run order by line_no) as m, first(i) over (partition by file, run order by line_no) as b from r),
 b as (select file, line_no, line from s where run is not null and (line_no = run or m is null or m > b)) """


@query(SQL_FLOW + r"""a as (select file, line_no, regexp_extract(line, 'uses:\s*["'']?([^"''\s#]+)', 1) as action from w) select file, line_no, action from a where contains(action, '@') and not starts_with(action, './') and not starts_with(action, 'docker://') and not regexp_matches(action, '@[0-9a-f]{40}$')""")
def workflow_uses_pin(spark, d):
    return workflows.unpinned(flow(spark, d)).select("file", F.col("line_no").cast("long").alias("line_no"), "action")


@query(SQL_FLOW + SQL_RUN + "select file, line_no, line from b")
def run_block_lines(spark, d):
    return workflows.run_lines(flow(spark, d)).select("file", F.col("line_no").cast("long").alias("line_no"), "line")


SQL_OUTSIDERS = "[" + ", ".join(map(sql_text, rules.INJECTABLE)) + "]"


@query(SQL_FLOW + SQL_RUN + f""", e as (select unnest({SQL_OUTSIDERS}) as x)
 select file, 'W002' as rule_id, 0 as line_no, case when bool_or(starts_with(line, 'permissions:')) then 'write-all' else 'missing' end as detail from w group by file having not bool_or(starts_with(line, 'permissions:')) or contains(arg_min(line, line_no) filter (starts_with(line, 'permissions:')), 'write-all')
 union all select file, 'W003', line_no, '' from w where file in (select file from w where contains(line, 'pull_request_target')) and contains(line, 'actions/checkout') and not starts_with(trim(line), '#')
 union all select file, 'W004', line_no, x from b join e on contains(line, '${{{{ ' || x) or contains(line, '${{{{' || x)
 union all select file, 'W005', line_no, case when regexp_matches(line, 'git\\s.*--no-verify') then '--no-verify' else '--force' end from w where regexp_matches(line, 'git\\s.*--no-verify') or regexp_matches(line, 'git\\s+push\\s.*--force(\\s|$)')""")
def workflow_rules(spark, d):
    f = flow(spark, d)
    rows = workflows.permissions(f).select("file", "rule_id", F.lit(0).alias("line_no"), F.col("reason").alias("detail"))
    for found, detail in ((workflows.checkout_of_requests(f), F.lit("")), (workflows.injections(f), F.col("expression")), (workflows.git_flags(f), F.col("flag"))):
        rows = rows.unionByName(found.select("file", "rule_id", "line_no", detail.alias("detail")))
    return rows.withColumn("line_no", F.col("line_no").cast("long"))


# --- lock files, rendered for each supplier and read back ---------------------------------------------------

SQL_LOCKED = "(select distinct l_suppkey as s, l_partkey as p from lineitem)"
#: file name, ecosystem, head, entry ({p} is the part, {v} the version), joint, tail, and in SQL: name, integrity, folder
LOCKS = {
    "cargo": ("Cargo.lock", "crates.io", "version = 3\n", '[[package]]\nname = "pkg{p}"\nversion = "1.{v}"\nchecksum = "c{p}"\n', "\n", "", "'pkg' || p", "'c' || p", None),
    "poetry": ("poetry.lock", "PyPI", "", '[[package]]\nname = "pkg{p}"\nversion = "1.{v}"\n', "\n", "", "'pkg' || p", None, None),
    "npm": ("package-lock.json", "npm", '{"lockfileVersion": 3, "packages": {"": {"version": "0"}, ', '"a/node_modules/@s/pkg{p}": {"version": "1.{v}", "integrity": "sha-{p}"}', ", ", "}}", "'@s/pkg' || p", "'sha-' || p", "'a/node_modules/@s/pkg' || p"),
    "npm_v1": ("package-lock.json", "npm", '{"lockfileVersion": 1, "dependencies": {"top": {"dependencies": {', '"pkg{p}": {"version": "1.{v}", "integrity": "sha-{p}"}', ", ", "}}}}", "'pkg' || p", "'sha-' || p", "'node_modules/top/node_modules/pkg' || p"),
    "yarn": ("yarn.lock", "npm", "# yarn lockfile v1\n\n", '"@s/pkg{p}@^1", "@s/pkg{p}@^2":\n  version "1.{v}"\n  resolved "u"\n  integrity sha-{p}\n  dependencies:\n    x "1"\n', "\n", "", "'@s/pkg' || p", "'sha-' || p", None),
    "pnpm": ("pnpm-lock.yaml", "npm", "lockfileVersion: 6\n\nimporters:\n  x@1:\n\npackages:\n\n", "  /@s/pkg{p}@1.{v}:\n    resolution: {{}}\n", "\n", "", "'@s/pkg' || p", None, None),
    "gems": ("Gemfile.lock", "RubyGems", "GEM\n  remote: u\n  specs:\n", "    pkg{p} (1.{v})\n      inner (>= 1)\n", "", "\nDEPENDENCIES\n    other (1)\n", "'pkg' || p", None, None),
    "go": ("go.sum", "Go", "", "ex.org/pkg{p} v1.{v} h1:a=\nex.org/pkg{p} v1.{v}/go.mod h1:b=\n", "", "", "'ex.org/pkg' || p", None, None),
    "requirements": ("requirements.txt", "PyPI", "# pins\n", "pkg{p}[x]==1.{v} ; python_version > '3'\nfree{p}>=1\n", "", "", "'pkg' || p", None, None),
    "pipfile": ("Pipfile.lock", "PyPI", '{"_meta": {}, "develop": {', '"pkg{p}": {{"version": "==1.{v}", "hashes": ["sha-{p}", "x"]}}', ", ", "}}", "'pkg' || p", "'sha-' || p", None),
}
READERS = {"cargo": lambda f: lockfiles.toml(f, "Cargo.lock"), "poetry": lambda f: lockfiles.toml(f, "poetry.lock"), "npm": lockfiles.npm, "npm_v1": lockfiles.npm_v1, "yarn": lockfiles.yarn, "pnpm": lockfiles.pnpm, "gems": lockfiles.gems, "go": lockfiles.go, "requirements": lockfiles.requirements, "pipfile": lockfiles.pipfile}


def lock_files(spark, d, kind: str):
    name, _, head, entry, joint, tail, *_ = LOCKS[kind]
    shown, parts = entry.replace("{{", "{").replace("}}", "}"), []
    for piece in shown.replace("{p}", "\0p\0").replace("{v}", "\0v\0").split("\0"):
        parts.append({"p": F.col("p").cast("string"), "v": (F.col("p") % 50).cast("string")}.get(piece, F.lit(piece)))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    text = F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(F.concat(*parts))), joint), F.lit(tail))
    return rows.groupBy("s").agg(text.alias("text")).select(F.concat(F.lit("s"), F.col("s").cast("string"), F.lit(f"/{name}")).alias("path"), "text")


for _kind, (_name, _system, *_, _sql_name, _integrity, _folder) in LOCKS.items():
    def _read(spark, d, kind=_kind):
        return READERS[kind](lock_files(spark, d, kind))

    _read.__name__ = f"lock_{_kind}"
    query(f"select 's' || s || '/{_name}' as file, '{_system}' as ecosystem, {_sql_name} as name, '1.' || p % 50 as version, {_integrity or 'null::varchar'} as integrity, {_folder or 'null::varchar'} as dir_path from {SQL_LOCKED}")(_read)


@query(f"select 's' || s || '/requirements.txt' as file, count(*) as n from {SQL_LOCKED} group by s")
def unpinned_requirements(spark, d):
    return lockfiles.unpinned_requirements(lock_files(spark, d, "requirements"))


@query("select distinct 'pkg' || l_partkey as name, '1.' || l_partkey % 50 as version, 'crates.io' as ecosystem from lineitem")
def package_dedup(spark, d):
    return lockfiles.packages(lock_files(spark, d, "cargo"))


@query("select doc_id from documents where split_part(coalesce(source, ''), '/', 1) not in (select distinct split_part(source, '/', 1) from documents join labels using (doc_id) where quality = 0 and source is not null)")
def uncovered_sources(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("path"))
    covered = docs.join(table(spark, d, "labels").where("quality = 0"), "doc_id").select(F.col("path").alias("dir_path"))
    return files.uncovered(docs, covered).select("doc_id")


# --- manifests, path files, hygiene ------------------------------------------------------------------------

HOOKS = ["preinstall", "postinstall", "install", "prepare", "test"]
COMMANDS = ["husky install", "node x.js", "curl u | sh", "tsc -p .", "prisma generate", "echo hi", "npx only-allow pnpm"]
SQL_COMMAND = sql_pick(COMMANDS, "p_partkey % 7")


def sql_any(column: str, starts: list[str]) -> str:
    return "(" + " or ".join(f"starts_with({column}, {sql_text(s)})" for s in starts) + ")"


@query(f"""with h as (select p_partkey, {sql_pick(HOOKS, 'p_partkey % 5')} as hook, {SQL_COMMAND} as command from part)
 select 'P012' as rule_id, p_partkey % 2 as root, hook, command, count(*) as n from h where p_partkey % 2 = 1 and hook in ('preinstall', 'postinstall', 'install', 'prepare') and not {sql_any('command', rules.SAFE_HOOKS)} and regexp_matches(command, {sql_text(rules.SUSPICIOUS_HOOK)}) group by all
 union all select 'P016', p_partkey % 2, hook, command, count(*) from h where p_partkey % 2 = 0 and hook in ('preinstall', 'postinstall', 'install') and not {sql_any('command', rules.SAFE_DEPENDENCY_HOOKS)} group by all""")
def install_hooks(spark, d):
    k = F.col("p_partkey")
    path = F.when(k % 2 == 1, "package.json").otherwise(F.concat(F.lit("node_modules/@s/p"), k.cast("string"), F.lit("/package.json")))
    text = F.concat(F.lit('{"name": "x", "scripts": {"'), pick(HOOKS, k % 5), F.lit('": "'), pick(COMMANDS, k % 7), F.lit('"}}'))
    found = patterns.install_hooks(table(spark, d, "part").select(path.alias("path"), text.alias("text")))
    return found.groupBy("rule_id", (F.col("file") == "package.json").cast("long").alias("root"), "hook", "command").agg(F.count("*").alias("n"))


PTH = ["../lib", "import os; x()", "import subprocess", "exec(y)", "import sys, base64"]


@query(f"with t as (select doc_id, {sql_pick(PTH, 'doc_id % 5')} || chr(10) || coalesce(text, '') as text from documents), k as (select doc_id, case " + " ".join(f"when contains(text, {sql_text(k)}) then {sql_text(k)}" for k in rules.PTH_KEYWORDS) + " end as keyword from t) select doc_id, 'P009' as rule_id, keyword from k where keyword is not null")
def path_files(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("venv/"), F.col("doc_id").cast("string"), F.lit(".pth")).alias("path"), F.concat(pick(PTH, F.col("doc_id") % 5), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    found = patterns.path_file_hits(rows)
    return found.select(F.regexp_extract("file", r"(\d+)\.pth$", 1).cast("long").alias("doc_id"), "rule_id", F.regexp_extract("message", r"contains '(.*)'$", 1).alias("keyword"))


@query("""with l as (select s_suppkey as project, s_nationkey as n from supplier)
 select 'H001' as rule_id, project, '' as detail from l where n % 3 <> 0
 union all select 'H002', project, p from l, (select unnest(['.env', '*.pem', '*.key']) as p) where not (p = '.env' and n % 2 = 0) and not (p = '*.pem' and n % 5 = 0)
 union all select r, project, 'yarn.lock' from l, (select unnest(['H003', 'D001']) as r) where n % 4 = 0
 union all select 'H004', project, '' from l where n % 7 < 3 and n % 2 = 1""")
def hygiene_rules(spark, d):
    base = table(spark, d, "supplier").select(F.col("s_suppkey").alias("project"), F.col("s_nationkey").alias("n"))
    listing = base.select("project", F.explode(F.array(F.lit("yarn.lock"), F.when(F.col("n") % 3 == 0, "docs/SECURITY.md").otherwise("a.js"))).alias("path"))
    ignores = base.select("project", F.explode(F.array(F.when(F.col("n") % 2 == 0, " /.env ").otherwise("dist"), F.when(F.col("n") % 5 == 0, "*.pem").otherwise("tmp"))).alias("line"))
    branches = base.select("project", (F.col("n") % 7 < 3).alias("is_default"), F.when(F.col("n") % 2 == 1, False).alias("protected"))
    ignored = base.where("n % 4 = 0").select("project", F.lit("yarn.lock").alias("path"))
    rows = hygiene.missing_policy(listing).select("rule_id", "project", F.lit("").alias("detail"))
    for found, detail in ((hygiene.missing_ignores(base, ignores), F.col("pattern")), (hygiene.ignored_locks(listing, ignored), F.col("path")), (hygiene.unprotected(branches), F.lit(""))):
        rows = rows.unionByName(found.select("rule_id", "project", detail.alias("detail")))
    return rows


# --- structure of code ------------------------------------------------------------------------------------------

#: folder, ending, code of one statement, its rule; the n-th document gets the n-th of them, with names of its own
CODE = [
    (".venv/lib/python3/site-packages/p", "py", "y = eval(line)", "P020"), (".venv/lib/python3/site-packages/p", "py", "import subprocess as sp\nsp.run(line, shell=True)", "P021"),
    (".venv/lib/python3/site-packages/p", "py", "import os\nos.popen(line)", "P022"), (".venv/lib/python3/site-packages/p", "py", "m = __import__(which)", "P023"), (".venv/lib/python3/site-packages/p", "py", "import pickle\nz = pickle.loads(buf)", "P024"),
    ("vendor/bundle/gems/p/lib", "rb", "eval(line)", "P030"), ("vendor/bundle/gems/p/lib", "rb", "system(line)", "P031"), ("vendor/bundle/gems/p/lib", "rb", "thing.send(which, 1)", "P032"),
    ("vendor/bundle/gems/p/lib", "rb", "require(chosen)", "P033"), ("vendor/bundle/gems/p/lib", "rb", 'open("|date")', "P034"), ("node_modules/p", "rs", 'fn go() { Command::new("bash").arg(x).spawn(); }', "P040"),
    ("node_modules/p", "rs", "fn go() { unsafe { *p = 1; } }", "P041"), ("node_modules/p", "rs", 'extern "C" { fn poke(at: *mut u8); }', "P042"), ("node_modules/p", "rs", 'static B: &[u8] = include_bytes!("blob.dat");', "P043"),
    ("node_modules/p", "js", "eval(line);", "P001"), ("node_modules/p", "js", "import { exec as run } from 'child_process';\nrun(line);", "P001"), ("node_modules/p", "js", "const m = require(names[0]);", "P013"),
    ("node_modules/p", "js", "f = new Function(line);", "P008"), ("node_modules/p", "js", "module.exports = 1;", None), (".venv/lib/python3/site-packages/p", "py", "import json\nprint(json.dumps({}))", None),
]


@query(f"with c as (select doc_id, {sql_pick([c[3] or '' for c in CODE], f'doc_id % {len(CODE)}')} as rule_id, len(string_split({sql_pick([c[2] for c in CODE], f'doc_id % {len(CODE)}')}, chr(10))) + 1 as line from documents) select doc_id, rule_id, line from c where rule_id <> ''")
def structure_rules(spark, d):
    n, i = F.col("doc_id") % len(CODE), F.col("doc_id").cast("string")
    path = F.concat(pick([c[0] for c in CODE], n), F.lit("/x"), i, F.lit("."), pick([c[1] for c in CODE], n))
    note = F.when(pick([c[1] for c in CODE], n).isin("py", "rb"), "# ").otherwise("// ")
    rows = table(spark, d, "documents").select(path.alias("path"), F.concat(note, F.lit("document "), i, F.lit("\n"), pick([c[2] for c in CODE], n), F.lit("\n")).alias("text"))
    found = ast_rows.findings(rows)
    return found.select(F.regexp_extract("file", r"x(\d+)\.\w+$", 1).cast("long").alias("doc_id"), "rule_id", F.col("line").cast("long").alias("line"))


# --- listings, sinks, reviews ----------------------------------------------------------------------------------

@query("select event_id % 1000 as pid, '10.0.' || user_id % 256 || '.7' as remote_host, 443 + event_id % 3 as remote_port, case when user_id % 2 = 0 then 'npm' else 'node' end as process_name, count(*) as n from events group by all")
def socket_listing(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    host, port, name, pid = F.concat(F.lit("10.0."), (u % 256).cast("string"), F.lit(".7")), (443 + i % 3).cast("string"), F.when(u % 2 == 0, "npm").otherwise("node"), (i % 1000).cast("string")
    ss = F.concat(F.lit("ESTAB 0      0      192.168.0.2:5000   "), host, F.lit(":"), port, F.lit('    users:(("'), name, F.lit('",pid='), pid, F.lit(",fd=21))"))
    lsof = F.concat(name, F.lit(" "), pid, F.lit(" me 21u IPv4 0x1 0t0 TCP 192.168.0.2:5000->"), host, F.lit(":"), port, F.lit(" (ESTABLISHED)"))
    rows = observations.connections(table(spark, d, "events").select(F.when(i % 2 == 0, ss).otherwise(lsof).alias("line")))
    return rows.groupBy(F.col("pid").cast("long").alias("pid"), "remote_host", F.col("remote_port").cast("long").alias("remote_port"), "process_name").agg(F.count("*").alias("n"))


@query(SQL_FINDINGS + " select rule_id, case when severity in ('critical', 'high') then 'error' when severity = 'medium' then 'warning' else 'note' end as level, file as uri, k2 as start_line, count(*) as n from f group by all")
def sarif_results(spark, d):
    rows = findings(spark, d)
    made = report.sarif_results(rows.select("rule_id", "severity", F.lit("m").alias("message"), "file", F.col("k2").alias("line")))
    get = lambda path, name: F.get_json_object("json", path).alias(name)
    out = made.select(get("$.ruleId", "rule_id"), get("$.level", "level"), get("$.locations[0].physicalLocation.artifactLocation.uri", "uri"), get("$.locations[0].physicalLocation.region.startLine", "start_line"))
    return out.groupBy("rule_id", "level", "uri", F.col("start_line").cast("long").alias("start_line")).agg(F.count("*").alias("n"))


@query(SQL_FINDINGS + " select rule_id, severity, file, count(*) as n from f group by all")
def json_findings(spark, d):
    made = report.json_lines(findings(spark, d).select("rule_id", "severity", "file"))
    return made.select(F.from_json("json", "rule_id string, severity string, file string").alias("x")).select("x.*").groupBy("rule_id", "severity", "file").agg(F.count("*").alias("n"))


SQL_VERDICT = "(select source as package, case when toxic = 1 then 'TP' when quality = 1 then 'FP' else 'NI' end as c from documents left join labels using (doc_id))"


@query(f"select package, case when bool_or(c = 'TP') then 'TP' when bool_or(c = 'NI') then 'NI' else 'FP' end as verdict, count_if(c = 'TP') as tp, count_if(c = 'FP') as fp, count_if(c = 'NI') as ni, count(*) as total from {SQL_VERDICT} group by package")
def triage_packages(spark, d):
    c = F.when(F.col("toxic") == 1, "TP").when(F.col("quality") == 1, "FP").otherwise("NI")
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(F.col("source").alias("package"), c.alias("classification"))
    return triage.packages(rows)


SQL_GLOSSARY = "(values " + ", ".join(f"({sql_text(r.id)}, {sql_text(r.description)})" for r in rules.LINE_RULES) + ") g(rule_id, description)"


@query(SQL_FINDINGS + f" select f.rule_id, any_value(g.description) as description, count(*) as n, ['low', 'medium', 'high', 'critical'][(max(o) + 1)::int] as severity from f left join {SQL_GLOSSARY} on g.rule_id = f.rule_id group by f.rule_id")
def rule_glossary(spark, d):
    return report.explained(findings(spark, d), report.glossary(spark)).select("rule_id", "description", "n", "severity")


@query("with recursive t(pid) as (select 1::bigint union all select c.c_custkey from customer c join t on c.c_custkey // 3 = t.pid where c.c_custkey > t.pid) select event_id from events where user_id in (select pid from t)")
def tree_connections(spark, d):
    processes = table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), F.floor(F.col("c_custkey") / 3).alias("parent"))
    return monitor.of_tree(table(spark, d, "events").select("event_id", F.col("user_id").alias("pid")), monitor.process_tree(processes, 1)).select("event_id")


TODAY = "2024-01-30"


@query(f"""with f as (select distinct l_partkey as p, l_suppkey as v, max(l_shipdate::date) over (partition by l_partkey) as published from lineitem), t as (select greatest(max(l_shipdate::date), date '{TODAY}') as today from lineitem)
 select 'pkg' || p as name, v::varchar as version, 'T002' as rule_id from f, t where date_diff('day', published, today) between 0 and 400
 union all select 'pkg' || p, v::varchar, 'T004' from f where p % 3 <> 0""")
def release_checks(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").cast("string").alias("version"), F.to_date("l_shipdate").alias("shipped"))
    named = rows.select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("pkg"), F.col("p").cast("string")).alias("name"), "version", "p", "shipped")
    links = F.when(F.col("p") % 3 == 0, F.array(F.lit("HOMEPAGE"), F.lit("SOURCE_REPO"))).when(F.col("p") % 3 == 1, F.array(F.lit("HOMEPAGE")))
    facts = named.groupBy("ecosystem", "name", "p").agg(F.max("shipped").alias("published")).join(named.select("name", "version").distinct(), "name").select("ecosystem", "name", "version", "published", links.alias("labels"))
    today = rows.agg(F.greatest(F.max("shipped"), F.lit(TODAY).cast("date")).alias("today")).first()["today"]
    return preflight.releases(named, facts, F.lit(today), 400).select("name", "version", "rule_id")


@query("select 'o' || s_nationkey || '/r' || s_suppkey || '/sub@v' || s_suppkey % 3 as action, case when s_suppkey % 3 = 0 then 'tag' || s_suppkey when s_suppkey % 3 = 1 then 'target' || s_suppkey else 'head' || s_suppkey end as sha from supplier")
def resolved_actions(spark, d):
    s, n, m = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"), F.col("s_suppkey") % 3
    base = table(spark, d, "supplier").select(F.concat(F.lit("o"), n, F.lit("/r"), s).alias("repository"), F.concat(F.lit("v"), m.cast("string")).alias("ref"), s.alias("s"), m.alias("m"))
    kinds = base.withColumn("kind", F.explode(F.when(F.col("m") == 2, F.array(F.lit("heads"))).otherwise(F.array(F.lit("heads"), F.lit("tags")))))
    refs = kinds.select("repository", "ref", "kind", F.concat(F.left("kind", F.length("kind") - 1), "s").alias("sha"), F.when((F.col("kind") == "tags") & (F.col("m") == 1), F.concat(F.lit("target"), "s")).alias("target"))
    return preflight.resolved(base.select(F.concat("repository", F.lit("/sub@"), "ref").alias("action")), refs)


@query("""with s as (select user_id, count_if(event_type = 'error') as canary, count_if(event_type = 'view') as unexpected, count_if(event_type = 'purchase') as reads from events group by 1),
 v as (select *, case when canary > 0 and unexpected > 0 then 'block' when canary > 0 then 'warn' when unexpected > 0 then 'info' else 'pass' end as verdict from s)
 select user_id, verdict, verdict in ('warn', 'block') or reads > 0 or user_id % 5 = 0 as issues, verdict in ('warn', 'block') or reads > 0 or user_id % 5 = 0 or unexpected > 0 as strict_issues from v""")
def run_issues(spark, d):
    count = lambda x: F.count_if(F.col("event_type") == x)
    rows = table(spark, d, "events").groupBy("user_id").agg(count("error").alias("canary"), count("view").alias("unexpected"), count("purchase").alias("reads"))
    rows = rows.withColumn("verdict", monitor.verdict(F.col("canary"), F.col("unexpected"), F.lit(0)))
    issues = lambda strict: monitor.has_issues(F.col("verdict"), F.col("reads"), F.lit(0), F.col("user_id") % 5 == 0, F.col("unexpected"), strict)
    return rows.select("user_id", "verdict", issues(False).alias("issues"), issues(True).alias("strict_issues"))


@query("select user_id, begin, count(*) as n from (select user_id, ts, last_value(case when gap then ts end ignore nulls) over (partition by user_id order by ts rows between unbounded preceding and current row) as begin from (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 6 hour, true) as gap from events)) group by 1, 2")
def event_sessions(spark, d):
    return stream.sessions(table(spark, d, "events"), "user_id", "6 hours").select("user_id", "begin", "n")
