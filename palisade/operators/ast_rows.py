"""Calls, imports and constants of source code as rows, and structural rules over them.

Files go through one Arrow pass that knows nothing of rules: Python by its own
parser (by tokens where that fails), other languages by a small tokenizer.  The
rules are predicates and joins over the rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T

SCHEMA = "path string, lang string, kind string, receiver string, callee string, arg_kind string, arg_text string, line int"

# Names that rules look for.
EXEC_METHODS = ["exec", "execSync", "spawn", "spawnSync", "execFile", "execFileSync"]
RESOLVED_NAMES = ["eval", *EXEC_METHODS, "readFileSync", "readFile", "writeFileSync", "writeFile", "Function"]
RUBY_EVALS = ["eval", "instance_eval", "class_eval", "module_eval"]
RUBY_SENDS = ["send", "public_send", "__send__"]

TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<template>`(?:\\.|[^`\\])*`)|(?P<name>[A-Za-z_$@][\w$!?]*)|(?P<number>\d[\w.]*)|(?P<op>=>|::|&&|\|\||[^\s\w])""",
    re.S,
)
RUBY_TOKEN = re.compile(TOKEN.pattern.replace(r"//[^\n]*|/\*.*?\*/", r"\#[^\n]*").replace("(?P<number>", "(?P<symbol>:[A-Za-z_]\\w*)|(?P<number>"), re.S)
RUST_TOKEN = re.compile(TOKEN.pattern.replace(r"|'(?:\\.|[^'\\\n])*'", r"|'(?:\\.|[^'\\])'"), re.S)


def _tokens(code: str, pattern: re.Pattern) -> list[tuple[str, str, int]]:
    out, at, line = [], 0, 1
    for m in pattern.finditer(code):
        line += code.count("\n", at, m.start())
        at = m.start()
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m.group(), line))
    return out


def _argument(tokens: list, i: int) -> tuple[str, str]:
    """Kind and text of the first argument that starts at token ``i``."""
    if i >= len(tokens) or tokens[i][1] == ")":
        return "none", ""
    depth, parts, before = 0, [], None
    for at in range(i, len(tokens)):
        kind, text, line = tokens[at]
        if depth == 0 and (text in (",", ")", "]", "}", ";", "\n") or before and line > before[2] and kind != "op" and before[0] != "op"):
            break  # the end of the argument, or of a statement that has no semicolon
        depth += text in ("(", "[", "{")
        depth -= text in (")", "]", "}")
        parts.append((kind, text))
        before = tokens[at]
    text = " ".join(t for _, t in parts)
    kinds = [k for k, _ in parts]
    if len(parts) == 1:
        kind, t = parts[0]
        if kind == "template":
            return ("interpolated" if "${" in t else "string"), t
        return {"string": "string", "symbol": "symbol", "name": "name"}.get(kind, "other"), t
    if kinds and all(k in ("string", "op") for k in kinds) and all(t == "+" for k, t in parts if k == "op"):
        return "folded", "".join(t[1:-1] for k, t in parts if k == "string")
    if any(t == "(" for _, t in parts):
        return "call", text
    if any(t == "[" for _, t in parts):
        return "subscript", text
    if any(t == "." for _, t in parts):
        return "member", text
    return "other", text


def _unquoted(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] in "\"'`" else text


def script_rows(code: str, lang: str) -> list[tuple]:
    """(kind, receiver, callee, arg_kind, arg_text, line) of code in JavaScript, TypeScript, Ruby or Rust."""
    t = _tokens(code, RUBY_TOKEN if lang == "ruby" else RUST_TOKEN if lang == "rust" else TOKEN)
    rows, text = [], [x[1] for x in t] + [""] * 8
    constants: dict[str, str] = {}
    for i, (kind, word, line) in enumerate(t):
        before = text[i - 1] if i else ""
        if kind == "name" and text[i + 1] == "=" and text[i + 2] not in ("=", ">"):
            value = _argument(t, i + 2)
            end = i + 3
            if i + 2 < len(t) and t[i + 2][0] in ("string", "template"):
                folded = _unquoted(text[i + 2])
                while text[end] == "+" and end + 1 < len(t) and t[end + 1][0] == "string":
                    folded += _unquoted(text[end + 1])
                    end += 2
                constants[word] = folded
                rows.append(("constant", None, word, "string", folded, line))
            elif text[i + 2] == "Function" and text[i + 3] != "(":
                rows.append(("alias", "Function", word, "name", "Function", line))
            elif value[0] in ("member", "name") and value[1].replace(" ", "").endswith((".require", "mainModule.require")):
                rows.append(("alias", "require", word, "member", value[1], line))
            elif "require" in text[i + 2 : i + 8]:
                at = text.index("require", i + 2)
                if text[at + 1] == "(" and at + 2 < len(t) and t[at + 2][0] == "string" and text[at + 4] != ".":
                    rows.append(("import", _unquoted(text[at + 2]), word, "require", None, line))
            elif text[i + 3] == "(" and i + 4 < len(t) and t[i + 4][0] == "string":
                rows.append(("import", _unquoted(text[i + 4]), word, text[i + 2], None, line))
        if word == "}" and text[i + 1] == "=" and text[i + 2] == "require" and i + 4 < len(t) and t[i + 4][0] == "string":
            at = i - 1
            while at >= 0 and text[at] != "{":
                if t[at][0] == "name" and text[at + 1] in (",", "}"):
                    rows.append(("import", _unquoted(text[i + 4]), text[at], "member", text[at - 2] if text[at - 1] == ":" else text[at], line))
                at -= 1
        if word == "import" and lang in ("javascript", "typescript") and text[i + 1] not in ("(", "."):
            at = i + 1
            names = []
            while at < len(t) and t[at][0] != "string" and text[at] != ";":
                if t[at][0] == "name" and text[at] not in ("from", "as", "type"):
                    if text[at - 1] == "as" and names:
                        names.pop()
                    names.append((text[at], text[at - 2] if text[at - 1] == "as" else text[at]))
                at += 1
            if at < len(t) and t[at][0] == "string":  # however many names there are
                rows += [("import", _unquoted(text[at]), n, "import", m, line) for n, m in names] or [("import", _unquoted(text[at]), None, "import", None, line)]
        if lang == "ruby" and kind == "template":
            rows.append(("call", None, "`", "string", word, line))
        if lang == "rust" and word == "unsafe" and text[i + 1] == "{":
            rows.append(("block", None, "unsafe", "none", "", line))
        if lang == "rust" and word == "extern" and i + 2 < len(t) and text[i + 2] == "{":
            rows.append(("block", None, "extern", "string", _unquoted(text[i + 1]), line))
        if lang == "rust" and kind == "name" and text[i + 1] == "!" and text[i + 2] in ("(", "["):
            rows.append(("call", None, f"{word}!", *_argument(t, i + 3), line))
        if word == "]" and text[i + 1] == "(":  # obj[key](...)
            at = i - 1
            while at >= 0 and text[at] != "[":
                at -= 1
            key_kind, key = _argument(t[: i], at + 1) if at >= 0 else ("other", "")
            resolved = constants.get(key, key if key_kind == "folded" else _unquoted(key) if key_kind == "string" else None)
            rows.append(("indexed", text[at - 1] if at > 0 else None, resolved, key_kind, key, line))
        called = text[i + 1] == "(" or (lang == "ruby" and i + 1 < len(t) and t[i + 1][0] in ("string", "name", "symbol") and t[i + 1][2] == line and word not in ("def", "class", "module", "end", "if", "unless", "return", "do", "then"))
        if kind == "name" and called and before not in ("def", "function", "fn"):
            dotted = before in (".", "::")
            receiver, at = [], i - 1
            while at > 0 and text[at] in (".", "::") and t[at - 1][0] == "name":
                receiver.append(text[at - 1])
                at -= 2
            if dotted and not receiver and text[i - 2] == ")":  # require('m').method(...)
                at = i - 3
                if at > 1 and t[at][0] == "string" and text[at - 1] == "(" and text[at - 2] == "require":
                    receiver = [f"require:{_unquoted(text[at])}"]
                else:
                    receiver = ["()"]
            sign = "new" if before == "new" or (receiver and at >= 0 and text[at] == "new") else "call"
            arg = _argument(t, i + 2 if text[i + 1] == "(" else i + 1)
            rows.append((sign, ".".join(reversed(receiver)) or None, word, *arg, line))
            if arg[0] == "name" and arg[1] in constants:
                rows[-1] = (*rows[-1][:3], "indirect", constants[arg[1]], line)
        if word == "(" and text[i + 1 : i + 6] == ["0", ",", "require", ")", "("]:
            rows.append(("call", None, "require", *_argument(t, i + 6), line))
    return rows


def python_rows(code: str) -> list[tuple] | None:
    """The same of Python code; None if it can't be parsed."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    rows = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            rows += [("import", a.name, a.asname or a.name, "import", None, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            rows += [("import", node.module, a.asname or a.name, "member", a.name, node.lineno) for a in node.names]
        elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
            rows += [("constant", None, x.id, "string", node.value.value, node.lineno) for x in node.targets if isinstance(x, ast.Name)]
        elif isinstance(node, ast.Call):
            f = node.func
            receiver = ast.unparse(f.value) if isinstance(f, ast.Attribute) else None
            callee = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None
            if callee is None:
                continue
            shell = any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords)
            if not node.args:
                arg = ("none", "")
            elif isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
                arg = ("string", node.args[0].value)
            else:
                arg = ("other", ast.unparse(node.args[0]))
            rows.append(("shell" if shell else "call", receiver, callee, *arg, node.lineno))
    return rows


def broken_python_rows(code: str) -> list[tuple]:
    """What tokens alone tell of Python code that doesn't parse."""
    text, out = code.split("\n"), []
    for i, line in enumerate(text, 1):
        if m := re.match(r"\s*import\s+([\w.]+)(?:\s+as\s+(\w+))?", line):
            out.append(("import", m[1], m[2] or m[1], "import", None, i))
    for r in script_rows(code, "ruby"):
        shell = r[0] == "call" and "shell=True" in text[r[5] - 1].replace(" ", "")
        out.append(("shell", *r[1:]) if shell else r)
    return out


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path, lang, code in zip(batch["path"], batch["lang"], batch["text"]):
            found = python_rows(code) if lang == "python" else None
            if found is None:
                found = broken_python_rows(code) if lang == "python" else script_rows(code, lang)
            out += [(path, lang, *r) for r in found]
        frame = pd.DataFrame(out, columns=["path", "lang", "kind", "receiver", "callee", "arg_kind", "arg_text", "line"], dtype=object)
        yield frame.astype({"line": "int32"}) if len(frame) else frame


def rows(files: DataFrame) -> DataFrame:
    """Rows of all files (path, text) in a known language; null texts have none."""
    code = files.select("path", T.language(F.col("path")).alias("lang"), "text").where("lang is not null and text is not null")
    return code.mapInPandas(_rows, SCHEMA)


def _by_argument() -> Column:
    return F.when(F.col("arg_kind").isin("string", "folded"), "medium").when(F.col("arg_kind") == "interpolated", "critical").otherwise("high")


def findings(files: DataFrame) -> DataFrame:
    """(rule_id, severity, confidence, file, line), one for each rule and line of a file."""
    r = rows(files).persist()
    js, calls = F.col("lang").isin("javascript", "typescript"), F.col("kind").isin("call", "new", "shell")
    imports = r.where("kind = 'import'").select("path", F.col("receiver").alias("module"), F.col("callee").alias("alias"), F.col("arg_kind").alias("form"), F.col("arg_text").alias("member"))
    modules = imports.where(F.regexp_replace("module", "^node:", "").isin(rules.EXEC_MODULES))
    loaders = r.where("kind = 'alias' and receiver = 'require'").select("path", F.col("callee").alias("form"))
    modules = modules.unionByName(imports.join(loaders, ["path", "form"], "left_semi").where(F.regexp_replace("module", "^node:", "").isin(rules.EXEC_MODULES)).select(*modules.columns)).distinct()

    def hit(where: DataFrame, rule: str, severity: Column | str, confidence: str = "high") -> DataFrame:
        s = F.lit(severity) if isinstance(severity, str) else severity
        return where.select(F.lit(rule).alias("rule_id"), s.alias("severity"), F.lit(confidence).alias("confidence"), F.col("path").alias("file"), "line")

    c = r.where(calls)
    name = F.coalesce("receiver", F.lit(""))
    on_alias = c.where(js).join(modules.select("path", F.col("alias").alias("receiver")), ["path", "receiver"], "left_semi").where(F.col("callee").isin(EXEC_METHODS))
    bare = c.where(js & F.col("receiver").isNull()).join(modules.select("path", F.col("alias").alias("callee")), ["path", "callee"], "left_semi")
    chained = c.where(js & F.regexp_replace(name, "^require:(node:)?", "").isin(rules.EXEC_MODULES) & name.startswith("require:"))
    made = c.where(js & ((F.col("kind") == "new") & (F.col("callee") == "Function")))
    made_by = c.where("kind = 'new'").join(r.where("kind = 'alias' and receiver = 'Function'").select("path", "callee"), ["path", "callee"], "left_semi")
    literal = F.col("arg_kind").isin("string", "none")
    required = c.where(js & F.col("callee").isin("require", "import") & F.col("receiver").isNull() & ~literal)
    dynamic = F.when(F.col("arg_kind").isin("call", "subscript", "member"), "critical").otherwise("high")
    codes = c.where(js & (F.col("callee") == "fromCharCode")).groupBy("path").agg(F.count("*").alias("n"), F.min("line").alias("line")).where("n >= 3")
    indexed = r.where(js & (F.col("kind") == "indexed") & F.col("callee").isin(RESOLVED_NAMES))
    loud = F.when((F.col("arg_kind") != "name") | F.col("callee").isin("eval", "Function", *EXEC_METHODS), "high").otherwise("medium")

    py = c.where("lang = 'python'")
    aliased = lambda m: py.join(imports.where(F.col("module") == m).select("path", F.col("alias").alias("receiver")), ["path", "receiver"], "left_semi")
    low = F.when(F.col("arg_kind") == "string", "low")
    ruby, rust = c.where("lang = 'ruby'"), r.where("lang = 'rust'")
    found = [
        hit(on_alias, "P001", _by_argument()), hit(bare, "P001", _by_argument()), hit(chained, "P001", "high"),
        hit(c.where(js & (F.col("callee") == "eval") & ~F.col("arg_kind").isin("string")), "P001", "high", "medium"),
        hit(c.where(js & (F.col("receiver") == "Reflect") & F.col("callee").isin("apply", "construct") & F.col("arg_text").rlike("readFile|exec|spawn|writeFile")), "P001", "high"),
        hit(indexed, "P001", loud), hit(made, "P008", _by_argument()), hit(made_by, "P008", _by_argument()), hit(required, "P013", dynamic), hit(codes, "P014", "high"),
        hit(py.where(F.col("callee").isin("eval", "exec", "compile") & F.col("receiver").isNull()), "P020", low.otherwise("high")),
        hit(aliased("subprocess").where("kind = 'shell'"), "P021", "high"),
        hit(aliased("os").where(F.col("callee").isin("system", "popen")), "P022", "high"),
        hit(py.where("callee = '__import__'"), "P023", low.otherwise("critical")),
        hit(aliased("pickle").where(F.col("callee").isin("load", "loads", "Unpickler")), "P024", "critical"),
        hit(ruby.where(F.col("callee").isin(RUBY_EVALS)), "P030", F.when(F.col("arg_kind") == "string", "medium").otherwise("high")),
        hit(ruby.where((F.col("receiver").isNull() & F.col("callee").isin("system", "exec", "`")) | (F.col("receiver").isNotNull() & F.col("callee").rlike("^(system|exec|popen|spawn|capture.*)$"))), "P031", "high"),
        hit(ruby.where(F.col("callee").isin(RUBY_SENDS)), "P032", F.when(F.col("arg_kind") == "symbol", "low").otherwise("high")),
        hit(ruby.where(F.col("callee").isin("require", "load", "require_relative") & F.col("receiver").isNull() & ~F.col("arg_kind").isin("string", "none")), "P033", "high"),
        hit(ruby.where((F.col("callee") == "open") & F.col("arg_text").rlike("""^['"]\\|""")), "P034", "high"),
        hit(rust.where("kind = 'call' and callee = 'new' and receiver like '%Command'"), "P040", "high"),
        hit(rust.where("kind = 'block' and callee = 'unsafe'"), "P041", "medium"), hit(rust.where("kind = 'block' and callee = 'extern'"), "P042", "medium"),
        hit(rust.where("callee in ('include_bytes!', 'include_str!')"), "P043", "low", "medium"),
    ]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # one finding for each rule and line, the gravest
    from ..schema import ordinal, severity_name

    return every.groupBy("rule_id", "file", "line").agg(severity_name(F.max(ordinal("severity"))).alias("severity"), F.max("confidence").alias("confidence"))


def imported_packages(files: DataFrame) -> DataFrame:
    """(package, file, line) that the application's own sources import."""
    r = rows(files).where("kind = 'import' and receiver is not null")
    return r.select(T.module_package(F.col("receiver")).alias("package"), F.col("path").alias("file"), "line").where("package is not null").distinct()
