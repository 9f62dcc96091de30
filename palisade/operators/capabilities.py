"""What packages can do: flags of files rolled up, and combinations that stand out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T


def file_flags(files: DataFrame) -> DataFrame:
    """``files`` (path, text, ...) with a column for each capability, from words of their text."""
    t = F.col("text")
    modules = "|".join(rules.NETWORK_MODULES)
    flags = {
        "network": t.rlike(rf"""(require\(|from |import )\s*['"](node:)?({modules})['"]""") | t.rlike(r"\bfetch\s*\(|requests\.(get|post)|urllib|Net::HTTP|reqwest::"),
        "fs_read": t.rlike(r"\b(readFile|readFileSync|createReadStream|readdir|readdirSync|access|accessSync)\s*\(|\bopen\s*\("),
        "fs_write": t.rlike(r"\b(writeFile|writeFileSync|createWriteStream|copyFile|copyFileSync|rename|renameSync|appendFile|appendFileSync|mkdir|mkdirSync|unlink|unlinkSync)\s*\("),
        "shell_exec": t.rlike(r"child_process|subprocess|os\.system|Command::new|Open3"),
        "env_access": t.rlike(r"process\.env|os\.environ|ENV\["),
        "install_hook": T.file_name(F.col("path")).isin(rules.INSTALL_SCRIPTS) | ((T.file_name(F.col("path")) == "package.json") & t.rlike(r'"(preinstall|postinstall|install)"\s*:')),
        "dynamic_load": t.rlike(r"""require\s*\(\s*[^'"`)\s]|__import__\s*\(|importlib"""),
        "obfuscated": t.rlike(r"_0x[a-f0-9]{4}|String\.fromCharCode|atob\s*\("),
    }
    path = F.lit(False)
    for p in rules.CREDENTIAL_PATHS:
        path = path | t.contains(p)
    return files.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()} | {"credential_path": F.coalesce(path, F.lit(False))})


def rolled_up(flags: DataFrame, by: str) -> DataFrame:
    """One row a package: a capability that any file has, credentials if files are read and a credential's path is named."""
    some = [c for c in rules.CAPABILITIES if c != "credential_read"]
    p = flags.groupBy(by).agg(*[F.bool_or(c).alias(c) for c in some], F.bool_or("credential_path").alias("__path"))
    return p.withColumn("credential_read", F.col("fs_read") & F.col("__path")).select(by, *rules.CAPABILITIES)


def names() -> Column:
    """A package's capabilities by name, in their fixed order."""
    return F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in rules.CAPABILITIES]))


def combined(packages: DataFrame, by: str, allow: DataFrame | None = None) -> DataFrame:
    """(by, name, severity) of combinations; a package whose capabilities the allow list (by, allowed array) covers has none."""
    if allow is not None:
        rows = packages.join(allow, by, "left").withColumn("caps", names())
        covered = F.coalesce((F.size("allowed") > 0) & (F.size(F.array_except("caps", "allowed")) == 0), F.lit(False))
        packages = rows.where(~covered)
    cases = F.array(*[F.when(F.col(a) & F.col(b), F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"))) for n, (a, b), s in rules.COMBINATIONS])
    return packages.select(by, F.explode(F.filter(cases, lambda c: c.isNotNull())).alias("c")).select(by, "c.name", "c.severity")
