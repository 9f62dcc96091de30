"""Lock files of all ecosystems as one table: (file, ecosystem, name, version, integrity, dir_path).

``files`` has (path, text).  Formats of lines are read with windows over each
file's lines, JSON with built-in functions; TOML and nested npm trees, which no
built-in reads, in Arrow batches, whose size doesn't follow the files' (``_pieces``).
A file that can't be parsed gives no row.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterable, Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

NAMES = ["Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Gemfile.lock", "go.sum", "poetry.lock", "Pipfile.lock", "requirements.txt"]
ECOSYSTEMS = {"Cargo.lock": "crates.io", "package-lock.json": "npm", "yarn.lock": "npm", "pnpm-lock.yaml": "npm", "Gemfile.lock": "RubyGems", "go.sum": "Go", "poetry.lock": "PyPI", "Pipfile.lock": "PyPI", "requirements.txt": "PyPI"}


def discovered(files: DataFrame, depth: int = 3) -> DataFrame:
    """Lock files at most ``depth`` deep, not below hidden or dependency folders."""
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin("node_modules", "target", "vendor"))
    return files.where(T.file_name(F.col("path")).isin(NAMES) & ~hidden & (F.size(parts) <= depth))


def _of(files: DataFrame, name: str) -> DataFrame:
    return files.where(T.file_name(F.col("path")) == name).select(F.col("path").alias("file"), "text")


def _row(rows: DataFrame, name: str, integrity: Column | None = None, dir_path: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select("file", F.lit(ECOSYSTEMS[name]).alias("ecosystem"), "name", "version", (integrity if integrity is not None else none).alias("integrity"), (dir_path if dir_path is not None else none).alias("dir_path"))


def npm(files: DataFrame) -> DataFrame:
    """package-lock of versions 2 and 3: an entry for each path that has a version."""
    entry = "map<string,struct<version:string,integrity:string>>"
    rows = _of(files, "package-lock.json").select("file", F.explode(F.from_json("text", f"packages {entry}").getField("packages")).alias("path", "e"))
    rows = rows.where((F.col("path") != "") & F.col("e.version").isNotNull())
    return _row(rows.select("file", F.regexp_extract("path", r"^(?:.*node_modules/)?(.*)$", 1).alias("name"), "e.version", "path", "e.integrity"), "package-lock.json", F.col("integrity"), F.col("path"))


#: Characters of a piece of a text, and rows that Python returns at once: with them a batch is bounded, however many and large the files.
PIECE, ROWS = 2_000, 10_000


def _pieces(files: DataFrame) -> DataFrame:
    """(file, no, piece): texts in pieces that follow one another, ``no`` is 0 at the first."""
    return files.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("no", "piece"))


def _whole(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[str, str]]:
    """(file, text), one file at a time, of batches of ``_pieces``."""
    held, of = [], None
    for batch in batches:
        for file, no, piece in zip(batch["file"], batch["no"], batch["piece"]):
            if no == 0 and held:
                yield of, "".join(held)
                held = []
            of = file
            held.append(piece)
    if held:
        yield of, "".join(held)


def _frames(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    for some in batched(rows, ROWS):
        yield pd.DataFrame(some, columns=columns, dtype=object)


def _nested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trees of package-lock version 1, at most 20 levels deep."""
    def rows():
        for file, text in _whole(batches):
            try:
                top = json.loads(text)
                todo = [] if top.get("packages") else [(top.get("dependencies") or {}, "", 0)]
                while todo:
                    tree, above, level = todo.pop()
                    for name, e in tree.items():
                        place = f"{above}node_modules/{name}"
                        if e.get("version"):
                            yield file, name, e["version"], e.get("integrity"), place
                        if e.get("dependencies") and level < 20:
                            todo.append((e["dependencies"], f"{place}/", level + 1))
            except (ValueError, AttributeError, TypeError):
                continue

    yield from _frames(rows(), ["file", "name", "version", "integrity", "dir_path"])


def npm_v1(files: DataFrame) -> DataFrame:
    rows = _pieces(_of(files, "package-lock.json").where(~F.col("text").contains('"packages"'))).mapInPandas(_nested, "file string, name string, version string, integrity string, dir_path string")
    return _row(rows, "package-lock.json", F.col("integrity"), F.col("dir_path"))


def yarn(files: DataFrame) -> DataFrame:
    """Headers hold the version lines below them; of several specifications the first counts."""
    order = Window.partitionBy("file").orderBy("line_no")
    rows = T.lines(_of(files, "yarn.lock"), "file")
    head = F.when(F.col("line").rlike(r"^[^\s#].*:$"), F.col("line"))
    rows = rows.withColumn("head", F.last(head, ignorenulls=True).over(order)).where(F.col("head").isNotNull() & F.col("line").rlike(r"^\s+(version|integrity)\s"))
    spec = F.regexp_extract("head", r"""^"?(@?[^@,"]+)@""", 1)
    value = F.regexp_extract("line", r"""^\s+(?:version|integrity):?\s+"?([^"]+)"?""", 1)
    field = F.regexp_extract("line", r"^\s+(\w+)", 1)
    # a header occurs once in a file
    rows = rows.groupBy("file", "head").agg(F.first(spec).alias("name"), F.min_by(F.when(field == "version", value), F.when(field == "version", F.col("line_no"))).alias("version"), F.min_by(F.when(field == "integrity", value), F.when(field == "integrity", F.col("line_no"))).alias("integrity"))
    return _row(rows.where("name <> '' and version is not null"), "yarn.lock", F.col("integrity"))


def pnpm(files: DataFrame) -> DataFrame:
    """Keys of the ``packages:`` section, split at their last ``@``."""
    order = Window.partitionBy("file").orderBy("line_no")
    rows = T.lines(_of(files, "pnpm-lock.yaml"), "file")
    rows = rows.withColumn("section", F.last(F.when(F.col("line").rlike(r"^\S"), F.col("line")), ignorenulls=True).over(order))
    key = F.regexp_extract("line", r"""^ {1,4}['"]?/?((?:@[^/@]+/)?[^@'"\s]+@[^:'"(]+)""", 1)
    rows = rows.where((F.trim("section") == "packages:") & F.col("line").rlike(r"^ {1,4}\S.*:\s*$")).withColumn("key", key).where("key <> ''")
    return _row(rows.select("file", F.regexp_extract("key", r"^(.*)@[^@]*$", 1).alias("name"), F.regexp_extract("key", r"@([^@]*)$", 1).alias("version")), "pnpm-lock.yaml")


def gems(files: DataFrame) -> DataFrame:
    """Entries with exactly four spaces in the specs of the GEM section."""
    order = Window.partitionBy("file").orderBy("line_no")
    rows = T.lines(_of(files, "Gemfile.lock"), "file")
    rows = rows.withColumn("section", F.last(F.when(F.col("line").rlike(r"^\S"), F.trim("line")), ignorenulls=True).over(order))
    entry = r"^ {4}([^\s(]+) \(([^)]+)\)"
    rows = rows.where((F.col("section") == "GEM") & F.col("line").rlike(entry))
    return _row(rows.select("file", F.regexp_extract("line", entry, 1).alias("name"), F.regexp_extract("line", entry, 2).alias("version")), "Gemfile.lock")


def go(files: DataFrame) -> DataFrame:
    """Modules once each, whether the sum is of the module or of its go.mod."""
    parts = F.split(F.trim("line"), r"\s+")
    rows = T.lines(_of(files, "go.sum"), "file").where(F.size(parts) >= 2)
    rows = rows.select("file", F.get(parts, F.lit(0)).alias("name"), F.regexp_replace(F.regexp_replace(F.get(parts, F.lit(1)), "/go\\.mod$", ""), "^v+", "").alias("version"))
    return _row(rows.distinct(), "go.sum")


def requirements(files: DataFrame) -> DataFrame:
    """Exact pins only; what follows a semicolon is a marker."""
    pin = r"^\s*([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*==\s*([^\s;#,]+)"
    rows = T.lines(_of(files, "requirements.txt"), "file").where(F.col("line").rlike(pin))
    return _row(rows.select("file", F.regexp_extract("line", pin, 1).alias("name"), F.regexp_extract("line", pin, 2).alias("version")), "requirements.txt")


def unpinned_requirements(files: DataFrame) -> DataFrame:
    """(file, n) of requirements without an exact pin."""
    rows = T.lines(_of(files, "requirements.txt"), "file").where(F.col("line").rlike(r"^\s*[A-Za-z0-9]") & ~F.col("line").contains("=="))
    return rows.groupBy("file").agg(F.count("*").alias("n"))


def pipfile(files: DataFrame) -> DataFrame:
    entry = "map<string,struct<version:string,hashes:array<string>>>"
    parsed = _of(files, "Pipfile.lock").select("file", F.from_json("text", f"default {entry}, develop {entry}").alias("m"))
    rows = None
    for part in ("default", "develop"):
        more = parsed.select("file", F.explode(F.col("m").getField(part)).alias("name", "e"))
        rows = more if rows is None else rows.unionByName(more)
    rows = rows.where(F.col("e.version").isNotNull()).select("file", "name", F.regexp_replace("e.version", "^==", "").alias("version"), F.get("e.hashes", F.lit(0)).alias("i"))
    return _row(rows, "Pipfile.lock", F.col("i"))


def _toml(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows():
        for file, text in _whole(batches):
            try:
                yield from [(file, p["name"], p["version"], p.get("checksum")) for p in tomllib.loads(text).get("package", []) if "name" in p and "version" in p]
            except (tomllib.TOMLDecodeError, TypeError):
                continue

    yield from _frames(rows(), ["file", "name", "version", "integrity"])


def toml(files: DataFrame, name: str) -> DataFrame:
    return _row(_pieces(_of(files, name)).mapInPandas(_toml, "file string, name string, version string, integrity string"), name, F.col("integrity"))


def parsed(files: DataFrame) -> DataFrame:
    """All lock packages of ``files``."""
    rows = npm(files)
    for more in (npm_v1(files), yarn(files), pnpm(files), gems(files), go(files), requirements(files), pipfile(files), toml(files, "Cargo.lock"), toml(files, "poetry.lock")):
        rows = rows.unionByName(more)
    return rows


def packages(files: DataFrame) -> DataFrame:
    """(name, version, ecosystem), each once."""
    return parsed(files).select("name", "version", "ecosystem").distinct()
