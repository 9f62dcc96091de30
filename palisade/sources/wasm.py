"""Imports of WebAssembly modules, and how grave they are."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self) -> int:
        """An unsigned number of seven bits a byte, lowest first."""
        value = shift = 0
        while True:
            byte = self.data[self.at]
            self.at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    def name(self) -> str:
        n = self.number()
        self.at += n
        return self.data[self.at - n : self.at].decode("utf-8", "replace")

    def limits(self) -> None:
        if self.number() & 1:
            self.number()
        self.number()


def imports(data: bytes) -> list[tuple[str, str]]:
    """(module, name) of the import section; nothing of what isn't a module or breaks off."""
    found: list[tuple[str, str]] = []
    if data[:4] != b"\0asm":
        return found
    r = _Reader(data)
    r.at = 8
    try:
        while r.at < len(data):
            section, size = r.number(), r.number()
            end = r.at + size
            if section == 2:
                for _ in range(r.number()):
                    found.append((r.name(), r.name()))
                    kind = r.number()
                    if kind == 0:  # function: a type
                        r.number()
                    elif kind == 1:  # table: a kind of reference, limits
                        r.number()
                        r.limits()
                    elif kind == 2:  # memory
                        r.limits()
                    else:  # global: a type, whether it changes
                        r.number()
                        r.number()
                break
            r.at = end
    except IndexError:
        pass
    return found


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"path": batch["path"], "imports": [[f"{m}.{n}" for m, n in imports(bytes(c or b""))] for c in batch["content"]]})


def findings(files: DataFrame) -> DataFrame:
    """P025 for each module of ``files`` (path, content): network with files or environment is critical, anything dangerous or no import high, else medium."""
    rows = files.where(F.col("path").endswith(".wasm")).select("path", "content").mapInPandas(_rows, "path string, imports array<string>")
    has = lambda *words: F.exists("imports", lambda i: F.lit(False) if not words else _any(i, words))
    name = F.transform("imports", lambda i: F.substring_index(i, ".", -1))
    grave = F.exists(name, lambda n: n.isin(rules.WASM_IMPORTS))
    severity = F.when(has("sock_", "http") & (has("fd_", "path_open") | has("environ")), "critical").when(grave | (F.size("imports") == 0), "high").otherwise("medium")
    return rows.select(F.lit("P025").alias("rule_id"), severity.alias("severity"), F.lit("medium").alias("confidence"), F.col("path").alias("file"), F.lit(0).alias("line"), "imports")


def _any(column, words):
    out = column.contains(words[0])
    for w in words[1:]:
        out = out | column.contains(w)
    return out
