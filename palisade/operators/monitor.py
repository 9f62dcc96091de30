"""Runtime observations: what a connection or an open file is, and what they mean together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T


def connection_class(host: Column, resolved: Column, process: Column, allowed: list[str] = ()) -> Column:
    """critical, expected or unexpected; the name decides, a resolved name only for hosts given as addresses."""
    base = F.element_at(F.split(process, "/"), -1)
    name = F.when(host.rlike(r"^[0-9.]+$"), F.coalesce(resolved, host)).otherwise(host)
    known = F.lit(False)
    for h in [*rules.UNIVERSAL_HOSTS, *allowed]:
        known = known | T.host_matches(name, F.lit(h))
    for p, hosts in rules.PROCESS_HOSTS.items():
        for h in hosts:
            known = known | ((base == p) & T.host_matches(name, F.lit(h)))
    return F.when(host.isin(rules.BLOCKED_HOSTS), "critical").when(known, "expected").otherwise("unexpected")


def baseline_class(host: Column, allowed: Column) -> Column:
    """Class of a captured host; ``allowed`` tells whether the baseline has it."""
    return F.when(host.isin(rules.BLOCKED_HOSTS), "critical").when(allowed, "matched").otherwise("violation")


def sensitive_reads(opened: DataFrame, paths: DataFrame) -> DataFrame:
    """Open files below one of ``paths`` (prefix): an equi-join on the parents of each path, so no prefix meets every file."""
    parts = F.split("path", "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = opened.withColumn("prefix", F.explode(parents)).join(paths.select("prefix").distinct(), "prefix", "left_semi")
    return rows.drop("prefix").distinct()


def outside_writes(opened: DataFrame, allowed: DataFrame) -> DataFrame:
    """Files open for writing that are below none of ``allowed`` (prefix)."""
    return opened.where("writable").join(sensitive_reads(opened, allowed).select("path").distinct(), "path", "left_anti")


def verdict(canary: Column, unexpected: Column, critical: Column) -> Column:
    """Kill-chain verdict from counts of canary accesses, unexpected and critical connections."""
    net = (unexpected > 0) | (critical > 0)
    return F.when((canary > 0) & net, "block").when(canary > 0, "warn").when(critical > 0, "block").when(unexpected > 0, "info").otherwise("pass")


def kill_chain(canary: DataFrame, network: DataFrame, by: list[str]) -> DataFrame:
    """A verdict for each session of either table: ``canary`` (by, kind) and ``network`` (by, class, destination)."""
    c = canary.groupBy(*by).agg(F.count("*").alias("canary"))
    n = network.groupBy(*by).agg(F.count_if(F.col("class") == "unexpected").alias("unexpected"), F.count_if(F.col("class") == "critical").alias("critical"))
    rows = c.join(n, by, "full_outer").na.fill(0, ["canary", "unexpected", "critical"])
    return rows.withColumn("verdict", verdict(F.col("canary"), F.col("unexpected"), F.col("critical")))


def outside(opened: DataFrame, folder: str) -> DataFrame:
    """Open files that aren't below ``folder``, such as a home that was laid out as a trap."""
    return opened.where(~T.under(F.col("path"), F.lit(folder)))


def has_issues(verdict: Column, reads: Column, writes: Column, failed: Column, unexpected: Column, strict: bool = False) -> Column:
    """Whether a run needs a look: a warning or a block always, else sensitive reads, writes outside, a command that failed, and with ``strict`` any unexpected connection."""
    own = (reads > 0) | (writes > 0) | failed
    return verdict.isin("warn", "block") | own | ((unexpected > 0) if strict else F.lit(False))


def tampered(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state) of canaries that are gone, changed or unreadable; both sides have (path, hash)."""
    rows = before.join(after.select("path", F.col("hash").alias("now"), F.lit(True).alias("there")), "path", "left")
    state = F.when(F.col("there").isNull(), "deleted").when(F.col("now").isNull(), "unreadable").when(F.col("now") != F.col("hash"), "tampered")
    return rows.select("path", state.alias("state")).where("state is not null")


def process_tree(processes: DataFrame, root) -> DataFrame:
    """All processes (pid, parent) below and with ``root``: (pid, depth).

    Every process points at its parent; each round it points at what that one points
    at, so a tree of depth n takes about log2(n) joins.  Parents in a circle never
    reach the root and end with the first round that brings nobody there.
    """
    state = processes.groupBy("pid").agg(F.min("parent").alias("parent"))
    state = state.select("pid", F.when(F.col("pid") == root, F.col("pid")).otherwise(F.col("parent")).alias("up"), F.when(F.col("pid") == root, 0).otherwise(1).alias("depth")).persist()
    reached = state.where(F.col("up") == root).count()
    while True:
        above = state.select(F.col("pid").alias("up"), F.col("up").alias("__up"), F.col("depth").alias("__d"))
        further = state.join(above, "up").select("pid", F.col("__up").alias("up"), (F.col("depth") + F.col("__d")).alias("depth")).persist()
        now = further.where(F.col("up") == root).count()
        state = further
        if now == reached:
            return state.where(F.col("up") == root).select("pid", "depth")
        reached = now


def of_tree(connections: DataFrame, tree: DataFrame) -> DataFrame:
    """Connections whose process (pid) is in a tree."""
    return connections.join(tree.select("pid"), "pid", "left_semi")


def seen_connections(connections: DataFrame, *by: str) -> DataFrame:
    """Each combination of ``by`` once."""
    return connections.select(*by).distinct()
