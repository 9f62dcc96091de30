"""Mixing sources to target weights, in DataFrame functions only.

A tree of domains, languages and sources shares out a budget of tokens.  At every
node the children get the parent's budget by weight; a child that cannot use its
part, even by repeating its documents ``epochs`` times, takes what it has and the
rest goes to its siblings by weight.  Only when all siblings are full does the
shortage show in the parent's own capacity and so reach the parent's siblings.
Each leaf then reads its documents epoch by epoch, in an order that the seed and
the epoch shuffle anew, until its budget is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, keyed

TOKEN = "[^\\x20\\x09-\\x0D]+"
NULL = "(null)"


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``quota`` of each child: columns ``parent``, ``name``, weight, capacity, budget (of the parent).

    Children in the order of capacity by weight fill up one after another; from the
    first that doesn't, all others get their part of what is left.  Whole numbers
    throughout; what the division leaves goes by one token to children in the order
    of their names.  Children of weight 0 get nothing.
    """
    wide = "decimal(38,0)"
    w = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), name)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    live = nodes.where("weight > 0 and capacity > 0")
    x = live.withColumn("filled", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("lighter", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    x = x.withColumn("rest", F.greatest(F.col("budget") - F.col("filled"), F.lit(0))).withColumn("heft", F.sum("weight").over(Window.partitionBy(*parent)) - F.col("lighter"))
    x = x.withColumn("full", (F.col("capacity").cast(wide) * F.col("heft").cast(wide) <= F.col("rest").cast(wide) * F.col("weight").cast(wide)))
    x = x.withColumn("over", F.max(F.when(~F.col("full"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    first = Window.partitionBy(*parent, "over").orderBy(F.col("capacity") / F.col("weight"), name)
    x = x.withColumn("rest", F.first("rest").over(first)).withColumn("heft", F.first("heft").over(first))
    x = x.withColumn("part", F.when(F.col("over"), F.expr("cast(rest as decimal(38,0)) * weight div heft").cast("long")).otherwise(F.col("capacity")))
    by_name = Window.partitionBy(*parent, "over").orderBy(name)
    spare = F.col("rest") - F.sum("part").over(Window.partitionBy(*parent, "over"))
    return x.withColumn("quota", F.col("part") + F.when(F.col("over") & (F.row_number().over(by_name) <= spare), 1).otherwise(0)).select(*parent, name, "capacity", "quota")


def quotas(leaves: DataFrame, path: list[str], weights: list[DataFrame | None], budget: int | Column, epochs: int) -> DataFrame:
    """Quota of every leaf of ``leaves(*path, tokens)``.

    ``weights[i]`` gives (*path[: i + 1], weight) for nodes of that depth; nodes that
    it doesn't name, or a depth without a table, weigh 1.  The tables have one row a
    leaf, whatever the corpus holds.
    """
    sums = leaves.withColumn("capacity", F.col("tokens") * epochs)
    given = sums.agg(F.least(F.sum("capacity"), F.lit(budget) if isinstance(budget, int) else budget).alias("budget")).select(F.lit(0).alias("__root"), "budget")
    parent: list[str] = ["__root"]
    for i, name in enumerate(path):
        nodes = sums.groupBy(*path[: i + 1]).agg(F.sum("capacity").cast("long").alias("capacity")).withColumn("__root", F.lit(0))
        if weights[i] is not None:
            nodes = nodes.join(weights[i].select(*path[: i + 1], F.col("weight").cast("long").alias("weight")), path[: i + 1], "left")
        else:
            nodes = nodes.withColumn("weight", F.lit(1).cast("long"))
        nodes = nodes.withColumn("weight", F.coalesce("weight", F.lit(1).cast("long"))).join(given, parent)
        given = cut(_share(nodes, parent, name).drop("capacity").withColumnRenamed("quota", "budget"))
        parent = parent + [name] if i == 0 else parent + [name]
    return given.select(*path, F.col("budget").alias("quota"))


def mix(rows: DataFrame, path: list[str], weights: list[DataFrame | None], share: float, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """(__row, *path, n_tokens, quota, epoch) for the documents taken, one row for each time.

    ``rows`` has __row, name (text that orders the leaf with the seed), tokens and
    the columns ``path``.  The budget is ``share`` of all tokens, at most what
    ``epochs`` repeats give.  A leaf of quota q and T tokens reads q div T whole
    epochs; of the next it takes the prefix, in the order of
    md5(seed:epoch:name), that reaches q mod T.  A document is taken whole, so a
    leaf goes over its quota by less than its last document.  Documents without a
    token fall in no prefix; they come with whole epochs.  Null path values are the
    node ``(null)``.  Repeated rows are documents of their own.

    The prefix is found by sums over 256 ranges of that order and then over 256
    ranges within the one where the quota falls, so only 1/65536 of a leaf is put
    in order row by row: a leaf with a third of the corpus is no single task's work.
    """
    leaves = rows.groupBy(*path).agg(F.sum("tokens").cast("long").alias("tokens"))
    leaves = cut(leaves)
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    leaf = quotas(leaves.where("tokens > 0"), path, weights, int(total * share), epochs).join(leaves, path)
    leaf = cut(leaf.where("quota > 0").select(*path, "quota", F.expr("quota div tokens").cast("int").alias("whole"), F.expr("quota % tokens").alias("left")))

    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole").cast("string"), F.col("name")).cast("binary"))
    taken = rows.join(F.broadcast(leaf) if _small(leaf) else leaf, path).withColumn("at", order)
    taken = cut(taken.withColumn("r1", F.substring("at", 1, 2)).withColumn("r2", F.substring("at", 3, 2)))
    cells = taken.where("left > 0 and tokens > 0")

    def boundary(sums: DataFrame, group: list[str], cell: str) -> DataFrame:
        run = Window.partitionBy(*group).orderBy(cell)
        x = sums.withColumn("start", F.coalesce(F.sum("tokens").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        return x.where("start < left and start + tokens >= left").select(*group, F.col(cell).alias(f"{cell}_cut"), (F.col("left") - F.col("start")).alias("left"))

    fine = cut(cells.groupBy(*path, "r1", "r2").agg(F.sum("tokens").cast("long").alias("tokens"), F.first("left").alias("left")))
    one = boundary(fine.groupBy(*path, "r1").agg(F.sum("tokens").cast("long").alias("tokens"), F.first("left").alias("left")), path, "r1")
    inside = fine.drop("left").join(one, path).where("r1 = r1_cut")
    two = boundary(inside, [*path, "r1_cut"], "r2").withColumnRenamed("left", "rest")
    edge = cut(two.select(*path, "r1_cut", "r2_cut", "rest"))

    near = cells.drop("left").join(edge, path)
    ahead = near.where("r1 < r1_cut or (r1 = r1_cut and r2 < r2_cut)").select("__row")
    last = near.where("r1 = r1_cut and r2 = r2_cut")
    run = Window.partitionBy(*path).orderBy("at", "__row").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("start", F.coalesce(F.sum("tokens").over(run), F.lit(0))).where("start < rest").select("__row")
    more = ahead.unionByName(last).withColumn("more", F.lit(1))
    out = taken.join(more, "__row", "left").withColumn("times", F.col("whole") + F.coalesce("more", F.lit(0))).where("times > 0")
    return out.select("__row", *path, F.col("tokens").alias("n_tokens"), "quota", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"))


def _small(leaf: DataFrame, most: int = 50_000) -> bool:
    """True if the table of leaves has at most ``most`` rows: the checked size under which it is broadcast."""
    return leaf.limit(most + 1).count() <= most


def n_tokens(text: str) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for a null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def domain_of(source: str) -> Column:
    """Domain of a source by the number at its end; sources without one are of the domain ``other``."""
    number = F.expr(f"try_cast(nullif(regexp_extract(`{source}`, '([0-9]{{1,9}})$', 1), '') as int)")
    named = F.lit("other")
    for k, domain in enumerate(DOMAINS):
        named = F.when(number % len(DOMAINS) == k, domain).otherwise(named)
    return F.when(number.isNull(), "other").otherwise(named)


# Production parameters: weights of domains, and of languages within each.
DOMAINS = ["web", "books", "code", "reference"]
DOMAIN_WEIGHTS = {"web": 4, "books": 3, "code": 1, "reference": 2}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
SHARE, EPOCHS, SEED = 0.6, 2, "mix"


def _prepared(docs: DataFrame, doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    rows = keyed(docs, doc_id, text, lang, source).toDF("__row", "name", "text", "lang", "source")
    named = [F.coalesce(F.col(c).cast("string"), F.lit(NULL)).alias(c) for c in ("lang", "source")]
    return rows.select("__row", F.coalesce(F.col("name").cast("string"), F.lit("")).alias("name"), n_tokens("text").alias("tokens"), domain_of("source").alias("domain"), *named)


def _weights(spark) -> list[DataFrame | None]:
    langs = [(d, x, w) for d in [*DOMAINS, "other"] for x, w in LANGUAGE_WEIGHTS.items()]
    return [spark.createDataFrame(list(DOMAIN_WEIGHTS.items()), "domain string, weight long"), spark.createDataFrame(langs, "domain string, lang string, weight long"), None]


def chosen(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, quota, epoch): the mixture, a row for each time a document is read."""
    rows = cut(_prepared(docs, doc_id, text, lang, source))
    out = mix(rows, ["domain", "lang", "source"], _weights(docs.sparkSession), share, epochs, seed)
    ids = keyed(docs, doc_id).toDF("__row", "doc_id")
    return out.join(ids, "__row").select("doc_id", "domain", "lang", "source", "n_tokens", "quota", "epoch")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` in the mixture, as often as they are read, with their columns as they are."""
    rows = cut(_prepared(docs, doc_id, text, lang, source))
    out = mix(rows, ["domain", "lang", "source"], _weights(docs.sparkSession), share, epochs, seed).select("__row")
    row = fresh(docs, "__row")
    return docs.withColumn(row, F.monotonically_increasing_id()).join(out.toDF(row), row).select(*[F.col(f"`{c}`") for c in docs.columns])
