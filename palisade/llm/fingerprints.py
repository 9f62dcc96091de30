"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each shingle of five words is hashed once; the top bits of the hash name one of
BINS bins and a bin keeps its smallest hash.  An empty bin asks bins in
the order in which an endless sequence of hashes of (bin, attempt) names them first,
and takes the value of the first that isn't empty (optimal densification).  Four low-order bits of each value are stored, one hex
digit a bin, and likeness is corrected for bits that agree by chance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHINGLE, BINS, BITS = 5, 128, 4
TRIES = 16  # bins that are asked before all others are looked at
BLOCK, SUPER = 256, 1000
QUANTILES = 4096  # ranges of doc_id with about as many rows each, which blocks divide further
SMALL = 100_000  # rows of the table of blocks up to which it is broadcast
SEPARATORS = "[^\\p{L}\\p{N}_]+"


def probes(bins: int = BINS) -> list[list[int]]:
    """For each bin the others in the order in which the hashes of (bin, 1), (bin, 2), ... name them first; constants, worked out on the driver."""
    table = []
    for j in range(bins):
        seen, t = [j], 0
        while len(seen) < bins:
            t += 1
            x = (j * 0x9E3779B97F4A7C15 + t * 0xD1B54A32D192ED03) % 2**64
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
            if (at := (x >> 32) % bins) not in seen:
                seen.append(at)
        table.append(seen[1:])
    return table


def _constant(table: list[list[int]], kind: str = "int") -> Column:
    """A table of numbers of one width as a flat array, folded into one literal at planning."""
    return F.split(F.lit(",".join(str(x) for row in table for x in row)), ",").cast(f"array<{kind}>")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(text: Column, order: list[list[int]], bins: int = BINS) -> Column:
    """An array of ``bins`` numbers below 16, empty for a text without a word.

    Words are runs of letters, digits and underscores, lower-cased; fewer than five
    are one shingle.
    """
    shift = 64 - int(math.log2(bins))
    bin_of = lambda x: F.shiftrightunsigned(x, shift).cast("int")
    soon, late = _constant([row[:TRIES] for row in order]), _constant([row[TRIES:] for row in order])

    def hashes(w: Column) -> Column:
        n = F.size(w)
        shingle = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])
        many = F.sort_array(F.transform(F.sequence(F.lit(0), n - SHINGLE), shingle))
        return F.when(n >= SHINGLE, many).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<long>"))

    def least(s: Column) -> Column:
        """Low-order bits of the smallest hash of each bin that has one, by bin; hashes are in order, so those of a bin stand together."""
        first = F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))
        return F.map_from_entries(F.transform(first, lambda x: F.struct(bin_of(x), x.bitwiseAND(F.lit(2**BITS - 1)).cast("int"))))

    def dense(v: Column) -> Column:
        here = lambda p: F.get(v, p)
        hit = lambda ps: here(F.get(F.filter(ps, lambda p: here(p).isNotNull()), F.lit(0)))
        part = lambda flat, j, n: F.slice(flat, j * n + 1, F.lit(n))
        return F.transform(v, lambda x, j: F.coalesce(x, hit(part(soon, j, TRIES)), hit(part(late, j, bins - 1 - TRIES))))

    spread = lambda m: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda j: F.try_element_at(m, j))
    words = F.filter(F.split(F.lower(text), SEPARATORS), lambda x: x != "")
    full = lambda s: _let(_let(_let(s, least), spread), dense)
    return _let(_let(words, hashes), lambda s: F.when(F.size(s) > 0, full(s)).otherwise(F.array().cast("array<int>")))


def packed(values: str | Column) -> Column:
    """A fingerprint as text: one lower-case hex digit for each bin."""
    col = F.col(values) if isinstance(values, str) else values
    return F.lower(F.array_join(F.transform(col, lambda x: F.hex(x)), ""))


def likeness(a: str, b: str, bins: int = BINS) -> Column:
    """Estimated Jaccard likeness, from 0 to 1, corrected for chance; two texts without words are alike, one is like no other."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (same / bins - chance) / (1 - chance)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(value)


def _blocked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``block``, a number that grows with the id and has about BLOCK rows; null ids are block -1.

    Up to QUANTILES quantiles of the ids, all that reaches the driver, split them into
    ranges, and each range is divided into blocks of equal width.  However unevenly
    ids lie, a block of several ids has no more rows than a range; an id's rows stay together.
    """
    ask = [(j + 1) / QUANTILES for j in range(QUANTILES - 1)]
    low, high, n, found = rows.agg(F.min("id"), F.max("id"), F.count("*"), F.percentile_approx("id", ask, 10 * QUANTILES)).first()
    low, high = low or 0, high or 0
    ranges = max(1, min(QUANTILES, -(-n // BLOCK)))
    each = max(1, -(-n // (ranges * BLOCK)))
    starts = sorted({low, *(found[i * QUANTILES // ranges - 1] for i in range(1, ranges) if found)})
    widths = [b - a for a, b in zip(starts, [*starts[1:], high + 1])]
    start, width = _constant([starts], "long"), _constant([widths], "double")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(starts).bit_length()))])
    later = lambda at, step: F.when(F.get(start, at + step) <= F.col("id"), at + step).otherwise(at)
    range_of = F.aggregate(steps, F.lit(0), later)
    inside = lambda q: F.floor((F.col("id").cast("double") - F.get(start, q).cast("double")) / F.get(width, q) * each).cast("long")
    block = _let(range_of, lambda q: q.cast("long") * each + F.least(F.lit(each - 1).cast("long"), F.greatest(F.lit(0).cast("long"), inside(q))))
    return rows.withColumn("block", F.when(F.col("id").isNull(), F.lit(-1).cast("long")).otherwise(block))


def _following(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text, block), and once more, as the tail of the block before, the first rows of every block.

    Blocks are put in order in two levels, so no task sees more than one row for
    SUPER blocks or SUPER rows; after the last block comes the first.
    """
    blocks = rows.groupBy("block").agg(F.min("id").alias("first")).withColumn("super", F.floor(F.col("block") / SUPER))
    by = Window.partitionBy("super").orderBy("block")
    lead = lambda w: F.lead(F.struct("block", "first")).over(w)
    inner = blocks.withColumn("next", lead(by))
    supers = blocks.groupBy("super").agg(F.min_by(F.struct("block", "first"), "block").alias("head"))
    order = Window.orderBy("super")
    supers = supers.withColumn("after", F.coalesce(F.lead("head").over(order), F.first("head").over(order)))
    links = inner.join(supers.select("super", "after"), "super").select(F.col("block").alias("before"), F.coalesce("next", "after").alias("next"))
    links = links.select("before", F.col("next.block").alias("block"), F.col("next.first").alias("first"))
    links = cut(links)
    if links.count() <= SMALL:
        links = F.broadcast(links)
    tails = rows.join(links, (rows["block"] == links["block"]) & rows["id"].eqNullSafe(links["first"])).select("id", "text", F.col("before").alias("block"))
    return rows.withColumn("tail", F.lit(False)).unionByName(tails.withColumn("tail", F.lit(True)))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last quarter replaced by as many first characters of the
    next document, or all of them if it is shorter; next is by doc_id, nulls first,
    rows of one doc_id by text, and after the last the first (a lone row follows
    itself).  A null text counts as empty.  Blocks of doc_id of about BLOCK rows are
    dealt out once; only each block's first rows go to a second block as well.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    table = probes()
    every = _following(_blocked(rows)).withColumn("fp", fingerprint(F.col("text"), table))
    order = Window.partitionBy("block").orderBy("tail", F.asc_nulls_first("id"), "text")
    every = every.withColumn("next", F.lead("text").over(order)).withColumn("next_fp", F.lead("fp").over(order)).where("not tail")
    length = F.char_length("text")
    quarter = F.expr("char_length(text) div 4").cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (length - quarter).cast("int")), F.substring(F.col("next"), F.lit(1), quarter))
    every = every.withColumn("edited", edited).withColumn("efp", fingerprint(F.col("edited"), table))
    return every.select(
        F.col("id").alias("doc_id"), length.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), packed("fp").alias("fingerprint"), packed("efp").alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )
