"""Near-duplicate classes by DartMinHash.

A document is a weighted set: its shingles of five words, weighted by how often
they occur.  Unit by unit of weight, each shingle throws darts at the ranks below
the document's threshold, as a Poisson process seeded by the shingle alone; each
dart names one of K coordinates, and the earliest dart of a coordinate is the
signature there.  The threshold makes the darts of a document about K(ln K + 4)
in all, however long it is.  Bands of coordinates give candidates, which are
compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, blocks, cut, fresh, keyed, slices, steady
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 22, 5
#: A block of a bucket holds about BLOCK members and BLOCK_UNITS units (1 MB) at most.
HUB_BANDS, BLOCK, BLOCK_UNITS = 4, 512, 1 << 17
K = BANDS * ROWS
DARTS = int(K * (np.log(K) + 4))
U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
ODD = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (multiply and shift)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BASE = 0x5851F42D4C957F2D
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, ``n`` at least."""
    if len(_tables.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps)
    return _tables["up"], _tables["down"]


def word_ids(text: str) -> np.ndarray:
    """64-bit numbers of the words of a text, lower-cased: polynomial hashes over code points."""
    if "word" not in _tables:
        _tables["word"] = np.fromiter((chr(i).isalnum() or chr(i) == "_" for i in range(0x110000)), bool, 0x110000)
    out = []
    for block in blocks(text):
        code = np.frombuffer(block.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.zeros(len(code) + 2, bool)
        inside[1:-1] = _tables["word"][code]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        if len(edge):
            up, down = _powers(len(code) + 1)
            sums = np.zeros(len(code) + 1, np.uint64)
            np.cumsum((code.astype(np.uint64) + U(1)) * up[: len(code)], out=sums[1:])
            start, end = edge[::2], edge[1::2]
            out.append(mix((sums[end] - sums[start]) * down[start]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def units(ids: np.ndarray) -> np.ndarray:
    """Units of weight of a document: the i-th occurrence of a shingle is one number, the same in every document.

    Fewer than five words are one shingle; no word gives none.
    """
    if not len(ids):
        return ids
    width = min(SHINGLE, len(ids))
    h = np.full(len(ids) - width + 1, width, np.uint64)
    for i in range(width):
        h += ids[i : len(ids) - width + 1 + i] * ODD[i]
    h = mix(h)
    h.sort()
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    place = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return np.where(place > 0, mix(h + place.astype(np.uint64) * GOLD), h)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Darts of the earliest rank, by coordinate: one row of K numbers for each set (none may be empty)."""
    d, best, sign = len(sets), np.full(len(sets) * K, np.inf), np.zeros(len(sets) * K, np.uint64)
    size = np.array([len(s) for s in sets])
    want, todo = np.full(d, float(DARTS)), np.arange(d)
    while len(todo):
        own = np.repeat(todo, size[todo])
        unit = np.concatenate([sets[i] for i in todo])
        limit = np.repeat((want / size)[todo], size[todo])
        rank, k = np.zeros(len(unit)), 0
        while len(unit):
            k += 1
            dart = mix(unit + U(k * 0xD1B54A32D192ED03 % 2**64))
            rank = rank - np.log(((dart >> U(11)).astype(np.float64) + 1) * 2.0**-53)
            hit = rank < limit
            own, unit, limit, rank, dart = own[hit], unit[hit], limit[hit], rank[hit], mix(dart[hit] + GOLD)
            cell = own * K + (dart % U(K)).astype(np.int64)
            np.minimum.at(best, cell, rank)
            won = best[cell] == rank
            sign[cell[won]] = dart[won]
        todo = todo[np.isinf(best.reshape(d, K)[todo]).any(axis=1)]
        want[todo] *= 2
    return sign.reshape(d, K)


def _bands(sign: np.ndarray) -> np.ndarray:
    parts = sign.reshape(len(sign), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * GOLD, parts.shape[:2])
    for i in range(ROWS):
        key = mix(key + parts[:, :, i])
    return key.view(np.int64)


def _sign(batches):
    def out(rows, same, sets):
        keys = np.zeros((len(rows), BANDS), np.int64)
        full = [i for i, s in enumerate(sets) if len(s)]
        if full:
            keys[full] = _bands(signatures([sets[i] for i in full]))
        lists = pa.ListArray.from_arrays(pa.array([0, *np.cumsum([BANDS if len(s) else 0 for s in sets])], pa.int32()), pa.array(keys[full].ravel()))
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(same, pa.binary()), lists], ["__row", "same", "bands"])

    for batch in slices(batches):
        rows, same, sets = batch.column(0).to_pylist(), [], []
        for text in batch.column(1).to_pylist():
            ids = word_ids(text or "")
            sets.append(units(ids))
            same.append(xxhash.xxh3_128_digest(ids.tobytes()) if len(ids) else xxhash.xxh3_128_digest("\0" + (text or "")))
        order = sorted(range(len(rows)), key=lambda i: len(sets[i]))  # sets of like size take like rounds
        at = 0
        while at < len(order):
            to, held = at, 0
            while to < len(order) and held < 200_000:
                held += len(sets[order[to]]) + DARTS
                to += 1
            yield out([rows[i] for i in order[at:to]], [same[i] for i in order[at:to]], [sets[i] for i in order[at:to]])
            at = to


def _units(batches):
    for batch in slices(batches):
        rows, sets = batch.column(0).to_pylist(), [np.sort(units(word_ids(t or ""))).tobytes() for t in batch.column(1).to_pylist()]
        for i in range(0, len(rows), 500):
            some = sets[i : i + 500]
            yield pa.RecordBatch.from_arrays([pa.array(rows[i : i + 500], pa.int64()), pa.array(some, pa.binary()), pa.array([len(x) // 8 for x in some], pa.int64())], ["row", "units", "size"])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard likeness of two sorted unit sets."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(both) - common)


def _verify(least: float):
    def verify(batches):
        for batch in slices(batches):
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            keep = [similarity(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) >= least for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    rows = pairs.join(sets.select(F.col("row").alias("a"), F.col("units").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("units").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(_verify(least), "a long, b long")


def _with_components(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (rep, comp) with the components of ``links`` in place of what it says, where there are any."""
    found = components(links).select(F.col("node").alias("rep"), F.col("comp").alias("__c"))
    return comp.join(found, "rep", "left").select("rep", F.coalesce("__c", "comp").alias("comp"))


def _shared(sets: list[np.ndarray], many: int, width: int = 4096) -> np.ndarray:
    """How many units each of the first ``many`` sets shares with each of the others, or each two of all if there are no others.

    Products of slices of their incidence matrix, without units that one set alone has.
    """
    n, size = len(sets), [len(s) for s in sets]
    own = np.repeat(np.arange(n), size)
    unit, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    kept = count[which] > 1
    own, at = own[kept], column[which[kept]]
    order = np.argsort(at, kind="stable")
    own, at = own[order], at[order]
    other = slice(many if many < n else 0, n)
    total = np.zeros((many, len(range(*other.indices(n)))), np.float32)
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        lo, hi = np.searchsorted(at, (first, first + width))
        part = np.zeros((n, width), np.float32)
        part[own[lo:hi], at[lo:hi] - first] = 1
        total += part[:many] @ part[other].T
    return total


def _compare(least: float):
    """Links between the members of one block, or of one and of another, that aren't in one class yet; one is enough to join two classes."""

    def run(batches):
        for batch in slices(batches, 1):
            a, b = [], []
            for row in batch.to_pylist():
                x, y = row["x"], row["y"] or []
                members = x + y
                sets = [np.frombuffer(m["units"], np.uint64) for m in members]
                rep, cls = [m["rep"] for m in members], np.array([m["comp"] for m in members])
                size = np.array([len(s) for s in sets], np.float64)
                both, at = _shared(sets, len(x)).astype(np.float64), len(x) if y else 0
                near = (both >= least * (size[: len(x), None] + size[None, at:] - both) - 1e-9) & (cls[: len(x), None] != cls[None, at:])
                top: dict[int, int] = {}

                def find(c):
                    while c in top:
                        c = top[c]
                    return c

                for i, k in zip(*np.nonzero(near if y else np.triu(near))):
                    p, q = find(int(cls[i])), find(int(cls[at + k]))
                    if p != q:
                        top[max(p, q)] = min(p, q)
                        a.append(rep[i])
                        b.append(rep[at + k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _blocked(now: DataFrame) -> DataFrame:
    """``now`` (key, rep, comp, size) without buckets of one class, with ``block``, ``rest`` and ``blocks``.

    Where a bucket needs several blocks, its largest class has blocks of its own: the
    blocks below ``rest`` hold all other members.
    """

    def parts(n, size):
        return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_UNITS)).cast("int")

    groups = now.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    most = F.max(F.struct("size", "n", "comp"))
    mixed = groups.groupBy("key").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("size").alias("all"), most.alias("most")).where("classes > 1")
    whole = parts(F.col("n"), F.col("all"))
    rest = F.when(whole > 1, parts(F.col("n") - F.col("most.n"), F.col("all") - F.col("most.size"))).otherwise(1)
    tops = F.when(whole > 1, parts(F.col("most.n"), F.col("most.size"))).otherwise(0)
    mixed = mixed.select("key", F.col("most.comp").alias("top"), rest.alias("rest"), tops.alias("tops"))
    apart = (F.col("tops") > 0) & (F.col("comp") == F.col("top"))
    place = F.xxhash64("rep")
    block = F.when(apart, F.col("rest") + F.pmod(place, F.greatest("tops", F.lit(1)))).otherwise(F.pmod(place, F.col("rest"))).cast("int")
    return now.join(mixed, "key").select("key", "rep", "comp", block.alias("block"), "rest", (F.col("rest") + F.col("tops")).alias("blocks"))


def _meetings(packed: DataFrame) -> DataFrame:
    """(x, y) from (key, rest, blocks, block, x): each block below ``rest`` alone, with y null, and with each later block of its bucket."""
    alone = packed.where("block < rest").select("x", F.lit(None).cast(packed.schema["x"].dataType).alias("y"))
    left = packed.where("block < rest and block + 1 < blocks").select("key", F.col("block").alias("i"), F.explode(F.expr("sequence(block + 1, blocks - 1)")).alias("j"), "x")
    right = packed.where("block > 0").select("key", F.explode(F.expr("sequence(0, least(block, rest) - 1)")).alias("i"), F.col("block").alias("j"), F.col("x").alias("y"))
    return alone.unionByName(left.join(right, ["key", "i", "j"]).select("x", "y"))


def _across(bucket: DataFrame, comp: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links within buckets (key, rep) that hold more than one class: all members against all of other classes, block by block."""
    now = cut(bucket.join(comp, "rep").join(sets.select(F.col("row").alias("rep"), "size"), "rep"))
    rows = _blocked(now)
    # the same members in the same classes meet in many bands: once is enough
    small = rows.where("blocks = 1").groupBy("key").agg(F.array_sort(F.collect_list("rep")).alias("reps")).groupBy("reps").agg(F.min("key").alias("key")).select("key")
    rows = rows.where("blocks > 1").unionByName(rows.where("blocks = 1").join(small, "key", "left_semi"))
    rows = rows.join(sets.select(F.col("row").alias("rep"), "units"), "rep")
    packed = cut(rows.groupBy("key", "rest", "blocks", "block").agg(F.collect_list(F.struct("rep", "comp", "units")).alias("x")))
    return _meetings(packed).mapInArrow(_compare(least), "a long, b long").distinct()


def classes(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(__row, cls) for rows of (__row, text): cls is the smallest __row of the class.

    Texts with the same words in the same order (letter case and punctuation
    aside) are one class; a null text counts as empty, and texts without a word
    are alike only when they are equal.  Classes are joined by links of weighted
    Jaccard likeness ``least`` or more between five-word shingles.  With 22 bands
    of 5 coordinates a pair at 0.8 is missed once in 6,000 times, and less often
    above.

    Copies are folded first.  In the buckets of HUB_BANDS bands every member is
    compared with one hub, which joins groups of very like texts at the cost of a
    comparison each.  Buckets of any band that still hold more than one class are
    then compared whole, in blocks of about BLOCK members: the tasks get pairs of
    blocks, and of pairs of texts only links leave them.  Blocks of a bucket's largest
    class meet the others, not each other.  So no pair that shares a bucket is left
    uncompared unless it is in one class already, and nothing is capped.  An empty table gives an empty one.
    """
    signed = cut(rows.select("__row", "text").mapInArrow(_sign, "__row long, same binary, bands array<long>"))
    rep = signed.groupBy("same").agg(F.min("__row").alias("rep"))
    member = cut(signed.select("__row", "same").join(rep, "same").select("__row", "rep"))
    bucket = signed.join(member.where("__row = rep").select("__row"), "__row", "left_semi").select(F.col("__row").alias("rep"), F.posexplode("bands").alias("band", "key"))
    full = bucket.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    bucket = cut(bucket.join(full, "key").select("key", "band", "rep"))
    needed = Rows(bucket.select("rep"), "rep")
    sets = cut(needed.among(rows.select("__row", "text"), "__row").mapInArrow(_units, "row long, units binary, size long"))

    comp = bucket.select("rep", F.col("rep").alias("comp")).distinct()
    now = bucket.where(F.col("band") < HUB_BANDS)
    hub = now.groupBy("key").agg(F.min_by("rep", F.xxhash64("rep")).alias("hub"))
    pairs = now.join(hub, "key").where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    links = cut(_similar(pairs, sets, least))
    comp = cut(_with_components(comp, links), needed.most)
    links = links.unionByName(cut(_across(bucket.select("key", "rep"), comp, sets, least)))
    comp = _with_components(comp.select("rep", F.col("rep").alias("comp")), links)
    return member.join(comp, "rep", "left").select("__row", F.coalesce("comp", "rep").alias("cls"))


def deduplicate(docs: DataFrame, text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The first row of each class of ``classes``, with all columns of ``docs`` as they are."""
    found = cut(classes(keyed(docs, text).toDF("__row", "text"), least))
    steady(docs.sparkSession)
    row = fresh(docs, "__row")
    return Rows(found.where("__row <> cls").select("__row"), "__row").apart(docs.withColumn(row, F.monotonically_increasing_id()), row).drop(row)


def class_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, kept) for every row; class_id is the smallest doc_id of the class, null if it has none, and its row the one kept (of several the first)."""
    rows = keyed(docs, doc_id, text).toDF("__row", "doc_id", "text")
    found = cut(classes(rows.select("__row", "text"), least).join(rows.select("__row", "doc_id"), "__row"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))
    name = found.groupBy("cls").agg(first.alias("first")).select("cls", F.col("first.doc_id").alias("class_id"), F.col("first.__row").alias("__kept"))
    return found.join(name, "cls").select("doc_id", "class_id", (F.col("__row") == F.col("__kept")).alias("kept"))
