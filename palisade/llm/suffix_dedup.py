"""Removal of every byte that a string of ``length`` bytes occurring elsewhere covers.

The order of suffixes is only needed where a long string can repeat, so it is
approached in three exact steps.

1. Every window of ``length`` bytes names as its anchor the leftmost of the
   smallest hashes of its 32-byte grams.  The anchor follows from the window's
   bytes, so equal windows have equal anchors at equal places, and an occurrence of
   an anchor owns a run of consecutive windows.  Anchors whose gram occurs once
   are done.  Runs that occur twice byte by byte are repeated as a whole.
2. The other runs are dealt into ranges of 32 windows.  All windows of a range
   share a core of ``length`` - 31 bytes, which becomes one symbol; a range is then
   a string of at most 31 bytes, the core, and at most 31 bytes, and its windows
   are the substrings of 32 symbols.  This is a parse with long phrases.
3. Of these strings, shards get Burrows-Wheeler transforms of their own, which are
   merged by refining the interleave: each round moves every entry to the place
   that its symbol gives it, so after t rounds entries are in the order of their
   first t symbols and blocks of entries share them.  The round in which a block
   splits is the common prefix; the blocks left after 32 rounds are the repeated
   intervals.  No suffix is sorted again.

Grams and cores are compared by 64 and 128 bits of hash, the rest byte by byte.

Passages of some number of words that repeat across texts, however few bytes they
have, are found in the same way: every window of that many words names its smallest
gram of 24 words, and the windows of grams that stand in two texts are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, cut, fresh, keyed, slices, steady
from .near_dup import _powers, mix

LENGTH, GRAM, WIDTH = 400, 32, 32
PIECE, PLACE_BITS = 1 << 23, 24
HOT, SHARD, MERGE = 20_000, 5_000, 20_000
WORD_GRAM, WORD_PIECE = 24, 1 << 20
U = np.uint64
TABLE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hash of the 32 bytes from each place on, by doubling."""
    h, s = TABLE[b], 1
    while s < GRAM:
        h = h[:-s] * U(0x9E3779B97F4A7C15) + (h[s:] ^ (h[s:] >> U(29))) * U(0xBF58476D1CE4E5B9 + 2 * s)
        s *= 2
    h ^= h >> U(31)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(30))


def anchors(b: np.ndarray, length: int = LENGTH):
    """(lo, hi, place, gram): windows lo..hi have the anchor at ``place``; arrays over the runs of one text."""
    found, n, at = [], len(b) - length + 1, 0
    u = length - GRAM + 1
    while at < n:
        m = min(PIECE, n - at)
        full = gram_hashes(b[at : at + m + length - 1])
        key = (full >> U(PLACE_BITS)) << U(PLACE_BITS) | np.arange(len(full), dtype=np.uint64)
        size = -(-len(key) // u) * u
        box = np.full(size, ~U(0))
        box[: len(key)] = key
        box = box.reshape(-1, u)
        ahead = np.minimum.accumulate(box, axis=1).ravel()
        back = np.ascontiguousarray(np.minimum.accumulate(box[:, ::-1], axis=1)[:, ::-1]).ravel()
        place = (np.minimum(back[:m], ahead[u - 1 : u - 1 + m]) & U((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], m) - 1
        found.append((first + at, last + at, place[first] + at, full[place[first]].view(np.int64)))
        at += m
    return [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 4


_wordy: np.ndarray | None = None


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a text, the byte at which each starts (and the end), and the first code point of each word and the one after it."""
    global _wordy
    if _wordy is None:
        _wordy = np.fromiter((chr(i).isalnum() or chr(i) == "_" for i in range(0x110000)), bool, 0x110000)
    code = np.frombuffer(data.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    size[(code >= 0xDC80) & (code <= 0xDCFF)] = 1  # a byte that is no character
    inside = np.zeros(len(code) + 2, bool)
    inside[1:-1] = _wordy[code]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return code, np.concatenate(([0], np.cumsum(size))), edge[::2], edge[1::2]


def word_anchors(data: bytes, least: int, piece: int = WORD_PIECE):
    """(a, b, gram): the windows of ``least`` words in the bytes a..b have one anchor; arrays over the runs of one text."""
    found, at, size, u = [], 0, piece, least - WORD_GRAM + 1
    while at < len(data):
        code, byte, start, end = word_places(data[at : at + size])
        whole = at + size >= len(data)
        n = len(start) if whole else len(start) - 1  # the last word may go on
        m = n - least + 1
        if m > 0:
            up, down = _powers(len(code) + 1)
            sums = np.zeros(len(code) + 1, U)
            np.cumsum((code.astype(U) + U(1)) * up[: len(code)], out=sums[1:])
            first, last = start[: n - WORD_GRAM + 1], end[WORD_GRAM - 1 : n]
            gram = mix(mix((sums[last] - sums[first]) * down[first]) + (last - first).astype(U))
            place = np.lib.stride_tricks.sliding_window_view(gram, u).argmin(axis=1) + np.arange(m)
            lo = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            hi = np.append(lo[1:], m) - 1
            found.append((byte[start[lo]] + at, byte[end[hi + least - 1]] + at, gram[place[lo]].view(np.int64)))
        if whole:
            break
        if m > 0:
            at, size = at + int(byte[start[m]]), piece
        else:
            size *= 2
    return [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 3


def _anchor_rows(length: int, words: int):
    """Runs of the windows of ``length`` bytes (even grams) and, without a place, of those of ``words`` words (odd grams), with a hash of each run's bytes."""
    names = ["row", "lo", "hi", "place", "gram", "x"]

    def run(batches):
        held, many = [], 0
        for batch in slices(batches):
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = data or b""
                view = memoryview(data)
                found = []
                if len(data) >= length:
                    lo, hi, place, gram = anchors(np.frombuffer(data, np.uint8), length)
                    found.append((lo, hi, hi + length, place, gram & ~1))
                if words:
                    lo, hi, gram = word_anchors(data, words)
                    found.append((lo, hi, hi, None, gram | 1))
                for lo, hi, end, place, gram in found:
                    x = np.array([xxhash.xxh3_64_intdigest(view[a:e]) for a, e in zip(lo.tolist(), end.tolist())], U).view(np.int64)
                    place = pa.array(place) if place is not None else pa.nulls(len(lo), pa.int64())
                    held.append([pa.array(np.full(len(lo), row, np.int64)), pa.array(lo), pa.array(hi), place, pa.array(gram), pa.array(x)])
                    many += len(lo)
                if many > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], names)
                    held, many = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held)], names)

    return run


def _range_rows(length: int, words: int = 0):
    """Strings of the ranges of windows of each run in column 2: array of (lo, hi, place).

    A run without a place is one of windows of ``words`` words in the bytes lo..hi;
    each of these gives a row with its first byte, the one after it and a hash.
    """
    kind = pa.schema([("row", pa.int64()), ("mid", pa.int64()), ("core", pa.binary()), ("left", pa.binary()), ("right", pa.binary()), ("stop", pa.int64())])
    inner = length - WIDTH + 1

    def run(batches):
        for batch in slices(batches):
            out = ([], [], [], [], [], [])
            for row, data, runs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                view = memoryview(data)
                for x in runs:
                    lo, hi, place = x["lo"], x["hi"], x["place"]
                    if place is None:
                        _, byte, start, end = word_places(data[lo:hi])
                        for a, b in zip((byte[start[: len(start) - words + 1]] + lo).tolist(), (byte[end[words - 1 :]] + lo).tolist()):
                            for c, value in zip(out, (row, a, xxhash.xxh3_128_digest(view[a:b]), None, None, b)):
                                c.append(value)
                        continue
                    for r in range((place - hi) // WIDTH, (place - lo) // WIDTH + 1):
                        mid = place - r * WIDTH
                        d0, d1 = max(0, mid - hi), min(WIDTH - 1, mid - lo)
                        out[0].append(row)
                        out[1].append(mid)
                        out[2].append(xxhash.xxh3_128_digest(view[mid : mid + inner]))
                        out[3].append(bytes(view[mid - d1 : mid]))
                        out[4].append(bytes(view[mid + inner : mid + length - d0]))
                        out[5].append(None)
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind)], schema=kind)
                    out = ([], [], [], [], [], [])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind)], schema=kind)

    return run


def shard_bwt(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and Burrows-Wheeler transform of strings that end with the symbol 0 at ``ends``.

    Ends are smaller than all symbols and differ among themselves by their place.
    Prefix doubling; strings are at most 2 * WIDTH symbols, so it takes a few rounds.
    """
    n = len(text)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    s = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[:-s] = rank[s:]
        key = rank * (n + len(ends) + 70_000) + after + 1
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or s > 4 * WIDTH:
            break
        s *= 2
    return order, text[order - 1]


def merge(bwts: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' transforms in the order of ``rounds`` symbols, and common prefixes.

    Returns the shard of each merged entry and the length of the prefix each entry
    shares with the one before (``rounds`` if that many or more).  Ends never share.
    """
    sizes = [len(b) for b in bwts]
    every = np.concatenate(bwts)
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    shard = np.repeat(np.arange(len(bwts), dtype=np.uint16), sizes)
    n = len(every)
    shared = np.full(n, rounds, np.int64)
    shared[0] = 0
    split = np.zeros(n, bool)
    split[0] = True
    for t in range(rounds):
        # the k-th entry of a shard in the interleave is the k-th of its transform
        by = np.argsort(shard, kind="stable")
        place = np.empty(n, np.int64)
        place[by] = np.arange(n) - np.repeat(base, sizes)
        symbol = every[base[shard] + place]
        block = np.cumsum(split)
        order = np.argsort(symbol, kind="stable")
        c, b = symbol[order], block[order]
        new = np.ones(n, bool)
        new[1:] = (c[1:] != c[:-1]) | (b[1:] != b[:-1]) | (c[1:] == 0)
        shared[new & (shared == rounds)] = t
        shard, split = shard[order], new
    shared[0] = 0
    return shard, shared


def repeated_masks(strings: list[tuple], shard_size: int = SHARD) -> list[int]:
    """For distinct strings (core, left, right, times): bit d is set if the window with d bytes of left is in another place too.

    That is so where the window's suffix shares WIDTH symbols with a neighbour in the
    merged order, or where its string occurs more than once.
    """
    made, cores = [], {}
    for i in range(0, len(strings), shard_size):
        part = strings[i : i + shard_size]
        sizes = np.array([len(x[1]) + len(x[2]) + 2 for x in part])
        ends = np.cumsum(sizes) - 1
        text = np.frombuffer(b"".join(x[1] + b"\0" + x[2] + b"\0" for x in part), np.uint8).astype(np.uint16) + 1
        starts = ends + 1 - sizes
        text[starts + np.array([len(x[1]) for x in part])] = [258 + cores.setdefault(x[0], len(cores)) for x in part]
        text[ends] = 0
        order, bwt = shard_bwt(text, ends)
        owner = np.searchsorted(ends, order)
        made.append((bwt, owner + i, order - starts[owner]))
    shard, shared = merge([m[0] for m in made], WIDTH)
    near = shared >= WIDTH
    again = near | np.append(near[1:], False)
    left, right = (np.array([len(x[k]) for x in strings]) for k in (1, 2))
    often = np.array([x[3] > 1 for x in strings])
    masks = [0] * len(strings)
    for k, (_, owner, offset) in enumerate(made):
        window = (offset <= left[owner]) & (offset + WIDTH <= left[owner] + right[owner] + 1)
        hit = (again[shard == k] | often[owner]) & window
        for o, f in zip(owner[hit].tolist(), offset[hit].tolist()):
            masks[o] |= 1 << (len(strings[o][1]) - f)
    return masks


def _mask_rows(batches):
    """Groups of one core come together; merges as many whole groups as fit."""
    held: list[tuple] = []

    def flush(part):
        core, left, right, _ = zip(*part)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (core, left, right)] + [pa.array(repeated_masks(part), pa.int64())], ["core", "left", "right", "mask"])

    for batch in slices(batches):
        for x in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if len(held) >= MERGE and held[-1][0] != x[0]:
                yield flush(held)
                held = []
            held.append(x)
    if held:
        yield flush(held)


def _cut_rows(length: int, decoded: bool = False):
    """Texts without the runs that are marked; with ``decoded`` (row, text), where bytes of a character that was cut in two go as well."""
    kind = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def table(rows):
        if decoded:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[4].decode("utf-8", "ignore") for r in rows], pa.string())], ["row", "text"])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    def spans(marks):
        ranges = []
        for m in marks or ():
            if m["mask"] is None:
                ranges.append((m["a"], m["b"]))
            else:
                ranges += [(m["a"] - d, m["a"] - d + length) for d in range(WIDTH) if m["mask"] >> d & 1]
        out = []
        for a, b in sorted(ranges):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return out

    def run(batches):
        for batch in slices(batches):
            rows, held = [], 0
            for row, data, marks in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data, gone = data or b"", spans(marks)
                edges = [0, *(x for s in gone for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if gone else data
                rows.append((row, len(data), len(data) - len(kept), [{"start": a, "end": b} for a, b in gone], kept))
                held += len(kept)
                if held > 8_000_000:
                    yield table(rows)
                    rows, held = [], 0
            if rows:
                yield table(rows)

    return run


def _hot_masks(hot: DataFrame) -> DataFrame:
    """Masks of the strings of a core with more than HOT of them, window by window: one count for each, summed map-side."""
    least, most = F.lit(WIDTH - 1) - F.length("right"), F.length("left")
    window = hot.withColumn("d", F.explode(F.sequence(least, most)))
    window = window.withColumn("key", F.struct("core", "d", F.expr("substring(left, length(left) - d + 1, d)").alias("l"), F.expr(f"substring(right, 1, {WIDTH - 1} - d)").alias("r")))
    twice = window.groupBy("key").agg(F.sum("n").alias("times")).where("times > 1").select("key")
    return window.join(twice, "key").groupBy("core", "left", "right").agg(F.bit_or(F.expr("shiftleft(1L, d)")).alias("mask"))


def touched(rows: DataFrame, length: int = LENGTH, hot: int = HOT, words: int = 0, decoded: bool = False) -> tuple[DataFrame, Rows]:
    """``removed_spans`` (with ``decoded`` row and text) of the rows that lose a byte, and their row numbers."""
    if 0 < words < WORD_GRAM:
        raise ValueError(f"words must be {WORD_GRAM} or more")
    if length < 2 * WIDTH:
        raise ValueError(f"length must be {2 * WIDTH} or more")
    data = rows.select(F.col("__row").alias("row"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    marks = cut(data.mapInArrow(_anchor_rows(length, words), "row long, lo long, hi long, place long, gram long, x long"))
    # marks whose gram stands elsewhere, with copies of a run folded
    grams = marks.groupBy("gram").agg(F.count("*").alias("t"), F.min("row").alias("first"), F.max("row").alias("last"))
    grams = grams.where("gram & 1 = 0 and t > 1 or gram & 1 = 1 and first < last").select("gram")
    grams = cut(grams)  # as a table of its own, so that the join can split a gram that many runs have
    marks = cut(marks.join(grams, "gram", "left_semi"))
    kinds = marks.groupBy("gram", "x").agg(F.count("*").alias("n"), *[f(F.struct("row", "lo", "hi", "place")).alias(x) for f, x in ((F.min, "rep"), (F.max, "top"))])
    grams = kinds.groupBy("gram").agg(F.count("*").alias("kinds"))
    wordy = F.expr("gram & 1 = 1")
    again = F.when(wordy, F.col("rep.row") < F.col("top.row")).otherwise(F.col("n") > 1)
    kinds = cut(kinds.join(grams, "gram").select("gram", "x", "rep", "top", "kinds", again.alias("again"), wordy.alias("wordy")))
    # runs that occur again as a whole, and runs of words of which a part may
    met = marks.join(kinds.where("again or wordy").select("gram", "x", "again"), ["gram", "x"])
    met = cut(met.select("row", "lo", "hi", "place", "again")) if words else met
    end = F.when(F.col("place").isNull(), F.col("hi")).otherwise(F.col("hi") + length)
    none = F.lit(None).cast("long")
    whole = met.where("again").select("row", F.col("lo").alias("a"), end.alias("b"), none.alias("mask"))

    runs = kinds.where("kinds > 1 and not wordy").select("rep.row", F.struct("rep.lo", "rep.hi", "rep.place").alias("run"))
    if words:  # copies of a run in two texts stand for all of them
        runs = runs.unionByName(met.where("not again").select("row", F.struct("lo", "hi", "place").alias("run")))
        ends = kinds.where("kinds > 1 and wordy and again").select(F.explode(F.array("rep", "top")).alias("rep"))
        runs = runs.unionByName(ends.select("rep.row", F.struct("rep.lo", "rep.hi", "rep.place").alias("run")))
    runs = cut(runs.groupBy("row").agg(F.collect_list("run").alias("runs")))
    every_range = cut(Rows(runs, "row").among(data, "row").join(runs, "row").select("row", "data", "runs").mapInArrow(_range_rows(length, words), "row long, mid long, core binary, left binary, right binary, stop long"))
    ranges = every_range.where("stop is null").drop("stop")
    s = ["core", "left", "right"]
    strings = ranges.groupBy(*s).agg(F.count("*").alias("n"))
    cores = strings.groupBy("core").agg(F.count("*").alias("kinds"), F.sum("n").alias("t")).where("t > 1")
    strings = cut(strings.join(cores.drop("t"), "core"))
    merged = strings.where(f"kinds <= {hot}").select(*s, "n")
    merged = merged.repartition("core").sortWithinPartitions("core").mapInArrow(_mask_rows, "core binary, left binary, right binary, mask long")
    masks = merged.unionByName(_hot_masks(strings.where(f"kinds > {hot}").select(*s, "n"))).where("mask <> 0")
    part = ranges.join(masks, s).select("row", F.col("mid").alias("a"), none.alias("b"), "mask")
    if words:
        windows = every_range.where("stop is not null").select("core", "row", F.col("mid").alias("a"), F.col("stop").alias("b"), none.alias("mask"))
        shared = windows.groupBy("core").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first < last").select("core")
        part = part.unionByName(windows.join(shared, "core", "left_semi").drop("core"))
    every = cut(whole.unionByName(part).groupBy("row").agg(F.collect_list(F.struct("a", "b", "mask")).alias("marks")))
    numbers = Rows(every, "row")
    out = numbers.among(data, "row").join(every, "row").select("row", "data", "marks")
    return out.mapInArrow(_cut_rows(length, decoded), "row long, text string" if decoded else SPANS), numbers


SPANS = "key long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def removed_spans(rows: DataFrame, length: int = LENGTH, hot: int = HOT, words: int = 0) -> DataFrame:
    """(key, n_bytes, n_removed, spans, kept) for rows of (__row, text).

    key is ``__row``; spans are the maximal removed runs of bytes, ends exclusive;
    kept is what is left, as bytes.  A byte goes if a string of ``length`` bytes
    that covers it starts anywhere else as well, in the same or another text;
    repeated rows count as texts of their own, and strings are judged on the input.
    Null and empty texts and those shorter than ``length`` bytes stay as they are.
    An empty table gives an empty one.  ``length`` is at least 2 * WIDTH.

    With ``words``, bytes of that many words in a row that stand in another text as
    well go too, byte by byte the same from the first letter to the last.  Words are
    runs of letters, digits and underscores.

    Cores with more than ``hot`` distinct strings, which no single merge should hold,
    are counted window by window instead, with the same result.
    """
    found, numbers = touched(rows, length, hot, words)
    data = F.coalesce("text", F.lit("")).cast("binary")
    rest = numbers.apart(rows, "__row").select(F.col("__row").alias("key"), F.octet_length(data).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"), data.alias("kept"))
    return found.unionByName(rest)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows = keyed(docs, doc_id, text).toDF("__row", "doc_id", "text")
    found = cut(touched(rows.select("__row", "text"), length)[0].select(F.col("key").alias("__row"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")))
    data = F.coalesce("text", F.lit("")).cast("binary")
    rest = Rows(found, "__row").apart(rows, "__row").select("doc_id", F.octet_length(data).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(data, 256).alias("kept_sha256"))
    ids = rows.select("__row", "doc_id", F.octet_length(data).cast("long").alias("n_bytes"))
    return rest.unionByName(ids.join(found, "__row").drop("__row"))


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, words: int = 0) -> DataFrame:
    """``docs`` with the removed bytes gone from ``text``; all rows and columns stay.

    Bytes of a character that was cut in two go as well; a null text stays null.
    Columns of any name may be there.
    """
    steady(docs.sparkSession)
    row, new = fresh(docs, "__row"), fresh(docs, "__text")
    found, numbers = touched(keyed(docs, text).toDF("__row", "text"), length, words=words, decoded=True)
    found = found.toDF(row, new)
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    cut_ = numbers.among(numbered, row).drop(text).join(found, row).withColumnRenamed(new, text).select(*[F.col(f"`{c}`") for c in docs.columns])
    return numbers.apart(numbered, row).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(cut_)
