"""Packing by concatenate and cut.

All documents, each closed by an end token, stand in one line of tokens.  A first
pass tokenizes partitions and totals them; prefix sums over the totals give each
partition, and so each document, its place in the line.  A second pass cuts the
line into windows of a fixed length; a document that a cut goes through is
recorded as a piece in either window.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, cut, fresh, slices, steady
from .near_dup import _powers, mix

WINDOW, END = 2048, 1
SMALL = 100_000  # partitions up to which the table of their places is broadcast
MAX_WORDS = 400_000
_loaded: dict = {}


class Merges:
    """The tokenizer's merges, applied to many words at once.

    All words of one length are the rows of a matrix.  In each round the best ranked
    pair of every row, the leftmost of equals, becomes one symbol; rows without a
    pair that merges are done.
    """

    def __init__(self, model: dict):
        vocab = model["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level vocabulary
        hidden = [b for b in range(256) if b not in set(shown)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letter[b] + model["end_of_word_suffix"]] for b in range(256)], np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], np.append(order, len(pairs)).astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.none = len(pairs)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``none`` where two symbols don't merge."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def ids(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at ``start`` in ``data`` (bytes), one after another, and how many each has."""
        count, found = np.zeros(len(start), np.int64), []
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            raw = data[start[own][:, None] + np.arange(n)]
            sym = self.inner[raw]
            sym[:, -1] = self.last[raw[:, -1]]
            rank = self.ranks(sym[:, :-1], sym[:, 1:])
            while len(own):
                going = (rank < self.none).any(axis=1) if rank.shape[1] else np.zeros(len(own), bool)
                if not going.all():
                    done = own[~going]
                    count[done] = sym.shape[1]
                    found.append((done, sym[~going].astype(np.uint32)))
                    own, sym, rank = own[going], sym[going], rank[going]
                    if not len(own):
                        break
                row, at = np.arange(len(own)), rank.argmin(axis=1)
                key = sym[row, at] << 20 | sym[row, at + 1]
                new = self.made[np.searchsorted(self.keys, key)]
                left = np.arange(sym.shape[1] - 1)[None, :] <= at[:, None]
                sym = np.where(left, sym[:, :-1], sym[:, 1:])
                sym[row, at] = new
                rank = np.where(left[:, :-1], rank[:, :-1], rank[:, 1:])
                some = np.flatnonzero(at > 0)
                rank[some, at[some] - 1] = self.ranks(sym[some, at[some] - 1], new[some])
                some = np.flatnonzero(at < sym.shape[1] - 1)
                rank[some, at[some]] = self.ranks(new[some], sym[some, at[some] + 1])
        place = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.uint32)
        for own, sym in found:
            flat[place[own][:, None] + np.arange(sym.shape[1])] = sym
        return flat, count


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


SUFFIXES = [b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d"]  # fixed values: word ends that the pattern splits off, in its order
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
_KIND = np.array([SPACE if b == 32 or 9 <= b <= 13 else LETTER if 97 <= b <= 122 or b >= 128 else DIGIT if 48 <= b <= 57 else OTHER for b in range(256)], np.uint8)


def parts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the tokenizer's words in lower-case bytes: runs of letters, single digits, runs of anything else but white space, and the suffixes."""
    kind = np.concatenate(([SPACE], _KIND[data], [SPACE]))
    edge = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    start = np.flatnonzero(edge[:-1] & (kind[1:-1] != SPACE))
    end = np.flatnonzero(edge[1:] & (kind[1:-1] != SPACE)) + 1
    mark = np.flatnonzero((data[start] == 39) & (end - start == 1))
    mark = mark[mark + 1 < len(start)]
    mark = mark[(start[mark + 1] == end[mark]) & (_KIND[data[end[mark]]] == LETTER)]
    for s in SUFFIXES:
        n = len(s) - 1
        fits = end[mark + 1] - start[mark + 1] >= n
        for k in range(n):
            fits &= data[np.minimum(start[mark] + 1 + k, len(data) - 1)] == s[k + 1]
        end[mark[fits]] += n
        start[mark[fits] + 1] += n
        mark = mark[~fits]
    full = end > start
    return start[full], end[full]


class Encoder:
    """Ids of whole texts.

    Texts of ASCII and Western European letters, which no normalization changes but
    for their case, are taken apart and merged as arrays, all words of a batch at
    once; others go through the library.  Words met are known by 64-bit hashes, a
    bounded number of them for as long as the worker lives.
    """

    PLAIN = re.compile("[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")

    def __init__(self, vocabulary: str):
        self.vocabulary, self.loaded = vocabulary, None
        model = json.loads(vocabulary)
        normal = [x["type"] for x in (model.get("normalizer") or {}).get("normalizers", [])]
        self.merges = Merges(model["model"]) if normal == ["NFC", "Replace", "Lowercase"] and model["model"].get("end_of_word_suffix") else None
        self.forget()

    @property
    def tokenizer(self):
        """The library's tokenizer, loaded when the first text needs it."""
        if self.loaded is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.loaded = Tokenizer.from_str(self.vocabulary)
        return self.loaded

    def forget(self) -> None:
        self.keys, self.place, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.store = np.empty(0, np.uint32)

    def plain(self, text: str) -> bool:
        return self.merges is not None and "<|" not in text and self.PLAIN.fullmatch(text) is not None

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        fast = [i for i, t in enumerate(texts) if self.plain(t)]
        slow = sorted(set(range(len(texts))) - set(fast))
        for i, e in zip(slow, self.tokenizer.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False) if slow else ()):
            out[i] = np.array(e.ids, np.uint32).tobytes()
        for i in fast:
            if len(texts[i]) > 1 << 21:
                out[i] = b"".join(self._arrays([b])[0] for b in blocks(texts[i]))
        fast = [i for i in fast if len(texts[i]) <= 1 << 21]
        if fast:
            for i, x in zip(fast, self._arrays([texts[i] for i in fast])):
                out[i] = x
        return out

    def _arrays(self, texts: list[str]) -> list[bytes]:
        raw = [t.lower().encode() for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        start, end = parts(data)
        stop = np.cumsum([len(r) + 1 for r in raw])
        up, down = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        key = mix(mix((sums[end] - sums[start]) * down[start]) + (end - start).astype(np.uint64))
        own, first, which = np.unique(key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, own)
        new = np.ones(len(own), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != own
        if new.any():
            if len(self.keys) > MAX_WORDS:
                self.forget()
                new[:] = True
            flat, count = self.merges.ids(data, start[first[new]], (end - start)[first[new]])
            place = len(self.store) + np.cumsum(count) - count
            self.store = np.concatenate((self.store, flat))
            keys = np.concatenate((self.keys, own[new]))
            order = np.argsort(keys, kind="stable")
            self.keys, self.place, self.count = keys[order], np.concatenate((self.place, place))[order], np.concatenate((self.count, count))[order]
            at = np.searchsorted(self.keys, own)
        place, count = self.place[at][which], self.count[at][which]
        tokens = self.store[ragged(place, count)]
        cuts = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(start, stop)]
        return [tokens[a:b].tobytes() for a, b in zip(np.concatenate(([0], cuts[:-1])).tolist(), cuts.tolist())]


def _tokenizer(vocabulary: str) -> Encoder:
    if _loaded.get("vocabulary") != vocabulary:
        _loaded.update(vocabulary=vocabulary, chunks=Encoder(vocabulary))
    return _loaded["chunks"]


def _tokens(vocabulary: str, end: int, names: list[str]):
    last = np.array([end], np.uint32).tobytes()

    def run(batches):
        chunks, part, before = _tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            keep, texts = list(range(batch.num_columns - 1)), batch.column(batch.num_columns - 1).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < 1_000_000):
                    size += len(texts[to] or "")
                    to += 1
                ids = [x + last for x in chunks.ids([t or "" for t in texts[at:to]])]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, to - at) for i in keep), pa.array([part] * len(ids), pa.int32()), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], names)
                at = to

    return run


def tokenized(docs: DataFrame, keep: list[str], text: str, vocabulary: str, end: int = END) -> DataFrame:
    """Columns ``keep`` and each whole text's ids (with the end), their number and their place within the partition."""
    steady(docs.sparkSession)
    own = fresh(docs, "__text")
    rows = docs.select(*keep, F.col(text).alias(own))
    out = rows.drop(own).schema.add("__part", "integer").add("__before", "long").add("__n", "long").add("__ids", "binary")
    return rows.mapInArrow(_tokens(vocabulary, end, out.names), out)


def pack(docs: DataFrame, keep: list[str], text: str, vocabulary: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """``keep`` and start, length, ids, doc_tokens, sequence_id, offset: one row for each piece.

    ids holds little-endian unsigned 32-bit numbers.  Every token of every row is in
    exactly one piece; sequences are numbered from 0 and all but the last are full,
    so at most window - 1 tokens of padding are needed in all.  A null text counts as
    empty, which leaves its end token alone; repeated rows are packed each.  The
    line's order is that of partitions and rows as read.  The tokens are written to
    the shared folder once, with their places, so a lost task changes nothing.
    An empty table gives no piece.
    """
    line = cut(tokenized(docs, keep, text, vocabulary, end))
    totals = line.groupBy("__part").agg(F.sum("__n").alias("total"))
    bases = totals.select("__part", (F.sum("total").over(Window.orderBy("__part")) - F.col("total")).alias("__base"))  # one row a partition
    bases = cut(bases)
    if bases.count() <= SMALL:
        bases = F.broadcast(bases)
    at = F.col("__base") + F.col("__before")
    line = line.join(bases, "__part").withColumn("__at", at)
    first, last = F.expr(f"__at div {window}"), F.expr(f"(__at + __n - 1) div {window}")
    pieces = line.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    pieces = pieces.withColumn("start", F.greatest(F.col("sequence_id") * window - F.col("__at"), F.lit(0)))
    pieces = pieces.withColumn("length", F.least((F.col("sequence_id") + 1) * window - F.col("__at"), F.col("__n")) - F.col("start"))
    ids = F.expr("substring(__ids, cast(start * 4 + 1 as int), cast(length * 4 as int))")
    return pieces.select(*keep, "start", "length", ids.alias("ids"), F.col("__n").alias("doc_tokens"), "sequence_id", (F.col("__at") + F.col("start") - F.col("sequence_id") * window).alias("offset"))


def digests(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    out = pack(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", vocabulary, window)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def read_vocabulary(path: str | None = None) -> str:
    """Text of the tokenizer's file, read on the driver; by default that of the public word BPE."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        text = f.read()
    json.loads(text)
    return text
