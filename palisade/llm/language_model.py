"""Document scoring with counts of all tokens and a gated recurrent model of words.

The HEAD most frequent tokens, the end and count ranges of all others are units,
SIDE to a class.  A unit's probability is that of its class after the text so far,
times that of the unit in its class after the text so far (a class-factored
softmax); a token of a count range takes its share of the range's counts.  The
history is carried by a gated recurrent unit, trained on whole texts of all
training rows with truncated backpropagation through time.  Its state goes on from
window to window, so the score is that of the complete document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, keyed, remainder, slices
from .near_dup import _powers, mix

U = np.uint64
END = 1  # number of the end of a text
SIDE = 32  # classes, and units of each
CLASSES = SIDE * SIDE
HEAD = CLASSES - SIDE  # most frequent tokens with a unit of their own; the last class has the end and the count ranges
END_UNIT, RARE = HEAD, CLASSES - 1
HIDDEN = 16
WINDOW, RATE = 32, 0.02
#: Training goes in ROUNDS a pass, between which tasks' weights are averaged; each task has TASK_TOKENS in a pass or more.
ROUNDS, TASKS, TASK_TOKENS = 4, 64, 2_000_000
#: Passes over all training tokens, however many there are.
PASSES = 1
#: Texts that are read side by side, and tokens of each that are laid out at a time; texts of more than LONG tokens come first.
LANES, SPAN, LONG = 256, 512, 1024
SCORE_LANES = 1024


def token_ids(text: str) -> np.ndarray:
    """64-bit numbers of a text's tokens (runs of anything but ASCII white space, A-Z lower-cased), then that of the end."""
    out = []
    for block in blocks(text):
        code = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where((code >= 65) & (code <= 90), code + 32, code)
        inside = np.zeros(len(code) + 2, bool)
        inside[1:-1] = (code != 32) & ((code < 9) | (code > 13))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        if len(edge):
            up, down = _powers(len(code) + 1)
            sums = np.zeros(len(code) + 1, U)
            np.cumsum((code.astype(U) + U(1)) * up[: len(code)], out=sums[1:])
            start, end = edge[::2], edge[1::2]
            out.append(mix(mix((sums[end] - sums[start]) * down[start]) + (end - start).astype(U)))
    return np.concatenate([*out, np.array([END], U)])


def _distinct(batches):
    """(part, token, n) of a partition: its distinct tokens and how often training texts have them."""
    part, keys, counts, held = None, [], [], 0

    def fold():
        key, n = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        return [key[first]], [np.add.reduceat(n, first)]

    def rows():
        key, n = (x[0] for x in fold())
        for i in range(0, len(key), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[i : i + 200_000]), part, np.int64)), pa.array(key[i : i + 200_000].view(np.int64)), pa.array(n[i : i + 200_000])], ["part", "token", "n"])

    for batch in slices(batches):
        for p, learn, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            part = p
            ids = token_ids(text or "")
            keys.append(ids)
            counts.append(np.full(len(ids), int(learn), np.int64))
            held += len(ids)
            if held > 1_000_000:
                keys, counts = fold()
                held = len(keys[0]) // 2
    if keys:
        yield from rows()


# --- the recurrent model ---------------------------------------------------------


def laid(texts, lanes: int = LANES, span: int = SPAN):
    """Texts laid end to end in lanes, ``span`` tokens at a time: a lane that ends takes the next text, so all are busy to the end.

    Yields the lanes in use, what came before each token (CLASSES at a text's start),
    the tokens, whether a text starts, and the number of the text (-1 where there is
    none); arrays of a row for each lane.
    """
    source, rest, last = enumerate(texts), [None] * lanes, np.full(lanes, CLASSES)
    while True:
        units, number, start = np.zeros((lanes, span), np.int64), np.full((lanes, span), -1), np.zeros((lanes, span), bool)
        for k in range(lanes):
            at = 0
            while at < span:
                if rest[k] is None and (new := next(source, None)) is not None:
                    rest[k] = (*new, 0)
                if rest[k] is None:
                    break
                which, text, done = rest[k]
                n = min(span - at, len(text) - done)
                units[k, at : at + n], number[k, at : at + n], start[k, at] = text[done : done + n], which, not done
                at, rest[k] = at + n, None if done + n == len(text) else (which, text, done + n)
        rows = np.flatnonzero(number[:, 0] >= 0)
        if not len(rows):
            return
        before = np.empty_like(units)
        before[:, 1:], before[:, 0], last = units[:, :-1], last, units[:, -1]
        before[start] = CLASSES
        yield rows, before[rows], units[rows], start[rows], number[rows]


class Gru:
    """Embedding, one gated recurrent layer, a softmax over classes and one over the units of each class, in numpy."""

    NAMES = ("x", "u", "b", "v", "c", "w", "d")

    def __init__(self, seed: int = 11, counts: np.ndarray | None = None):
        r = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *shape: (r.standard_normal(shape) * 0.15).astype(np.float32)
        self.x, self.u, self.b = draw(CLASSES + 1, 3 * HIDDEN), draw(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32)
        n = (np.ones(CLASSES) if counts is None else counts + 0.5).reshape(SIDE, SIDE)  # it starts from the units' counts
        self.v, self.c = draw(HIDDEN, SIDE), np.log(n.sum(axis=1) / n.sum()).astype(np.float32)
        self.w, self.d = draw(SIDE, HIDDEN, SIDE), np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)

    def step(self, h: np.ndarray, token: np.ndarray, x: np.ndarray):
        """State after ``token`` (the number CLASSES starts a text), and what the way back needs; ``x`` is the embedding with the bias."""
        H = HIDDEN
        a, g = x[token], h @ self.u
        zr = 1 / (1 + np.exp(-(a[:, : 2 * H] + g[:, : 2 * H])))
        z, r = zr[:, :H], zr[:, H:]
        n = np.tanh(a[:, 2 * H :] + r * g[:, 2 * H :])
        return h + z * (n - h), (h, token, z, r, n, g[:, 2 * H :])

    def predict(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None):
        """Natural log-likelihood of the units ``y`` after the states ``h``, one each; with ``grads`` also that of the loss by ``h``."""
        out, dh = np.empty(len(y)), np.zeros_like(h) if grads is not None else None

        def softmax(s, aim):
            """Of columns; a row for each choice, as sums over rows are fast."""
            s -= s.max(axis=0)
            at = np.arange(len(aim))
            mine = s[aim, at]
            np.exp(s, out=s)
            total = s.sum(axis=0)
            if grads is not None:
                s /= total
                s[aim, at] -= 1
            return mine - np.log(total), s

        class_ = y // SIDE
        order = np.argsort(class_.astype(np.uint8), kind="stable")
        edge = np.searchsorted(class_[order], np.arange(SIDE + 1))
        h, class_, side = h[order], class_[order], (y % SIDE)[order]
        logs, dp = softmax(self.v.T @ h.T + self.c[:, None], class_)
        if grads is not None:
            grads["v"] += (dp @ h).T
            grads["c"] += dp.sum(axis=1)
            near = (self.v @ dp).T
        for k in range(SIDE):
            a, b = edge[k], edge[k + 1]
            if a < b:
                own, dp = softmax(self.w[k].T @ h[a:b].T + self.d[k][:, None], side[a:b])
                logs[a:b] += own
                if grads is not None:
                    grads["w"][k] += (dp @ h[a:b]).T
                    grads["d"][k] += dp.sum(axis=1)
                    near[a:b] += (self.w[k] @ dp).T
        out[order] = logs
        if grads is not None:
            dh[order] = near
        return out, dh

    def run(self, h: np.ndarray, before: np.ndarray, start: np.ndarray, back: bool):
        """States of lanes over the columns of ``before`` (what came before each token); those of ``start`` begin anew.  With ``back``, what the way back needs."""
        states, kept, x = [], [], self.x + self.b
        fresh = start.any(axis=0)
        for t in range(before.shape[1]):
            if fresh[t]:
                h = np.where(start[:, t, None], np.float32(0), h)
            h, way = self.step(h, before[:, t], x)
            states.append(h)
            if back:
                kept.append((*way, start[:, t] if fresh[t] else None))
        return h, states, kept

    def window(self, h: np.ndarray, before: np.ndarray, units: np.ndarray, start: np.ndarray, live: np.ndarray):
        """Last state, loss and gradients of one window; the gradient stops at its start and at that of a text."""
        grads = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        h, after, kept = self.run(h, before, start, True)
        H = HIDDEN
        states, aim = np.concatenate(after), units.T.ravel()
        on = np.flatnonzero(live.T.ravel())
        whole = len(on) == len(aim)
        logs, dp = self.predict(states if whole else states[on], aim if whole else aim[on], grads)
        if whole:
            seen = dp
        else:
            seen = np.zeros_like(states)
            seen[on] = dp
        seen = seen.reshape(len(after), *h.shape)
        past, token, z, r, n, g, anew = zip(*kept)
        past, z, r, n, g = (np.stack(x) for x in (past, z, r, n, g))
        by_n, by_z, by_r, still = z * (1 - n * n), (n - past) * z * (1 - z), g * r * (1 - r), 1 - z
        dh, da, dg = np.zeros_like(h), np.empty((len(z), len(h), 3 * H), z.dtype), np.empty((len(z), len(h), 3 * H), z.dtype)
        back = np.ascontiguousarray(self.u.T)
        for t in range(len(z) - 1, -1, -1):
            dh += seen[t]
            dn = dh * by_n[t]
            dg[t, :, :H] = dh * by_z[t]
            dg[t, :, H : 2 * H] = dn * by_r[t]
            dg[t, :, 2 * H :] = dn * r[t]
            da[t, :, 2 * H :] = dn
            dh = dh * still[t] + dg[t] @ back
            if anew[t] is not None:
                dh[anew[t]] = 0
        da[:, :, : 2 * H] = dg[:, :, : 2 * H]
        da, dg, token = da.reshape(-1, 3 * H), dg.reshape(-1, 3 * H), np.concatenate(token)
        order = np.argsort(token.astype(np.uint16), kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(token[order]) != 0)))
        grads["x"][token[order[first]]] = np.add.reduceat(da[order], first, axis=0)
        grads["b"] += da.sum(axis=0)
        grads["u"] += past.reshape(-1, H).T @ dg
        return h, -float(logs.sum()), grads

    def fit(self, texts) -> int:
        """Adam over windows of WINDOW tokens of whole texts; the state goes from one window of a text to the next.  Tells the number of tokens."""
        moment = {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in self.NAMES}
        h, done, n = np.zeros((LANES, HIDDEN), np.float32), 0, 0
        for rows, before, units, start, number in laid(texts):
            live = number >= 0
            n += int(live.sum())
            for a in range(0, units.shape[1], WINDOW):
                of = slice(a, a + WINDOW)
                if not live[:, a].all():  # lanes that end here
                    some = live[:, a]
                    rows, before, units, start, live = rows[some], before[some], units[some], start[some], live[some]
                    if not len(rows):
                        break
                h[rows], _, grads = self.window(h[rows], before[:, of], units[:, of], start[:, of], live[:, of])
                done += 1
                on = float(live[:, of].sum())
                for k in self.NAMES:
                    g = np.clip(grads[k] / on, -1, 1)
                    m, q = moment[k]
                    m += 0.1 * (g - m)
                    q += 0.01 * (g * g - q)
                    getattr(self, k).__isub__((RATE * (m / (1 - 0.9**done)) / (np.sqrt(q / (1 - 0.99**done)) + 1e-6)).astype(np.float32))
        return n

    def score(self, texts):
        """(number, natural log-likelihood) of each whole text of units, by its place in ``texts``, as they end; the state is carried to the end."""
        h, open_ = np.zeros((SCORE_LANES, HIDDEN), np.float32), {}
        for rows, before, units, start, number in laid(texts, SCORE_LANES):
            for a in range(0, units.shape[1], WINDOW):
                of = slice(a, a + WINDOW)
                some = np.flatnonzero(number[:, a] >= 0)
                if not len(some):
                    break
                h[rows[some]], states, _ = self.run(h[rows[some]], before[some, of], start[some, of], False)
                whose = number[some, of].T.ravel()
                on = np.flatnonzero(whose >= 0)
                logs, _ = self.predict(np.concatenate(states)[on], units[some, of].T.ravel()[on])
                whose, at = np.unique(whose[on], return_inverse=True)
                for k, v in zip(whose.tolist(), np.bincount(at, logs).tolist()):
                    open_[k] = open_.get(k, 0.0) + v
            still = set(number[:, -1].tolist())  # may go on in the next block
            for k in [k for k in open_ if k not in still]:
                yield k, open_.pop(k)
        yield from open_.items()

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> "Gru":
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self


# --- scoring ----------------------------------------------------------------------


def _coded(n_all: int, v_all: int, shares: np.ndarray, hold: int = 200_000):
    """Texts as units.  Rows of a part come together: first its tokens (token, count, unit), then its texts."""
    kind = pa.schema([("__row", pa.int64()), ("learn", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("inner", pa.float64()), ("units", pa.binary())])
    unseen = np.log10(0.5) - np.log10(n_all + 0.5 * (v_all + 1))

    def run(batches):
        part, keys, counts, units = None, [], [], []
        rows, learns, texts, held, ready = [], [], [], 0, None

        def flush():
            nonlocal rows, learns, texts, held, ready, keys, counts, units
            if not rows:
                return
            if ready is None:
                key = np.concatenate(keys).view(U) if keys else np.empty(0, U)
                order = np.argsort(key)
                c = np.concatenate(counts)[order].astype(np.float64) if keys else np.empty(0)
                k = np.concatenate(units)[order] if keys else np.empty(0, np.int64)
                # of the rare ones, half goes to tokens seen once and half to unseen ones
                inner = np.where(k == RARE, np.log10(0.5 * c / max(shares[RARE], 1.0)), np.log10(c / np.maximum(shares[k], 1.0)))
                base = np.log10(c + 0.5) - np.log10(n_all + 0.5 * (v_all + 1))
                ready = (key[order], np.append(base, unseen), np.append(k, RARE), np.append(inner, np.log10(0.5)))
                keys, counts, units = [], [], []
            key, base, k, inner = ready
            size = np.array([len(t) for t in texts])
            flat = np.concatenate(texts)
            at = np.searchsorted(key, flat)
            at[(key[np.minimum(at, len(key) - 1)] != flat) if len(key) else np.ones(len(flat), bool)] = len(key)
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            known = np.add.reduceat((at < len(key)).astype(np.int64), start)
            own = k[at].astype(np.uint16)
            out = [rows, learns, size, known, np.add.reduceat(base[at], start), np.add.reduceat(inner[at], start), [x.tobytes() for x in np.split(own, start[1:])]]
            rows, learns, texts, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind)], schema=kind)

        for batch in batches:
            column = batch.column(0).to_numpy(zero_copy_only=False)
            for p in np.unique(column):
                own = batch.filter(pa.array(column == p))
                if p != part:
                    yield from flush()
                    part, keys, counts, units, ready = p, [], [], [], None
                words = own.filter(pa.compute.is_valid(own.column(2)))
                if words.num_rows:
                    keys.append(words.column(2).to_numpy())
                    counts.append(words.column(3).to_numpy(zero_copy_only=False))
                    units.append(words.column(4).to_numpy(zero_copy_only=False).astype(np.int64))
                docs = own.filter(pa.compute.is_null(own.column(2)))
                for some in slices([docs]):
                    for row, text, learn in zip(*(some.column(i).to_pylist() for i in (1, 5, 6))):
                        rows.append(row)
                        learns.append(learn)
                        texts.append(token_ids(text))
                        held += len(texts[-1])
                        if held > hold:
                            yield from flush()
        yield from flush()

    return run


def _train(weights):
    """Tokens and weights (times tokens) of a task that goes on from ``weights`` with its texts."""

    def run(batches):
        model = Gru().load(weights.value)
        n = model.fit(np.frombuffer(x.as_py(), np.uint16) for batch in batches for x in batch.column(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([model.flat().astype(np.float32).tobytes()], pa.binary())], ["n", "weights"])

    return run


def _long_first(coded: DataFrame) -> DataFrame:
    """Long texts first in each partition, so that no task ends with a few lanes in use; the others in an order of their own."""
    return coded.sortWithinPartitions(F.col("n_tokens") < LONG, F.xxhash64("__row"))


def train(coded: DataFrame, counts: np.ndarray) -> tuple[Gru, int]:
    """The recurrent model after passes over whole texts of all rows of ``coded`` to learn from, and the tokens it went over.

    Tasks fit the texts they hold; after each round the weights of at most TASKS
    tasks (0.3 MB each) are averaged on the driver by tokens.
    """
    spark = coded.sparkSession
    model, n, seen = Gru(counts=counts), float(counts.sum()), 0
    for turn in range(PASSES * ROUNDS if n else 0):
        own = coded.where(F.col("learn") & (F.pmod(F.xxhash64("__row"), F.lit(ROUNDS)) == turn % ROUNDS))
        weights = spark.sparkContext.broadcast(model.flat())
        own = _long_first(own.select("__row", "n_tokens", "units").coalesce(int(min(TASKS, max(1, n // ROUNDS // TASK_TOKENS)))))
        got = own.select("units").mapInArrow(_train(weights), "n long, weights binary").collect()
        weights.unpersist()
        if got:
            n_got = sum(r["n"] for r in got)
            model.load(sum(np.frombuffer(r["weights"], np.float32).astype(np.float64) * r["n"] for r in got) / n_got)
            seen += n_got
    return model, seen


def _score(weights):
    kind = pa.schema([("__row", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches):
        model, open_, out = Gru().load(weights.value), {}, []

        def texts():
            k = 0
            for batch in batches:
                for *own, units in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    open_[k] = own
                    k += 1
                    yield np.frombuffer(units, np.uint16)

        for k, logs in model.score(texts()):
            *own, inner = open_.pop(k)
            out.append((*own, logs / np.log(10) + inner))
            if len(out) >= 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)

    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 5, held: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; learns from rows whose crc32(doc_id) mod ``modulus`` isn't ``held``.

    Counts cover all training tokens, each distinct token once per partition of the
    input on its way to the sums and back, so no table of tokens is broadcast.  The
    recurrent model is trained on whole texts of all training rows.  Tokens are
    known by 64-bit hashes.  A null text counts as empty and is the end alone; a null
    doc_id counts as the empty text in the split; repeated rows are scored each.
    Without training rows all tokens are unknown.
    """
    rows = keyed(docs, doc_id, text).toDF("__row", "doc_id", "text")
    rows = rows.withColumn("part", F.shiftright("__row", 33)).withColumn("learn", remainder("doc_id", modulus) != held)
    seen = cut(rows.select("part", "learn", "text").mapInArrow(_distinct, "part long, token long, n long"))
    counts = cut(seen.groupBy("token").agg(F.sum("n").alias("c")).where("c > 0"))
    n_all, v_all = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.where((F.col("token") != END) & (F.col("c") > 1)).orderBy(F.desc("c"), "token").limit(HEAD).collect()
    head = docs.sparkSession.createDataFrame([(r["token"], i) for i, r in enumerate(top)], "token long, own int")
    bin_ = END_UNIT + F.least(F.lit(RARE - 1 - END_UNIT), F.floor(F.log2("c"))).cast("int")
    unit = F.coalesce("own", F.when(F.col("token") == END, END_UNIT).when(F.col("c") == 1, RARE).otherwise(bin_)).cast("int")
    classed = cut(counts.join(F.broadcast(head), "token", "left").select("token", "c", unit.alias("unit")))  # HEAD rows broadcast
    shares = np.zeros(CLASSES)
    for r in classed.groupBy("unit").agg(F.sum("c").alias("c")).collect():  # at most CLASSES rows
        shares[r["unit"]] = r["c"]

    none = F.lit(None)
    token_rows = seen.select("part", "token").join(classed, "token").select("part", none.cast("long").alias("__row"), "token", "c", "unit", none.cast("string").alias("text"), none.cast("boolean").alias("learn"))
    text_rows = rows.select("part", "__row", none.cast("long").alias("token"), none.cast("long").alias("c"), none.cast("int").alias("unit"), F.coalesce("text", F.lit("")).alias("text"), "learn")
    parts = seen.agg(F.coalesce(F.max("part"), F.lit(0)) + 1).first()[0]
    met = token_rows.unionByName(text_rows).repartition(int(parts), "part").sortWithinPartitions("part", F.col("token").isNull(), "__row")
    coded = cut(met.mapInArrow(_coded(n_all, v_all, shares), "__row long, learn boolean, n_tokens long, n_known long, base_score double, inner double, units binary"))
    weights = docs.sparkSession.sparkContext.broadcast(train(coded, shares)[0].flat())
    out = _long_first(coded).select("__row", "n_tokens", "n_known", "base_score", "inner", "units").mapInArrow(_score(weights), "__row long, n_tokens long, n_known long, base_score double, score double")
    ids = keyed(docs, doc_id).toDF("__row", "doc_id")
    return out.join(ids, "__row").select("doc_id", (remainder("doc_id", modulus) == held).alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
