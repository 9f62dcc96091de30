"""Nearest neighbours by a block matrix join.

Vectors are rounded to 8-bit tiles with a scale and the exact length of the
rounding error of each.  The product of two tiles bounds every squared distance
from both sides; pairs that the bounds cannot rule out are computed again from the
original vectors, and heaps keep the best of each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, steady

TILE, QUERIES, GROUPS = 2048, 256, 64


def _tiles(rows_in_tile: int):
    kind = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary()), ("codes", pa.binary()), ("scales", pa.binary()), ("errors", pa.binary())])

    def tile(dim, ids, vecs):
        v = np.array(vecs, np.float64)
        scale = np.abs(v).max(axis=1) / 127
        scale[scale == 0] = np.finfo(float).tiny
        code = np.clip(np.rint(v / scale[:, None]), -127, 127).astype(np.int8)
        error = np.sqrt(((v - code * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9)
        cells = [dim, np.array(ids, np.int64).tobytes(), v.tobytes(), code.tobytes(), scale.tobytes(), error.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, kind)], schema=kind)

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, vecs = held.setdefault(len(v), ([], []))
                ids.append(i)
                vecs.append(v)
                if len(ids) == rows_in_tile:
                    yield tile(len(v), *held.pop(len(v)))
        for dim, (ids, vecs) in held.items():
            yield tile(dim, ids, vecs)

    return run, "dim int, ids binary, vecs binary, codes binary, scales binary, errors binary"


def _read(x: dict):
    dim = x["dim"]
    code = np.frombuffer(x["codes"], np.int8).reshape(-1, dim)
    scale = np.frombuffer(x["scales"], np.float64)
    return np.frombuffer(x["ids"], np.int64), np.frombuffer(x["vecs"], np.float64).reshape(-1, dim), code, scale, np.frombuffer(x["errors"], np.float64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed in the order of the components in double precision."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j] - b[:, j]
        total += d * d
    return np.sqrt(total)


def bounds(code_a, scale_a, error_a, code_b, scale_b, error_b):
    """Least and most that the squared distances of two tiles' vectors can be.

    The product of codes is a whole number, so it is exact in floats of 24 bits as
    long as 127 * 127 * components fits, else in doubles.
    """
    exact = np.float32 if code_a.shape[1] <= 1000 else np.float64
    dot = (code_a.astype(exact) @ code_b.astype(exact).T).astype(np.float64) * scale_a[:, None] * scale_b[None, :]
    na = np.sqrt((code_a.astype(np.float64) ** 2).sum(axis=1)) * scale_a
    nb = np.sqrt((code_b.astype(np.float64) ** 2).sum(axis=1)) * scale_b
    near = np.sqrt(np.maximum(na[:, None] ** 2 + nb[None, :] ** 2 - 2 * dot, 0))
    slack = error_a[:, None] + error_b[None, :] + 1e-6 * (na[:, None] + nb[None, :])
    return np.maximum(near - slack, 0) ** 2, (near + slack) ** 2


def _search(k: int):
    def run(batches):
        best: dict[int, list[tuple[float, int]]] = {}

        def out():
            rows = [(q, i, d) for q, found in best.items() for d, i in found]
            best.clear()
            cols = list(zip(*rows)) if rows else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            for x in batch.to_pylist():
                qi, qv, qc, qs, qe = _read(x["q"])
                ci, cv, cc, cs, ce = _read(x["c"])
                low, high = bounds(qc, qs, qe, cc, cs, ce)
                own = qi[:, None] == ci[None, :]
                low[own] = high[own] = np.inf
                if len(ci) > k:
                    limit = np.partition(high, k - 1, axis=1)[:, k - 1]
                else:
                    limit = np.full(len(qi), np.inf)
                for r, q in enumerate(qi.tolist()):
                    if len(found := best.get(q, ())) == k:
                        limit[r] = min(limit[r], found[-1][0] ** 2 * (1 + 1e-9))
                rows, cols = np.nonzero((low <= limit[:, None]) & ~own)
                exact = distances(qv[rows], cv[cols])
                starts = np.searchsorted(rows, np.arange(len(qi) + 1))
                for r, q in enumerate(qi.tolist()):
                    a, b = starts[r], starts[r + 1]
                    if a < b:
                        best[q] = sorted([*best.get(q, ()), *zip(exact[a:b].tolist(), ci[cols[a:b]].tolist())])[:k]
                if len(best) > 200_000:
                    yield out()
        yield out()

    return run


def valid(rows: DataFrame) -> DataFrame:
    """Rows (id, vec) whose vector is neither null, empty nor zero and has finite components only."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where("id is not null and vec is not null").where(~bad & F.exists("vec", lambda x: x != 0))


def search(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest candidates of each query, all if there are fewer.

    Both tables have (id, vec).  Every query is held against every candidate, block
    by block, by Euclidean distance on the original vectors in double precision;
    ties go to the smaller id.  A query's own id is no candidate.  Vectors that
    ``valid`` leaves out take no part; vectors are only compared with those of as
    many components.  Of rows that repeat a query's id the smallest vector asks;
    repeated candidates are found each.  Empty tables give an empty one.

    Candidate tiles are dealt into groups, and each group meets a copy of the query
    blocks, which are a hundredth of the table; both sides are shuffled, as the
    copies grow with the table and their size is underestimated; a task holds a batch of a few pairs of blocks and
    k results for each of its queries.
    """
    steady(candidates.sparkSession)  # a pair of tiles has over a megabyte, so batches are bounded by bytes
    run, kind = _tiles(TILE)
    tiles = cut(valid(candidates.select("id", F.col("vec").cast("array<double>").alias("vec"))).select("id", "vec").mapInArrow(run, kind))
    run, kind = _tiles(QUERIES)
    asked = valid(queries.select("id", F.col("vec").cast("array<double>").alias("vec"))).groupBy("id").agg(F.min("vec").alias("vec"))
    asked = cut(asked.coalesce(max(1, min(64, asked.rdd.getNumPartitions()))).mapInArrow(run, kind))
    group = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    row = F.struct("dim", "ids", "vecs", "codes", "scales", "errors")
    left = tiles.select("dim", group(GROUPS).alias("g"), row.alias("c"))
    right = asked.select("dim", row.alias("q"), F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("g"))
    met = left.join(right.hint("merge"), ["dim", "g"]).select("q", "c").mapInArrow(_search(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_table(table: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The nearest of the vectors whose id is divisible by ``every``, among all rows."""
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("vec"))
    return search(rows.where(F.col("id") % every == 0), rows, k)
