"""Exact top-k inner-product search by tiled matrix products.

Queries and candidates are packed into blocks. A tile is one block of queries
against one block of candidates: a matrix product followed by a partial
selection that keeps ``k`` rows per query. The partial lists are then merged
as a tree over groups of ``FAN_IN`` blocks, so that no task ever holds more
than ``FAN_IN * k`` rows of one query.

Defined results
- A vector that is null, or holds a null or non-finite component, takes no part.
- Vectors of different lengths are not compared with each other.
- Ties go to the smaller identifier; rows that repeat an identifier each count
  as candidates, but a query never meets a row with its own identifier.
- Several query rows with one identifier count as one (the smallest vector).
- Scores beyond the range of a long are set to its ends.
- An empty table, or k = 0, gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.llm.common import written

QUERY_ROWS = 512
CANDIDATE_ROWS = 8192
FAN_IN = 8
_BLOCK = "block string, dim int, n int, ids binary, vectors binary"
_PARTIAL = "query_id long, lane int, vec_id long, score long"
_LONG = np.iinfo(np.int64)
#: Whole numbers too large for one float64 product are multiplied in parts of so many bits.
LIMB_BITS = 20
_LIMB = float(1 << LIMB_BITS)
_DIMS = 4096
#: Digits of scores held at once.
_DIGITS = 8 << 20
_SIZES = ((1, 1), (2, 4), (5, 1 << 10))


def _pack(rows_per_block: int, scale: float):
    """Rows (id, vector) to blocks of one dimension, by input partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids = np.concatenate([x[0] for x in held[dim]])
            vectors = np.concatenate([x[1] for x in held[dim]])
            head, rest = slice(None, rows_per_block), slice(rows_per_block, None)
            held[dim] = [(ids[rest], vectors[rest])]
            made += 1
            return pa.RecordBatch.from_pydict(
                {
                    "block": [f"{part}-{made}"],
                    "dim": pa.array([dim], pa.int32()),
                    "n": pa.array([len(ids[head])], pa.int32()),
                    "ids": [ids[head].tobytes()],
                    "vectors": [vectors[head].tobytes()],
                }
            )

        for batch in batches:
            ids = np.asarray(batch.column(0))
            vectors = batch.column(1)
            lengths = np.asarray(vectors.value_lengths())
            flat = np.asarray(vectors.flatten().cast(pa.float64()))
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                matrix = flat[starts[rows][:, None] + np.arange(dim)]
                held.setdefault(dim, []).append((ids[rows], np.floor(matrix * scale)))
                while sum(len(x[0]) for x in held[dim]) >= rows_per_block:
                    yield block(dim)
        for dim in list(held):
            if sum(len(x[0]) for x in held[dim]):
                yield block(dim)

    return pack


def _best(q_ids, q, c_ids, c, k: int):
    """The k best candidates of every query: positions of query, ids, scores."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    n, kept = len(c_ids), min(k, len(c_ids))
    bound = (np.abs(q).max(initial=0) + 1) * (np.abs(c).max(initial=0) + 1) * (q.shape[1] + 1)
    if bound * (n + 1) < 2.0**52:
        # score and position in one number, so that ties select the smaller id
        key = (q @ c.T) * n + np.arange(n - 1, -1, -1)
        key[q_ids[:, None] == c_ids[None, :]] = -np.inf
        top = np.argpartition(-key, kept - 1, axis=1)[:, :kept]
        best = np.take_along_axis(key, top, axis=1)
        rows, cols = np.nonzero(best > -np.inf)
        picked = top[rows, cols]
        scores = np.floor_divide(best[rows, cols], n).astype(np.int64)
        return rows, c_ids[picked], scores
    scores = _exact_scores(q, c)
    # extra places for the query's own rows, which are dropped; later ranks drop what is more than k
    own = q_ids[:, None] == c_ids[None, :]
    kept = min(kept + int(own.sum(axis=1).max(initial=0)), n)
    least = np.partition(scores, n - kept, axis=1)[:, n - kept, None]
    better, equal = scores > least, scores == least
    chosen = better | (equal & (np.cumsum(equal, axis=1) <= kept - better.sum(axis=1)[:, None]))
    rows, picked = np.nonzero(chosen & ~own)
    return rows, c_ids[picked], scores[rows, picked]


def _limbs(x: np.ndarray, n: int) -> list[np.ndarray]:
    """Whole numbers as ``n`` numbers below 2 ** LIMB_BITS, the lowest first, with the sign of the whole."""
    sign, rest, out = np.sign(x), np.abs(x), []
    for _ in range(n):
        low = np.fmod(rest, _LIMB)
        out.append(sign * low)
        rest = (rest - low) / _LIMB
    return out


def _exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers of any size, set to the ends of a long beyond them."""
    out = np.zeros((len(q), len(c)), np.int64)
    sizes = [np.maximum(1, -(-np.frexp(np.abs(x).max(axis=1, initial=0))[1] // LIMB_BITS)) for x in (q, c)]
    # rows of few and of many limbs apart, so that one outlier doesn't make the others dear
    for low_q, high_q in _SIZES:
        for low_c, high_c in _SIZES:
            a, b = ((low <= s) & (s <= high) for s, low, high in ((sizes[0], low_q, high_q), (sizes[1], low_c, high_c)))
            if a.any() and b.any():
                n_q, n_c = int(sizes[0][a].max()), int(sizes[1][b].max())
                step = max(1, _DIGITS // ((n_q + n_c + 3) * int(b.sum())))
                parts = np.flatnonzero(a)
                for at in range(0, len(parts), step):
                    out[np.ix_(parts[at : at + step], b)] = _limb_products(q[parts[at : at + step]], n_q, c[b], n_c)
    return out


def _limb_products(q: np.ndarray, n_q: int, c: np.ndarray, n_c: int) -> np.ndarray:
    digits = np.zeros((n_q + n_c + 3, len(q), len(c)), np.int64)
    for at in range(0, q.shape[1], _DIMS):  # of so many products of limbs a float64 sum is exact
        parts_q, parts_c = _limbs(q[:, at : at + _DIMS], n_q), _limbs(c[:, at : at + _DIMS], n_c)
        for i, x in enumerate(parts_q):
            for j, y in enumerate(parts_c):
                digits[i + j] += (x @ y.T).astype(np.int64)
    for k in range(len(digits) - 1):
        digits[k + 1] += digits[k] >> LIMB_BITS
        digits[k] &= int(_LIMB) - 1
    # three limbs are the low 60 bits; what is above must fit in the other four
    high = digits[-1]
    for d in digits[-2:2:-1]:
        high = np.clip(high, -(1 << 40), 1 << 40) * int(_LIMB) + d
    low = digits[0] + (digits[1] << LIMB_BITS) + (digits[2] << 2 * LIMB_BITS)
    return np.where(high > 7, _LONG.max, np.where(high < -8, _LONG.min, (np.clip(high, -8, 7) << 60) + low))


def _tiles(k: int):
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                dim = x["dim"]
                q_ids, c_ids = (np.frombuffer(x[n], np.int64) for n in ("q_ids", "ids"))
                q = np.frombuffer(x["q_vectors"]).reshape(len(q_ids), dim)
                c = np.frombuffer(x["vectors"]).reshape(len(c_ids), dim)
                rows, ids, scores = _best(q_ids, q, c_ids, c, k)
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": q_ids[rows],
                        "lane": pa.array(np.full(len(rows), x["lane"]), pa.int32()),
                        "vec_id": ids,
                        "score": scores,
                    }
                )

    return select


def exact_topk(queries: DataFrame, candidates: DataFrame, *, id_col: str, vector_col: str, k: int, scale: float = 1.0) -> DataFrame:
    """For each query its k candidates of the highest integer inner product.

    Components are turned into ``floor(scale * x)``. Returns query_id, rank
    (from 1), vec_id, score.
    """
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    columns = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")]
    wanted = queries.select(*columns).where(usable & F.col("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v"))
    rows = candidates.select(*columns).where(usable & F.col("id").isNotNull())

    asked = written(wanted.mapInArrow(_pack(QUERY_ROWS, scale), _BLOCK), "topk-queries")
    shards = written(rows.mapInArrow(_pack(CANDIDATE_ROWS, scale), _BLOCK), "topk-shards")
    lanes = max(1, -(-shards.count() // FAN_IN))
    asked = asked.select("dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    shards = shards.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int"))
    tiles = asked.join(shards, ["dim", "lane"]).select("dim", "lane", "q_ids", "q_vectors", "ids", "vectors")
    best = tiles.mapInArrow(_tiles(k), _PARTIAL)

    while True:
        order = Window.partitionBy("query_id", "lane").orderBy(F.col("score").desc(), "vec_id")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if lanes == 1:
            return best.select("query_id", "rank", "vec_id", "score")
        lanes = -(-lanes // FAN_IN)
        best = best.select("query_id", F.floor(F.col("lane") / FAN_IN).cast("int").alias("lane"), "vec_id", "score")
