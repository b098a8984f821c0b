"""Exact top-k inner products, pruned by multi-resolution segment statistics.

A vector is cut into 1, 2, 4, ... equal segments. With a segment's mean m and deviation d (the norm of what is left
after the mean), Cauchy-Schwarz bounds the product of two segments by width * m1 * m2 + d1 * d2; the squared distance is
|x|^2 + |q|^2 minus twice the product, so a lower bound of the distance and an upper bound of the product are the same
thing. Bounds go coarse to fine; a candidate leaves a query as soon as its bound is below the query's k-th best score so
far, and exact integer products are computed for survivors only. Ties stay: a bound equal to that score survives.

Queries and candidates are packed into blocks. A lane holds a bounded share of the candidates, LANE_BYTES, which are sent
once; the blocks of queries go to all lanes, one after the other, so a task holds its lane and one block of queries: a stated
query set against all rows, in blocks. The number of lanes grows with the candidates. A block of candidates first meets the
block of queries as a whole, by the ranges of its statistics, and is left out if no query's bound reaches its k-th score.
What is merged at the end is k rows for each query and lane.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, map_arrow, stage, table

QUERY_BLOCK = 1024
#: Bytes of a block of candidates, and of a lane's.
BLOCK_BYTES, LANE_BYTES = 1 << 20, 48 << 20
LEVELS = (1, 4, 16)
#: Sums of products below this are exact in doubles.
EXACT = 2.0**52


def _vectors(column: pa.Array, ids: pa.Array, scale: float, every: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, lengths, first places, values) of a batch's vectors that take part, as integers in doubles."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    known = column.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = np.floor(pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False) * scale)
    first = np.cumsum(lengths) - lengths
    bad = np.add.reduceat(np.append(~np.isfinite(values), False), np.minimum(first, len(values))) if len(first) else np.zeros(0)
    number = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    good = known & ((bad == 0) | (lengths == 0))
    if every:
        good &= number % every == 0
    return number[good], lengths[good], first[good], values


def _blocks(rows: DataFrame, scale: float, every: int | None) -> DataFrame:
    """(dim, ids, data): blocks of vectors of one dimension, QUERY_BLOCK of them or BLOCK_BYTES."""

    def run(batches):
        claim()
        waiting: dict[int, list] = {}

        def record(dim, ids, x):
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([x.astype("<f8").tobytes()], pa.binary())], names=["dim", "ids", "data"])

        for batch in batches:
            ids, lengths, first, values = _vectors(batch.column("vector"), batch.column("id"), scale, every)
            for dim in np.unique(lengths).tolist():
                at = np.nonzero(lengths == dim)[0]
                x = values[first[at][:, None] + np.arange(dim)]
                size = QUERY_BLOCK if every else max(1, BLOCK_BYTES // (8 * max(1, dim)))
                if dim in waiting:
                    old_ids, old = waiting.pop(dim)
                    at_ids, x = np.concatenate([old_ids, ids[at]]), np.concatenate([old, x])
                else:
                    at_ids = ids[at]
                for i in range(0, len(at_ids) - size + 1, size):
                    yield record(dim, at_ids[i : i + size], x[i : i + size])
                left = len(at_ids) % size
                if left:
                    waiting[dim] = [at_ids[-left:], x[-left:]]
        for dim, (ids, x) in waiting.items():
            yield record(dim, ids, x)

    return map_arrow(rows, run, "dim int, ids binary, data binary")


def summary(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner product with another's bounds the product of the vectors from above."""
    out = []
    for part in np.array_split(x, min(segments, max(1, x.shape[1])), axis=1):
        width = max(1, part.shape[1])
        mean = part.sum(axis=1) / width
        rest = part - mean[:, None]
        out += [mean * np.sqrt(width), np.sqrt(np.einsum("ij,ij->i", rest, rest))]
    return np.stack(out, axis=1)


class Candidates:
    """A block of candidates with its statistics and their ranges."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.levels = [summary(x, s) for s in LEVELS]
        self.low, self.high = self.levels[1].min(axis=0), self.levels[1].max(axis=0)
        self.norm = np.linalg.norm(self.levels[1], axis=1).max()


class TopK:
    """The k best of each query of a block so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.levels = [summary(x, s) for s in LEVELS]
        self.score = np.zeros((len(ids), 0), np.int64)
        self.other = np.zeros((len(ids), 0), np.int64)

    def floor(self) -> np.ndarray:
        if self.score.shape[1] < self.k:
            return np.full(len(self.ids), -np.inf)
        return np.where(self.other[:, -1] >= 0, self.score[:, -1].astype(float), -np.inf)

    def add(self, block: Candidates) -> None:
        ids, x = block.ids, block.x
        floor = self.floor()
        mine = self.levels[1]
        most = np.maximum(mine, 0) @ block.high + np.minimum(mine, 0) @ block.low
        if not (most + 1e-9 * (np.linalg.norm(mine, axis=1) * block.norm + 1) >= floor).any():
            return
        small = np.abs(self.x).max(initial=0) * np.abs(x).max(initial=0) * max(1, x.shape[1]) < EXACT
        if not small and float(np.abs(self.x).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] >= 2.0**63:
            raise OverflowError("inner products beyond 64 bits")
        live = None
        for mine, theirs in zip(self.levels, block.levels, strict=True):
            if live is None:
                bound = mine @ theirs.T
                slack = 1e-9 * (np.linalg.norm(mine, axis=1)[:, None] * np.linalg.norm(theirs, axis=1)[None, :] + 1)
                live = bound + slack >= floor[:, None]
            else:
                rows, cols = np.nonzero(live)
                if len(rows) > live.size // 4:  # dense: one product of matrices is cheaper than gathering
                    bound = mine @ theirs.T
                    slack = 1e-9 * (np.linalg.norm(mine, axis=1)[:, None] * np.linalg.norm(theirs, axis=1)[None, :] + 1)
                    live &= bound + slack >= floor[:, None]
                else:
                    bound = np.einsum("ij,ij->i", mine[rows], theirs[cols])
                    slack = 1e-9 * (np.linalg.norm(mine[rows], axis=1) * np.linalg.norm(theirs[cols], axis=1) + 1)
                    live[rows, cols] = bound + slack >= floor[rows]
        some = np.nonzero(live.any(axis=0))[0]
        if not len(some):
            return
        live, ids, x = live[:, some], ids[some], x[some]
        if small:
            exact = np.rint(self.x @ x.T).astype(np.int64)
        else:
            exact = self.x.astype(np.int64) @ x.T.astype(np.int64)
        least = np.iinfo(np.int64).min
        live &= ids[None, :] != self.ids[:, None]
        exact = np.where(live, exact, least)
        other = np.where(live, ids[None, :], -1)
        score = np.concatenate([self.score, exact], axis=1)
        other = np.concatenate([self.other, other], axis=1)
        if score.shape[1] > 4 * self.k:  # all that tie with the k-th score stay
            kth = -np.partition(-score.astype(float), self.k - 1, axis=1)[:, self.k - 1]
            keep = np.nonzero((score.astype(float) >= kth[:, None]).any(axis=0))[0]
            score, other = score[:, keep], other[:, keep]
        order = np.lexsort((other, -score.astype(object) if not small else -score.clip(min=least + 1)), axis=1)[:, : self.k]
        self.score, self.other = np.take_along_axis(score, order, 1), np.take_along_axis(other, order, 1)


def exact_topk(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", lanes: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each row whose id is divisible by ``every``.

    Defined results: vectors that are null, or hold a null or a component that isn't finite, take no part, nor do rows
    without an id; vectors of different length never meet. Rows that repeat an id are candidates each, but never for
    their own id. Components times ``scale`` are floored in doubles; products that could leave 64 bits raise.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    candidates = stage(_blocks(rows, scale, None).withColumn("block", F.monotonically_increasing_id()), "search-candidates")
    queries = stage(_blocks(rows.filter(F.col("id") % every == 0), scale, every), "search-queries")
    total, blocks = candidates.agg(F.coalesce(F.sum(F.length("data").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    lanes = lanes or max(-(-total // LANE_BYTES), min(blocks, spark.sparkContext.defaultParallelism), 1)
    left = candidates.select(F.pmod(F.xxhash64("block"), F.lit(lanes)).alias("lane"), F.lit(0).alias("kind"), "dim", "ids", "data")
    right = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"), F.lit(1).alias("kind"), "dim", "ids", "data")
    met = left.unionByName(right).repartition(int(lanes), "lane").sortWithinPartitions("lane", "kind")

    def run(batches):
        claim()
        held: dict[int, list[Candidates]] = {}
        lane = None
        for batch in batches:
            for i in range(batch.num_rows):
                at, kind, dim, ids, data = (batch.column(c)[i] for c in range(5))
                if at.as_py() != lane:
                    lane, held = at.as_py(), {}
                ids = np.frombuffer(ids.as_buffer(), "<i8")
                x = np.frombuffer(data.as_buffer(), "<f8").reshape(len(ids), dim.as_py())
                if kind.as_py() == 0:
                    held.setdefault(dim.as_py(), []).append(Candidates(ids.copy(), x.copy()))
                    continue
                top = TopK(ids, x, k)
                for block in held.get(dim.as_py(), ()):
                    top.add(block)
                real = top.score.ravel() != np.iinfo(np.int64).min
                width = top.score.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(top.ids, width)[real]), pa.array(top.other.ravel()[real]), pa.array(top.score.ravel()[real])],
                    names=["query_id", "vec_id", "score"],
                )

    partial = map_arrow(met, run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    return exact_topk(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM q JOIN v ON v.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
