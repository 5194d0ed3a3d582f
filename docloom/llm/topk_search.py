"""Exact top-k search by inner product over impact-ordered, score-at-a-time block indexes."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, tasks

SCALE, K = 1024, 10
#: Vectors of an index block and queries of a query block at most, on average: what one task holds.
BLOCK, QUERIES = 16_384, 16_384
#: Vectors that make a block of its own worth while.
LEAST = 2048
#: Impact levels of a dimension, and rounds in which a query's segments are processed.
LEVELS, ROUNDS = 24, 3


def whole_components(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def narrow(x: np.ndarray) -> np.ndarray:
    """x in the smallest whole type that holds it."""
    for kind in (np.int16, np.int32):
        if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


class BlockIndex:
    """Posting segments of a block: for each dimension the rows by falling component, cut where a quantised level ends.

    For a query, the impact of a segment is the largest product in it above the smallest product of its dimension:
    never negative, so every row's score is at most the sum of the smallest products and its segments' impacts. Along a
    dimension impacts fall from one end, so what has been processed of it is always a range of its postings.
    """

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS, order: np.ndarray | None = None, starts: np.ndarray | None = None):
        self.vectors, self.levels = vectors, levels
        n, dims = vectors.shape
        self.order = np.argsort(-vectors, axis=0, kind="stable").T if order is None else order
        self.order = np.ascontiguousarray(self.order, dtype=np.intp)
        self.sorted = np.take_along_axis(vectors.T, self.order, axis=1)
        if starts is None:
            top, low = self.sorted[:, :1], self.sorted[:, -1:]
            step = np.maximum(top - low, 1) / levels
            level = np.minimum(((top - self.sorted) / step).astype(np.int64), levels - 1)
            #: starts[d, l]: first place in order[d] with a level of l or more
            starts = np.stack([np.searchsorted(level[d], np.arange(levels + 1)) for d in range(dims)]) if dims else np.zeros((0, levels + 1), dtype=np.int64)
            starts[:, -1] = n
        self.starts = starts
        self.sizes = np.diff(starts, axis=1)
        first = np.minimum(starts[:, :-1], n - 1)
        last = np.maximum(starts[:, 1:] - 1, 0)
        rows = np.arange(dims)[:, None]
        #: The largest and smallest component of each segment
        self.high, self.low = self.sorted[rows, first], self.sorted[rows, last]
        self.largest = float(np.abs(vectors.astype(np.float64)).max()) if vectors.size else 0.0
        self.floats = vectors.astype(np.float64)

    def dump(self) -> bytes:
        """The index as bytes; load() builds nothing anew but what follows from it row by row."""
        return pickle.dumps((narrow(self.vectors), narrow(self.order), narrow(self.starts), self.levels), protocol=5)

    @classmethod
    def load(cls, blob: bytes) -> BlockIndex:
        vectors, order, starts, levels = pickle.loads(blob)
        return cls(vectors.astype(np.int64), levels, order, starts.astype(np.int64))

    def segments(self, query: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of the smallest products, and impacts[d, l]; zero for empty segments."""
        q = query[:, None]
        bound = np.where(q >= 0, q * self.high, q * self.low)
        least = np.where(query >= 0, query * self.sorted[:, -1], query * self.sorted[:, 0])
        impacts = np.where(self.sizes > 0, bound - least[:, None], 0)
        return float(least.sum()), impacts

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles where every partial sum is a whole number they hold, else in long integers."""
        if self.largest * float(np.abs(query.astype(np.float64)).sum()) < 2**52:
            return (self.floats[rows] @ query.astype(np.float64)).astype(np.int64)
        return self.vectors[rows] @ query

    def top(self, query: np.ndarray, k: int, own: np.ndarray, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(score, id, row) of the k best rows, those in `own` left out; ties to the smaller id.

        Rounds take the segments in falling order of impact. After each, what any row can still gain is the sum over
        dimensions of the largest impact not yet processed. The query stops when few rows can reach the k-th exact
        score found so far, or all is processed; every row that can reach it is then scored exactly.
        """
        n = len(ids)
        base, impacts = self.segments(query)
        ranked = np.sort(impacts[impacts > 0])[::-1]
        sums = np.zeros(n)
        slack = 1e-9 * (abs(base) + float(impacts.max(axis=1).sum() if impacts.size else 0))  # what sums of doubles can lose
        allowed = np.ones(n, dtype=bool)
        allowed[own] = False
        want = min(k, int(allowed.sum()))
        if not want:
            return []
        cuts = [ranked[min(len(ranked) - 1, len(ranked) * (i + 1) // ROUNDS)] if i + 1 < ROUNDS else 0 for i in range(ROUNDS)] if len(ranked) else [0]
        done = np.zeros_like(impacts, dtype=bool)
        for cut in cuts:
            now = (impacts > cut) & ~done
            done |= now
            where, weights = [], []
            begin, end = now.argmax(axis=1).tolist(), (self.levels - now[:, ::-1].argmax(axis=1)).tolist()
            for d in np.flatnonzero(now.any(axis=1)).tolist():
                a, b = begin[d], end[d]
                where.append(self.order[d, self.starts[d, a] : self.starts[d, b]])
                weights.append(impacts[d, a:b].repeat(self.sizes[d, a:b]))
            if where:
                sums += np.bincount(np.concatenate(where), np.concatenate(weights), n)
            open_ = np.where(done, 0, impacts).max(axis=1).sum() if impacts.size else 0
            reach = base + sums + (open_ + slack)
            reach[~allowed] = -np.inf
            best = np.argpartition(-reach, want - 1)[: max(want, min(n, 4 * k))] if n > want else np.arange(n)
            best = best[allowed[best]]
            exact = self.scores(best, query)
            floor = np.partition(exact, len(exact) - want)[len(exact) - want]
            possible = np.flatnonzero(reach >= floor)
            if len(possible) <= max(4 * k, n // 32):
                break
        scores = self.scores(possible, query)
        keep = np.lexsort((ids[possible], -scores))[:want]
        return [(int(scores[i]), int(ids[possible[i]]), int(possible[i])) for i in keep]


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), dtype=np.int64)
    for i, x in enumerate(column.to_pylist()):
        out[i, : len(x)] = x
    return out


def search(
    vectors: DataFrame, queries: Column, *, k: int = K, scale: int = SCALE, block: int = BLOCK, query_block: int = QUERIES, least: int = LEAST, scratch: Scratch | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows with the largest inner product to each query.

    vectors: vec_id, embedding (more are ignored, whatever their names); queries: condition on vec_id. Components x
    count as floor(scale * x); ties go to the smaller vec_id; a query doesn't meet rows of its own id.

    Null ids, null or empty vectors and those with a null or non-finite component take no part. Of vectors of different
    lengths the shorter count as padded with zeros. Rows that repeat, id and vector, each take a place of their own as
    candidates, but are one query; different vectors of one id are queries of their own. No rows: no rows.

    Repeated rows are collapsed to one with their number, so none fills a block. Rows are dealt to blocks by a hash of
    the row; each block's index is built and written once, queries likewise in blocks. Every index meets every block of
    queries in a task of its own, whose memory the block sizes bound, and sends k rows a query on.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "search")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite)
    rows = valid.select(F.col("vec_id").cast("long").alias("vec_id"), whole_components(F.col("embedding"), scale).alias("x"))
    rows = scratch.save(rows.groupBy("vec_id", "x").agg(F.count("*").alias("copies")), "rows")
    n, n_queries, dims = rows.agg(F.count("*"), F.count(F.when(queries, 1)), F.coalesce(F.max(F.size("x")), F.lit(1))).first()
    blocks = max(1, -(-n // block), min(tasks(spark), n // least))
    q_blocks = max(1, -(-n_queries // query_block))

    def index(part: pa.Table) -> pa.Table:
        blob = pickle.dumps((part.column("vec_id").to_numpy(), part.column("copies").to_numpy(), BlockIndex(matrix(part.column("x"), dims)).dump()), protocol=5)
        return pa.table([part.column("block").slice(0, 1).cast(pa.int64()), pa.array([blob], pa.binary())], names=["block", "index"])

    def asked(part: pa.Table) -> pa.Table:
        blob = pickle.dumps((part.column("vec_id").to_numpy(), narrow(matrix(part.column("x"), dims))), protocol=5)
        return pa.table([part.column("q_block").slice(0, 1).cast(pa.int64()), pa.array([blob], pa.binary())], names=["q_block", "queries"])

    dealt = lambda m: F.pmod(F.xxhash64("vec_id", "x"), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    indexes = scratch.save(rows.withColumn("block", dealt(blocks)).groupBy("block").applyInArrow(index, "block long, index binary"), "indexes")
    questions = scratch.save(rows.where(queries).withColumn("q_block", dealt(q_blocks)).groupBy("q_block").applyInArrow(asked, "q_block long, queries binary"), "queries")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, copies, blob = pickle.loads(left.column("index")[0].as_py())
            found = BlockIndex.load(blob)
            at: dict[int, list[int]] = {}
            for i, v in enumerate(ids.tolist()):
                at.setdefault(v, []).append(i)
            q_ids, q_vectors = pickle.loads(right.column("queries")[0].as_py())
            block_of = right.column("q_block")[0].as_py()
            for i, (q, x) in enumerate(zip(q_ids.tolist(), q_vectors.astype(np.int64), strict=True)):
                own = np.array(at.get(q, []), dtype=np.int64)
                out += [(q, block_of, i, v, s, min(int(copies[r]), k)) for s, v, r in found.top(x, k, own, ids)]
        names = ["query_id", "q_block", "turn", "vec_id", "score", "copies"]
        return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(len(names))], names=names)

    keys = ["block", "q_block"]
    pairs = indexes.withColumn("q_block", every(q_blocks)).groupBy(*keys).cogroup(questions.withColumn("block", every(blocks)).groupBy(*keys))
    found = pairs.applyInArrow(run, "query_id long, q_block long, turn long, vec_id long, score long, copies long")
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    place = F.row_number().over(Window.partitionBy("query_id", "q_block", "turn").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
