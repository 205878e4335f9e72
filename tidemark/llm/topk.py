"""Exact top-k by inner product with an impact-ordered index.

The index of a block of vectors holds posting segments: for each quantised
impact (how large a component is) and dimension the vectors that have it there.
Queries read the segments score-at-a-time, by falling impact, adding to one
accumulator a vector.  What segments not yet read may still add to a vector is
bounded by the lengths of the query and of the vector's unread part, so each
vector has a lower and an upper bound.  Reading stops on proof only: when few
enough vectors can still be among the best ``k``.  These are then scored
exactly.

Every block of vectors goes to one task, which builds its index once and
streams all queries past it, a few at a time; blocks are sized so that index
and accumulators take bounded memory whatever the number of dimensions.  Per
query and block at most ``k`` rows leave a task, and the best ``k`` of them are
the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import on_workers, partitions, table

SCALE = 64
HITS = "query_id long, vec_id long, score long"
BLOCK, LEAST_BLOCK = 1 << 22, 1 << 18  # components of a block of vectors
AT_ONCE = 32  # queries that read an index together
LONG = np.iinfo(np.int64)


class ImpactIndex:
    """Whole-number vectors, rising by id, as posting segments by falling impact."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, levels: int = 24):
        self.vectors, self.ids = vectors, ids
        self.largest = max(map(abs, (int(vectors.max(initial=0)), int(vectors.min(initial=0)))))
        self.read = self.held = 0
        if self.largest >= 2**31:
            return  # products may not fit: no segments, see ``top``
        size = np.abs(vectors)
        impacts = np.unique(size[size > 0])
        if len(impacts) > levels:
            impacts = np.unique(np.quantile(size[size > 0], np.linspace(0, 1, levels + 1)[:-1], method="lower"))
        level = np.searchsorted(impacts, size, side="right")  # 0: nothing to post
        at, dim = np.nonzero(level)
        order = np.lexsort((at, dim, -level[at, dim]))
        at, dim = at[order], dim[order]
        start = np.flatnonzero(np.diff(level[at, dim] * vectors.shape[1] + dim, prepend=-1))
        stop = np.append(start[1:], len(at))
        self.at, self.value = at.astype(np.int32), vectors[at, dim].astype(np.int32)
        self.segments: list[list[tuple[int, int, int]]] = [[] for _ in impacts]  # dimension, first and last posting
        for a, b in zip(start.tolist(), stop.tolist()):
            self.segments[len(impacts) - int(level[at[a], dim[a]])].append((int(dim[a]), a, b))
        # Lengths of what is unread after each impact.
        self.unread = [np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (np.where(level <= k, vectors, 0).astype(float) for k in range(len(impacts) - 1, -1, -1))]

    def top(self, queries: np.ndarray, own: np.ndarray, k: int, few: int = 8) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the positions of the best ``k`` vectors, best first (ties by id), and their exact scores; vectors with its id ``own`` are left out."""
        n, many = len(self.vectors), len(queries)
        lo, hi = np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, side="right")
        size = int(np.abs(queries.astype(float)).max(initial=0)) + 1
        bound = (self.largest + 1) * size * max(1, queries.shape[1])
        if bound >= 2**62 or self.largest >= 2**31:  # Python's own whole numbers; scores beyond a long become its ends
            exact = self.vectors.astype(object) @ queries.T.astype(object)
            return [self._best(np.array([min(max(x, LONG.min), LONG.max) for x in exact[:, i]], np.int64), np.arange(n), lo[i], hi[i], k) for i in range(many)]
        kind = np.int32 if bound < 2**31 else np.int64
        acc, side = np.zeros((n, many), kind), np.ascontiguousarray(queries.T.astype(kind))
        length = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * many
        open_ = np.arange(many)
        asked = np.inf
        for segments, unread in zip(self.segments, self.unread):
            for dim, a, b in segments:
                acc[self.at[a:b]] += self.value[a:b, None].astype(kind) * side[dim]
            self.read += sum(b - a for _, a, b in segments) * len(open_)
            left = unread.max(initial=0)
            if n <= few * k or left > 0.6 * asked or not left:
                continue  # a proof is tried whenever the unread part has shrunk enough
            asked = left
            slack = unread[:, None] * (length[open_] * (1 + 1e-9))
            low = (acc - slack).T.copy()
            for i, q in enumerate(open_):
                low[i, lo[q] : hi[q]] = -np.inf
            reach = np.partition(low, n - k, axis=1)[:, n - k]
            may = acc + slack >= reach
            done = may.sum(axis=0) <= few * k
            for i in np.flatnonzero(done):
                q, at = open_[i], np.flatnonzero(may[:, i])
                out[q] = self._best(self.vectors[at] @ queries[q], at, lo[q], hi[q], k)
            if done.any():
                open_, acc, side = open_[~done], np.ascontiguousarray(acc[:, ~done]), np.ascontiguousarray(side[:, ~done])
            if not len(open_):
                break
        for i, q in enumerate(open_):  # all segments read: the sums are exact
            out[q] = self._best(acc[:, i].astype(np.int64), np.arange(n), lo[q], hi[q], k)
        self.held += len(self.at) * many
        return out

    @staticmethod
    def _best(score: np.ndarray, at: np.ndarray, lo: int, hi: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        other = (at < lo) | (at >= hi)
        score, at = score[other], at[other]
        if len(score) > k:
            near = score >= np.partition(score, len(score) - k)[len(score) - k]
            score, at = score[near], at[near]
        order = np.argsort(~score, kind="stable")[:k]  # falling; a long's least number has no negative
        return at[order], score[order]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, cut or padded with zeros to ``width``."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    if len(ends) > 1 and (np.diff(ends) == width).all():
        return flat[ends[0] : ends[-1]].reshape(-1, width).astype(np.int64)
    out = np.zeros((len(ends) - 1, width), np.int64)
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        out[i, : min(width, b - a)] = flat[a : min(b, a + width)]
    return out


def _streamed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows by block, in each the vectors by id and then the queries: the index of a block is built once, and few queries are held."""
    block, index = None, None
    parts: list[tuple[np.ndarray, pa.Array]] = []
    for batch in batches:
        vb, asks, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = np.flatnonzero((np.diff(vb) != 0) | (np.diff(asks.astype(int)) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(vb)]):
            if a == b:
                continue
            if vb[a] != block:
                block, index, parts = vb[a], None, []
            v = batch.column(3).slice(a, b - a)
            if not asks[a]:
                parts.append((ids[a:b], v))
                continue
            if index is None:
                width = max((int(np.diff(p.offsets.to_numpy()).max(initial=0)) for _, p in parts), default=0)
                if width:
                    index, parts = ImpactIndex(np.concatenate([_matrix(p, width) for _, p in parts]), np.concatenate([i for i, _ in parts])), []
                else:
                    continue
            for at in range(0, b - a, AT_ONCE):
                own = ids[a + at : min(b, a + at + AT_ONCE)]
                found = index.top(_matrix(v.slice(at, len(own)), index.vectors.shape[1]), own, k)
                cols = [np.repeat(own, [len(p) for p, _ in found]), index.ids[np.concatenate([p for p, _ in found])], np.concatenate([s for _, s in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row of ``queries(vec_id, v)`` the best ``k`` of ``vectors(vec_id, v)``.

    ``v`` are arrays of whole numbers (shorter ones count as padded with
    zeros; products that a long can't hold are summed exactly all the same,
    scores beyond it become its ends).  Rows with the query's own ``vec_id``
    are no candidates; of several queries with one id the least vector asks;
    repeated candidate rows compete each.  Ties go to the smaller ``vec_id``.
    Empty tables give no rows; other columns are ignored.  ``block`` bounds the
    components that a task indexes at once.
    """
    on_workers(vectors.sparkSession)
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    total = size["n"] * max(1, size["d"] or 1)
    # Small tables go in smaller blocks, so that all tasks have some.
    many = max(1, -(-total // block), min(-(-total // LEAST_BLOCK), 2 * partitions(vectors.sparkSession)))
    left = vectors.select(F.pmod(F.xxhash64("vec_id", F.spark_partition_id()), F.lit(many)).cast("int").alias("vb"), F.lit(False).alias("asks"), "vec_id", "v")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("vb"), F.lit(True).alias("asks"), "vec_id", "v")
    dealt = left.unionByName(right).repartitionById(many, "vb").sortWithinPartitions("vb", "asks", "vec_id")
    hits = dealt.mapInArrow(lambda batches: _streamed(batches, k), HITS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """``vec_id, v``: floor(64 * x) of finite vectors; null, empty and other ones (also such without id) take no part, very long ones whole."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: F.coalesce((e < float("inf")) & (e > float("-inf")) & ~F.isnan(e), F.lit(False)))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(fine)
    return rows.select("vec_id", F.transform(x, lambda e: F.floor(e * SCALE)).alias("v"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th of ``embeddings`` asks all others; edge cases as in ``top_k`` and ``whole_numbers``."""
    rows = whole_numbers(table(spark, sf_dir, "embeddings"))
    return top_k(rows.where(F.col("vec_id") % 20 == 0), rows)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
