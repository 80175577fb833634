"""Exact nearest vectors of a query set of any size: blocked products, short lists merged, no pair rows.

Up to ``MOST`` queries go to every task, which reads its own memories once. More queries are dealt to blocks, as the
memories are dealt to chunks, by hash; a task has one block and one chunk, holds the block and streams the chunk. There are
as many chunks as give every core some tasks, so a self-product of n rows moves n * n / BLOCK rows and no task holds
more than a block, whose lists have ``HELD`` entries or some more. A task keeps the best few of each query over all it reads; the tasks' lists meet in one aggregation by
query. Vectors are whole numbers and products exact. A product in single precision goes first: what lies below the last of a
full list by more than its rounding can hide is left out, and only the rest, a few pairs a query, is multiplied exactly, so a
tile costs one product and one comparison. Queries of equal vectors are asked once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.storage import written

#: Queries that go to every task; queries of a block, memories multiplied at once, tasks for each core, and entries of a block's lists.
MOST, BLOCK, ROWS, WAVES, HELD = 2048, 16384, 512, 6, 1 << 19
#: Pairs multiplied exactly at once.
PAIRS = 1 << 14
SCHEMA = "query_id long, memory_id long, weight double, d long, nv long, nq long"
_COLUMNS = ["query_id", "memory_id", "weight", "d", "nv", "nq"]


def matrix(column: pa.Array) -> np.ndarray:
    """An array column of equal lengths as rows of int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The exact products of the rows of v and q, pair by pair."""
    return np.einsum("ij,ij->i", v, q)


def keys(d: np.ndarray, nv: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The squared cosine, but for the query's length, of weighted products; 0 where not positive."""
    x = d * weight
    return np.where(x > 0, x * x / nv.astype(float), 0.0)


class Lists:
    """The k best memories of each of a block of queries, over all that was shown so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, by: str):
        self.ids, self.q, self.k, self.by = ids, q, k, by
        self.nq = (q * q).sum(1) if len(q) else np.zeros(0, np.int64)
        self.least = np.full(len(ids), -np.inf)  # the key of the last of a full list
        self.held = [np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64, np.int64, float)]  # query, memory, weight, d, nv, key
        # rows of length 1, or of whole numbers scaled by the longest query
        self.long = np.sqrt(self.nq.astype(float))
        self.unit = (q / np.where(self.long > 0, self.long, 1.0)[:, None]).astype(np.float32).T.copy() if len(q) else np.zeros((0, 0), np.float32)

    def _rough(self, v: np.ndarray, nv: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vectors, queries) in single precision that order each query's memories nearly as the key does, how far off they
        may be, by memory, and the same measure of each query's last key."""
        long = np.sqrt(nv.astype(float))
        unit = v / long[:, None]
        slack = 4 * (v.shape[1] + 8) * 2.0**-24
        if self.by == "cosine":  # |q| cos w, by unit query: cos w
            with np.errstate(invalid="ignore"):
                last = np.where(self.least > 0, np.sqrt(np.maximum(self.least, 0)) / np.where(self.long > 0, self.long, 1.0), -np.inf)
            return (unit * weight[:, None]).astype(np.float32) @ self.unit, slack * np.abs(weight), last
        if self.by == "dot":
            top = max(1.0, float(long.max()))
            return (v / top).astype(np.float32) @ self.unit, np.full(len(v), slack), self.least / (top * np.where(self.long > 0, self.long, 1.0))
        # nearness: 2 d - nv, over the longest of all
        top = max(1.0, float(long.max()), float(self.long.max(initial=0)))
        rough = (2 * v / top).astype(np.float32) @ (self.unit * (self.long / top).astype(np.float32)) - (nv / top**2).astype(np.float32)[:, None]
        return rough, np.full(len(v), 6 * slack), (self.least + self.nq) / top**2

    def show(self, v: np.ndarray, mid: np.ndarray, weight: np.ndarray) -> None:
        for s in range(0, len(v), ROWS):
            self._tile(v[s : s + ROWS], mid[s : s + ROWS], weight[s : s + ROWS])

    def _tile(self, v: np.ndarray, mid: np.ndarray, weight: np.ndarray) -> None:
        nv = (v * v).sum(1)
        ok = nv > 0
        v, mid, weight, nv = v[ok], mid[ok], weight[ok], nv[ok]
        if not len(v) or not len(self.q):
            return
        rough, slack, last = self._rough(v, nv, weight)
        slack = float(slack.max())
        floor = last - slack
        unset = np.flatnonzero(~np.isfinite(last))
        if len(unset) and len(v) > self.k:  # a list that is not full yet takes the best of this tile
            own = rough[:, unset]
            floor[unset] = np.partition(own, len(own) - self.k, axis=0)[len(own) - self.k] - 2 * slack
            if self.by == "cosine":  # all that is not positive is a tie at 0
                floor[unset] = np.where(floor[unset] <= 2 * slack, -np.inf, floor[unset])
        with np.errstate(over="ignore"):
            low = np.nextafter(floor.astype(np.float32), np.float32(-np.inf))
        row, query = np.divmod(np.flatnonzero((rough >= low[None]).ravel()), len(self.q))
        del rough
        for s in range(0, len(row), PAIRS):
            self._take(row[s : s + PAIRS], query[s : s + PAIRS], v, mid, weight, nv)

    def _take(self, row: np.ndarray, query: np.ndarray, v: np.ndarray, mid: np.ndarray, weight: np.ndarray, nv: np.ndarray) -> None:
        d = exact(v[row], self.q[query])
        key = keys(d, nv[row], weight[row]) if self.by == "cosine" else d.astype(float) if self.by == "dot" else -(nv[row] + self.nq[query] - 2 * d).astype(float)
        ok = key >= self.least[query]
        row, query, d, key = row[ok], query[ok], d[ok], key[ok]
        if not len(row):
            return
        new = [query, mid[row], weight[row], d, nv[row], key]
        met = np.zeros(len(self.ids), bool)  # only the lists that change are sorted again
        met[query] = True
        again = met[self.held[0]]
        both = [np.concatenate((x[again], y)) for x, y in zip(self.held, new, strict=True)]
        order = np.lexsort((both[1], -both[5], both[0]))
        both = [x[order] for x in both]
        nth = np.arange(len(order)) - np.searchsorted(both[0], np.arange(len(self.ids)))[both[0]]
        last = nth == self.k - 1
        self.least[both[0][last]] = both[5][last]
        self.held = [np.concatenate((x[~again], y[nth < self.k])) for x, y in zip(self.held, both, strict=True)]

    def told(self) -> pa.RecordBatch:
        query, *rest = self.held
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[query], *rest[:4], self.nq[query])], names=_COLUMNS)


def best(memories: DataFrame, queries: DataFrame, k: int, by: str = "cosine") -> DataFrame:
    """The k best memories (memory_id, v, weight) of each query (query_id, q), ties to the smaller id, as ``SCHEMA``.

    By ``cosine`` (weighted, at least 0), ``dot`` or ``near`` (least distance). Memories without length take no part.
    """
    memories = memories.select("memory_id", "v", F.col("weight").cast("double").alias("weight"))
    asked = queries.select("query_id", "q").limit(MOST + 1).toArrow()
    if asked.num_rows <= MOST:
        return _first(_by_all(memories, asked, k, by), k, by)
    every = written(queries.select("query_id", "q"))
    one = written(every.groupBy("q").agg(F.min("query_id").alias("one")))
    if one.count() == every.count():
        return _first(_by_blocks(memories, every, k, by), k, by)
    asked = one.limit(MOST + 1).select(F.col("one").alias("query_id"), "q")
    few = asked.toArrow()
    near = _by_all(memories, few, k, by) if few.num_rows <= MOST else _by_blocks(memories, one.select(F.col("one").alias("query_id"), "q"), k, by)
    same = every.join(one, "q").select("query_id", F.col("one").alias("of"))
    near = _first(near, k, by).withColumnRenamed("query_id", "of")
    return same.join(near, "of").select(*_COLUMNS)


def _first(near: DataFrame, k: int, by: str) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc(key_column(by)), "memory_id")
    return near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def _by_all(memories: DataFrame, asked: pa.Table, k: int, by: str) -> DataFrame:
    """Lists of each task's own memories; the queries go to all tasks."""
    ids, q = asked.column("query_id").to_numpy(), matrix(asked.column("q").combine_chunks())

    def run(batches):
        lists = Lists(ids, q, k, by)
        for b in batches:
            lists.show(matrix(b.column("v")), b.column("memory_id").to_numpy(), b.column("weight").to_numpy())
        yield lists.told()

    return memories.mapInArrow(run, SCHEMA)


def _by_blocks(memories: DataFrame, queries: DataFrame, k: int, by: str) -> DataFrame:
    """Lists of each block of queries over each chunk of memories: a cell of a grid is a task's work."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    blocks = -(-queries.count() // min(BLOCK, max(1024, HELD // k)))
    chunks = -(-WAVES * cores // blocks)
    deal = lambda c, n: F.pmod(F.xxhash64(c, F.lit(n)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(deal("query_id", blocks).alias("block"), every(chunks).alias("chunk"), F.lit(0).alias("side"), F.col("query_id").alias("id"), F.col("q").alias("v"), F.lit(None).cast("double").alias("weight"))
    shown = memories.select(every(blocks).alias("block"), deal("memory_id", chunks).alias("chunk"), F.lit(1).alias("side"), F.col("memory_id").alias("id"), "v", "weight")
    return in_cells(asked, shown, ["block", "chunk"], k, by, blocks * chunks)


def in_cells(asked: DataFrame, shown: DataFrame, cell: list[str], k: int, by: str, parts: int | None = None) -> DataFrame:
    """Lists of the queries of each cell over the memories of that cell; both have the cell's columns, side (0, 1), id, v, weight."""

    def run(batches):
        now, lists, ids, rows = None, None, [], []
        for b in batches:
            where = np.stack([b.column(c).to_numpy() for c in (*cell, "side")])
            cuts = np.append(0, np.flatnonzero((where[:, 1:] != where[:, :-1]).any(0)) + 1)
            for a, z in zip(cuts, np.append(cuts[1:], b.num_rows), strict=True):
                if z <= a:
                    continue
                here, side = tuple(where[:-1, a]), where[-1, a]
                if here != now:
                    if lists:
                        yield lists.told()
                    now, lists, ids, rows = here, None, [], []
                part = b.slice(a, z - a)
                v, mid = matrix(part.column("v")), part.column("id").to_numpy()
                if side == 0:
                    ids.append(mid)
                    rows.append(v)
                    continue
                if lists is None and ids:
                    lists = Lists(np.concatenate(ids), np.concatenate(rows), k, by)
                if lists:
                    lists.show(v, mid, part.column("weight").to_numpy())
        if lists:
            yield lists.told()

    both = asked.unionByName(shown)
    dealt = both.repartition(parts, *cell) if parts else both.repartition(*cell)
    return dealt.sortWithinPartitions(*cell, "side").mapInArrow(run, SCHEMA)


def key_column(by: str = "cosine"):
    if by != "cosine":
        return F.col("d") if by == "dot" else 2 * F.col("d") - F.col("nv") - F.col("nq")
    x = F.col("d").cast("double") * F.col("weight")
    return F.when(x > 0, x * x / F.col("nv").cast("double")).otherwise(0.0)
