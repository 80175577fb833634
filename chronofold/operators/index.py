"""A kept index of nearest vectors: lists around centroids, with insertion, deletion, merging and an exact way.

Centroids are fitted on a bounded sample. A vector stands in the list of its nearest centroid and, where others are
nearly as near, in these too (``COPIES`` at most). A query reads the lists of its nearest centroids; equal cells of queries
and list rows meet in one shuffle, and long lists are dealt in chunks, so that no task has more than a chunk of a list.
Everything is a commit: rows are added, ids are deleted by tombstones, and ``merge`` writes the lists anew without them. A row
is alive if no later commit deleted or replaced its id, and each search reads one version.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.operators import similarity
from chronofold.sources.commits import Commits

SAMPLE, MOST_LISTS, ROUNDS, COPIES, NEARLY, CHUNK = 20_000, 4096, 8, 2, 1.15, 16_384
LISTS = "list bigint, memory_id bigint, v array<bigint>, first boolean, born bigint"
GONE = "memory_id bigint, died bigint"
CENTRES = "list bigint, v array<double>"


def _centroids(x: np.ndarray, n: int) -> np.ndarray:
    """Lloyd's centroids of the rows, from distinct rows far from one another."""
    rng = np.random.default_rng(1)
    c = x[rng.permutation(len(x))[:n]].copy()
    for _ in range(ROUNDS):
        near = _distances(x, c).argmin(1)
        sums, count = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[rng.integers(len(x), size=len(c))])
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0.0)


class Index:
    """Lists of vectors (memory_id, v) in a folder of commits."""

    def __init__(self, commits: Commits):
        self.commits, self.spark = commits, commits.spark

    def build(self, memories: DataFrame, lists: int | None = None) -> int:
        """Fit the centroids and write all rows; about the root of their number of lists, unless told."""
        n = memories.count()
        lists = min(lists or max(1, int(n**0.5)), MOST_LISTS)
        share = min(1.0, 2 * SAMPLE / max(n, 1))
        some = memories.select("v").sample(fraction=share, seed=1).limit(SAMPLE).toArrow() if n else None
        x = similarity.matrix(some.column("v").combine_chunks()).astype(float) if some is not None and some.num_rows else np.zeros((0, 0))
        centres = _centroids(x, min(lists, len(x))) if len(x) else x
        at = self.commits.version()
        rows = [(i, [float(z) for z in c]) for i, c in enumerate(centres)]
        table = self.spark.createDataFrame(rows, CENTRES)
        return self.commits.commit({"centres": table.withColumn("born", F.lit(at + 1).cast("long")), "lists": self._listed(memories, centres, at + 1)}, at)

    def _centres(self, version: int) -> np.ndarray:
        told = self.commits.read("centres", version)
        if told is None:
            raise ValueError("the index is not built")
        last = told.where(F.col("born") == told.agg(F.max("born")).first()[0]).orderBy("list").collect()
        return np.array([r.v for r in last]) if last else np.zeros((0, 0))

    def _near(self, rows: DataFrame, centres: np.ndarray, most: int, ratio: float) -> DataFrame:
        """rows (id, v) with list and nth: their nearest lists, up to ``most`` and to ``ratio`` times the least distance."""
        shared = self.spark.sparkContext.broadcast(centres)  # MOST_LISTS rows at most

        def run(batches):
            c = shared.value
            for b in (x.slice(s, similarity.ROWS) for x in batches for s in range(0, x.num_rows, similarity.ROWS)):
                if not len(c):
                    continue
                d = _distances(similarity.matrix(b.column("v")).astype(float), c)
                order = np.argsort(d, axis=1, kind="stable")[:, :most]
                far = np.take_along_axis(d, order, 1)
                row, nth = np.nonzero(np.sqrt(far) <= ratio * np.sqrt(far[:, :1]) + 1e-9)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), b.column("v").take(pa.array(row)), pa.array(order[row, nth].astype(np.int64)), pa.array(nth.astype(np.int64))], names=["id", "v", "list", "nth"])

        return rows.mapInArrow(run, "id long, v array<bigint>, list long, nth long")

    def _listed(self, memories: DataFrame, centres: np.ndarray, born: int) -> DataFrame:
        near = self._near(memories.select(F.col("memory_id").alias("id"), "v"), centres, COPIES, NEARLY)
        return near.select("list", F.col("id").alias("memory_id"), "v", (F.col("nth") == 0).alias("first"), F.lit(born).cast("long").alias("born"))

    def insert(self, memories: DataFrame) -> int:
        """Add rows; rows of an id that is there replace it."""
        at = self.commits.version()
        gone = memories.select("memory_id").distinct().withColumn("died", F.lit(at).cast("long"))
        return self.commits.commit({"lists": self._listed(memories, self._centres(at), at + 1), "gone": gone}, at, ("gone", "memory_id"))

    def delete(self, ids: DataFrame) -> int:
        """Tombstones for ids (memory_id)."""
        at = self.commits.version()
        return self.commits.commit({"gone": ids.select("memory_id").distinct().withColumn("died", F.lit(at).cast("long"))}, at, ("gone", "memory_id"))

    def rows(self, version: int | None = None) -> DataFrame:
        """The living rows of the lists: those born by the commit that is told last for their list table and not deleted since."""
        at = self.commits.version() if version is None else version
        base = self.commits.read("centres", at)
        lists = self.commits.read("lists", at)
        if base is None or lists is None:
            raise ValueError("the index is not built")
        lists = lists.where(F.col("born") >= base.agg(F.max("born")).first()[0])
        gone = self.commits.read("gone", at)
        if gone is None:
            return lists
        last = gone.groupBy("memory_id").agg(F.max("died").alias("died"))
        return lists.join(last, "memory_id", "left").where(F.col("died").isNull() | (F.col("born") > F.col("died"))).drop("died")

    def merge(self) -> int:
        """Write the living rows anew, around centroids of their own; the old commits stay readable by version."""
        alive = self.rows().where("first").select("memory_id", "v")
        return self.build(alive)

    def search(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = False) -> DataFrame:
        """query_id, memory_id, rank, distance2: the k nearest of each query (query_id, q) in its lists, or of all rows.

        Queries whose lists have fewer than k living rows are answered exactly.
        """
        at = self.commits.version()
        alive = self.rows(at)
        told = None if exact else self._probed(alive, queries, self._centres(at), k, probes)
        if told is not None:
            short = queries.join(told.groupBy("query_id").count().where(F.col("count") >= k), "query_id", "left_anti")
        rest = queries if exact else short
        if rest.limit(1).count():
            whole = alive.where("first").select("memory_id", "v", F.lit(1.0).alias("weight"))
            full = similarity.best(whole, rest, k, "near")
            told = full if told is None else told.join(rest.select("query_id"), "query_id", "left_anti").unionByName(full)
        order = W.partitionBy("query_id").orderBy(F.desc(similarity.key_column("near")), "memory_id")
        return told.select("query_id", "memory_id", F.row_number().over(order).alias("rank"), (F.col("nv") + F.col("nq") - 2 * F.col("d")).alias("distance2"))

    def _probed(self, alive: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probes: int) -> DataFrame:
        size = alive.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
        near = self._near(queries.select(F.col("query_id").alias("id"), F.col("q").alias("v")), centres, probes, float("inf"))
        chunk = lambda n: F.pmod(F.xxhash64("id"), n)
        asked = near.join(size, "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "id", "v", F.lit(None).cast("double").alias("weight"))
        shown = alive.select("list", F.col("memory_id").alias("id"), "v").join(size, "list").select("list", chunk(F.col("chunks")).alias("chunk"), F.lit(1).alias("side"), "id", "v", F.lit(1.0).alias("weight"))
        found = similarity.in_cells(asked, shown, ["list", "chunk"], k, "near").dropDuplicates(["query_id", "memory_id"])
        order = W.partitionBy("query_id").orderBy(F.desc(similarity.key_column("near")), "memory_id")
        return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
