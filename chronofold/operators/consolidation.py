"""Consolidation of episodes: clusters of near memories, each merged into one.

Memories are clustered within a group (a session or a topic). Up to ``LINKAGE`` of them merge by average linkage, exactly;
larger groups stream in order of id through running centroids, which holds a centroid a cluster. A block of vectors meets the
centroids in one product; only centroids that change within the block are met again, vector by vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.storage import positioned, written

THRESHOLD, LINKAGE = 0.8, 2000
#: Vectors that meet the centroids at once, centroids of a product, and how far its cosines may be off.
BLOCK, CENTRES, SLACK = 256, 8192, 1e-9


def average_linkage(x: np.ndarray, theta: float) -> np.ndarray:
    """Cluster numbers of unit vectors: merge the closest two clusters while their mean cosine reaches theta, ties to the first."""
    n = len(x)
    sim = x @ x.T
    np.fill_diagonal(sim, -np.inf)
    size, label = np.ones(n), np.arange(n)
    alive = np.ones(n, bool)
    while n > 1:
        i, j = divmod(int(np.argmax(sim)), len(x))
        if not sim[i, j] >= theta:
            break
        i, j = min(i, j), max(i, j)
        merged = (size[i] * sim[i] + size[j] * sim[j]) / (size[i] + size[j])
        merged[[i, j]] = -np.inf
        sim[i], sim[:, i] = merged, merged
        sim[j], sim[:, j] = -np.inf, -np.inf
        sim[i, ~alive] = sim[~alive, i] = -np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
        n -= 1
    return label


def greedy(x: np.ndarray, theta: float) -> np.ndarray:
    """Cluster numbers in one pass: each vector joins the nearest running centroid within theta, or begins its own."""
    n, dims = x.shape
    centres, long, count = np.empty((min(n, BLOCK), dims)), np.empty(min(n, BLOCK)), 0
    label = np.empty(n, np.int64)
    cosines = lambda k, v: np.einsum("ij,j->i", centres[k], v) / long[k]
    for s in range(0, n, BLOCK):
        block, old = x[s : s + BLOCK], count
        if count + len(block) > len(centres):
            size = min(n, max(2 * len(centres), count + len(block)))
            centres, long = np.resize(centres, (size, dims)), np.resize(long, size)
        # the centroids that each vector may join, if they stay as they are
        vector, centre = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for c in range(0, old, CENTRES):
            z = min(c + CENTRES, old)
            i, k = np.nonzero(block @ centres[c:z].T >= (theta - SLACK) * long[c:z])
            vector.append(i)
            centre.append(k + c)
        order = np.argsort(np.concatenate(vector), kind="stable")
        vector, centre = np.concatenate(vector)[order], np.concatenate(centre)[order]
        at = np.searchsorted(vector, np.arange(len(block) + 1))
        moved: list[int] = []  # old centroids that changed in this block
        for i, v in enumerate(block):
            near = np.union1d(centre[at[i] : at[i + 1]], np.array([*moved, *range(old, count)], np.int64))
            cos = cosines(near, v)
            best = int(np.argmax(cos)) if len(near) else 0
            if len(near) and cos[best] >= theta:
                k = int(near[best])
                centres[k] += v
                if k < old and k not in moved:
                    moved.append(k)
            else:
                k, count = count, count + 1
                centres[k] = v
            long[k] = max(float(np.sqrt(centres[k] @ centres[k])), 1e-300)
            label[s + i] = k
    return label


def clusters(memories: DataFrame, group: str, theta: float = THRESHOLD, linkage: int = LINKAGE) -> DataFrame:
    """The memories (group, memory_id, v, recalls) with head, the smallest id of their cluster; zero vectors stay alone."""
    schema = memories.select(group, "memory_id").schema.add("head", memories.schema["memory_id"].dataType)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("memory_id")
        ids = t["memory_id"].to_numpy()
        v = t["v"].combine_chunks()
        x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
        norm = np.linalg.norm(x, axis=1)
        ok = norm > 0
        head = ids.copy()
        if ok.any():
            y = x[ok] / norm[ok, None]
            label = average_linkage(y, theta) if len(y) <= linkage else greedy(y, theta)
            _, first, of = np.unique(label, return_index=True, return_inverse=True)  # ids ascend
            head[ok] = ids[ok][first][of]
        return pa.table({group: t[group], "memory_id": t["memory_id"], "head": pa.array(head)})

    found = memories.select(group, "memory_id", "v").groupBy(group).applyInArrow(run, schema)
    return memories.join(found.select("memory_id", "head"), "memory_id")


def merged(told: DataFrame) -> DataFrame:
    """head, members, weight and v of the clusters of more than one: the mean by recalls (1 at least), of unit length."""
    w = F.greatest(F.col("recalls"), F.lit(1))
    many = told.groupBy("head").agg(F.count("*").alias("members"), F.sum(w).alias("weight")).where("members > 1")
    cells = told.join(many.select("head"), "head", "left_semi").select("head", w.alias("w"), F.posexplode("v").alias("i", "x")).groupBy("head", "i").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"].cast("double"))  # the dimensions of one vector
    vectors = cells.groupBy("head").agg(v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return many.join(vectors, "head").withColumn("norm", norm).select("head", "members", "weight", F.transform("v", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(0.0)).alias("v"))


def applied(memories: DataFrame, links: DataFrame, told: DataFrame, next_id: int) -> tuple[DataFrame, DataFrame]:
    """(memories, links) after consolidation: merged memories in, their sources out, and links of sources with them."""
    told = written(told)  # clusters are found once, however often they are read
    one = written(merged(told))
    gone = told.join(one.select("head"), "head", "left_semi").select("memory_id")
    new = positioned(one, [F.col("head")], "place").select((F.col("place") + next_id).alias("memory_id"), "v", F.col("weight").alias("recalls"))
    kept = memories.join(gone, "memory_id", "left_anti").select("memory_id", F.col("v").cast("array<double>").alias("v"), F.col("recalls").cast("long").alias("recalls"))
    live = links.join(gone.withColumnRenamed("memory_id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("memory_id", "to_id"), "to_id", "left_anti")
    return kept.unionByName(new.withColumn("recalls", F.col("recalls").cast("long"))), live.select(*links.columns)
