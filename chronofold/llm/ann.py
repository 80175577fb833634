"""Operator 6: approximate nearest neighbours by balanced posting lists, for the largest inner product.

Vectors get one more component, so that the largest inner product is the least distance. Centroids come
from balanced k-means on a bounded sample (``SAMPLE`` rows by hash of the id; about ``LIST`` vectors a list, and at
most a centroid for 8 sampled rows): a cluster pays for its size in each assignment, and centroids of the lightest
clusters move into the heaviest. Every vector goes to the posting list of its nearest centroid and, near
a boundary, to further ones within ``CLOSURE`` times that distance (``REPLICAS`` lists at most). Centroids
are found through an in-memory graph that links each to its nearest ones; the search starts from a few entries and
widens over the links of what it has met, as long as it meets centroids within the distance ratio. A query reads all
lists within ``RATIO`` times the distance of its nearest centroid, with no cap on lists, and more where these hold
too few vectors.

Long lists are dealt in blocks of ``BLOCK`` vectors, and many probes of one list in blocks of ``PROBES``, so
that a common vector loads no single task. Scores are inner products in double precision of the original vectors,
summed the same way wherever a vector stands, so that equal vectors tie exactly. Distances are taken of
vectors divided by the largest component of the table, so that their squares stay finite.

Beyond ``SAMPLE`` / 8 * ``LIST`` vectors (3.2 million) lists grow with the table.

Edge cases: null vectors, zero vectors, vectors with null or non-finite components, of another length than
most, or without an id take no part; a repeated id counts once for each query, with its best score; ties go to the
smaller id; a score that overflows is infinite and one that is not a number comes last; an empty table gives an
empty result; fewer than 20 candidates are all returned; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm._util import materialize, table
from chronofold.llm.ngram_join import _by_group

SAMPLE, LIST, REPLICAS, CLOSURE, RATIO = 100_000, 256, 3, 1.12, 1.14
BLOCK, PROBES, K, EVERY, DEGREE = 1024, 4096, 20, 20, 24
#: Cells of a distance matrix held at a time.
CELLS = 1 << 22


def _squares(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (q**2).sum(1)[:, None] - 2 * q @ c.T + (c**2).sum(1)[None])


def balanced_means(points: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids of clusters of about equal size."""
    rng = np.random.default_rng(seed)
    c = points[rng.choice(len(points), lists, replace=False)].copy()
    price, mean = np.zeros(lists), len(points) / lists
    step = max(1, CELLS // lists)
    for r in range(rounds):
        near, d = np.empty(len(points), np.int64), np.empty(len(points))
        for s in range(0, len(points), step):
            far = _squares(points[s : s + step], c)
            near[s : s + step] = (far + price).argmin(1)
            d[s : s + step] = far[np.arange(len(far)), near[s : s + step]]
        count = np.bincount(near, minlength=lists)
        price = np.maximum(0, price + 0.5 * d.mean() * (count / mean - 1))
        order = np.argsort(near, kind="stable")
        ends = np.cumsum(count)
        full = count > 0
        sums = np.add.reduceat(points[order], (ends - count)[full], axis=0)
        c[full] = sums / count[full, None]
        light, heavy = np.flatnonzero(count < mean / 4), np.flatnonzero(count > 2 * mean)
        if r < rounds - 1 and len(heavy):
            heavy = heavy[np.argsort(-count[heavy], kind="stable")]
            for i, j in zip(light, np.resize(heavy, len(light)), strict=True):  # a light centroid goes to a point of a heavy cluster
                c[i] = points[order[ends[j] - 1 - rng.integers(count[j])]]
                price[i] = 0
    return c


class Centroids:
    """Centroids and the graph that links each to its nearest ones, both ways: neighbours of i are links[at[i] : at[i + 1]]."""

    def __init__(self, points: np.ndarray, lists: int):
        self.c = balanced_means(points, lists)
        degree, step, near = min(DEGREE, lists - 1), max(1, CELLS // lists), []
        for s in range(0, lists, step):
            d = _squares(self.c[s : s + step], self.c)
            d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
            near.append(np.argpartition(d, degree - 1, 1)[:, :degree] if degree else np.zeros((len(d), 0), int))
        out = np.repeat(np.arange(lists), degree)
        to = np.concatenate(near).ravel()
        both = np.unique(np.concatenate((out * lists + to, to * lists + out)))
        self.at = np.searchsorted(both, np.arange(lists + 1) * lists)
        self.links = (both % lists).astype(np.int32)
        self.entries = np.arange(0, lists, max(1, int(lists**0.5)))

    def search(self, q: np.ndarray, ratio: float, least: int) -> np.ndarray:
        """Distances (queries, centroids) of the centroids met, infinite elsewhere."""
        b, k = len(q), len(self.c)
        least = min(least, len(self.entries))
        first = np.sqrt(_squares(q, self.c[self.entries]))
        d = np.full((b, k), np.inf)
        d[:, self.entries] = first
        done = np.zeros((b, k), bool)
        best = np.partition(first, least - 1, 1)[:, :least]  # the nearest ones met so far
        x, y = np.repeat(np.arange(b), len(self.entries)), np.tile(self.entries, b)
        while len(x):  # x, y: met and not widened yet
            near = d[x, y] <= np.maximum(best.min(1) * ratio, best.max(1))[x]
            wait = (x[~near], y[~near])
            x, y = x[near], y[near]
            done[x, y] = True
            n = self.at[y + 1] - self.at[y]
            ends = np.cumsum(n)
            to = self.links[np.repeat(self.at[y] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
            new = np.unique(np.repeat(x, n) * k + to)
            new = new[np.isinf(d.ravel()[new])]
            r, c = new // k, new % k
            for s in range(0, len(r), 1 << 14):
                i, j = r[s : s + (1 << 14)], c[s : s + (1 << 14)]
                d[i, j] = np.sqrt(((q[i] - self.c[j]) ** 2).sum(1))
            if not len(r):
                break
            got = np.full((b, int(np.bincount(r, minlength=b).max())), np.inf)
            got[r, np.arange(len(r)) - np.searchsorted(r, np.arange(b))[r]] = d[r, c]
            best = np.partition(np.hstack((best, got)), least - 1, 1)[:, :least]
            x, y = np.concatenate((wait[0], r)), np.concatenate((wait[1], c))
        return d

    def by_parts(self, f, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of f over x, some rows at a time."""
        step = max(1, CELLS // len(self.c))
        got = [(r + s, c) for s in range(0, len(x), step) for r, c in [f(x[s : s + step])]]
        return (np.concatenate([r for r, _ in got]), np.concatenate([c for _, c in got])) if got else (np.zeros(0, int), np.zeros(0, int))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists of each vector."""
        d = self.search(x, CLOSURE, 8)
        near = np.argsort(d, 1, kind="stable")[:, :REPLICAS]
        got = np.take_along_axis(d, near, 1)
        return np.nonzero(got <= got[:, :1] * CLOSURE)[0], near[got <= got[:, :1] * CLOSURE]

    def probe(self, q: np.ndarray, sizes: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists to read: those within the ratio, and at least ``wanted`` vectors."""
        d = self.search(q, RATIO, 4)
        use = d <= d.min(1, keepdims=True) * RATIO
        short = np.flatnonzero((use * sizes).sum(1) < wanted)
        if len(short):
            full = _squares(q[short], self.c)
            order = np.argsort(full, 1, kind="stable")
            before = np.cumsum(sizes[order], 1) - sizes[order]
            more = np.zeros_like(full, bool)
            np.put_along_axis(more, order, before < wanted, 1)
            use[short] |= more
        return np.nonzero(use)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), flat.dtype)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, most) of the vectors that take part, with their largest component's size."""
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    return df.where(ok).withColumn("most", F.array_max(F.transform("v", F.abs))).where("most > 0")


def _scan(batches, scale: float):
    """The best K of each query over the lists of a task."""
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def flush() -> pa.RecordBatch:
        q = np.repeat(np.array(list(best), np.int64), [len(x[0]) for x in best.values()])
        ids = np.concatenate([x[0] for x in best.values()]) if best else np.zeros(0, np.int64)
        sc = np.concatenate([x[1] for x in best.values()]) if best else np.zeros(0)
        best.clear()
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, pa.int64()), pa.array(sc, pa.float64())], names=["query_id", "vec_id", "score"])

    for t, starts in _by_group(batches, ("list", "block", "probe")):
        kind, ids, vec = t.column("kind").to_numpy(), t.column("id").to_numpy(), _matrix(t.column("v"))
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            m = s + int((kind[s:e] == 0).sum())
            if m == s or m == e:
                continue
            v, vid, q, qid = vec[s:m], ids[s:m], vec[m:e], ids[m:e]
            rough = (q / scale) @ (v / scale).T
            rough[qid[:, None] == vid[None]] = -np.inf
            cut = np.partition(rough, len(v) - K, 1)[:, len(v) - K] if len(v) > K else np.full(len(q), -np.inf)
            margin = 1e-9 * (1 + np.abs(np.where(np.isfinite(cut), cut, 0)))
            for i in range(len(q)):
                j = np.flatnonzero((rough[i] >= cut[i] - margin[i]) & np.isfinite(rough[i]))
                if not len(j):
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    a, b = vid[j], (q[i][None, :] * v[j]).sum(1)
                b[np.isnan(b)] = -np.inf
                if int(qid[i]) in best:
                    x, y = best[int(qid[i])]
                    a, b = np.concatenate((x, a)), np.concatenate((y, b))
                order = np.lexsort((a, -b))
                a, b = a[order], b[order]
                first = np.sort(np.unique(a, return_index=True)[1])[:K]
                best[int(qid[i])] = (a[first], b[first])
            if len(best) > 50_000:
                yield flush()
    yield flush()


def search(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    good = usable(vectors)
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    dim, total = sizes[0]["d"], sizes[0]["count"]
    good = good.where(F.size("v") == dim)
    scale = good.agg(F.max("most")).first()[0]
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.lit(scale)) * (x / F.lit(scale)))
    top2 = good.agg(F.max(norm2)).first()[0]
    points = _matrix(good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v")) / scale

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0, top2 - (x**2).sum(1)))[:, None]])

    graph = Centroids(lifted(points), max(1, min(total // LIST, len(points) // 8)))

    def assign(batches):
        for b in batches:
            x = _matrix(b.column("v"))
            r, c = graph.by_parts(graph.assign, lifted(x / scale))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), b.column("vec_id").take(pa.array(r)), b.column("v").take(pa.array(r))], names=["list", "id", "v"])

    index = materialize(good.select("vec_id", "v").mapInArrow(assign, "list int, id long, v array<double>"))
    counts = {r["list"]: r["count"] for r in index.groupBy("list").count().collect()}  # a row for each centroid
    held = np.array([counts.get(i, 0) for i in range(len(graph.c))])

    def probe(batches):
        for b in batches:
            x = _matrix(b.column("v"))
            q = np.hstack([x / scale, np.zeros((len(x), 1))])
            r, c = graph.by_parts(lambda part: graph.probe(part, held, REPLICAS * (K + 1)), q)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), b.column("vec_id").take(pa.array(r)), b.column("v").take(pa.array(r))], names=["list", "id", "v"])

    asked = good.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    probes = materialize(asked.mapInArrow(probe, "list int, id long, v array<double>"))
    asks = {r["list"]: r["count"] for r in probes.groupBy("list").count().collect()}
    deal = spark.createDataFrame([(i, -(-int(held[i]) // BLOCK) or 1, -(-asks.get(i, 0) // PROBES) or 1) for i in range(len(held))], "list int, blocks int, parts int")

    def cross(df: DataFrame, kind: int, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        return df.join(F.broadcast(deal), "list").select("list", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("theirs"), F.lit(kind).alias("kind"), "id", "v")

    left = cross(index, 0, "blocks", "parts").select("list", F.col("mine").alias("block"), F.col("theirs").alias("probe"), "kind", "id", "v")
    right = cross(probes, 1, "parts", "blocks").select("list", F.col("theirs").alias("block"), F.col("mine").alias("probe"), "kind", "id", "v")
    keys = ["list", "block", "probe"]
    found = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(lambda it: _scan(it, scale), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
