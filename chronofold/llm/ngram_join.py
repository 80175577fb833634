"""Operator 10: n-gram Jaccard join as a blocked sparse matrix product.

Rows of the matrix are distinct shingle sets (documents with equal sets are one row), columns are
shingles. Only blocks of the product that can hold a pair above the bound are computed:

1. Columns are ordered by an estimate of how many documents have them. By the size bound (a partner shares
   at least ceil(t * size) columns) two linked rows meet in the first size - ceil(t * size) + 1 columns of
   both in that order. Rows are joined on those columns only.
2. In each such column, rows are compared in tiles of like sizes by size and by a parity sketch, whose
   Hamming distance never exceeds the size of the symmetric difference; the rest is discarded by the bound
   (1 - t) / (1 + t) * (a + b). Feasible rows are united into row blocks. In a column of several tiles, the
   sketches of rows outside the column's largest block then visit the other tiles that hold sizes they can
   link with, in parts of VISITORS rows. So a block never parts two linked rows.
3. Each row block gets its columns, in tiles of rows. A tile's sparse product accumulates overlap counts
   exactly, and pairs below the bound are discarded. Blocks of several tiles are finished by sending the
   rows outside the block's largest component to every tile of it, in a second product.

The result depends on no estimate: the order of columns and the row blocks only decide what is compared.
Pairs are never emitted: a tile gives a spanning forest of its links.

A column that stands out in a sample of the rows is dealt to its tiles by size and hash, never sorted in one task.

Edge cases: null text and texts without words have the empty set, size 0, are linked with nothing and form
their own component; fewer words than n give one shingle; very long texts have longer sketches and are hashed
whole, some at a time; pairs that meet the threshold exactly link; repeated rows and repeated ids are rows of
their own, a component's id being its smallest doc_id that is not null; extra columns, whatever their names, are
ignored, and kept by ``one_of_each``; an empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm._util import MERGE, WORD, components, find, materialize, maybe_in, settled, table, without
from chronofold.llm.shingles import mix64, shingles, sliced

N, THRESHOLD, TILE = 3, Fraction(9, 10), 256
BUCKETS, HEAVY, SKETCH, COLUMN_BITS, CELLS, VISITORS = 1 << 20, 1 << 16, 512, 40, 1 << 18, 4096
#: Rows sampled to find hot columns, and the share of them, one in so many, that makes a column hot.
ONE_IN, MOST_HOT = 64, 2000


def _heavy_columns(docs: DataFrame, n: int) -> dict[int, int]:
    """Estimated counts of the hash buckets that stand out in some task; at most HEAVY of them."""

    def run(batches):
        seen = np.zeros(BUCKETS, np.int64)
        for b in sliced(batches, "text"):
            _, h = shingles(b.column("text"), n)
            np.add.at(seen, (h >> np.uint64(44)).astype(np.int64), 1)
        hot = np.flatnonzero(seen >= max(8, 8 * seen.sum() / BUCKETS))
        yield pa.RecordBatch.from_arrays([pa.array(hot, pa.int64()), pa.array(seen[hot], pa.int64())], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in rows.orderBy(F.desc("n"), "bucket").limit(HEAVY).collect()}


def _lists(values: np.ndarray, rows: np.ndarray, count: int) -> pa.Array:
    at = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=count)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.view(np.int64)))


def _described(docs: DataFrame, n: int, t: Fraction, heavy: dict[int, int]) -> DataFrame:
    """doc_id, key of the text, size, two hashes of the set, its first columns and its parity sketch."""
    num, den = t.numerator, t.denominator

    def run(batches):
        weight = np.zeros(BUCKETS, np.int64)
        for k, v in heavy.items():
            weight[k] = v
        for b in sliced(batches, "text"):
            m = b.num_rows
            r, h = shingles(b.column("text"), n)
            size = np.bincount(r, minlength=m)
            at = np.concatenate(([0], np.cumsum(size)))
            # order-free 128-bit set hashes
            sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(h ^ np.uint64(s))))) for s in (0x1234567, 0xABCDEF01)]
            h1, h2 = ((x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums)
            order = np.lexsort((h, weight[(h >> np.uint64(44)).astype(np.int64)], r))
            place = np.arange(len(r)) - at[r]
            first = size - -(-num * size // den) + 1
            keep = place < first[r]
            cols = h[order][keep] >> np.uint64(64 - COLUMN_BITS)  # columns that fall together only add candidates
            bits = (np.bincount(r * SKETCH + (h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=m * SKETCH) & 1).astype(np.uint8)
            packed = np.packbits(bits.reshape(m, SKETCH), axis=1) if m else np.zeros((0, SKETCH // 8), np.uint8)
            sketch = [x.tobytes() for x in packed]
            for i in np.flatnonzero(size > 2 * SKETCH):  # a longer sketch for a larger set: the power of two from size / 2
                long = 1 << ((int(size[i]) + 1) // 2 - 1).bit_length()
                parity = np.bincount((h[at[i] : at[i + 1]] & np.uint64(long - 1)).astype(np.int64), minlength=long) & 1
                sketch[i] = np.packbits(parity.astype(np.uint8)).tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("txh"), pa.array(size, pa.int64()), pa.array(h1), pa.array(h2), _lists(cols, r[keep], m), pa.array(sketch, pa.binary())],
                names=["doc_id", "txh", "size", "h1", "h2", "cols", "sketch"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", F.xxhash64("text").alias("txh")).mapInArrow(run, f"doc_id {kind}, txh long, size long, h1 long, h2 long, cols array<long>, sketch binary")


def _by_group(batches, keys: tuple[str, ...]):
    """Whole groups of a sorted stream of batches, as one batch each time, with the groups' bounds."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        k = [t.column(x).to_numpy() for x in keys]
        new = np.ones(t.num_rows, bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in k], axis=0)
        starts = np.flatnonzero(new)
        if len(starts) > 1:
            yield t.slice(0, starts[-1]), starts
        rest = t.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _edges(pairs: list) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _folded(sketches: list[bytes], length: int) -> np.ndarray:
    """Sketches as rows of ``length`` 64-bit words; the halves of a longer one are added."""
    out = np.empty((len(sketches), length), np.uint64)
    for i, x in enumerate(sketches):
        w = np.frombuffer(x, np.uint64)
        while len(w) > length:
            w = w[: len(w) // 2] ^ w[len(w) // 2 :]
        out[i] = w
    return out


def _feasible(batches, num: int, den: int, keys: tuple[str, ...], guests: bool):
    """Spanning forests, by size bound and sketch, of the rows that meet in a tile of a column.

    With guests, a group's residents are compared with its guests only, and rows of equal label are already
    joined. Sketches of two lengths meet at the shorter one; sets that can link differ by one length at most.
    """
    for t, starts in _by_group(batches, keys):
        node, size, sketch = t.column("node").to_numpy(), t.column("size").to_numpy(), t.column("sketch").to_pylist()
        label = t.column("label").to_numpy() if guests else node
        guest = t.column("guest").to_numpy() if guests else None
        length = np.array([len(x) // 8 for x in sketch])
        out: list = []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if e - s < 2:
                continue
            parent: dict = {}
            for k in np.unique(length[s:e]):
                own, longer = (np.flatnonzero(length[s:e] == x) + s for x in (k, 2 * k))
                rows = np.concatenate((own, longer))
                words = _folded([sketch[x] for x in rows], int(k))
                for p in range(len(rows) if guests else len(own)):
                    i = rows[p]
                    if not guests:
                        q = np.arange(p + 1, len(rows))
                    elif guest[i]:
                        continue
                    else:  # two longer ones meet at their own length
                        q = np.flatnonzero(guest[rows if p < len(own) else own] == 1)
                    a, b = size[i], size[rows[q]]
                    q = q[np.minimum(a, b) * den >= num * np.maximum(a, b)]
                    far = np.bitwise_count(words[q] ^ words[p]).sum(1)
                    for j in rows[q[far * (num + den) <= (den - num) * (a + size[rows[q]])]]:
                        x, y = find(parent, label[i]), find(parent, label[j])
                        if x != y:
                            parent[max(x, y)] = min(x, y)
                            out.append((node[i], node[j]))
        yield _edges(out)


def _outside(named: DataFrame, *group: str) -> DataFrame:
    """Rows that are not in the largest component (root) of their group."""
    parts = named.groupBy(*group, "root").agg(F.count("*").alias("m"))
    main = parts.groupBy(*group).agg(F.max(F.struct("m", (-F.col("root")).alias("r"))).alias("x")).select(*group, (-F.col("x.r")).alias("main"))
    return named.join(main.hint(MERGE), [*group]).where("root <> main").drop("main")


def _across(met: DataFrame, sketches: DataFrame, edges: DataFrame, num: int, den: int) -> DataFrame:
    """Feasible links between tiles of one column."""
    named = materialize(met.join(components(edges, "a", "b").hint(MERGE), "node", "left").withColumn("root", F.coalesce("root", "node")))
    outside = materialize(_outside(named, "col"))
    parts = outside.groupBy("col").agg(F.ceil(F.count("*") / VISITORS).alias("parts"))
    tiles = named.groupBy("col", F.col("tile").alias("to")).agg(F.min("size").alias("low"), F.max("size").alias("high"))
    can = (F.col("tile") != F.col("to")) & (F.col("high") * den >= F.col("size") * num) & (F.col("size") * den >= F.col("low") * num)
    guests = outside.join(parts.hint(MERGE), "col").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).join(tiles.hint(MERGE), "col").where(can)
    stay = named.join(parts.hint(MERGE), "col").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    all_rows = guests.select("col", F.col("to").alias("tile"), "part", "node", "size", "root", F.lit(1).alias("guest")).unionByName(
        stay.select("col", "tile", "part", "node", "size", "root", F.lit(0).alias("guest"))
    )
    keys = ("col", "tile", "part")
    dealt = all_rows.withColumnRenamed("root", "label").join(sketches.hint(MERGE), "node").repartition(*keys).sortWithinPartitions(*keys)
    return materialize(dealt.mapInArrow(lambda it: _feasible(it, num, den, keys, True), "a long, b long"))


def tile_links(nodes: np.ndarray, sets: tuple[np.ndarray, np.ndarray], label: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning links of a tile's rows by its sparse product; rows of equal label are already joined.

    sets: (row, column) of the incidences, sorted by row and column.
    """
    row, col = sets
    g = len(nodes)
    size = np.bincount(row, minlength=g)
    order = np.lexsort((row, col))  # by column
    by_col, c = row[order], col[order]
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    start = np.flatnonzero(new)
    length = np.diff(np.concatenate((start, [len(c)])))
    which = np.cumsum(new) - 1  # column number of each incidence in column order
    back = np.empty(len(c), np.int64)
    back[order] = which
    at = np.concatenate(([0], np.cumsum(size)))
    parent: dict = {}
    out = []
    for i in range(g):
        if not size[i]:
            continue
        k = back[at[i] : at[i + 1]]
        k = k[length[k] > 1]
        if not len(k):
            continue
        counts = np.zeros(g, np.int64)
        step = max(1, CELLS // int(length[k].max()))
        for at_k in range(0, len(k), step):  # a block of columns at a time
            block = k[at_k : at_k + step]
            n = length[block]
            ends = np.cumsum(n)
            idx = np.repeat(start[block] - (ends - n), n) + np.arange(ends[-1])
            counts += np.bincount(by_col[idx], minlength=g)
        overlap = counts[i + 1 :]
        ok = overlap * (num + den) >= num * (size[i] + size[i + 1 :])
        ok &= overlap > 0
        for j in np.flatnonzero(ok) + i + 1:
            x, y = find(parent, int(label[i])), find(parent, int(label[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def _products(n: int, num: int, den: int):
    def run(batches):
        for t, starts in _by_group(batches, ("block", "tile")):
            text = t.column("text").combine_chunks()
            text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)
            node, label = t.column("node").to_numpy(), t.column("label").to_numpy()
            out = []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if e - s > 1:  # one tile's columns are held at a time
                    out += tile_links(node[s:e], shingles(text.slice(s, e - s), n), label[s:e], num, den)
            yield _edges(out)

    return run


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def _split_hot(met: DataFrame, threshold: Fraction, tile: int, one_in: int = ONE_IN, least: int = 64) -> tuple[DataFrame, DataFrame | None]:
    """(rows of other columns, rows of columns that stand out in a sample of the rows, with n and tile).

    The tiles of a hot column are dealt by classes of size and a hash, with counts by the sample, so that no task
    holds such a column; the counts only set the tiles.
    """
    step = np.log(float(1 / threshold)) if threshold < 1 else 1.0
    kind = F.floor(F.log(F.col("size").cast("double")) / F.lit(float(step)))
    sample = met.where(F.pmod(F.xxhash64("node"), F.lit(one_in)) == 0)
    seen = materialize(sample.groupBy("col", kind.alias("kind")).agg(F.count("*").alias("c")))
    bound = max(least, sample.select("node").distinct().count() // MOST_HOT)
    hot = materialize(seen.groupBy("col").agg(F.sum("c").alias("all")).where(F.col("all") >= bound))  # MOST_HOT times the columns of a row at most
    if not hot.limit(1).count():
        return met, None
    own = met.join(F.broadcast(hot), "col").withColumn("kind", kind)
    own = own.join(F.broadcast(seen.join(F.broadcast(hot.select("col")), "col")), ["col", "kind"], "left")
    tiles = F.ceil(F.coalesce("c", F.lit(1)) * one_in / tile)
    own = own.select("node", "col", "size", F.greatest(F.col("all") * one_in, F.lit(tile + 1)).alias("n"), (F.col("kind") * (1 << 32) + F.pmod(F.xxhash64("node", "col"), tiles)).alias("tile"))
    return met.join(F.broadcast(hot.select("col")), "col", "left_anti"), own


def _labelled(docs: DataFrame, n: int, threshold: Fraction, tile: int) -> DataFrame:
    """doc_id, txh, size, root (null without words), component_id; one row per document."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    described = materialize(_described(docs, n, threshold, _heavy_columns(docs, n)))
    key = ["h1", "h2", "size"]
    rows = materialize(
        described.where("size > 0")
        .groupBy(*key)
        .agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "txh")).alias("at"), F.first("cols").alias("cols"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    edges = settled(spark, lambda: _feasible_links(rows, threshold, tile))
    sizes = settled(spark, lambda: components(edges, "a", "b").select("node", F.col("root").alias("block")))
    links = settled(spark, lambda: _exact_links(docs, rows, sizes, n, threshold, tile))
    joined_roots = components(links, "a", "b")
    node_root = rows.select("node", *key, "least_id").join(joined_roots.hint(MERGE), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(node_root)
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = named.join(ids.hint(MERGE), "root").select(*key, "root", "component_id")
    return described.select("doc_id", "txh", *key).join(labels.hint(MERGE), key, "left").select("doc_id", "txh", "size", "root", "component_id")


def _feasible_links(rows: DataFrame, threshold: Fraction, tile: int) -> DataFrame:
    """Links (a, b) by size bound and sketch that join all rows which may link."""
    num, den = threshold.numerator, threshold.denominator
    met = rows.select("node", "size", F.explode("cols").alias("col"))
    met, split = _split_hot(met, threshold, tile)
    # one shuffle: a row without a neighbour of its size in a column cannot link there
    by_size, own = W.partitionBy("col").orderBy("size"), W.partitionBy("col")
    met = met.withColumn("below", F.lag("size").over(by_size)).withColumn("above", F.lead("size").over(by_size))
    met = met.where((F.col("below") * den >= F.col("size") * num) | (F.col("size") * den >= F.col("above") * num)).select("node", "col", "size").withColumn("n", F.count("*").over(own))
    met = met.withColumn("tile", F.floor((F.row_number().over(by_size) - 1) / tile))
    met = materialize(met if split is None else met.unionByName(split))
    sketches = rows.select("node", "sketch")
    feasible = _dealt(met.join(sketches.hint(MERGE), "node").select("col", "tile", "node", "size", "sketch"), "col", "tile")
    edges = materialize(feasible.mapInArrow(lambda it: _feasible(it, num, den, ("col", "tile"), False), "a long, b long"))
    hot = met.where(F.col("n") > tile)
    if hot.limit(1).count():
        edges = edges.unionByName(_across(hot, sketches, edges, num, den))
    return edges


def _exact_links(docs: DataFrame, rows: DataFrame, sizes: DataFrame, n: int, threshold: Fraction, tile: int) -> DataFrame:
    """The links (a, b) of the rows of each block (sizes: node, block), by their products."""
    num, den = threshold.numerator, threshold.denominator
    counted = sizes.join(sizes.groupBy("block").agg(F.count("*").alias("n")).hint(MERGE), "block")
    members = counted.join(rows.select("node", "at").hint(MERGE), "node").select(
        "node", "block", "n", F.col("at.doc_id").alias("doc_id"), F.col("at.txh").alias("txh"), F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / tile)).alias("tile")
    )
    members = materialize(members)
    keyed = maybe_in(docs.withColumn("txh", F.xxhash64("text")), F.col("txh"), members, F.col("txh"))
    joined = keyed.join(members.hint(MERGE), (keyed["txh"] == members["txh"]) & keyed["doc_id"].eqNullSafe(members["doc_id"]))
    texts = materialize(joined.select("block", "tile", "node", "n", "text"))
    schema = "a long, b long"
    first = materialize(
        _dealt(texts.withColumn("label", F.col("node")), "block", "tile").select("block", "tile", "node", "label", "text").mapInArrow(_products(n, num, den), schema)
    )
    links = first
    large = members.where(F.col("n") > tile)
    if large.limit(1).count():
        roots = components(first, "a", "b")
        named = materialize(
            large.select("node", "block", "tile", "n").join(roots.hint(MERGE), "node", "left").withColumn("root", F.coalesce("root", "node"))
        )
        outside = _outside(named, "block").select("node", "block", "tile", "n", "root")
        # visitors go to the other tiles; residents stay where they are, in blocks that have visitors
        visit = outside.select("node", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / tile) - 1)).alias("to"), "tile", "root").where("tile <> to").select("node", "block", F.col("to").alias("tile"), "root")
        stay = named.join(outside.select("block").distinct().hint(MERGE), "block", "left_semi").select("node", "block", "tile", "root")
        again = visit.unionByName(stay).join(texts.where(F.col("n") > tile).select("node", "text").hint(MERGE), "node").withColumnRenamed("root", "label")
        second = _dealt(again, "block", "tile").select("block", "tile", "node", "label", "text").mapInArrow(_products(n, num, den), schema)
        links = first.unionByName(materialize(second))
    return links


def jaccard_components(docs: DataFrame, n: int = N, threshold: Fraction = THRESHOLD, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id; one row per document."""
    out = _labelled(docs, n, threshold, tile)
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = N, threshold: Fraction = THRESHOLD, tile: int = TILE) -> DataFrame:
    """The documents with one of each component, its smallest doc_id; documents without words all stay."""
    named = settled(docs.sparkSession, lambda: _labelled(docs, n, threshold, tile).where("root is not null"))
    first = named.groupBy("root").agg(F.min(F.struct("doc_id", "txh")).alias("first"))
    here = F.struct("doc_id", "txh")
    gone = materialize(named.join(first.hint(MERGE), "root").where(~here.eqNullSafe(F.col("first"))).select("doc_id", "txh"))
    kept = without(docs, gone)
    several = materialize(named.groupBy("doc_id", "txh").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", "txh"))
    if several.limit(1).count():  # of rows with equal id and text one stays
        packed = kept.select(F.struct(*kept.columns).alias("doc")).select("doc", F.col("doc")["doc_id"].alias("id"), F.xxhash64(F.col("doc")["text"].cast("string")).alias("own"))
        same = (F.col("own") == F.col("txh")) & F.col("id").eqNullSafe(F.col("doc_id"))
        again = packed.join(several.hint(MERGE), same, "left_semi").groupBy("id", "own").agg(F.first("doc").alias("doc"))
        kept = packed.join(several.hint(MERGE), same, "left_anti").select("doc.*").unionByName(again.select("doc.*"))
    return kept


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
with recursive w as (
  select doc_id, row_number() over () as rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select rid, doc_id, case when coalesce(len(w), 0) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
         else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as g
  from w),
i as (select rid, unnest(g) as t from s),
f as (select t, count(*) as df from i group by t),
p as (
  select rid, t, row_number() over (partition by rid order by df, t) as k, count(*) over (partition by rid) as n
  from i join f using (t)),
x as (select rid, t, n from p where k <= n - ceil(0.9 * n) + 1),
c as (select distinct a.rid as a, b.rid as b from x a join x b on a.t = b.t and a.rid < b.rid and least(a.n, b.n) * 10 >= 9 * greatest(a.n, b.n)),
l as (
  select c.a, c.b from c join s a on a.rid = c.a join s b on b.rid = c.b
  where 190 * len(list_intersect(a.g, b.g)) >= 90 * (len(a.g) + len(b.g))),
e as (select a, b from l union all select b, a from l),
r as (select rid, rid as o from s union select e.b, r.o from r join e on e.a = r.rid),
m as (select r.rid, min(s.doc_id) as component_id from r join s on s.rid = r.o group by r.rid)
select s.doc_id, len(s.g)::bigint as n_shingles, m.component_id from s join m using (rid)
"""
