"""Operator 12: a Merkle manifest of a dataset, in contiguous digest matrices.

A row's leaf is the hash of its named columns. The leaves of a source, in order of ids, form a tree of fanout
``FANOUT``; the sources' roots form a tree of their own in the same way. Leaves are dealt by aligned blocks of
``BLOCK`` = FANOUT ** 3 of one source, so a source of any size spreads over tasks. A block is a contiguous matrix of
64-byte hex digests, which is reshaped to rows of FANOUT digests and hashed row by row, level by level. The blocks'
nodes are the leaves of the next tier, until one node is left; so a tree of 10^11 leaves has four tiers. Then paths go
down the tiers: a block learns the siblings above it once, and every row's siblings inside of it are slices of the
matrices, found by index. Texts are hashed natively and only once; from then on rows hold digests alone.

A row's proof is the hash of all siblings from leaf to root. Verification folds a leaf (of the tampered text, where the
audit tampers) with the siblings up to a root, and compares that with the root of the data as given.

Edge cases: a null column counts as ``-``; null ids stand before others, and are never tampered with; a null source is a
source of its own, first of all; repeated ids stand by leaf, so equal rows share their leaf but not their place; the
leaf of an only row is its source's root, the only source's root the root; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm._util import ascii_lower, indexed, materialize, starts, table, whole_groups
from chronofold.llm.turns import CRC32

FANOUT, DEPTH = 16, 3
BLOCK = FANOUT**DEPTH
#: Of the audit: ids whose crc32 this number divides are tampered with.
TAMPER = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "before array<string>, after array<string>"


def leaf(*columns: Column) -> Column:
    """The hash of the columns, each ``-`` or its count of bytes, a colon and its value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _matrix(digests: pa.ChunkedArray | list[str]) -> np.ndarray:
    """One row of 64 bytes for each digest."""
    texts = digests if isinstance(digests, list) else digests.to_pylist()
    return np.frombuffer("".join(texts).encode("ascii"), np.uint8).reshape(-1, 64)


def _above(level: np.ndarray) -> np.ndarray:
    """The nodes over a level: each FANOUT consecutive digests, the last run fewer, hashed."""
    whole = len(level) // FANOUT * FANOUT
    runs = [*level[:whole].reshape(-1, FANOUT * 64), *([level[whole:].reshape(-1)] if whole < len(level) else [])]
    return _matrix([hashlib.sha256(r).hexdigest() for r in runs])


def _levels(leaves: np.ndarray, block: int) -> list[np.ndarray]:
    """A block's levels, from its leaves to its node; a tree's only block stops as soon as one node is left."""
    levels, only = [leaves], block == 0 and len(leaves) < BLOCK
    while len(levels) <= DEPTH and not (only and len(levels[-1]) == 1):
        levels.append(_above(levels[-1]))
    return levels


def _siblings(levels: list[np.ndarray], i: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes before and after the node of leaf i in its run, level by level."""
    for level in levels[:-1]:
        run = level[i // FANOUT * FANOUT : i // FANOUT * FANOUT + FANOUT].reshape(-1)
        at = i % FANOUT * 64
        yield run[:at], run[at + 64 :]
        i //= FANOUT


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole blocks with the places where blocks start, and the end."""
    for t in whole_groups(batches, keys):
        yield t, np.append(starts(t, keys), t.num_rows)


def _dealt(nodes: DataFrame, key: str, *order: str) -> DataFrame:
    return nodes.repartition(key, "block").sortWithinPartitions(key, "block", *order)


def _tier(nodes: DataFrame, key: str) -> DataFrame:
    """The nodes of the blocks: key, i (the block's number), node."""
    kind = nodes.schema[key].dataType.simpleString()

    def run(batches):
        for t, at in _blocks(batches, [key, "block"]):
            digests, blocks = t.column("node"), t.column("block").take(at[:-1])
            made = [bytes(_levels(_matrix(digests.slice(a, b - a)), block)[-1]).decode() for a, b, block in zip(at, at[1:], blocks.to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([t.column(key).take(at[:-1]).combine_chunks(), blocks.cast(pa.int64()).combine_chunks(), pa.array(made, pa.string())], names=[key, "i", "node"])

    here = nodes.select(key, (F.col("i") / BLOCK).cast("long").alias("block"), "i", "node")
    return materialize(_dealt(here, key, "i").mapInArrow(run, f"`{key}` {kind}, i long, node string"))


def climb(leaves: DataFrame, key: str) -> list[DataFrame]:
    """The tiers of each key's tree, from its leaves (key, i, node) to one node a key."""
    tiers = [leaves, _tier(leaves, key)]
    while (tiers[-1].agg(F.max("i")).first()[0] or 0) > 0:
        tiers.append(_tier(tiers[-1], key))
    return tiers


def _with_paths(nodes: DataFrame, paths: DataFrame, key: str, more: list[str], told: list[str]) -> DataFrame:
    """A tier's nodes in their blocks, each block led by a row with the siblings above it (and the columns ``told``)."""
    own = nodes.select(key, (F.col("i") / BLOCK).cast("long").alias("block"), "i", "node", *more)
    types = {f.name: f.dataType for f in [*nodes.schema, *paths.schema]}
    empty = lambda c: F.lit(None).cast(types[c]).alias(c)
    head = paths.select(key, F.col("i").alias("block"), F.lit(-1).cast("long").alias("i"), empty("node"), *map(empty, more), "before", "after", *told)
    return _dealt(own.select("*", empty("before"), empty("after"), *map(empty, told)).unionByName(head), key, "i")


def descend(tiers: list[DataFrame], top: DataFrame, key: str, told: tuple[str, ...] = ()) -> DataFrame:
    """Paths (key, i, before, after, told) of the nodes of the lowest tier, given those of the highest."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in top.schema)

    def run(batches):
        for t, at in _blocks(batches, [key, "block"]):
            for a, b in zip(at, at[1:], strict=False):
                head, rows = t.slice(a, 1).to_pylist()[0], t.slice(a + 1, b - a - 1)
                levels = _levels(_matrix(rows.column("node")), head["block"])
                made = []
                for i in range(rows.num_rows):
                    own = [(bytes(x).decode(), bytes(y).decode()) for x, y in _siblings(levels, i)]
                    made.append(head | {"i": head["block"] * BLOCK + i, "before": [x for x, _ in own] + head["before"], "after": [y for _, y in own] + head["after"]})
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in schema.names} for r in made], schema=schema)

    schema = pa.schema([(key, pa.int64() if dict(top.dtypes)[key] == "bigint" else pa.string()), ("i", pa.int64()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string())), *[(c, pa.string()) for c in told]])
    paths = top
    for nodes in reversed(tiers[:-1]):
        paths = materialize(_with_paths(nodes, paths, key, [], list(told)).mapInArrow(run, kinds))
    return paths


def _proved(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Rows of whole blocks to their proofs and folded roots."""
    for t, at in _blocks(batches, ["source", "block"]):
        for a, b in zip(at, at[1:], strict=False):
            head, rows = t.slice(a, 1).to_pylist()[0], t.slice(a + 1, b - a - 1)
            levels = _levels(_matrix(rows.column("node")), head["block"])
            above = [(x.encode(), y.encode()) for x, y in zip(head["before"], head["after"], strict=True)]
            rest = b"".join(x + y for x, y in above)
            proofs, folded = [], []
            for i, value in enumerate(rows.column("tampered").fill_null("").to_pylist()):
                proof, node = hashlib.sha256(), value.encode() or bytes(levels[0][i])
                for x, y in _siblings(levels, i):
                    proof.update(x)
                    proof.update(y)
                    node = hashlib.sha256(b"".join((x, node, y))).hexdigest().encode()
                proof.update(rest)
                for x, y in above:
                    node = hashlib.sha256(x + node + y).hexdigest().encode()
                proofs.append(proof.hexdigest())
                folded.append(node.decode())
            same = [f == root for f in folded]
            fixed = [pa.array([x] * rows.num_rows, pa.string()) for x in (head["subroot"], root)]
            columns = [rows.column("doc_id").combine_chunks(), rows.column("source").combine_chunks(), rows.column("node").combine_chunks(), *fixed, pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def manifest(docs: DataFrame) -> DataFrame:
    """Every row's leaf, source root, root, proof and the outcome of the audit."""
    f = {c: F.col(c) for c in FIELDS}
    audited = F.crc32(f["doc_id"].cast("string")) % TAMPER == 0
    leaves = docs.select("doc_id", "source", leaf(*f.values()).alias("node"), F.when(audited, leaf(*(f | {"text": ascii_lower(f["text"])}).values())).alias("tampered"))
    rows = materialize(indexed(materialize(leaves), ["source"], [F.col("source"), F.col("doc_id"), F.col("node")], "i"))
    tiers = climb(rows.select("source", "i", "node"), "source")
    subroots = indexed(tiers[-1].select("source", "node").withColumn("all", F.lit(0).cast("long")), ["all"], [F.col("all"), F.col("source")], "i")
    over = climb(materialize(subroots).select("all", "i", "node", "source"), "all")
    root = over[-1].select("node").first()
    root = root[0] if root else ""
    none = F.array().cast("array<string>")
    paths = descend([over[0].select("all", "i", "node"), *over[1:]], over[-1].select("all", "i", none.alias("before"), none.alias("after")), "all")
    named = over[0].select("source", "i", F.col("node").alias("subroot")).join(paths.drop("all"), "i")
    top = named.select("source", F.lit(0).cast("long").alias("i"), "before", "after", "subroot")
    blocks = descend(tiers[1:], top, "source", ("subroot",))
    led = _with_paths(rows, blocks, "source", ["doc_id", "tampered"], ["subroot"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return led.mapInArrow(lambda batches: _proved(batches, root), f"doc_id {kind}, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents")).drop("source")


def _leaf_sql(text: str) -> str:
    values = ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


#: The same in SQL: both trees level by level, every leaf's siblings by place, and the fold along them.
SQL = f"""
with recursive leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i from (
    select doc_id, source, {_leaf_sql("text")} as leaf, case when coalesce({CRC32.format("doc_id::varchar")} % {TAMPER} = 0, false) then {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as tampered from documents) x),
nodes as (
  select source, 0 as level, i, leaf as node from leaves
  union all
  select source, level + 1, i // {FANOUT}, sha256(string_agg(node, '' order by i)) from (select *, count(*) over (partition by source) as n from nodes) x where n > 1 group by source, level, i // {FANOUT}),
tops as (select source, max_by(node, level) as subroot, max(level) as height from nodes group by source),
ranked as (select *, row_number() over (order by source nulls first) - 1 as place from tops),
over_ as (
  select 0 as level, place as i, subroot as node from ranked
  union all
  select level + 1, i // {FANOUT}, sha256(string_agg(node, '' order by i)) from (select *, count(*) over () as n from over_) x where n > 1 group by level, i // {FANOUT}),
top as (select max_by(node, level) as root, max(level) as height from over_),
paths as (
  select l.source, l.i, n.level as step, string_agg(n.node, '' order by n.i) filter (n.i < l.i // ({FANOUT} ** n.level)::bigint) as before, string_agg(n.node, '' order by n.i) filter (n.i > l.i // ({FANOUT} ** n.level)::bigint) as after
  from leaves l join ranked r on r.source is not distinct from l.source join nodes n on n.source is not distinct from l.source and n.level < r.height and n.i // {FANOUT} = l.i // ({FANOUT} ** (n.level + 1))::bigint group by l.source, l.i, n.level
  union all
  select l.source, l.i, r.height + o.level, string_agg(o.node, '' order by o.i) filter (o.i < r.place // ({FANOUT} ** o.level)::bigint), string_agg(o.node, '' order by o.i) filter (o.i > r.place // ({FANOUT} ** o.level)::bigint)
  from leaves l join ranked r on r.source is not distinct from l.source join over_ o on o.level < (select height from top) and o.i // {FANOUT} = r.place // ({FANOUT} ** (o.level + 1))::bigint group by l.source, l.i, r.height, o.level),
folded as (
  select source, i, 0 as step, coalesce(tampered, leaf) as node from leaves
  union all
  select f.source, f.i, f.step + 1, sha256(coalesce(p.before, '') || f.node || coalesce(p.after, '')) from folded f join paths p on p.source is not distinct from f.source and p.i = f.i and p.step = f.step),
proofs as (select source, i, sha256(string_agg(coalesce(before, '') || coalesce(after, ''), '' order by step)) as proof from paths group by source, i),
ends as (select source, i, max_by(node, step) as node from folded group by source, i)
select l.doc_id, l.leaf, r.subroot, t.root, coalesce(p.proof, sha256('')) as proof_sha256, e.node as folded_root, e.node = t.root as verified
from leaves l join ranked r on r.source is not distinct from l.source cross join top t left join proofs p on p.source is not distinct from l.source and p.i = l.i join ends e on e.source is not distinct from l.source and e.i = l.i"""
