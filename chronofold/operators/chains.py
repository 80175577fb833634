"""Hash-chained event ledgers: appending, verification, Merkle roots and seals, for all chains at once.

A chain is a subject's rows (seq from 0, first its birth event). Each entry hash is the SHA-256 of the previous entry
hash and the canonical envelope of the row; the first follows the subject's genesis hash. The genesis prefix is the
ledger's own and a parameter.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronofold.functions import canonical as C
from chronofold.storage import positioned, written

BLOCK = 1024
COLUMNS = ["event_type", "actor", "reason", "created_at", "payload_json"]


@dataclass(frozen=True)
class ChainSpec:
    """What a kind of chain has of its own: names in the envelope, genesis prefix, birth event and vocabulary."""

    kind: str
    prefix: str
    subject_key: str
    actor_key: str
    birth: str
    vocabulary: frozenset[str]


CUSTODY = ChainSpec(
    "custody", "CUSTODY_GENESIS:", "memory_id", "actor_id", "STORED",
    frozenset("STORED REINFORCED CONTRADICTED_BY SUPERSEDED_BY QUARANTINED TAINT_FLAGGED REHABILITATED STATE_CHANGED DECISION_USED_MEMORY".split()),
)
AUTHORITY = ChainSpec("authority", "AUTHORITY_GENESIS:", "subject_id", "issuer_id", "ACTOR_REGISTERED", frozenset("ACTOR_REGISTERED GRANTED REVOKED ACTOR_QUARANTINED ACTOR_REINSTATED".split()))
CLAIM = ChainSpec(
    "claim", "CLAIM_GENESIS:", "claim_id", "actor_id", "CLAIM_ASSERTED",
    frozenset("CLAIM_ASSERTED EVIDENCE_LINKED RELATED_TO SET_MEMBERSHIP CLAIM_VALIDATED CLAIM_REFUTED CLAIM_WITHDRAWN CLAIM_SUPERSEDED".split()),
)


def genesis(spec: ChainSpec, subject: Column) -> Column:
    return C.sha256(F.concat(F.lit(spec.prefix), subject))


def envelope(spec: ChainSpec) -> Column:
    """Canonical JSON of a row (subject, seq, event_type, actor, reason, created_at, payload_json)."""
    c = F.col
    return C.json_object({spec.subject_key: c("subject"), "seq": C.Number(c("seq")), "event_type": c("event_type"), spec.actor_key: c("actor"), "reason": c("reason"), "created_at": c("created_at"), "payload": C.Raw(c("payload_json"))})


def entry_hash(spec: ChainSpec) -> Column:
    return C.sha256(F.concat("prev_hash", envelope(spec)))


def _chained(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds prev_hash and entry_hash to rows with head_hash and envelope: a stream over sorted partitions that holds one hash."""
    return _hashed(df.repartition("subject").sortWithinPartitions("subject", *order))


def _hashed(df: DataFrame, prefix: str = "") -> DataFrame:
    """``_chained`` of rows that lie by subject, each chain in order and in one partition; without head_hash it begins with its genesis."""
    schema = df.drop("envelope", "head_hash").schema.add("prev_hash", "string").add("entry_hash", "string")

    def run(batches):
        subject, last = None, ""
        for b in batches:
            prev, own = [], []
            for s, head, e in zip(b.column("subject").to_pylist(), b.column("head_hash").to_pylist(), b.column("envelope").cast(pa.binary()).to_pylist(), strict=True):
                if s != subject:
                    subject, last = s, hashlib.sha256((prefix + s).encode()).hexdigest() if head is None else head
                prev.append(last)
                last = hashlib.sha256(last.encode() + e).hexdigest()
                own.append(last)
            kept = b.drop_columns(["envelope", "head_hash"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(prev, pa.string()), pa.array(own, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def heads(rows: DataFrame) -> DataFrame:
    """subject, seq, entry_hash of the last entry of each chain."""
    return rows.groupBy("subject").agg(F.max_by(F.struct("seq", "entry_hash"), "seq").alias("h")).select("subject", "h.seq", "h.entry_hash")


def judged(spec: ChainSpec, pending: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """The pending events (subject, place, event_type, ...) with code: null, or why the event cannot be appended."""
    bad = (
        F.when(~C.valid_id(F.col("subject")) | ~C.valid_id(F.col("actor")), "BAD_ID")
        .when(~F.coalesce(F.col("event_type").isin(*sorted(spec.vocabulary)), F.lit(False)), "UNKNOWN_EVENT")
        .when(F.trim(F.coalesce("reason", F.lit(""))) == "", "NO_REASON")
    )
    df = pending.withColumn("bad", bad)
    df = df.join(heads(chains).select("subject", F.col("seq").alias("head_seq"), F.col("entry_hash").alias("head_hash")), "subject", "left") if chains is not None else df.withColumn("head_seq", F.lit(None).cast("long")).withColumn("head_hash", F.lit(None).cast("string"))
    born = F.min(F.when(F.col("bad").isNull() & (F.col("event_type") == spec.birth), F.col("place"))).over(W.partitionBy("subject"))
    df = df.withColumn("born", F.when(F.col("head_seq").isNull(), born))
    birth = F.col("event_type") == spec.birth
    late = F.when(birth & (F.col("head_seq").isNotNull() | (F.col("place") > F.col("born"))), "SECOND_BIRTH").when(~birth & F.col("head_seq").isNull() & (F.col("born").isNull() | (F.col("place") < F.col("born"))), "NOT_BORN")
    return df.withColumn("code", F.coalesce("bad", late)).drop("bad", "born")


def append(spec: ChainSpec, pending: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """The rows that the pending events (subject, place, event_type, actor, reason, created_at, payload_json) add, in order of ``place``.

    Events that ``judged`` refuses are left out and take no seq.
    """
    ok = judged(spec, pending, chains).where("code is null")
    seq = F.coalesce("head_seq", F.lit(-1)) + F.row_number().over(W.partitionBy("subject").orderBy("place"))
    rows = ok.withColumn("seq", seq.cast("long")).withColumn("head_hash", F.coalesce("head_hash", genesis(spec, F.col("subject"))))
    return _chained(rows.select("subject", "seq", *COLUMNS, "head_hash", envelope(spec).alias("envelope")), ["seq"])


def continued(spec: ChainSpec, events: DataFrame, chains: DataFrame, order: list[str]) -> DataFrame:
    """The rows that events of which ``judged`` refuses none add to the chains, in ``order``: one shuffle and one sort of the events."""
    last = heads(chains).select("subject", F.col("seq").alias("head_seq"), F.col("entry_hash").alias("head_hash"))
    dealt = events.join(last.hint("shuffle_hash"), "subject", "left")  # a row a chain: the events are not sorted for it
    dealt = dealt.withColumn("at", F.row_number().over(W.partitionBy("subject").orderBy(*order))).sortWithinPartitions("subject", *order)
    rows = dealt.select("subject", (F.coalesce("head_seq", F.lit(-1)) + F.col("at")).cast("long").alias("seq"), *COLUMNS, "head_hash")
    return _hashed(rows.withColumn("envelope", envelope(spec)), spec.prefix)


def faults(spec: ChainSpec, rows: DataFrame) -> DataFrame:
    """The rows with code: the first check that the row fails, or null."""
    chain = W.partitionBy("subject").orderBy("seq", "entry_hash")
    df = rows.withColumn("i", F.row_number().over(chain) - 1).withColumn("before", F.lag("entry_hash").over(chain)).withColumn("earlier", F.lag("created_at").over(chain))
    df = df.withColumn("payload_fault", C.payload_faults(F.col("payload_json")))
    birth = F.col("event_type") == spec.birth
    stamp = F.coalesce(F.col("created_at").rlike(C.TIMESTAMP), F.lit(False))
    code = (
        F.when(F.col("seq") != F.col("i"), "SEQ_NOT_DENSE")
        .when(~F.coalesce(F.col("event_type").isin(*sorted(spec.vocabulary)), F.lit(False)), "UNKNOWN_EVENT")
        .when((F.col("i") == 0) & ~birth, "NO_BIRTH")
        .when((F.col("i") > 0) & birth, "SECOND_BIRTH")
        .when(~F.coalesce(F.col("prev_hash") == F.when(F.col("i") == 0, genesis(spec, F.col("subject"))).otherwise(F.col("before")), F.lit(False)), "NOT_LINKED")
        .when(F.col("payload_fault").isNotNull(), F.col("payload_fault"))
        .when(~F.coalesce(entry_hash(spec) == F.col("entry_hash"), F.lit(False)), "TAMPERED")
        .when(~stamp, "BAD_TIMESTAMP")
        .when(F.col("created_at") < F.col("earlier"), "BACKWARDS")
    )
    return df.withColumn("code", code).drop("before", "earlier", "payload_fault")


def verify(spec: ChainSpec, rows: DataFrame) -> DataFrame:
    """subject, n, code and seq of the first fault (null for a sound chain)."""
    found = faults(spec, rows)
    first = F.min(F.when(F.col("code").isNotNull(), F.struct("i", "code", "seq")))
    return found.groupBy("subject").agg(F.count("*").alias("n"), first.alias("f")).select("subject", "n", F.col("f.code").alias("code"), F.col("f.seq").alias("seq"))


def _fold(level: list[str]) -> str:
    while len(level) > 1:
        up = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = [*up, level[-1]] if len(level) % 2 else up
    return level[0]


def merkle_root(leaves: DataFrame, order: list[Column], empty: str | None = "EMPTY_HEADS") -> DataFrame:
    """One row (root, leaves) over the column ``leaf`` in the order; an odd node is promoted.

    Aligned blocks of 1024 nodes fold on their own, level by level, which gives the same root as pair by pair.
    """
    nodes = positioned(leaves.select("leaf", *[o.alias(f"o{i}") for i, o in enumerate(order)]), [F.col(f"o{i}") for i in range(len(order))], "at").select("at", F.col("leaf").alias("node"))
    n = total = nodes.count()
    spark = leaves.sparkSession
    if not n:
        if empty is None:
            raise ValueError("there are no leaves")
        return spark.createDataFrame([(hashlib.sha256(empty.encode()).hexdigest(), 0)], "root string, leaves long")

    def block(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        return pa.table({"at": pa.array([t["block"][0].as_py()], pa.int64()), "node": pa.array([_fold(t["node"].to_pylist())], pa.string())})

    while n > 1:
        nodes = written(nodes.withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("block").applyInArrow(block, "at long, node string"))
        n = -(-n // BLOCK)
    return nodes.select(F.col("node").alias("root"), F.lit(total).cast("long").alias("leaves"))


def seals(ids: DataFrame, group: str, id_: str, key: str = "memory_ids") -> DataFrame:
    """group, n, ids_sha256: SHA-256 of the canonical object of each group's distinct sorted ids.

    The ids stream in order through one hash, so a group of any size takes no more memory than a batch.
    """
    kind = dict(ids.dtypes)[group]

    def run(batches):
        now, n, state, out = None, 0, None, []
        for b in batches:
            for g, i in zip(b.column(group).to_pylist(), b.column("literal").to_pylist(), strict=True):
                if state is None or g != now:
                    if state is not None:
                        out.append((now, n, state))
                    now, n, state = g, 0, hashlib.sha256(('{"' + key + '":[').encode())
                state.update(("," if n else "").encode() + i.encode())
                n += 1
        if state is not None:
            out.append((now, n, state))
        for _, _, x in out:
            x.update(b"]}")
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _, _ in out], types), pa.array([n for _, n, _ in out], pa.int64()), pa.array([x.hexdigest() for _, _, x in out], pa.string())], names=[group, "n", "ids_sha256"])

    rows = ids.select(group, F.col(id_).cast("string").alias("id")).distinct()
    dealt = rows.repartition(group).sortWithinPartitions(group, "id").select(group, C.json_string(F.col("id")).alias("literal"))
    types = to_arrow_type(dealt.schema[group].dataType)
    return dealt.mapInArrow(run, f"{group} {kind}, n long, ids_sha256 string")
