"""Queries over real hash chains, authority, claims, decisions and provenance, each with SQL of its own.

The inputs are views of the benchmark tables (``INPUTS``); what an operator computes is written twice, as DataFrame code in
``chronofold.operators`` and as DuckDB SQL here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import canonical as C
from chronofold.operators import chains
from chronofold.plans.dialect import expand, query, statement

INPUTS = """
pending as (
  select 'u' || STR(subject) as subject, seq as place, kind as event_type, 'actor-' || STR(actor) as actor, 'because "' || event_type || '"' as reason,
         STAMP(ts) as created_at,
         case when kind = 'STORED' then '{"content_sha256":"' || SHA('content ' || STR(subject)) || '"}' else '{"causes":[],"value":"' || STR(actor) || '"}' end as payload_json
  from chain)"""

#: name: query, and SQL by name (without an entry where SQL cannot express it).
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def view(spark: SparkSession, sf_dir: str, name: str, inputs: str = INPUTS) -> DataFrame:
    return query(inputs.strip() + f"\nselect * from {name}")(spark, sf_dir)


def duck(body: str, inputs: str = INPUTS, recursive: bool = False) -> str:
    """DuckDB SQL over the model and the inputs."""
    return expand(statement(("recursive " if recursive else "") + inputs.strip() + (",\n" if not body.strip().startswith("select") else "\n") + body.strip()), 1)


#: The chained rows, in SQL: one step of the recursion adds the next row of every chain.
CHAINED = """
numbered as (select *, cast(place as bigint) as seq from pending),
rows_ as (
  select n.subject, n.seq, n.event_type, n.actor, n.reason, n.created_at, n.payload_json, sha256('CUSTODY_GENESIS:' || n.subject) as prev_hash,
         sha256(sha256('CUSTODY_GENESIS:' || n.subject) || ENVELOPE(n)) as entry_hash
  from numbered n where n.seq = 0
  union all
  select n.subject, n.seq, n.event_type, n.actor, n.reason, n.created_at, n.payload_json, r.entry_hash, sha256(r.entry_hash || ENVELOPE(n))
  from rows_ r join numbered n on n.subject = r.subject and n.seq = r.seq + 1)"""


def _enveloped(sql: str) -> str:
    """Puts the envelope of an alias for ENVELOPE(alias)."""
    import re

    def env(m):
        a = m[1]
        return (
            f"""'{{"actor_id":"' || {a}.actor || '","created_at":"' || {a}.created_at || '","event_type":"' || {a}.event_type || '","memory_id":"' || {a}.subject"""
            f""" || '","payload":' || {a}.payload_json || ',"reason":"' || replace({a}.reason, '"', '\\"') || '","seq":' || {a}.seq || '}}'"""
        )

    return re.sub(r"ENVELOPE\((\w+)\)", env, sql)


def custody(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.append(chains.CUSTODY, view(spark, sf_dir, "pending"))


@registered("EVT-1_append", duck(_enveloped(CHAINED + " select subject, seq, prev_hash, entry_hash from rows_"), recursive=True))
def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return custody(spark, sf_dir).select("subject", "seq", "prev_hash", "entry_hash")


@registered("EVT-2_genesis", duck("select distinct subject, sha256('CUSTODY_GENESIS:' || subject) as genesis from pending"))
def geneses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "pending").select("subject").distinct().withColumn("genesis", chains.genesis(chains.CUSTODY, F.col("subject")))


@registered("EVT-3_entry_hash", duck(_enveloped("n as (select *, cast(place as bigint) as seq, sha256('CUSTODY_GENESIS:' || subject) as p from pending)\nselect subject, seq, sha256(p || ENVELOPE(n)) as entry_hash from n")))
def entry_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "pending").withColumn("seq", F.col("place").cast("long"))
    return rows.withColumn("prev_hash", chains.genesis(chains.CUSTODY, F.col("subject"))).select("subject", "seq", chains.entry_hash(chains.CUSTODY).alias("entry_hash"))


#: Faults by subject number: a changed reason, a hole, a cut link, a second birth, no birth, a word beyond the vocabulary, an odd payload.
DAMAGE = {1: "TAMPERED", 2: "SEQ_NOT_DENSE", 3: "NOT_LINKED", 4: "SECOND_BIRTH", 5: "NO_BIRTH", 6: "UNKNOWN_EVENT", 7: "NOT_CANONICAL", 8: "NOT_JSON"}


def damaged(rows: DataFrame) -> DataFrame:
    """The chains with one fault in each subject whose number mod 10 is in ``DAMAGE``."""
    k = F.col("subject").substr(2, 20).cast("long") % 10
    rows = rows.where(~((k == 2) & (F.col("seq") == 2)))
    at = F.col("seq") == 3
    return (
        rows.withColumn("reason", F.when((k == 1) & at, "another").otherwise(F.col("reason")))
        .withColumn("prev_hash", F.when((k == 3) & at, F.sha2(F.col("prev_hash"), 256)).otherwise(F.col("prev_hash")))
        .withColumn("event_type", F.when((k == 4) & at, "STORED").when((k == 5) & (F.col("seq") == 0), "REINFORCED").when((k == 6) & at, "INVENTED").otherwise(F.col("event_type")))
        .withColumn("payload_json", F.when((k == 7) & at, '{"b":1, "a":2}').when((k == 8) & at, "{").otherwise(F.col("payload_json")))
    )


@registered(
    "WIN-1_chain_verification",
    duck(
        """
s as (select subject, count(*) as n, cast(substr(subject, 2) as bigint) % 10 as k from pending group by subject),
f as (select subject, n - case when k = 2 and n > 2 then 1 else 0 end as n,
             case when k = 5 then 'NO_BIRTH' when k = 2 and n > 3 then 'SEQ_NOT_DENSE' when n <= 3 then null when k = 1 then 'TAMPERED' when k = 3 then 'NOT_LINKED' when k = 4 then 'SECOND_BIRTH'
                  when k = 6 then 'UNKNOWN_EVENT' when k = 7 then 'NOT_CANONICAL' when k = 8 then 'NOT_JSON' end as code from s)
select subject, n, code, cast(case when code = 'NO_BIRTH' then 0 when code is not null then 3 end as bigint) as seq from f"""
    ),
)
def chain_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains with planted faults: the SQL tells which fault each chain was given."""
    return chains.verify(chains.CUSTODY, damaged(custody(spark, sf_dir)))


@registered("WIN-2_entry_hashes", duck(_enveloped(CHAINED + " select subject, max(seq) + 1 as n, cast(null as varchar) as code, cast(null as bigint) as seq from rows_ group by subject"), recursive=True))
def sound_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-node chains as they were written: no fault anywhere."""
    return chains.verify(chains.CUSTODY, custody(spark, sf_dir))


@registered("AGG-9_chain_heads", duck(_enveloped(CHAINED + " select subject, max(seq) as seq, max_by(entry_hash, seq) as entry_hash from rows_ group by subject"), recursive=True))
def chain_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.heads(custody(spark, sf_dir))


#: The root by pairs: level, place and node, an odd node promoted.
MERKLE = """
leaves as (select row_number() over (order by subject) - 1 as place, sha256(subject || ':' || sha256('CUSTODY_GENESIS:' || subject)) as node from (select distinct subject from pending)),
tree as (
  select 0 as level, list(node order by place) as nodes from leaves
  union all
  select level + 1, list_transform(range(0, len(nodes), 2), lambda i: case when i + 1 < len(nodes) then sha256(nodes[i + 1] || nodes[i + 2]) else nodes[i + 1] end) from tree where len(nodes) > 1)
"""


@registered("AGG-10_merkle_root", duck(MERKLE + "select nodes[1] as root, (select count(*) from leaves) as leaves from tree where len(nodes) = 1", recursive=True))
def merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = view(spark, sf_dir, "pending").select("subject").distinct()
    leaf = C.sha256(F.concat("subject", F.lit(":"), chains.genesis(chains.CUSTODY, F.col("subject"))))
    return chains.merkle_root(ids.withColumn("leaf", leaf), [F.col("subject")])


@registered("AGG-11_node_merkle_root", duck(MERKLE.replace("subject || ':' || sha256('CUSTODY_GENESIS:' || subject)", "sha256('CUSTODY_GENESIS:' || subject) || '|' || subject") + "select nodes[1] as root, (select count(*) from leaves) as leaves from tree where len(nodes) = 1", recursive=True))
def node_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rule with another leaf, over heads of nodes; no heads are an error."""
    ids = view(spark, sf_dir, "pending").select("subject").distinct()
    leaf = C.sha256(F.concat(chains.genesis(chains.CUSTODY, F.col("subject")), F.lit("|"), "subject"))
    return chains.merkle_root(ids.withColumn("leaf", leaf), [F.col("subject")], None)


@registered("AGG-12_set_seal", duck("""select event_type, count(distinct subject) as n, sha256('{"memory_ids":[' || string_agg(distinct '"' || subject || '"', ',' order by '"' || subject || '"') || ']}') as ids_sha256 from pending group by event_type"""))
def set_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.seals(view(spark, sf_dir, "pending"), "event_type", "subject")


JUDGED = """
b as (select *, min(case when event_type = 'STORED' and actor <> 'actor-3' then place end) over (partition by subject) as born from pending)
select subject, place, case when actor = 'actor-3' then 'NO_REASON' when event_type = 'STORED' and place > born then 'SECOND_BIRTH' when event_type <> 'STORED' and (born is null or place < born) then 'NOT_BORN' end as code from b"""


@registered("FLT-13_append_refusals", duck(JUDGED))
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an append refuses, with events of actor 3 given no reason."""
    pending = view(spark, sf_dir, "pending").withColumn("reason", F.when(F.col("actor") == "actor-3", " ").otherwise(F.col("reason")))
    return chains.judged(chains.CUSTODY, pending).select("subject", "place", "code")
