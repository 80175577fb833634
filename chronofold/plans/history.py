"""Queries over time and by sweeps: states of then, as-of and interval joins, drains, silenced sets; with SQL of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators import ablation, agent, store, sweep
from chronofold.operators import states as S
from chronofold.operators.replay import state_at
from chronofold.plans import states as plans
from chronofold.plans.dialect import query
from chronofold.plans.field import own as field_own
from chronofold.plans.field import view as field_view
from chronofold.plans.ledger import duck, registered
from chronofold.plans.ledger import view as ledger_view
from chronofold.storage import positioned, shared_dir
from chronofold.streaming import once

INPUTS = """
lives as (
  select subject as memory_id, seq, MICROS(ts) as at_us,
         case when seq > 0 and kind = 'DECISION_USED_MEMORY' and event_id % 5 = 0 then 'STATE_CHANGED' else kind end as kind,
         case when seq > 0 and kind = 'DECISION_USED_MEMORY' and event_id % 10 = 0 then 'FORGOTTEN' when seq > 0 and kind = 'DECISION_USED_MEMORY' and event_id % 5 = 0 then 'NEUTRAL' end as to_state
  from chain)"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ledger_view(spark, sf_dir, name, INPUTS)


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return query(f"select * from {name}")(spark, sf_dir)


_THEN = """
mid as (select (min(at_us) + max(at_us)) // 2 as t from lives),
r as (
  select memory_id, seq, 'CLEAN' as status, 0.5::double as conf, 'NEUTRAL' as state from lives, mid where seq = 0 and at_us <= t
  union all
  select memory_id, seq, status, conf, case when kind = 'STATE_CHANGED' then to_state when kind = 'REINFORCED' and status = 'CLEAN' and state = 'NEUTRAL' and conf >= 0.75 then 'REINFORCED' else state end
  from (select c.memory_id, c.seq, c.kind, c.to_state, r.state,
               case when c.kind = 'QUARANTINED' then 'QUARANTINED' when c.kind = 'TAINT_FLAGGED' and r.status = 'CLEAN' then 'TAINT_FLAGGED' when c.kind = 'REHABILITATED' and r.status = 'TAINT_FLAGGED' then 'CLEAN' else r.status end as status,
               case when c.kind = 'REINFORCED' and r.status = 'CLEAN' then r.conf + (1 - r.conf) / 4 else r.conf end as conf
        from r join lives c on c.memory_id = r.memory_id and c.seq = r.seq + 1 join mid on c.at_us <= mid.t))
select memory_id, max_by(status, seq) as custody_status, max_by(state, seq) as field_state from r group by memory_id"""


@registered("WIN-11_state_as_of", duck(_THEN, INPUTS, True))
def then(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and state of every memory half way through the history, of the events that its chain would have taken."""
    c = view(spark, sf_dir, "lives").withColumnsRenamed({"to_state": "to", "at_us": "created_at"})
    lawful = S.legal_events(c.withColumnRenamed("memory_id", "subject")).where("legal").withColumnRenamed("subject", "memory_id")
    mid = c.agg(F.expr("(min(created_at) + max(created_at)) div 2")).first()[0]
    return state_at(lawful, mid).select("memory_id", "custody_status", "field_state")


@registered("JOIN-6_as_of", duck("asked as (select event_id as ask_id, user_id, epoch_us(ts) as t from events where event_type = 'view') select a.ask_id, max(c.seq) as seq, max_by(c.kind, c.seq) as kind from asked a join chain c on c.subject = a.user_id and epoch_us(c.ts) <= a.t group by a.ask_id", "dummy as (select 1 as one)"))
def last_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question's chain came to by then."""
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'view'").select(F.col("event_id").alias("ask_id"), F.col("user_id").alias("subject"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    c = view(spark, sf_dir, "lives").select(F.col("memory_id").alias("subject"), "seq", F.col("at_us").alias("at")).join(model(spark, sf_dir, "chain").select("subject", "seq", "kind"), ["subject", "seq"])
    told = sweep.as_of(asked, c, ["subject"], "at", ("seq",)).where("found is not null")
    return told.select("ask_id", "found.seq", "found.kind")


_SPANS = plans._GRANTS + "," + plans._QUARANTINES + ", z as (select subject, opened_us, case when then_ = 'ACTOR_REINSTATED' then freed end as closed_us from q)"


@registered("JOIN-7_event_grant_interval", plans.own(_SPANS + " select a.subject, a.seq, (select count(*) from g where g.subject = a.subject and g.granted_us <= a.at_us and (g.revoked_us is null or a.at_us < g.revoked_us) and (g.revoked_us is null or g.revoked_us > g.granted_us)) as grants, (select count(*) from z where z.subject = a.subject and z.opened_us <= a.at_us and (z.closed_us is null or a.at_us < z.closed_us)) > 0 as barred from authority a"))
def under_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with how many grants of its subject held then, and whether a quarantine barred it."""
    a = plans.authority(spark, sf_dir)
    spans = {"grants": S.grants(a).select("subject", F.col("granted_at").alias("since"), F.col("revoked_at").alias("until")), "open": S.quarantines(a).select("subject", F.col("opened").alias("since"), F.col("closed").alias("until"))}
    told = sweep.covered(a.select("subject", "seq", "at"), spans, ["subject"], "at")
    return told.select("subject", "seq", "grants", (F.col("open") > 0).alias("barred"))


@registered("JOIN-1_contradictions", duck("select a.memory_id as from_id, b.memory_id as to_id from memories a join memories b on a.topic = b.topic and a.memory_id <> b.memory_id and a.claim <> b.claim", "dummy as (select 1 as one)"))
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of memories of a topic with unlike claims, both ways, block by block."""
    a, b = _sides(spark, sf_dir)
    return store.in_blocks(a, b, ["topic"], "from_id", "to_id").where("claim <> other").select("from_id", "to_id")


@registered("JOIN-2_new_contradictions", duck("select a.memory_id as from_id, b.memory_id as to_id from memories a join memories b on a.topic = b.topic and a.memory_id < b.memory_id and a.claim <> b.claim where not exists (select 1 from links l where l.from_id = a.memory_id and l.to_id = b.memory_id)", "dummy as (select 1 as one)"))
def new_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs, the smaller id first, that no link joins yet; a memory carries the targets of its links, so pairs are not shuffled."""
    a, b = _sides(spark, sf_dir)
    linked = model(spark, sf_dir, "links").where("from_id < to_id").groupBy("from_id").agg(F.collect_set("to_id").alias("linked"))
    pairs = store.in_blocks(a.join(linked, "from_id", "left"), b, ["topic"], "from_id", "to_id").where("from_id < to_id and claim <> other")
    return pairs.where(~F.coalesce(F.array_contains("linked", F.col("to_id")), F.lit(False))).select("from_id", "to_id")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = model(spark, sf_dir, "memories")
    return m.select("topic", "claim", F.col("memory_id").alias("from_id")), m.select("topic", F.col("claim").alias("other"), F.col("memory_id").alias("to_id"))


@registered("EVT-6_supersede", duck("select a.memory_id, min(b.memory_id) as superseded_by from memories a join memories b on a.topic = b.topic and a.claim = b.claim and b.memory_id > a.memory_id group by a.memory_id", "dummy as (select 1 as one)"))
def superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next memory of the same topic and claim: an as-of join with ids in place of time, from above."""
    m = model(spark, sf_dir, "memories").select("topic", "claim", "memory_id")
    later = m.select("topic", "claim", (-F.col("memory_id")).alias("at"), F.col("memory_id").alias("next"))
    told = sweep.as_of(m.withColumn("at", -F.col("memory_id") - 1), later, ["topic", "claim"], "at")
    return told.where("found is not null").select("memory_id", F.col("found.next").alias("superseded_by"))


@registered("SNK-12_paged_list", duck("select memory_id, topic, (row_number() over (order by topic, memory_id) - 1) // 50 as page from memories", "dummy as (select 1 as one)"))
def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir, "memories").select("memory_id", "topic")
    return positioned(m, [F.col("topic"), F.col("memory_id")], "at").select("memory_id", "topic", F.floor(F.col("at") / 50).alias("page"))


_TTL, _CHUNK, _MOST = "interval 30 minutes", 100, 5


def expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    now = e.agg((F.max("ts") - F.expr("interval 12 hours")).alias("t")).first()[0]
    s = e.select(F.col("event_id").alias("id"), "event_type", (F.col("ts") + F.expr(_TTL)).alias("expires_at"))
    return s.where(F.col("expires_at") <= F.lit(now))


def drained(spark: SparkSession, sf_dir: str) -> tuple[once.Ledger, once.Drained]:
    import uuid

    ledger = once.Ledger(spark, f"{shared_dir(spark)}/drain-{uuid.uuid4().hex}", "id long, event_type string, expires_at timestamp")
    return ledger, once.drain(ledger, expired(spark, sf_dir), "id", ["expires_at"], _CHUNK, _MOST)


_DUE = "select event_id as id, event_type, row_number() over (order by ts, event_id) - 1 as i from events where ts + interval 30 minute <= (select max(ts) - interval 12 hour from events)"


@registered("STR-7_sweep", f"select id, event_type, i // {_CHUNK} as batch from ({_DUE}) where i < {_CHUNK * _MOST}")
def swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick of the sweeper: the oldest expired signals, in chunks that the ledger keeps."""
    return drained(spark, sf_dir)[0].rows().select("id", "event_type", "batch")


@registered("AGG-20_bounded_drain", f"select least({_MOST}, count(*) // {_CHUNK} + 1) as chunks, least(count(*), {_CHUNK * _MOST}) as total, count(*) < {_CHUNK * _MOST} as drained from ({_DUE})")
def drain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = drained(spark, sf_dir)[1]
    return spark.createDataFrame([(told.chunks, told.total, told.drained)], "chunks long, total long, drained boolean")


_CEIL = "(select max(epoch_us(ts)) from events)"


@registered("FLT-7_liveness", duck(f"select event_id, round(least(value / 100, 1) * exp(-({_CEIL} - epoch_us(ts)) / 1e6 / 604800), 9) as vigor from events where value is not null and epoch_us(ts) + 1209600000000 > {_CEIL} and event_type <> 'error' and least(value / 100, 1) * exp(-({_CEIL} - epoch_us(ts)) / 1e6 / 604800) >= 0.05", "dummy as (select 1 as one)"))
def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending signals that are not expired and whose strength, decayed from their creation, is at least the floor."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    now = e.agg(F.max("at")).first()[0]
    return S.live_signals(e.where("event_type <> 'error'").select("event_id", (F.least(F.col("value") / 100, F.lit(1.0))).alias("strength"), F.col("at").alias("created_us"), (F.col("at") + 1_209_600_000_000).alias("expires_us")), now, 604_800).select("event_id", F.round("vigor", 9).alias("vigor"))


@registered("FLT-8_stale", duck(f"select subject from chain group by subject having max(epoch_us(ts)) <= (select quantile_disc(m, 0.25) from (select max(epoch_us(ts)) as m from chain group by subject))", "dummy as (select 1 as one)"))  # noqa: F541
def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarter of the chains that has been silent for longest."""
    last = model(spark, sf_dir, "chain").groupBy("subject").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last"))
    cut = last.agg(F.expr("percentile_disc(0.25) within group (order by last)")).first()[0]
    return last.where(F.col("last") <= F.lit(int(cut))).select("subject")


def served(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m, x = model(spark, sf_dir, "memories"), model(spark, sf_dir, "links")
    return m, x, model(spark, sf_dir, "queries")


@registered("GRF-14_dependence_class")
def dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each served memory: which of the others served it depends on, singly or in pairs; brute force in the tests."""
    from chronofold.operators.recall import recall

    m, x, q = served(spark, sf_dir)
    told = ablation.dependence(m, x, q, recall(m, x, q).select("query_id", "memory_id"))
    return told.select("query_id", "watched", "verdict", F.to_json("killers").alias("killers"))


@registered("GRF-15_rescue_fuzz")
def rescue_fuzz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exits of REINFORCED memories of each query under random silencing of NEUTRAL ones, by reason; brute force in the tests."""
    m, x, q = served(spark, sf_dir)
    told = ablation.rescue_fuzz(m, x, q, trials=8)
    reasons = [F.count_if(F.col("reason") == r).alias(r.lower()) for r in ("INHIBITED", "OUTRANKED", "UNREACHABLE")]
    return q.select("query_id").join(told, "query_id", "left").groupBy("query_id").agg(*reasons)


@registered("VEC-18_seeded_embedding")
def seeded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded vectors of all documents' texts, by their digests; held to another generator of the same stream in the tests."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("trim(text) <> ''").select(F.col("doc_id").alias("id"), "text")
    text = F.array_join(F.transform("v", lambda x: x.cast("string")), ",")
    return agent.PROVIDERS["seeded-384"](d).select("id", F.size("v").alias("n"), F.sha2(text, 256).alias("vector_sha256"))


_IMPACT = """
e as (select 'M' || memory_id as a, 'D' || decision_id as b from uses union select 'D' || decision_id, 'M' || memory_id from derived union select 'M' || old, 'M' || new from succession),
src as (select min(memory_id) as id from uses), s as (select distinct decision_id // 2 as receipt_id, memory_id from uses),
walk as (select 'M' || id as id from src union select e.b from walk join e on e.a = walk.id),
direct as (select distinct s.receipt_id from s, src where s.memory_id = src.id)
select 'RECEIPT' as kind, receipt_id as id, 'DIRECT' as level from direct
union all select 'MEMORY', memory_id, 'POSSIBLE' from (select memory_id from s where receipt_id in (select receipt_id from direct) union select r.b from resonant r, src where r.a = src.id) p where 'M' || memory_id not in (select id from walk)"""


@registered("API-8_impact", field_own(_IMPACT, True))
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contact of one memory: receipts that served it, and what they served with it or links join to it."""
    from chronofold.operators import graph

    uses = field_view(spark, sf_dir, "uses")
    first = uses.agg(F.min("memory_id").alias("id"))
    receipts = uses.select(F.floor(F.col("decision_id") / 2).alias("receipt_id"), "memory_id").distinct()
    told = graph.blast_radius(first, uses, field_view(spark, sf_dir, "derived"), field_view(spark, sf_dir, "succession"), receipts, field_view(spark, sf_dir, "resonant"))
    return told.where("level = 'POSSIBLE' or kind = 'RECEIPT'").select("kind", "id", "level")
