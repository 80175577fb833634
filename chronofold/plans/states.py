"""Queries of the state machines, each with SQL of its own (recursive where the reference folds)."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators import states as S
from chronofold.plans.dialect import query
from chronofold.plans.ledger import duck, registered
from chronofold.plans.ledger import view as ledger_view

INPUTS = """
authority as (
  select subject, seq, case when seq = 0 then 'ACTOR_REGISTERED' when event_type = 'click' then 'GRANTED' when event_type = 'view' then 'REVOKED' when event_type = 'error' then 'ACTOR_QUARANTINED' else 'ACTOR_REINSTATED' end as kind,
         'g' || STR(actor % 5) as grant_id, 'CAP' || STR(actor % 3) as capability, 's' || STR(subject * 7 % 11) as issuer, MICROS(ts) as at_us from chain),
claim_events as (
  select 'c' || STR(subject) as claim_id, seq, MICROS(ts) as created_us,
         case when seq = 0 then 'CLAIM_ASSERTED' when actor = 1 then 'CLAIM_VALIDATED' when actor = 2 then 'CLAIM_REFUTED' when actor = 3 and event_type = 'click' then 'CLAIM_WITHDRAWN' when actor = 4 and event_type = 'view' then 'CLAIM_SUPERSEDED'
              when actor < 7 then 'EVIDENCE_LINKED' else 'RELATED_TO' end as kind, actor from chain),
sets as (
  select distinct 's' || STR(subject % 40) as set_id, case subject % 40 % 3 when 0 then 'AT_MOST_ONE' when 1 then 'EXACTLY_ONE' else 'INCOMPATIBLE' end as kind, 'c' || STR(subject) as claim_id from chain),
turns as (
  select conv_id as session, turn, STR(turn * 7 % 5) as x, STR((turn * 3 + conv_id) % 6) as y from conversations)"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ledger_view(spark, sf_dir, name, INPUTS)


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query("select subject, seq, kind from chain")(spark, sf_dir).withColumn("seq", F.col("seq").cast("long"))


def own(body: str, recursive: bool = False) -> str:
    return duck(body, INPUTS, recursive)


@registered(
    "EVT-4_legal_append",
    own(
        """
r as (
  select subject, seq, true as legal, 'CLEAN' as status from chain where seq = 0
  union all
  select c.subject, c.seq, not (c.kind = 'TAINT_FLAGGED' and r.status <> 'CLEAN' or c.kind = 'REHABILITATED' and r.status <> 'TAINT_FLAGGED'),
         case when c.kind = 'QUARANTINED' then 'QUARANTINED' when c.kind = 'TAINT_FLAGGED' and r.status = 'CLEAN' then 'TAINT_FLAGGED' when c.kind = 'REHABILITATED' and r.status = 'TAINT_FLAGGED' then 'CLEAN' else r.status end
  from r join chain c on c.subject = r.subject and c.seq = r.seq + 1)
select * from r""",
        True,
    ),
)
def legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.legal_events(chain(spark, sf_dir)).drop("kind")


def _reinforcement_sql(thirds: str, promote: bool) -> str:
    """thirds: the next confidence as a SQL expression of r.conf in whole units."""
    up = "r.state = 'NEUTRAL' and n >= 7500000000" if promote else "false"
    return f"""
s as (
  select subject, seq, kind, 'CLEAN' as status from chain where seq = 0
  union all
  select c.subject, c.seq, c.kind, case when c.kind = 'QUARANTINED' then 'QUARANTINED' when c.kind = 'TAINT_FLAGGED' and s.status = 'CLEAN' then 'TAINT_FLAGGED' when c.kind = 'REHABILITATED' then 'CLEAN' else s.status end
  from s join chain c on c.subject = s.subject and c.seq = s.seq + 1),
k as (select subject, seq, row_number() over (partition by subject order by seq) as i from s where kind = 'REINFORCED' and status = 'CLEAN'),
r as (
  select distinct subject, cast(0 as bigint) as i, cast(-1 as bigint) as seq, cast(0 as bigint) as before, cast(5000000000 as bigint) as conf, 'NEUTRAL' as state, false as promoted from chain
  union all
  select subject, i, seq, before, n, case when up then 'REINFORCED' else state end, up
  from (select *, {up.replace("r.state", "state")} as up from (select k.subject, k.i, k.seq, r.conf as before, r.state, {thirds} as n from r join k on k.subject = r.subject and k.i = r.i + 1)))
select subject, seq, (before // 10000000000)::varchar || '.' || lpad((before % 10000000000)::varchar, 10, '0') as before, (conf // 10000000000)::varchar || '.' || lpad((conf % 10000000000)::varchar, 10, '0') as after, promoted from r where i > 0"""


@registered("EVT-7_reinforce", own(_reinforcement_sql("(3 * r.conf + 10000000000) // 4 + case when (3 * r.conf + 10000000000) % 4 > 2 or (3 * r.conf + 10000000000) % 4 = 2 and (3 * r.conf + 10000000000) // 4 % 2 = 1 then 1 else 0 end", True), True))
def reinforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reinforcements(chain(spark, sf_dir))


@registered("EVT-8_reinforce_fifth", own(_reinforcement_sql("(4 * r.conf + 10000000000) // 5 + case when (4 * r.conf + 10000000000) % 5 >= 3 then 1 else 0 end", False), True))
def reinforce_fifth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reinforcements(chain(spark, sf_dir), S.SECOND_ALPHA, False)


@registered("EVT-9_pure_rule", "select event_id, round((value + (1000 - value) * 0.2) / 1000, 9) as after from (select event_id, least(value, 1000.0) as value from events)")
def pure_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.least(F.col("value"), F.lit(1000.0)) / 1000
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(c + (1 - c) * float(S.SECOND_ALPHA), 9).alias("after"))


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of each subject, by the last event that sets one."""
    c = chain(spark, sf_dir)
    strong = F.max(F.when(F.col("kind").isin("QUARANTINED", "REHABILITATED"), F.struct("seq", "kind")))
    per = c.groupBy("subject").agg(strong.alias("s"), F.max(F.when(F.col("kind") == "TAINT_FLAGGED", F.col("seq"))).alias("t"))
    return per.select("subject", F.when(F.col("s.kind") == "QUARANTINED", "QUARANTINED").when(F.col("t") > F.coalesce("s.seq", F.lit(-1)), "TAINT_FLAGGED").otherwise("CLEAN").alias("status"))


_STATUS = """
s as (
  select subject, seq, 'CLEAN' as status from chain where seq = 0
  union all
  select c.subject, c.seq, case when c.kind = 'QUARANTINED' then 'QUARANTINED' when c.kind = 'TAINT_FLAGGED' and s.status = 'CLEAN' then 'TAINT_FLAGGED' when c.kind = 'REHABILITATED' then 'CLEAN' else s.status end
  from s join chain c on c.subject = s.subject and c.seq = s.seq + 1),
now_ as (select subject, max_by(status, seq) as status, max(seq) + 1 as next from s group by subject)"""


@registered("EVT-14_quarantine_memory", own(_STATUS + " select subject, case when status = 'QUARANTINED' then null else next end as seq, status as status_from, case when status = 'QUARANTINED' then 'REFUSED' else 'QUARANTINED' end as outcome from now_", True))
def quarantine_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarantine asked of every memory: refused where one holds."""
    heads = chain(spark, sf_dir).groupBy("subject").agg((F.max("seq") + 1).alias("next"))
    held = F.col("status") == "QUARANTINED"
    return statuses(spark, sf_dir).join(heads, "subject").select("subject", F.when(~held, F.col("next")).alias("seq"), F.col("status").alias("status_from"), F.when(held, "REFUSED").otherwise("QUARANTINED").alias("outcome"))


@registered("EVT-15_rehabilitate", own(_STATUS + " select subject, case when status = 'TAINT_FLAGGED' then next end as seq, case when status = 'TAINT_FLAGGED' then 'REHABILITATED' else 'REFUSED' end as outcome from now_", True))
def rehabilitate(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = chain(spark, sf_dir).groupBy("subject").agg((F.max("seq") + 1).alias("next"))
    ok = F.col("status") == "TAINT_FLAGGED"
    return statuses(spark, sf_dir).join(heads, "subject").select("subject", F.when(ok, F.col("next")).alias("seq"), F.when(ok, "REHABILITATED").otherwise("REFUSED").alias("outcome"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query("select memory_id, topic, claim, custody_status, field_state from memories")(spark, sf_dir)


@registered("EVT-11_revive", own("select memory_id, field_state as state_from, case when field_state = 'FORGOTTEN' then 'NEUTRAL' end as state_to from memories"))
def revive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only a forgotten memory is revived; its confidence is kept, so no other column changes."""
    return memories(spark, sf_dir).select("memory_id", F.col("field_state").alias("state_from"), F.when(F.col("field_state") == "FORGOTTEN", "NEUTRAL").alias("state_to"))


@registered("EVT-12_update", own("select a.memory_id, (select min(b.memory_id) from memories b where b.topic = a.topic and b.claim = a.claim and b.memory_id > a.memory_id) as successor, case when a.custody_status <> 'CLEAN' then 'NOT_CLEAN' else 'OK' end as code from memories a"))
def update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next memory of the same topic and claim takes over; a predecessor that is not CLEAN refuses."""
    from pyspark.sql import Window as W

    nxt = F.lead("memory_id").over(W.partitionBy("topic", "claim").orderBy("memory_id"))
    return memories(spark, sf_dir).select("memory_id", nxt.alias("successor"), F.when(F.col("custody_status") != "CLEAN", "NOT_CLEAN").otherwise("OK").alias("code"))


_CLAIM = """
r as (
  select claim_id, seq, 'ASSERTED' as state, cast(null as varchar) as error from claim_events where seq = 0
  union all
  select c.claim_id, c.seq,
         case c.kind when 'CLAIM_VALIDATED' then 'VALIDATED' when 'CLAIM_REFUTED' then 'REFUTED' when 'CLAIM_WITHDRAWN' then 'WITHDRAWN' when 'CLAIM_SUPERSEDED' then 'SUPERSEDED' else r.state end,
         case when c.kind in ('CLAIM_VALIDATED', 'CLAIM_WITHDRAWN') and r.state <> 'ASSERTED' or c.kind in ('CLAIM_REFUTED', 'CLAIM_SUPERSEDED') and r.state not in ('ASSERTED', 'VALIDATED') then r.state end
  from r join claim_events c on c.claim_id = r.claim_id and c.seq = r.seq + 1)"""


@registered("WIN-8_claim_replay", own(_CLAIM + " select * from r", True))
def claim_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.claim_states(view(spark, sf_dir, "claim_events")).select("claim_id", "seq", "state", "error")


@registered("WIN-10_claim_state_before", own(_CLAIM + ", t as (select claim_id, max(created_us) - 3600000000 as at_us from claim_events group by claim_id) select t.claim_id, t.at_us, coalesce((select max_by(r.state, r.seq) from r join claim_events c on c.claim_id = r.claim_id and c.seq = r.seq where r.claim_id = t.claim_id and c.created_us < t.at_us), 'ASSERTED') as state from t", True))
def claim_state_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim an hour before its last event."""
    e = view(spark, sf_dir, "claim_events").withColumnRenamed("created_us", "created_at")
    t = e.groupBy("claim_id").agg((F.max("created_at") - 3_600_000_000).alias("at"))
    return S.state_before(e, t).withColumnRenamed("at", "at_us")


_LAST = _CLAIM + ", last_ as (select claim_id, max_by(state, seq) as state from r group by claim_id)"
_SETS = _LAST + """,
m as (select s.set_id, s.kind, count(*) filter (l.state = 'VALIDATED') as held, count(*) filter (l.state = 'ASSERTED') as open_, count(*) as n from sets s left join last_ l using (claim_id) group by s.set_id, s.kind),
v as (select *, case when held > 1 and kind <> 'INCOMPATIBLE' or kind = 'INCOMPATIBLE' and held = n or kind = 'EXACTLY_ONE' and held = 0 and open_ = 0 then 'VIOLATED' when open_ > 0 then 'UNDETERMINED' else 'SATISFIED' end as status from m)"""


def claim_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.claim_states(view(spark, sf_dir, "claim_events")).groupBy("claim_id").agg(F.max_by("state", "seq").alias("state"))


@registered("AGG-17_constraints", own(_SETS + " select set_id, kind, held, open_ as open, n, status from v", True))
def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.evaluated(view(spark, sf_dir, "sets"), claim_now(spark, sf_dir))


@registered("AGG-18_evaluate_sets", own(_SETS + """ select v.set_id, v.status, sha256('{"members":[' || (select string_agg('"' || s.claim_id || '"', ',' order by s.claim_id) from sets s where s.set_id = v.set_id) || ']}') as members_sha256 from v""", True))
def evaluated_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets with their status and the seal of their members."""
    from chronofold.operators import chains

    members = view(spark, sf_dir, "sets")
    sealed = chains.seals(members, "set_id", "claim_id", "members").withColumnRenamed("ids_sha256", "members_sha256")
    return S.evaluated(members, claim_now(spark, sf_dir)).select("set_id", "status").join(sealed.select("set_id", "members_sha256"), "set_id")


@registered("EVT-22_declare_set", own(_LAST + " select set_id, count(*) as members, case when count(*) < 2 then 'TOO_FEW' when bool_or(coalesce(state, 'ASSERTED') = 'VALIDATED') then 'ADJUDICATE' else 'ASSERT' end as needs from sets left join last_ using (claim_id) group by set_id", True))
def declare_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capability that declaring a set takes: ADJUDICATE if a member is VALIDATED already."""
    per = view(spark, sf_dir, "sets").join(claim_now(spark, sf_dir), "claim_id", "left").groupBy("set_id").agg(F.count("*").alias("members"), F.bool_or(F.coalesce(F.col("state") == "VALIDATED", F.lit(False))).alias("ruled"))
    return per.select("set_id", "members", F.when(F.col("members") < 2, "TOO_FEW").when(F.col("ruled"), "ADJUDICATE").otherwise("ASSERT").alias("needs"))


@registered("EVT-23_resolve_set", own(_LAST + ", w as (select s.*, l.state, row_number() over (partition by s.set_id order by s.claim_id) = 1 as wins from sets s left join last_ l using (claim_id)), a as (select set_id, kind, case when state in ('ASSERTED') and wins then 'VALIDATED' when state in ('ASSERTED', 'VALIDATED') and not wins then 'REFUTED' else state end as state from w), m as (select set_id, kind, count(*) filter (state = 'VALIDATED') as held, count(*) filter (state = 'ASSERTED') as open_, count(*) as n from a group by set_id, kind) select set_id, not (held > 1 and kind <> 'INCOMPATIBLE' or kind = 'INCOMPATIBLE' and held = n or kind = 'EXACTLY_ONE' and held = 0 and open_ = 0) as accepted from m", True))
def resolve_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first member of each set is validated and the others are refuted, as far as their states allow; a result that violates is refused."""
    members = view(spark, sf_dir, "sets")
    first = members.groupBy("set_id").agg(F.min("claim_id").alias("winner"))
    s = members.join(first, "set_id").join(claim_now(spark, sf_dir), "claim_id", "left")
    wins = F.col("claim_id") == F.col("winner")
    new = F.when(wins & (F.col("state") == "ASSERTED"), "VALIDATED").when(~wins & F.col("state").isin("ASSERTED", "VALIDATED"), "REFUTED").otherwise(F.col("state"))
    per = s.withColumn("state", new).groupBy("set_id", "kind").agg(F.count_if(F.col("state") == "VALIDATED").alias("held"), F.count_if(F.col("state") == "ASSERTED").alias("open"), F.count("*").alias("n"))
    return per.select("set_id", (S.constraint(F.col("kind"), F.col("held"), F.col("open"), F.col("n")) != "VIOLATED").alias("accepted"))


_GRANTS = """
f as (select subject, grant_id, min(seq) as seq from authority where kind = 'GRANTED' group by subject, grant_id),
g as (select a.subject, a.grant_id, a.capability, a.issuer, a.seq, a.at_us as granted_us, (select min_by(r.at_us, r.seq) from authority r where r.subject = a.subject and r.grant_id = a.grant_id and r.kind = 'REVOKED' and r.seq > a.seq) as revoked_us
      from authority a join f on f.subject = a.subject and f.grant_id = a.grant_id and f.seq = a.seq)"""


def authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "authority").withColumnRenamed("at_us", "at")


@registered("WIN-7_authority_replay", own(_GRANTS + " select subject, grant_id, capability, issuer, granted_us, revoked_us from g"))
def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.grants(authority(spark, sf_dir)).withColumnsRenamed({"granted_at": "granted_us", "revoked_at": "revoked_us"})


_QUARANTINES = """
q as (select a.subject, a.at_us as opened_us, (select min_by(b.kind, b.seq) from authority b where b.subject = a.subject and b.seq > a.seq and b.kind in ('ACTOR_QUARANTINED', 'ACTOR_REINSTATED')) as then_,
             (select min_by(b.at_us, b.seq) from authority b where b.subject = a.subject and b.seq > a.seq and b.kind = 'ACTOR_REINSTATED') as freed from authority a where a.kind = 'ACTOR_QUARANTINED')"""


@registered("FLT-6_quarantine_intervals", own(_QUARANTINES + " select subject, opened_us, case when then_ = 'ACTOR_REINSTATED' then freed end as closed_us from q"))
def quarantine_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quarantines(authority(spark, sf_dir)).withColumnsRenamed({"opened": "opened_us", "closed": "closed_us"})


@registered("FLT-5_grants_active", own(_GRANTS + ", t as (select (min(at_us) + max(at_us)) // 2 as t from authority) select subject, grant_id, capability from g, t where granted_us <= t and (revoked_us is null or revoked_us > t)"))
def active_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants active half way through the history: the interval is closed at its start and open at its end."""
    a = authority(spark, sf_dir)
    t = a.agg(F.expr("(min(at) + max(at)) div 2")).first()[0]
    return S.grants(a).where((F.col("granted_at") <= t) & (F.col("revoked_at").isNull() | (F.col("revoked_at") > t))).select("subject", "grant_id", "capability")


@registered("AGG-7_actors_holding", own(_GRANTS + " select capability, count(distinct subject) as holders from g where revoked_us is null group by capability"))
def holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.grants(authority(spark, sf_dir)).where("revoked_at is null").groupBy("capability").agg(F.count_distinct("subject").alias("holders"))


@registered("AGG-6_authority_genesis", own("select min(at_us) as genesis_us, count(distinct subject) as subjects from authority where kind = 'ACTOR_REGISTERED'"))
def authority_genesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authority(spark, sf_dir).where("kind = 'ACTOR_REGISTERED'").agg(F.min("at").alias("genesis_us"), F.count_distinct("subject").alias("subjects"))


@registered("EVT-18_revoke_guard", own(_GRANTS + ", l as (select capability, count(distinct subject) as holders from g where revoked_us is null group by capability) select g.subject, g.grant_id, case when g.revoked_us is not null then 'ALREADY_REVOKED' when l.holders = 1 then 'LAST_HOLDER' else 'OK' end as code from g left join l using (capability)"))
def revoke_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A revocation asked of every grant: the last holder of a capability keeps it."""
    g = S.grants(authority(spark, sf_dir))
    held = g.where("revoked_at is null").groupBy("capability").agg(F.count_distinct("subject").alias("holders"))
    code = F.when(F.col("revoked_at").isNotNull(), "ALREADY_REVOKED").when(F.col("holders") == 1, "LAST_HOLDER").otherwise("OK")
    return g.join(held, "capability", "left").select("subject", "grant_id", code.alias("code"))


_CONTROL = """
o as (select user_id as agent, row_number() over (partition by user_id order by ts, event_id) as i, cast(least(floor(value), 100) as bigint) * 100000000 as u from events),
r as (
  select distinct agent, cast(0 as bigint) as i, cast(0 as bigint) as ema, 'ROAMING' as mode, cast(null as varchar) as trigger_, 0 as still from o
  union all
  select agent, i, ema4 // 4 + case when ema4 % 4 > 2 or ema4 % 4 = 2 and ema4 // 4 % 2 = 1 then 1 else 0 end, case t when 'ENTER' then 'DWELLING' when 'LEAVE' then 'ROAMING' when 'STAGNATION' then 'ROAMING' else mode end, t, case when t is not null then 0 else s end
  from (select *, case when mode = 'ROAMING' and ema4 >= 24000000000 then 'ENTER' when mode = 'DWELLING' and ema4 <= 16000000000 then 'LEAVE' when mode = 'DWELLING' and s >= 5 then 'STAGNATION' end as t
        from (select r.agent, o.i, r.mode, o.u + 3 * r.ema as ema4, case when r.mode <> 'DWELLING' then 0 when o.u + 3 * r.ema >= 4 * (r.ema + 100000000) then 0 else r.still + 1 end as s from r join o on o.agent = r.agent and o.i = r.i + 1)))"""


def _shown(x: str) -> str:
    return f"({x} // 10000000000)::varchar || '.' || lpad(({x} % 10000000000)::varchar, 10, '0')"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("agent"), seq.alias("seq"), (F.least(F.floor("value"), F.lit(100)).cast("long") * 100_000_000).alias("units"))


@registered("WIN-12_controller", own(_CONTROL + f" select agent, i as seq, {_shown('ema')} as ema, mode, still as stagnation from r where i > 0", True))
def controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.controlled(observations(spark, sf_dir)).select("agent", F.col("seq").cast("long").alias("seq"), "ema", "mode", "stagnation")


@registered("STR-8_transitions", own(_CONTROL + " select agent, i as seq, mode, trigger_ as trigger from r where trigger_ is not null", True))
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only transitions are told."""
    return S.controlled(observations(spark, sf_dir)).where("trigger is not null").select("agent", F.col("seq").cast("long").alias("seq"), "mode", "trigger")


@registered("STR-9_hysteresis", own(_CONTROL + " select agent, count(*) filter (trigger_ = 'ENTER') as entered, count(*) filter (trigger_ = 'LEAVE') as fell, count(*) filter (trigger_ = 'STAGNATION') as stalled, max_by(mode, i) as mode from r where i > 0 group by agent", True))
def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = S.controlled(observations(spark, sf_dir))
    return told.groupBy("agent").agg(*[F.count_if(F.col("trigger") == t).alias(n) for t, n in (("ENTER", "entered"), ("LEAVE", "fell"), ("STAGNATION", "stalled"))], F.max_by("mode", "seq").alias("mode"))


_LEARNED = """
i as (select session, turn, x as id from turns union select session, turn, y from turns),
p as (select a.session, a.turn, a.id as from_id, b.turn as now from i a join (select session, turn, lead(turn) over (partition by session order by turn) as next from (select distinct session, turn from turns)) n on n.session = a.session and n.turn = a.turn join (select distinct session, turn from turns) b on b.session = a.session and b.turn = n.next),
d as (select distinct session, id from i),
k as (select p.session, p.from_id, d.id as to_id, row_number() over (partition by p.session, p.from_id, d.id order by p.now) as s, exists (select 1 from i where i.session = p.session and i.turn = p.now and i.id = d.id) as hit from p join d on d.session = p.session and d.id <> p.from_id),
w as (
  select session, from_id, to_id, cast(0 as bigint) as s, 0.0::double as weight from (select distinct session, from_id, to_id from k)
  union all
  select k.session, k.from_id, k.to_id, k.s, case when k.hit then least(2.0, w.weight + 0.1) when greatest(0.0, w.weight - 0.02) <= 1e-9 then 0.0 else w.weight - 0.02 end from w join k on k.session = w.session and k.from_id = w.from_id and k.to_id = w.to_id and k.s = w.s + 1)
select session, from_id, to_id, round(max_by(weight, s), 6) as weight from w group by session, from_id, to_id having max_by(weight, s) > 0"""


@registered("EVT-24_stdp", own(_LEARNED, True))
def stdp(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "turns").select("session", "turn", F.array("x", "y").alias("ids"))
    return S.learned(t).withColumn("weight", F.round("weight", 6))


@registered("STR-10_rate_limiter")
def rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three accepted hits an hour and client; held against a loop in the tests."""
    hits = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("client"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))
    return S.limited(hits, 3, 3600).select("id", "client", "accepted")


@registered("STR-12_recall_cache")
def recall_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by type, a generation a day; held against a loop in the tests."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    r = e.select(F.col("user_id").alias("session"), at.alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("key"), F.floor(at / 86_400_000_000).alias("generation"), (F.col("event_type") == "error").alias("degraded"))
    return S.cached(r, 43_200, 3).select("id", "session", "hit")


