"""Integrity checks, audit logs, filters, upserts and replays that are not chains, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions import canonical as C
from chronofold.functions import text as T
from chronofold.operators import audit, chains
from chronofold.operators import states as S
from chronofold.operators.folds import folded
from chronofold.plans import ledger, scalars, states
from chronofold.plans.dialect import query
from chronofold.plans.ledger import duck, registered
from chronofold.plans.ledger import view as ledger_view
from chronofold.storage import spread

INPUTS = """
logs as (
  select conv_id as log, turn as seq, '{"operation":"recall","query_sha256":"' || SHA(text) || '","turn":' || STR(turn) || '}' as payload from conversations),
moves as (
  select subject as memory_id, seq, case when seq = 0 then 'STORED' when event_type = 'click' then 'REINFORCED' when event_type = 'view' then 'MIGRATED' when event_type = 'error' then 'ORPHANED' else 'REDISCOVERED' end as kind, 'r' || STR(actor % 4) as region from chain),
proposals as (
  select event_id as id, user_id % 50 as from_id, event_id * 7 % 53 as to_id, case when event_id % 3 = 0 then 'INHIBITORY' else 'RESONANT' end as link_type, MICROS(ts) as at_us from events)"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ledger_view(spark, sf_dir, name, INPUTS)


def own(body: str, recursive: bool = False) -> str:
    return duck(body, INPUTS, recursive)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_AUDIT = """
a as (
  select log, seq, payload, repeat('0', 64) as prev_hash, sha256(payload || repeat('0', 64)) as audit_hash from logs l where seq = (select min(seq) from logs x where x.log = l.log)
  union all
  select l.log, l.seq, l.payload, a.audit_hash, sha256(l.payload || a.audit_hash) from a join logs l on l.log = a.log and l.seq = a.seq + 1)"""


@registered("SNK-10_audit_append", own(_AUDIT + " select log, seq, audit_hash from a", True))
def audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.append(view(spark, sf_dir, "logs")).select("log", "seq", "audit_hash")


def damaged_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each third log has a changed payload in its second row, each fourth a changed link in its third."""
    rows = audit.append(view(spark, sf_dir, "logs")).withColumn("i", F.row_number().over(W.partitionBy("log").orderBy("seq")))
    rows = rows.withColumn("payload", F.when((F.col("log") % 3 == 0) & (F.col("i") == 2), "{}").otherwise(F.col("payload")))
    return rows.withColumn("prev_hash", F.when((F.col("log") % 4 == 0) & (F.col("i") == 3), F.lit("f" * 64)).otherwise(F.col("prev_hash"))).drop("i")


@registered("WIN-3_audit_verification", own("n as (select *, row_number() over (partition by log order by seq) as i from logs) select log, seq, not (log % 4 = 0 and i = 3) as linked, false as sound from n where log % 3 = 0 and i = 2 or log % 4 = 0 and i = 3"))
def audit_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.issues(damaged_log(spark, sf_dir))


@registered("WIN-5_tail_check", own("n as (select *, row_number() over (partition by log order by seq) as i, count(*) over (partition by log) as n from logs) select log, seq from n where log % 4 = 0 and i = 3 and n - i < 3"))
def tail_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.tail_issues(damaged_log(spark, sf_dir), 4)


_DAYS = "days as (select cast(ts as date) as day, list(event_id order by event_id) as ids from events group by 1), roots as (select row_number() over (order by day) - 1 as seq, sha256('{\"event_ids\":[' || array_to_string(list_transform(list_sort(list_transform(ids, lambda x: '\"' || x || '\"')), lambda x: x), ',') || ']}') as root from days)"


@registered(
    "WIN-4_ledger",
    "with recursive " + _DAYS + ", l as (select seq, root, sha256('LEDGER' || root) as ledger_hash from roots where seq = 0 union all select r.seq, r.root, sha256(l.ledger_hash || r.root) from l join roots r on r.seq = l.seq + 1) select seq, root, ledger_hash, case when seq % 5 = 3 then 'ROOT' end as code from l",
)
def snapshot_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot a day over the day's ids; every fifth stores another root than its ids give, which the check finds."""
    e = read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id")
    sealed = chains.seals(e, "day", "event_id", "event_ids")
    rows = sealed.select(F.lit("ledger").alias("subject"), (F.row_number().over(W.orderBy("day")) - 1).cast("long").alias("seq"), F.col("ids_sha256").alias("root"))  # a row a day
    rows = rows.withColumn("envelope", F.col("root")).withColumn("head_hash", F.lit("LEDGER"))
    told = chains._chained(rows, ["seq"]).withColumn("stored", F.when(F.col("seq") % 5 == 3, F.sha2(F.col("root"), 256)).otherwise(F.col("root")))
    return told.select("seq", "root", F.col("entry_hash").alias("ledger_hash"), F.when(F.col("stored") != F.col("root"), "ROOT").alias("code"))


_MOVES = """
r as (
  select memory_id, seq, region, 'SHORT_TERM' as tier, 'NEUTRAL' as state, cast(5000000000 as bigint) as conf from moves where seq = 0
  union all
  select m.memory_id, m.seq, case when m.kind = 'MIGRATED' then m.region else r.region end,
         case m.kind when 'MIGRATED' then 'REGIONAL' when 'ORPHANED' then 'ORPHANED' when 'REDISCOVERED' then case when r.tier = 'ORPHANED' then 'SHORT_TERM' else r.tier end else r.tier end,
         case when m.kind = 'REINFORCED' then 'REINFORCED' else r.state end, case when m.kind = 'REINFORCED' then (4 * r.conf + 10000000000) // 5 + case when (4 * r.conf + 10000000000) % 5 >= 3 then 1 else 0 end else r.conf end
  from r join moves m on m.memory_id = r.memory_id and m.seq = r.seq + 1)"""


@registered("WIN-9_region_replay", own(_MOVES + " select memory_id, max_by(region, seq) as region, max_by(tier, seq) as tier, max_by(state, seq) as state, max_by(conf, seq) as units from r group by memory_id", True))
def region_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, tier, state and confidence of each memory after its moves."""

    def step(s, row):
        region, tier, state, conf = s
        k = row["kind"]
        if k == "STORED":
            return (row["region"], "SHORT_TERM", "NEUTRAL", S.FIRST), None
        if k == "MIGRATED":
            region, tier = row["region"], "REGIONAL"
        elif k == "ORPHANED":
            tier = "ORPHANED"
        elif k == "REDISCOVERED" and tier == "ORPHANED":
            tier = "SHORT_TERM"
        elif k == "REINFORCED":
            state, conf = "REINFORCED", S.reinforced(conf, S.SECOND_ALPHA)
        return (region, tier, state, conf), None

    return folded(view(spark, sf_dir, "moves"), "memory_id", ["seq"], lambda: (None, None, None, S.FIRST), step, "region string, tier string, state string, units long", lambda s: s)


@registered("SNK-7_upsert_memory", own("select from_id as memory_id, max_by(to_id, id) as topic from proposals group by from_id"))
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write of each key."""
    return view(spark, sf_dir, "proposals").groupBy(F.col("from_id").alias("memory_id")).agg(F.max_by("to_id", "id").alias("topic"))


@registered("SNK-8_upsert_links", own("select from_id, to_id, max_by(link_type, id) as link_type from proposals group by from_id, to_id"))
def upsert_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "proposals").groupBy("from_id", "to_id").agg(F.max_by("link_type", "id").alias("link_type"))


@registered("SNK-9_first_wins", own("select from_id, to_id, min_by(link_type, id) as link_type from proposals p where from_id <> to_id and from_id in (select memory_id from memories) and to_id in (select memory_id from memories) and not exists (select 1 from links l where l.from_id = p.from_id and l.to_id = p.to_id) group by from_id, to_id"))
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New links between memories that exist, none to itself, none that is there already; the first proposal counts."""
    ids = query("select memory_id from memories")(spark, sf_dir)
    there = query("select distinct from_id, to_id from links")(spark, sf_dir)
    p = view(spark, sf_dir, "proposals").where("from_id <> to_id").join(ids.withColumnRenamed("memory_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("memory_id", "to_id"), "to_id", "left_semi")
    return p.join(there, ["from_id", "to_id"], "left_anti").groupBy("from_id", "to_id").agg(F.min_by("link_type", "id").alias("link_type"))


@registered("SRC-1_open", " union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in ("documents", "embeddings", "events", "conversations", "orders")))
def opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in ("documents", "embeddings", "events", "conversations", "orders"):
        n = read(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")).select("name", "n")
        out = n if out is None else out.unionByName(n)
    return out


def by_ids(df: DataFrame, key: str, ids: list | None) -> DataFrame:
    """All rows, those of the ids, or none for an empty list."""
    if ids is None:
        return df
    return df.where(F.col(key).isin(*ids)) if ids else df.limit(0)


@registered("SRC-9_decision_scan", "select o_orderkey as decision_id, o_custkey as actor_id, o_orderstatus as status from orders where o_orderkey in (1, 2, 3, 5, 8, 13, 21)")
def decision_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = by_ids(read(spark, sf_dir, "orders"), "o_orderkey", [1, 2, 3, 5, 8, 13, 21])
    return found.select(F.col("o_orderkey").alias("decision_id"), F.col("o_custkey").alias("actor_id"), F.col("o_orderstatus").alias("status"))


@registered("SRC-10_set_scan", duck("select set_id, kind, count(*) as members from sets where set_id in ('s1', 's2', 's30') group by set_id, kind", states.INPUTS))
def set_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = by_ids(states.view(spark, sf_dir, "sets"), "set_id", ["s1", "s2", "s30"])
    return found.groupBy("set_id", "kind").agg(F.count("*").alias("members"))


@registered("SRC-8_receipt_scan", duck("select decision_id, list_aggregate(list(memory_id order by memory_id), 'string_agg', ',') as served from uses where decision_id in (1, 3, 7, 32) group by decision_id", scalars.USES))
def receipt_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_ids(scalars.used(spark, sf_dir), "decision_id", [1, 3, 7, 32]).select("decision_id", F.array_join("used", ",").alias("served"))


@registered("FLT-4_valid_id", "select page_id, regexp_full_match(id, '[a-zA-Z0-9_.:-]+') and len(id) <= 64 as valid from (select page_id, case when page_id % 3 = 0 then url when page_id % 3 = 1 then 'p-' || page_id else repeat('x', 60 + page_id % 9) end as id from pages)")
def valid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    made = F.when(k % 3 == 0, F.col("url")).when(k % 3 == 1, F.concat(F.lit("p-"), k.cast("string"))).otherwise(F.expr("repeat('x', cast(60 + page_id % 9 as int))"))
    return read(spark, sf_dir, "pages").select("page_id", C.valid_id(made).alias("valid"))


@registered("FLT-9_provider_check", "select event_type, count(distinct json_extract_string(props, '$.k')) as providers, bool_or(json_extract_string(props, '$.k') <> '7') as foreign_provider from events group by event_type")
def provider_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct(k).alias("providers"), F.bool_or(k != "7").alias("foreign_provider"))


PROTOCOLS = {"ranking": ("1.0.0",), "custody": ("1.0.0", "1.1.0"), "replay": ("1.0.0", "1.1.0")}


def protocol_fault(p: str):
    """KEYS if a map does not have exactly the known protocols, VERSION if one has an unknown version."""
    known = F.array(*map(F.lit, sorted(PROTOCOLS)))
    versions = F.lit(False)
    for k, vs in PROTOCOLS.items():
        versions = versions | ~F.coalesce(F.element_at(p, F.lit(k)).isin(*vs), F.lit(False))
    return F.when(F.array_sort(F.map_keys(p)) != known, "KEYS").when(versions, "VERSION")


@registered("FLT-10_protocol_check", "select event_id, case event_id % 4 when 1 then 'KEYS' when 2 then 'KEYS' when 3 then 'VERSION' end as fault from events")
def protocol_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sound declaration, one too few, one too many and an unknown version in turn."""
    k = F.col("event_id") % 4
    full = F.create_map(F.lit("ranking"), F.lit("1.0.0"), F.lit("custody"), F.lit("1.1.0"), F.lit("replay"), F.when(k == 3, "9.9.9").otherwise("1.1.0"))
    p = F.when(k == 1, F.map_filter(full, lambda n, _: n != "replay")).when(k == 2, F.map_concat(full, F.create_map(F.lit("other"), F.lit("1.0.0")))).otherwise(full)
    return read(spark, sf_dir, "events").withColumn("p", p).select("event_id", protocol_fault("p").alias("fault"))


def vector_fault(v: str, dim: int):
    """DIMENSION, NOT_FINITE, ZERO or null."""
    return F.when(F.size(v) != dim, "DIMENSION").when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "NOT_FINITE").when(F.forall(v, lambda x: x == 0), "ZERO")


@registered("FLT-11_embedding_check", "select vec_id, case vec_id % 5 when 1 then 'DIMENSION' when 2 then 'NOT_FINITE' when 3 then 'ZERO' when 4 then 'NOT_FINITE' end as fault from embeddings")
def embedding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("vec_id") % 5, F.col("embedding").cast("array<double>")
    set_first = lambda x: F.concat(F.array(F.lit(x).cast("double")), F.slice(v, 2, 63))
    made = F.when(k == 1, F.slice(v, 1, 63)).when(k == 2, set_first(float("nan"))).when(k == 3, F.transform(v, lambda _: F.lit(0.0))).when(k == 4, set_first(float("inf"))).otherwise(v)
    return read(spark, sf_dir, "embeddings").withColumn("v", made).select("vec_id", vector_fault("v", 64).alias("fault"))


@registered("FLT-12_tensor_check", "select label, count(*) as n, case when label % 3 = 1 then 'SHAPE' when label % 3 = 2 then 'NOT_FINITE' end as fault from embeddings group by label")
def tensor_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of a label as one tensor: rows of one length, all finite."""
    v, k = F.col("embedding").cast("array<double>"), F.col("label") % 3
    first = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) == 1
    made = F.when(first & (k == 1), F.slice(v, 1, 10)).when(first & (k == 2), F.transform(v, lambda _: F.lit(float("inf")))).otherwise(v)
    t = read(spark, sf_dir, "embeddings").withColumn("v", made)
    odd = F.count_if(F.exists("v", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))) > 0
    return t.groupBy("label").agg(F.count("*").alias("n"), F.when(F.min(F.size("v")) != F.max(F.size("v")), "SHAPE").when(odd, "NOT_FINITE").alias("fault"))


#: What an event takes of its actor.
CAPABILITY = {"STORED": "STORE", "REINFORCED": "REINFORCE", "SUPERSEDED_BY": "SUPERSEDE", "QUARANTINED": "QUARANTINE", "TAINT_FLAGGED": "QUARANTINE", "REHABILITATED": "REHABILITATE", "STATE_CHANGED": "REINFORCE", "DECISION_USED_MEMORY": "DECIDE", "CONTRADICTED_BY": "STORE"}


@registered("FLT-13_capability", duck("select subject, place, case when event_type = 'STORED' and place % 2 = 1 then 'SUPERSEDE' when event_type = 'STORED' then 'STORE' when event_type = 'REINFORCED' then 'REINFORCE' when event_type in ('QUARANTINED', 'TAINT_FLAGGED') then 'QUARANTINE' when event_type = 'REHABILITATED' then 'REHABILITATE' when event_type = 'DECISION_USED_MEMORY' then 'DECIDE' end as capability from pending", ledger.INPUTS))
def capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event takes; a STORED that names what it supersedes takes SUPERSEDE."""
    p = ledger.view(spark, sf_dir, "pending")
    payload = F.when((F.col("event_type") == "STORED") & (F.col("place") % 2 == 1), '{"supersedes":"m"}').otherwise(F.col("payload_json"))
    need = F.when((F.col("event_type") == "STORED") & F.get_json_object(payload, "$.supersedes").isNotNull(), "SUPERSEDE")
    known = F.create_map(*[F.lit(x) for k, v in CAPABILITY.items() for x in (k, v)])
    return p.select("subject", "place", F.coalesce(need, known[F.col("event_type")]).alias("capability"))


_STYLE_MEAN = "with " + scalars._STYLE.strip() + """,
k as (select s.*, t.source, row_number() over (partition by t.source order by s.doc_id desc) as r from s join t using (doc_id)),
n as (select source, count(*) as n from k where r <= 10 group by source),
v as (select source, w, sum(x) as x from (select source, doc_id, w, count(*) / total as x from (select source, doc_id, total, unnest(own) as w from k where r <= 10) group by source, doc_id, w, total) group by source, w)
select v.source, v.w as word, round(v.x / n.n, 9) as share from v join n using (source)"""


@registered("AGG-16_style_profile", _STYLE_MEAN)
def style_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean share of each function word over the last ten texts of a source; a text without it counts as 0."""
    last = F.row_number().over(W.partitionBy("source").orderBy(F.desc("doc_id")))
    d = read(spark, sf_dir, "documents").select("source", "doc_id", "text", last.alias("r")).where("r <= 10").withColumn("s", T.style(F.col("text")))
    n = d.groupBy("source").agg(F.count("*").alias("n"))
    words = d.select("source", F.explode("s.words").alias("word", "x")).groupBy("source", "word").agg(F.sum("x").alias("x"))
    return words.join(n, "source").select("source", "word", F.round(F.col("x") / F.col("n"), 9).alias("share"))


@registered("AGG-22_counters", "select 'requests_total{type=\"' || event_type || '\"} ' || count(*) as line from events group by event_type union all select 'requests_value_sum ' || sum(floor(value))::bigint from events union all select 'requests_cached ' || count(*) filter (json_extract_string(props, '$.k')::int % 2 = 0) from events")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals as lines of the text format that monitors read."""
    e = read(spark, sf_dir, "events")
    per = e.groupBy("event_type").agg(F.count("*").alias("n")).select(F.concat(F.lit('requests_total{type="'), "event_type", F.lit('"} '), F.col("n").cast("string")).alias("line"))
    value = e.agg(F.concat(F.lit("requests_value_sum "), F.sum(F.floor("value")).cast("long").cast("string")).alias("line"))
    hit = e.agg(F.concat(F.lit("requests_cached "), F.count_if(F.get_json_object("props", "$.k").cast("int") % 2 == 0).cast("string")).alias("line"))
    return per.unionByName(value).unionByName(hit)


@registered("JOIN-9_bilateral", duck("select decision_id, memory_id, case when (decision_id + substr(memory_id, 2)::bigint) % 13 = 1 then 'NO_EVENT' else 'NO_DECISION' end as code from uses where (decision_id + substr(memory_id, 2)::bigint) % 13 in (1, 2)", scalars.USES))
def bilateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision names its memories and their events name it: what one side tells and the other does not."""
    lines, key = read(spark, sf_dir, "lineitem"), ["decision_id", "memory_id"]
    u = lines.select(F.col("l_orderkey").alias("decision_id"), F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("memory_id"))
    u = spread(u, lines.count(), *key).distinct()  # both sides of the join stay where they are dealt to
    k = (F.col("decision_id") + F.substring("memory_id", 2, 20).cast("long")) % 13
    told, events = u.where(k != 2).withColumn("told", F.lit(True)), u.where(k != 1).withColumn("seen", F.lit(True))
    both = told.join(events, key, "full")
    return both.where("told is null or seen is null").select("decision_id", "memory_id", F.when(F.col("seen").isNull(), "NO_EVENT").otherwise("NO_DECISION").alias("code"))


@registered("JOIN-12_signature_coverage", own("select subject, seq, case when actor % 3 = 0 then 'UNSIGNED' when actor % 3 = 1 then 'NO_KEY' else 'NO_EVENT' end as code from (select subject, seq, actor from chain) where actor % 3 = 0 and seq % 5 = 1 or actor % 3 = 1 and seq % 7 = 2 or actor % 3 = 2 and seq % 11 = 3"))
def signature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of keyed actors without a signature, signatures of actors without a key, and signatures without an event."""
    c = query("select subject, seq, actor from chain")(spark, sf_dir)
    k, n = F.col("actor") % 3, F.col("seq")
    keys = c.where(k == 0).select("actor").distinct().withColumn("keyed", F.lit(True))
    events = c.where(~((k == 2) & (n % 11 == 3))).select("subject", "seq", F.col("actor").alias("by"))
    signed = c.where(((k == 0) & (n % 5 != 1)) | ((k == 1) & (n % 7 == 2)) | ((k == 2) & (n % 11 == 3))).select("subject", "seq", F.col("actor").alias("signer"))
    both = events.join(signed, ["subject", "seq"], "full").withColumn("actor", F.coalesce("by", "signer")).join(keys, "actor", "left")
    code = F.when(F.col("by").isNull(), "NO_EVENT").when(F.col("signer").isNull() & F.col("keyed"), "UNSIGNED").when(F.col("signer").isNotNull() & F.col("keyed").isNull(), "NO_KEY")
    return both.withColumn("code", code).where("code is not null").select("subject", "seq", "code")


_HELD = states._GRANTS + """,
p as (select subject, seq, issuer, capability, at_us from authority where kind = 'GRANTED')
select p.subject, p.seq, case when exists (select 1 from g where 's' || (g.subject % 11) = p.issuer and g.capability = p.capability and g.granted_us < p.at_us and (g.revoked_us is null or g.revoked_us >= p.at_us)) then 'OK' else 'AMPLIFIED' end as code from p"""


@registered("VER-7_authority", states.own(_HELD))
def authority_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each grant against what its issuer (actors by number mod 11) held just before: no capability may come from nowhere.

    One sort of grants, ends and questions by holder, capability and time, and a running count; no join by key.
    """
    a = states.authority(spark, sf_dir)
    g = S.grants(a).withColumn("holder", F.concat(F.lit("s"), (F.col("subject") % 11).cast("string")))
    starts = g.select("holder", "capability", F.col("granted_at").alias("at"), F.lit(1).alias("change"), F.lit(2).alias("order"))
    ends = g.where("revoked_at is not null").select("holder", "capability", F.col("revoked_at").alias("at"), F.lit(-1).alias("change"), F.lit(2).alias("order"))
    asked = a.where("kind = 'GRANTED'").select(F.col("issuer").alias("holder"), "capability", "at", F.lit(0).alias("change"), F.lit(1).alias("order"), "subject", "seq")
    both = asked.unionByName(starts, True).unionByName(ends, True)
    held = F.sum("change").over(W.partitionBy("holder", "capability").orderBy("at", "order").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("held", held).where("seq is not null").select("subject", "seq", F.when(F.col("held") > 0, "OK").otherwise("AMPLIFIED").alias("code"))


@registered("EVT-17_grant_guard", states.own(_HELD.replace("select p.subject, p.seq, case when", "select p.issuer, count(*) filter (not (").replace(" then 'OK' else 'AMPLIFIED' end as code from p", ")) as refused, count(*) as asked from p group by p.issuer")))
def grant_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants that an issuer may not make, by issuer."""
    a = states.authority(spark, sf_dir).where("kind = 'GRANTED'").select("subject", "seq", "issuer")
    return authority_check(spark, sf_dir).join(a, ["subject", "seq"]).groupBy("issuer").agg(F.count_if(F.col("code") == "AMPLIFIED").alias("refused"), F.count("*").alias("asked"))


@registered("VER-8_causality", duck("select decision_id, count(*) as missing from uses where (decision_id + substr(memory_id, 2)::bigint) % 13 = 1 group by decision_id", scalars.USES))
def causality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that used what their receipt does not serve."""
    u = ledger_view(spark, sf_dir, "uses", scalars.USES)
    served = u.where((F.col("decision_id") + F.substring("memory_id", 2, 20).cast("long")) % 13 != 1)
    return u.join(served, ["decision_id", "memory_id"], "left_anti").groupBy("decision_id").agg(F.count("*").alias("missing"))


@registered("VER-9_claims", states.own(states._LAST + " select claim_id, state, case when substr(claim_id, 2)::bigint % 4 = 1 then 'STATE' end as code from last_", True))
def claims_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared states of claims against their replay; every fourth is declared otherwise."""
    c = states.claim_now(spark, sf_dir).withColumn("declared", F.when(F.substring("claim_id", 2, 20).cast("long") % 4 == 1, "SOMETHING").otherwise(F.col("state")))
    return c.select("claim_id", "state", F.when(F.col("declared") != F.col("state"), "STATE").alias("code"))


@registered("VER-10_sweep_seal", duck("f as (select actor, subject from pending where event_type = 'TAINT_FLAGGED') select actor, count(distinct subject) as n, sha256('{\"memory_ids\":[' || string_agg(distinct '\"' || subject || '\"', ',' order by '\"' || subject || '\"') || ']}') as ids_sha256, actor = 'actor-5' as forged from f group by actor", ledger.INPUTS))
def sweep_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set that each actor flagged, derived and sealed again, against the declared seal; one is forged."""
    flagged = ledger.view(spark, sf_dir, "pending").where("event_type = 'TAINT_FLAGGED'")
    sealed = chains.seals(flagged, "actor", "subject")
    declared = F.when(F.col("actor") == "actor-5", F.lit("0" * 64)).otherwise(F.col("ids_sha256"))
    return sealed.select("actor", "n", "ids_sha256", (declared != F.col("ids_sha256")).alias("forged"))


@registered("VER-12_decisions", duck("select decision_id, decision_id % 7 = 3 as edited from uses group by decision_id", scalars.USES))
def decisions_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose seal does not follow from their columns; every seventh had an id added."""
    d = scalars.used(spark, sf_dir).withColumn("record_sha256", C.sha256(C.json_object(scalars.decision_body())))
    d = d.withColumn("used", F.when(F.col("decision_id") % 7 == 3, F.concat("used", F.array(F.lit("zz")))).otherwise(F.col("used")))
    return d.select("decision_id", (C.sha256(C.json_object(scalars.decision_body())) != F.col("record_sha256")).alias("edited"))


@registered("EVT-16_record_decision", duck("select decision_id, memory_id, '{\"causes\":[{\"id\":\"r' || decision_id || '\",\"kind\":\"receipt\"}],\"decision_id\":\"d' || decision_id || '\"}' as payload_json from uses where decision_id % 6 <> 0 and decision_id in (select decision_id from uses group by decision_id having count(*) >= 2)", scalars.USES))
def record_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event for each memory of a decision that may be recorded: at least two used, and every sixth has no receipt."""
    d = scalars.used(spark, sf_dir).where((F.col("decision_id") % 6 != 0) & (F.size("used") >= 2))
    cause = C.json_object({"kind": "receipt", "id": F.concat(F.lit("r"), F.col("decision_id").cast("string"))})
    payload = C.json_object({"decision_id": F.concat(F.lit("d"), F.col("decision_id").cast("string")), "causes": C.Raw(F.concat(F.lit("["), cause, F.lit("]")))})
    return d.select("decision_id", F.explode("used").alias("memory_id"), payload.alias("payload_json"))


@registered("EVT-13_quarantine_actor", duck("""f as (select distinct subject from pending where actor = 'actor-4' and event_type not in ('CONTRADICTED_BY', 'DECISION_USED_MEMORY')), n as (select subject, max(place) + 1 as place from pending group by subject) select n.subject, n.place, 'TAINT_FLAGGED' as event_type from n join f using (subject)""", ledger.INPUTS))
def quarantine_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag for every memory that an actor influenced; records of contradiction and use are no influence."""
    p = ledger.view(spark, sf_dir, "pending")
    hit = p.where((F.col("actor") == "actor-4") & ~F.col("event_type").isin("CONTRADICTED_BY", "DECISION_USED_MEMORY")).select("subject").distinct()
    return p.groupBy("subject").agg((F.max("place") + 1).alias("place")).join(hit, "subject", "left_semi").select("subject", "place", F.lit("TAINT_FLAGGED").alias("event_type"))


@registered("EVT-31_region_taint", duck("""f as (select distinct cast(substr(subject, 2) as bigint) as id from pending where actor = 'actor-4' and event_type <> 'CONTRADICTED_BY'), n as (select to_id as id from links where from_id in (select id from f) union select from_id from links where to_id in (select id from f)) select id, id in (select id from f) as flagged from (select id from f union select id from n)""", ledger.INPUTS))
def region_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other rule: only contradictions are no influence, and neighbours on either side are advised."""
    p = ledger.view(spark, sf_dir, "pending").where("actor = 'actor-4' and event_type <> 'CONTRADICTED_BY'")
    f = p.select(F.substring("subject", 2, 20).cast("long").alias("id")).distinct().withColumn("flagged", F.lit(True))
    l = query("select from_id, to_id from links")(spark, sf_dir)
    out = l.join(f, l["from_id"] == f["id"], "left_semi").select(F.col("to_id").alias("id")).unionByName(l.join(f, l["to_id"] == f["id"], "left_semi").select(F.col("from_id").alias("id"))).distinct()
    return out.join(f, "id", "full").select("id", F.coalesce("flagged", F.lit(False)).alias("flagged"))


@registered("EVT-25_activations", own("select from_id as memory_id, count(*) as recalls, max(at_us) as last_us from proposals group by from_id"))
def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "proposals").groupBy(F.col("from_id").alias("memory_id")).agg(F.count("*").alias("recalls"), F.max("at_us").alias("last_us"))


@registered("EVT-27_emit_signal", own("select memory_id, origin, min(event_id) as id from (select from_id as memory_id, link_type as origin, id as event_id from proposals) p where not exists (select 1 from (select distinct from_id as memory_id, link_type as origin from proposals where to_id = 7) h where h.memory_id = p.memory_id and h.origin = p.origin) group by memory_id, origin"))
def emit_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One live vote for each memory and origin: the first, unless one is pending."""
    p = view(spark, sf_dir, "proposals").select("id", F.col("from_id").alias("memory_id"), F.col("link_type").alias("origin"), "to_id")
    held = p.where("to_id = 7").select("memory_id", "origin").distinct()
    return p.join(held, ["memory_id", "origin"], "left_anti").groupBy("memory_id", "origin").agg(F.min("id").alias("id"))


@registered("EVT-28_create_region", own("select region, min(memory_id) as first, count(*) - 1 as refused from moves where kind = 'MIGRATED' group by region"))
def create_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first request makes a region, later ones find that it exists."""
    return view(spark, sf_dir, "moves").where("kind = 'MIGRATED'").groupBy("region").agg(F.min("memory_id").alias("first"), (F.count("*") - 1).alias("refused"))


@registered("EVT-29_revoke_node", own("h as (select distinct memory_id as node, region from moves where kind = 'STORED' or kind = 'MIGRATED'), k as (select region, count(distinct node) filter (node % 3 <> 0) as left_ from h group by region) select region, left_, left_ = 0 as expires from k"))
def revoke_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a number divisible by 3 are revoked: regions without another holder lose their pending signals."""
    h = view(spark, sf_dir, "moves").where("kind in ('STORED', 'MIGRATED')").select(F.col("memory_id").alias("node"), "region").distinct()
    left = F.count_distinct(F.when(F.col("node") % 3 != 0, F.col("node")))
    return h.groupBy("region").agg(left.alias("left_")).withColumn("expires", F.col("left_") == 0)
