"""Queries of sources and sinks, changefeeds and experiments, with SQL of their own where SQL can tell them."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions import canonical as C
from chronofold.operators import agent, consolidation, spectral
from chronofold.operators import experiments as X
from chronofold.plans import ledger, scalars
from chronofold.plans.dialect import query
from chronofold.plans.ledger import duck, registered
from chronofold.plans.ledger import view as ledger_view
from chronofold.sources import bundle, portable, vault
from chronofold.storage import written
from chronofold.streaming import changefeed

INPUTS = """
feed as (
  select user_id as batch, event_id, event_type, row_number() over (partition by user_id order by event_id) - 1 as place,
         case event_type when 'click' then '{"after":{"memory_id":"m' || STR(event_id % 3) || '","origin_region":"r1","status":"PENDING"}}'
              when 'view' then '{"after":{"memory_id":"m' || STR(event_id % 3) || '","origin_region":"r2","status":"ACCEPTED"}}'
              when 'error' then '{"after":{"origin_region":"r1"}}' when 'purchase' then '{"key":["k"]}' else '{"after":{"memory_id":"m' || STR(event_id % 2) || '","origin_region":"r3","status":"PENDING"}}' end as image
  from events),
trials as (
  select event_id, user_id as run, row_number() over (partition by user_id order by ts, event_id) as step, event_type, value, PROP() as k, PROP() % 2 as a, event_id % 2 as b from events)"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ledger_view(spark, sf_dir, name, INPUTS)


def own(body: str, recursive: bool = False) -> str:
    return duck(body, INPUTS, recursive)


@registered("SRC-13_vault_import", duck("t as (select name, lower(trim(unnest(regexp_extract_all(text, '\\[\\[([^\\]|#]+)(?:#[^\\]|]*)?(?:\\|[^\\]]*)?\\]\\]', 1)))) as key from notes) select distinct t.name as from_name, n.name as to_name, 'RESONANT' as link_type from t join notes n on lower(n.name) = t.key where lower(t.name) <> t.key", scalars.NOTES))
def vault_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of notes made of the documents (files are read by sources.vault)."""
    return vault.imported(ledger_view(spark, sf_dir, "notes", scalars.NOTES))[1]


def field(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    m = query("select memory_id, field_state as state from memories")(spark, sf_dir)
    return {
        "memory": m.select("memory_id", F.concat(F.lit("content é \"q\" "), F.col("memory_id").cast("string")).alias("content"), "state", F.unhex(F.sha2(F.col("memory_id").cast("string").cast("binary"), 256)).alias("embedding")),
        "link": query("select from_id, to_id, link_type from links")(spark, sf_dir),
    }


@registered("SNK-1_jsonl_export", duck("""select kind, count(*) as n, sha256(string_agg(line, chr(10) order by key)) as lines_sha256 from (
select 'memory' as kind, lpad(memory_id::varchar, 20, '0') || '/content é "q" ' || memory_id as key, '{"kind":"memory","memory_id":' || memory_id || ',"content":"content é \\"q\\" ' || memory_id || '","state":"' || field_state || '","embedding":"' || to_base64(unhex(sha256(memory_id::varchar))) || '"}' as line from memories
union all select 'link', lpad(from_id::varchar, 20, '0') || '/' || lpad(to_id::varchar, 20, '0') || link_type, '{"kind":"link","from_id":' || from_id || ',"to_id":' || to_id || ',"link_type":"' || link_type || '"}' from links) x group by kind""", "dummy as (select 1 as one)"))
def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines by kind: their number, and the hash of all of them in order."""
    told = portable.lines(field(spark, sf_dir)).where("rank > 0").withColumn("kind", F.when(F.col("rank") == 1, "memory").otherwise("link"))
    link_type = F.coalesce(F.get_json_object("line", "$.link_type"), F.lit(""))
    per = told.groupBy("kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("key", link_type.alias("t"), "line"))).alias("x"))  # a digest of the whole for the check
    return per.select("kind", "n", C.sha256(F.array_join(F.transform("x", lambda v: v["line"]), "\n")).alias("lines_sha256"))


@registered("SRC-14_jsonl_import", duck("select 'memory' as kind, count(*) as n, sum(memory_id)::bigint as s from memories union all select 'link', count(*), sum(from_id * 3 + to_id)::bigint from links", "dummy as (select 1 as one)"))
def import_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes back of the exported lines."""
    t = portable.parsed(portable.lines(field(spark, sf_dir)).select(F.col("line").alias("value")))
    m = t["memory"].agg(F.lit("memory").alias("kind"), F.count("*").alias("n"), F.sum("memory_id").alias("s"))
    return m.unionByName(t["link"].agg(F.lit("link").alias("kind"), F.count("*").alias("n"), F.sum(F.col("from_id") * 3 + F.col("to_id")).alias("s")))


@registered("SET-7_included", duck("select decision_id, bool_and(substr(memory_id, 2)::bigint % 10 <> 3) as included from uses group by decision_id", scalars.USES))
def included(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = ledger_view(spark, sf_dir, "uses", scalars.USES)
    return bundle.partitioned(u, u.where(F.substring("memory_id", 2, 20).cast("long") % 10 != 3))


def evidence(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    custody = written(ledger.custody(spark, sf_dir))  # the chains are hashed once, however many checks read them
    born = custody.where("seq = 0").select(F.col("subject").alias("memory_id"), F.concat(F.lit("content "), F.substring("subject", 2, 20)).alias("content"))
    strong = F.max(F.when(F.col("event_type").isin("QUARANTINED", "REHABILITATED"), F.struct("seq", "event_type")))
    per = custody.groupBy(F.col("subject").alias("memory_id")).agg(strong.alias("s"), F.max(F.when(F.col("event_type") == "TAINT_FLAGGED", F.col("seq"))).alias("t"))
    status = F.when(F.col("s.event_type") == "QUARANTINED", "QUARANTINED").when(F.col("t") > F.coalesce("s.seq", F.lit(-1)), "TAINT_FLAGGED").otherwise("CLEAN")
    return {"custody": custody, "memories": written(born.join(per.select("memory_id", status.alias("custody_status")), "memory_id"))}


def _statuses(events: str) -> str:
    """SQL: the replayed status of each subject of a table of events (subject, seq, event_type), fold by fold."""
    return f"""(select subject, case max_by(event_type, seq) filter (event_type in ('QUARANTINED', 'SUPERSEDED_BY', 'REHABILITATED')) when 'QUARANTINED' then 'QUARANTINED' when 'SUPERSEDED_BY' then 'SUPERSEDED'
      else case when max(seq) filter (event_type = 'TAINT_FLAGGED') > coalesce(max(seq) filter (event_type in ('QUARANTINED', 'SUPERSEDED_BY', 'REHABILITATED')), -1) then 'TAINT_FLAGGED' else 'CLEAN' end end as status from {events} group by subject)"""


def _root(rows: str, section: str) -> str:
    """SQL: the tree over the canonical rows of a section, pair by pair."""
    return f"""
{section}_tree as (
  select 0 as level, list(sha256(row_) order by row_) as nodes from ({rows}) x
  union all
  select level + 1, list_transform(range(0, len(nodes), 2), lambda i: case when i + 1 < len(nodes) then sha256(nodes[i + 1] || nodes[i + 2]) else nodes[i + 1] end) from {section}_tree where len(nodes) > 1)"""


_ROWS = """'{"actor":"' || actor || '","created_at":"' || created_at || '","entry_hash":"' || entry_hash || '","event_type":"' || event_type || '","payload_json":"' || replace(payload_json, '"', '\\"') || '","prev_hash":"' || prev_hash || '","reason":"' || replace(reason, '"', '\\"') || '","seq":' || seq || ',"subject":"' || subject || '"}'"""
_EXPORT = ledger._enveloped(ledger.CHAINED) + f""",
told as (select subject, seq, event_type from rows_),
{_root(f"select {_ROWS} as row_ from rows_", "custody")},
{_root("""select '{"content":"content ' || substr(subject, 2) || '","custody_status":"' || status || '","memory_id":"' || subject || '"}' as row_ from """ + _statuses("told") + " y", "memories")}
select 'custody' as section, nodes[1] as root, (select count(*) from rows_) as n from custody_tree where len(nodes) = 1 union all select 'memories', nodes[1], (select count(distinct subject) from rows_) from memories_tree where len(nodes) = 1"""


@registered("SNK-2_bundle_export", duck(_EXPORT, ledger.INPUTS, True))
def bundle_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections that a manifest seals, with their roots over all rows."""
    sections = evidence(spark, sf_dir)
    told = bundle.manifest(sections)
    out = [(k, told["sections"][k], df.count()) for k, df in sections.items()]
    return spark.createDataFrame(out, "section string, root string, n long")


@registered("VER-0_bundle", duck(f"""s as (select subject, cast(substr(subject, 2) as bigint) as k, count(*) as n from pending group by subject),
ch as (select subject, place as seq, event_type from pending),
dm as (select ch.subject, seq, case when k % 10 = 4 and seq = 3 then 'STORED' when k % 10 = 5 and seq = 0 then 'REINFORCED' when k % 10 = 6 and seq = 3 then 'INVENTED' else event_type end as event_type from ch join s on s.subject = ch.subject where not (k % 10 = 2 and seq = 2))
select 'B1' as check_id, 'custody' as subject, 'ROOT' as code union all select 'B1', 'memories', 'ROOT' union all select 'B0', 'protocols', 'VERSION' union all select 'B1', 'seal', 'SEAL'
union all select 'B2', subject, case when k % 10 = 5 then 'NO_BIRTH' else case k % 10 when 1 then 'TAMPERED' when 2 then 'SEQ_NOT_DENSE' when 3 then 'NOT_LINKED' when 4 then 'SECOND_BIRTH' when 6 then 'UNKNOWN_EVENT' when 7 then 'NOT_CANONICAL' when 8 then 'NOT_JSON' end end from s where k % 10 = 5 or k % 10 between 1 and 8 and n > 3
union all select 'B3', subject, 'CONTENT' from s where k % 6 = 1
union all select 'B4', a.subject, 'STATE' from {_statuses("ch")} a join {_statuses("dm")} b on a.subject = b.subject where a.status <> b.status""", ledger.INPUTS))
def bundle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bundle's checks say after its chains, contents and protocols were tampered with."""
    sections = evidence(spark, sf_dir)
    told = bundle.manifest(sections)
    told = {**told, "protocols": {**told["protocols"], "custody": "9.0.0"}}
    changed = sections["memories"].withColumn("content", F.when(F.substring("memory_id", 2, 20).cast("long") % 6 == 1, "another").otherwise(F.col("content")))
    return bundle.verify(spark, told, {"custody": ledger.damaged(sections["custody"]), "memories": changed}).withColumnRenamed("check", "check_id")


_FEED = "select batch, place, case when event_type in ('click', 'view') then 'm' || event_id % 3 when event_type = 'signup' then 'm' || event_id % 2 end as memory_id, case event_type when 'click' then 'r1' when 'view' then 'r2' when 'error' then 'r1' when 'signup' then 'r3' end as origin_region, case event_type when 'error' then 'MALFORMED' when 'view' then 'IGNORED' when 'purchase' then 'IGNORED' else case when row_number() over (partition by batch, event_type, case event_type when 'click' then event_id % 3 else event_id % 2 end order by place) = 1 then 'ATTEMPT' else 'IGNORED' end end as outcome from feed"


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "feed").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("place", "image"))).alias("x"))  # the images of one delivery
    return f.select("batch", F.concat(F.lit('{"payload":['), F.array_join(F.transform("x", lambda v: v["image"]), ","), F.lit('],"length":'), F.size("x").cast("string"), F.lit("}")).alias("value"))


@registered("STR-1_changefeed", own(_FEED))
def changefeed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.parsed(envelopes(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@registered("STR-2_handler", own("f as (" + _FEED + ") select distinct memory_id, origin_region from f where outcome = 'ATTEMPT'"))
def handled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempt a pair over all deliveries, repeated deliveries included."""
    e = envelopes(spark, sf_dir).select("value", F.lit("2024-01-01").cast("timestamp").alias("at"))
    return changefeed.attempts(e.unionByName(e))


_CASES = """
r as (select 'r' || x as region_id, x <> 3 as active, x = 2 as cooling from range(5) t(x)),
m as (select 'm' || memory_id as memory_id, 'r' || memory_id % 5 as region_id, case when field_state = 'FORGOTTEN' then 'ORPHANED' else 'REGIONAL' end as tier, memory_id % 4 as backing, 4 as live from memories),
p as (select 'm' || memory_id as memory_id, 'r' || (memory_id * 3 + 1) % 6 as origin_region from memories union all select 'none', 'r1')"""


@registered("STR-3_attempts", duck(_CASES + " select p.memory_id, p.origin_region, case when m.tier is null then 'LOOKUP_ERROR' when not coalesce(r.active, false) then 'REGION_UNAVAILABLE' when m.tier = 'ORPHANED' then 'ORPHANED' when m.region_id = p.origin_region then 'ALREADY_THERE' when r.cooling then 'COOLDOWN' when 2 * backing >= live then 'MIGRATED' else 'NOT_REACHED' end as outcome from p left join m using (memory_id) left join r on r.region_id = p.origin_region", "dummy as (select 1 as one)"))
def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = query("select memory_id, field_state from memories")(spark, sf_dir)
    k = F.col("memory_id")
    name = F.concat(F.lit("m"), k.cast("string"))
    told = m.select(name.alias("memory_id"), F.concat(F.lit("r"), (k % 5).cast("string")).alias("region_id"), F.when(F.col("field_state") == "FORGOTTEN", "ORPHANED").otherwise("REGIONAL").alias("tier"), (k % 4).alias("backing"), F.lit(4).alias("live"))
    pairs = m.select(name.alias("memory_id"), F.concat(F.lit("r"), ((k * 3 + 1) % 6).cast("string")).alias("origin_region")).unionByName(spark.createDataFrame([("none", "r1")], "memory_id string, origin_region string"))
    regions = spark.createDataFrame([(f"r{x}", x != 3, x == 2) for x in range(5)], "region_id string, active boolean, cooling boolean")
    return changefeed.classified(pairs, regions, told)


@registered("STR-6_orphans", f"select memory_id, last_seen_us from (select user_id as memory_id, max(epoch_us(ts)) as last_seen_us from events group by user_id) x where last_seen_us <= (select quantile_disc(m, 0.4) from (select max(epoch_us(ts)) as m from events group by user_id)) and memory_id % 7 <> 0 and memory_id % 5 <> 0 order by last_seen_us, memory_id limit 1000")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stalest memories that are neither orphans already nor reinforced, the limit being the sweep's own."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.col("memory_id")
    m = e.groupBy(F.col("user_id").alias("memory_id")).agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_accessed_at"))
    m = m.withColumns({"tier": F.when(k % 7 == 0, "ORPHANED").otherwise("REGIONAL"), "state": F.when(k % 5 == 0, "REINFORCED").otherwise("NEUTRAL"), "last_reinforced_at": F.lit(None).cast("timestamp")})
    cut = m.agg(F.expr("percentile_disc(0.4) within group (order by unix_micros(last_accessed_at))")).first()[0]
    now = F.timestamp_micros(F.lit(int(cut))) + F.make_dt_interval(F.lit(7))
    return changefeed.orphaned(m, now).select("memory_id", F.unix_micros("last_seen").alias("last_seen_us"))


@registered("EXP-2_trajectories", own("a as (select run, step // 5 as step, list_sort(list_distinct(list(event_type) filter (a = 0))) as x, list_sort(list_distinct(list(event_type) filter (b = 0))) as y from trials group by run, step // 5) select run, count(*) as steps, round(avg((coalesce(x, []) <> coalesce(y, []))::int), 9) as sets, round(avg((len(coalesce(x, [])) <> len(coalesce(y, [])))::int), 9) as sizes from a group by run"))
def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two arms of a run serve different sets, by windows of five steps."""
    t = view(spark, sf_dir, "trials").withColumn("step", F.floor(F.col("step") / 5))
    per = t.groupBy("run", "step").agg(F.collect_set(F.when(F.col("a") == 0, F.col("event_type"))).alias("x"), F.collect_set(F.when(F.col("b") == 0, F.col("event_type"))).alias("y"))
    told = X.differing(per.select("run", "step", F.col("x").alias("items")), per.select("run", "step", F.col("y").alias("items")))
    return told.select("run", "steps", F.round("sets", 9).alias("sets"), F.round("sizes", 9).alias("sizes"))


@registered("EXP-3_paired_runs", own("select run, count(*) filter (step between 4 and 8 and a <> b) as during, count(*) filter (step > 8 and a <> b) as washout, min(case when step > 8 and a = b then step end) - 8 as gap from trials group by run"))
def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disagreement of two arms during an intervention (steps 4 to 8) and after it, and how long until they agree again."""
    t, differ, s = view(spark, sf_dir, "trials"), F.col("a") != F.col("b"), F.col("step")
    return t.groupBy("run").agg(F.count_if(s.between(4, 8) & differ).alias("during"), F.count_if((s > 8) & differ).alias("washout"), (F.min(F.when((s > 8) & ~differ, s)) - 8).alias("gap"))


@registered("EXP-4_query_generator", "select g as draw, kind, case kind when 'uniform' then h % n when 'clustered' then (h % 5) * (n // 5) + (h // 5) % 3 else (h % n) * ((h // n) % n) // n end as memory_id from (select g, (select count(*) from embeddings) as n, ('0x' || substr(sha256('seed:' || g), 1, 8))::bigint as h from range(300) t(g)) x, (values ('uniform'), ('clustered'), ('biased')) k(kind)")
def generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hundred draws of each kind by a keyed hash: even, in five clusters, and leaning to small ids."""
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    d = spark.range(300).withColumnRenamed("id", "draw")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("seed:"), F.col("draw").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    d = d.withColumn("h", h).withColumn("kind", F.explode(F.array(*map(F.lit, ("uniform", "clustered", "biased")))))
    return d.select("draw", "kind", F.expr(f"case kind when 'uniform' then h % {n} when 'clustered' then (h % 5) * ({n} div 5) + (h div 5) % 3 else ((h % {n}) * ((h div {n}) % {n})) div {n} end").alias("memory_id"))


@registered("EXP-5_tost", own("select event_type, count(*) as n, round(avg(value - k), 6) as mean, round(stddev_samp(value - k), 6) as sd, round((avg(value - k) + 60) / (stddev_samp(value - k) / sqrt(count(*))), 4) as t_low, round((avg(value - k) - 60) / (stddev_samp(value - k) / sqrt(count(*))), 4) as t_high from trials group by event_type"))
def tost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of both one-sided tests (their p-values are held against known values in the tests)."""
    t = view(spark, sf_dir, "trials").withColumn("x", F.col("value") - F.col("k"))
    se = F.stddev_samp("x") / F.sqrt(F.count("*"))
    return t.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("sd"), F.round((F.avg("x") + 60) / se, 4).alias("t_low"), F.round((F.avg("x") - 60) / se, 4).alias("t_high"))


@registered("EXP-7_ols_interactions", own("m as (select avg(value) filter (a = 0 and b = 0) as y00, avg(value) filter (a = 1 and b = 0) as y10, avg(value) filter (a = 0 and b = 1) as y01, avg(value) filter (a = 1 and b = 1) as y11 from trials) select 'constant' as name, round(y00, 6) as beta from m union all select 'a', round(y10 - y00, 6) from m union all select 'b', round(y01 - y00, 6) from m union all select 'ab', round(y11 - y10 - y01 + y00, 6) from m"))
def ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saturated model with an interaction: its coefficients are differences of cell means, which the SQL takes."""
    t = view(spark, sf_dir, "trials")
    rows = X.regression(t, {"a": F.col("a"), "b": F.col("b"), "ab": F.col("a") * F.col("b")}, F.col("value"))
    return spark.createDataFrame([(r["name"], round(r["beta"], 6)) for r in rows], "name string, beta double")


@registered("EXP-8_partial", own("c as (select event_type, corr(value, k) as a, corr(value, step) as b, corr(k, step) as c from trials group by event_type) select event_type, round(a, 6) as r, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) as partial from c"))
def partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "trials")
    return t.groupBy("event_type").agg(F.round(F.corr("value", "k"), 6).alias("r"), F.round(X.partial_correlation(t, "value", "k", "step"), 6).alias("partial"))


@registered("EXP-12_factorial", own("select a, b, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value) / sqrt(count(*)), 6) as sem from trials group by a, b"))
def factorial(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "trials")
    return t.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value") / F.sqrt(F.count("*")), 6).alias("sem"))


@registered("EXP-13_topology", own("c as (select to_id as id, count(*) as contributors from links where link_type = 'RESONANT' group by to_id), f as (select m.memory_id, coalesce(c.contributors, 0) >= 1 as predicted, m.field_state = 'REINFORCED' as flipped from memories m left join c on c.id = m.memory_id) select round(count(*) filter (predicted and flipped) / count(*) filter (predicted)::double, 6) as precision, round(count(*) filter (predicted and flipped) / count(*) filter (flipped)::double, 6) as recall, count(*) as n from f"))
def topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories with a contributor are predicted to be reinforced."""
    c = query("select to_id as memory_id from links where link_type = 'RESONANT'")(spark, sf_dir).groupBy("memory_id").agg(F.count("*").alias("contributors"))
    m = query("select memory_id, field_state from memories")(spark, sf_dir).join(c, "memory_id", "left")
    told = m.select((F.coalesce("contributors", F.lit(0)) >= 1).alias("predicted"), (F.col("field_state") == "REINFORCED").alias("flipped"))
    return X.predicted(told).select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "n")


@registered("EXP-14_collisions", own("f as (select run, step, a, b, lead(event_type) over (partition by run order by step) as future from trials) select a, b, count(*) as states, count(distinct future) as futures from f where future is not null group by a, b having count(distinct future) > 1"))
def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal projections of a state with different futures."""
    f = view(spark, sf_dir, "trials").withColumn("future", F.lead("event_type").over(W.partitionBy("run").orderBy("step"))).where("future is not null")
    return f.groupBy("a", "b").agg(F.count("*").alias("states"), F.count_distinct("future").alias("futures")).where("futures > 1")


@registered("EXP-15_components", own("f as (select a, b, k % 3 as c, lead(event_type) over (partition by run order by step) as future from trials), g as (select 'a' as left_out, b as x, c as y, future from f union all select 'b', a, c, future from f union all select 'c', a, b, future from f) select left_out, count(*) as groups_, count(*) filter (n > 1) as colliding from (select left_out, x, y, count(distinct future) as n from g where future is not null group by left_out, x, y) h group by left_out"))
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With each component of the state left out: how many groups of equal rests have different futures."""
    f = view(spark, sf_dir, "trials").withColumn("c", F.col("k") % 3).withColumn("future", F.lead("event_type").over(W.partitionBy("run").orderBy("step"))).where("future is not null")
    out = None
    for left in "abc":
        x, y = (c for c in "abc" if c != left)
        n = f.groupBy(x, y).agg(F.count_distinct("future").alias("n")).agg(F.lit(left).alias("left_out"), F.count("*").alias("groups_"), F.count_if(F.col("n") > 1).alias("colliding"))
        out = n if out is None else out.unionByName(n)
    return out


@registered("VER-13_region_heads", duck("select subject, count(*) filter (event_type = 'STORED') = 1 as born_once, max(place) + 1 = count(*) as dense from pending group by subject", ledger.INPUTS))
def region_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two checks kept apart by subject: born once, and dense."""
    c = ledger.custody(spark, sf_dir)
    return c.groupBy("subject").agg((F.count_if(F.col("event_type") == "STORED") == 1).alias("born_once"), (F.max("seq") + 1 == F.count("*")).alias("dense"))




@registered("VEC-17_token_hash", """with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents),
h as (select doc_id, sha256('tok:' || w) as s from t),
c as (select doc_id, ('0x' || substr(s, 1, 8))::bigint % 64 as bucket, sum(case when ('0x' || substr(s, 10, 1))::int % 2 = 1 then 1 else -1 end)::double as x from h group by all)
select doc_id, bucket, round(x / sqrt(sum(x * x) over (partition by doc_id)), 6) as weight from c qualify x <> 0""")
def token_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit vector of each text by the hashes of its tokens, its cells that are not zero."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    v = agent.token_hash(docs.select(F.col("doc_id").alias("id"), "text"))
    cells = v.select(F.col("id").alias("doc_id"), F.posexplode("v").alias("bucket", "weight")).where("weight <> 0")
    return cells.select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round("weight", 6).alias("weight"))


@registered("VEC-3_exact_sqrt", "select event_id, (r // 10000000000)::varchar || '.' || lpad((r % 10000000000)::varchar, 10, '0') as root from (select event_id, case when (f + 1) * (f + 1) <= x then f + 1 when f * f > x then f - 1 else f end as r from (select event_id, event_id::hugeint * 100000000000000000000::hugeint as x, floor(sqrt(event_id::double) * 1e10)::hugeint as f from events))")
def exact_sqrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square roots rounded down at ten digits, by whole numbers."""

    def run(x: pa.Array) -> pa.Array:
        units = [None if v is None else math.isqrt(v * 10**20) for v in x.to_pylist()]
        return pa.array([None if u is None else f"{u // 10**10}.{u % 10**10:010d}" for u in units], pa.string())

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.arrow_udf(run, "string")("event_id").alias("root"))


@registered("VEC-12_pca")
def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modes of the embeddings and the share of the variance (held against a decomposition in the tests)."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("embedding").cast("array<double>").alias("v"))
    b = spectral.basis(v)
    return spark.createDataFrame([(i, [round(float(x), 6) for x in m]) for i, m in enumerate(b.modes)], "mode int, loadings array<double>")


@registered("VEC-13_projection")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", spectral.projected(F.col("v"), spectral.basis(e, most=8)).alias("projection"))


@registered("VEC-14_resonance")
def resonances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cosine of the projections of both ends of each link."""
    p = projection(spark, sf_dir)
    l = query("select from_id, to_id from links")(spark, sf_dir)
    both = l.join(p.select(F.col("vec_id").alias("from_id"), F.col("projection").alias("x")), "from_id").join(p.select(F.col("vec_id").alias("to_id"), F.col("projection").alias("y")), "to_id")
    return both.select("from_id", "to_id", F.round(spectral.resonance(F.col("x"), F.col("y")), 6).alias("resonance"))


@registered("VEC-15_coherence", duck("select from_id, round(count(*) filter (link_type = 'RESONANT') / count(*)::double, 9) as coherence from links group by from_id", "dummy as (select 1 as one)"))
def coherences(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = query("select from_id, link_type from links")(spark, sf_dir)
    return spectral.coherence(l, "from_id").select("from_id", F.round("coherence", 9).alias("coherence"))


@registered("VEC-16_staleness", "select label, abs(count(*) - n0) / n0::double > 0.1 as stale from (select label, vec_id, count(*) filter (vec_id % 8 <> 3) over (partition by label) as n0 from embeddings) x group by label, n0")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a label has grown by over a tenth since seven eighths of its vectors made its basis."""
    n, n0 = F.count("*"), F.count_if(F.col("vec_id") % 8 != 3)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy("label").agg((F.abs(n - n0) / n0 > spectral.STALE).alias("stale"))


@registered("VEC-20_clusters")
def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the memories of each topic (held against plain versions in the tests)."""
    m = query("select memory_id, topic, v from memories")(spark, sf_dir).withColumn("recalls", F.lit(1))
    return consolidation.clusters(m, "topic").select("topic", "memory_id", "head")


@registered("VEC-22_consolidation")
def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories after a run: merged ones with new ids, their sources gone."""
    m = query("select memory_id, topic, v from memories where field_state = 'NEUTRAL'")(spark, sf_dir).withColumn("recalls", (F.col("memory_id") % 4).cast("long"))
    told = consolidation.clusters(m, "topic")
    next_id = m.agg(F.max("memory_id")).first()[0] + 1
    return consolidation.applied(m.select("memory_id", "v", "recalls"), query("select from_id, to_id from links")(spark, sf_dir), told, next_id)[0].select("memory_id", "recalls")
