"""Queries of the memory field: rankings, worlds, graphs and finite machines, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions import canonical as C
from chronofold.operators import graph, similarity
from chronofold.operators import recall as R
from chronofold.plans.dialect import query
from chronofold.plans.ledger import duck, registered
from chronofold.plans.ledger import view as ledger_view

INPUTS = """
uses as (select distinct l_orderkey as decision_id, l_partkey as memory_id, o_custkey % 3 as actor from lineitem join orders on o_orderkey = l_orderkey),
derived as (select o_orderkey * 31 % (select max(p_partkey) from part) as memory_id, o_orderkey as decision_id, o_orderkey % 3 as actor from orders where o_orderkey % 97 = 3),
succession as (select p_partkey as old, p_partkey + 1 as new from part where p_partkey % 23 = 0),
machine as (
  select vec_id as state, label % 2 as output, (2 * vec_id) % (select count(*) from embeddings) as next0, (2 * vec_id + 1) % (select count(*) from embeddings) as next1 from embeddings),
weighted as (
  select vec_id as a, 2 * vec_id + 1 as b, 0.5e0 as w from embeddings where 2 * vec_id + 1 < (select count(*) from embeddings)
  union all select vec_id, 3 * vec_id + 2, 0.25e0 from embeddings where 3 * vec_id + 2 < (select count(*) from embeddings)),
resonant as (select distinct from_id as a, to_id as b from links where link_type = 'RESONANT')"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ledger_view(spark, sf_dir, name, INPUTS)


def own(body: str, recursive: bool = False) -> str:
    return duck(body, INPUTS, recursive)


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return query(f"select * from {name}")(spark, sf_dir)


def ranked(spark: SparkSession, sf_dir: str, where: str, k: int, by: str = "dot") -> DataFrame:
    """query_id, memory_id, r, d, ...: the k best of each query among the memories of the condition."""
    m = model(spark, sf_dir, "memories").where(where).withColumn("weight", F.lit(1.0))
    found = similarity.best(m, model(spark, sf_dir, "queries"), k, by)
    return found.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(similarity.key_column(by)), "memory_id")))


_DOTS = "s as (select q.query_id, m.memory_id, m.topic, m.claim, m.custody_status, m.field_state, DOT(q.q, m.v) as d, DOT(m.v, m.v) as nv, DOT(q.q, q.q) as nq, L2SQ(q.q, m.v) as l2 from queries q cross join memories m)"


def _top(where: str, k: int, order: str = "d desc", name: str = "t") -> str:
    return f"{name} as (select * from (select *, row_number() over (partition by query_id order by {order}, memory_id) as r from s where {where}) x where r <= {k})"


@registered("TOP-1_exact_top_k", own(_DOTS + ", " + _top("custody_status = 'CLEAN' and field_state <> 'FORGOTTEN'", 5) + " select query_id, memory_id, r from t"))
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir, "custody_status = 'CLEAN' and field_state <> 'FORGOTTEN'", 5).select("query_id", "memory_id", "r")


@registered("TOP-2_float_top_k", own(_DOTS + ", f as (select *, d / sqrt(nv::double * nq) as c from s where nv > 0), t as (select *, row_number() over (partition by query_id order by case when d > 0 then d::double * d / nv else 0 end desc, memory_id) as r from f) select query_id, memory_id, r, round(greatest(c, 0), 6) as score from t where r <= 8"))
def float_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    cosine = F.col("d") / F.sqrt(F.col("nv").cast("double") * F.col("nq"))
    return ranked(spark, sf_dir, "true", 8, "cosine").select("query_id", "memory_id", "r", F.round(F.greatest(cosine, F.lit(0.0)), 6).alias("score"))


@registered("TOP-4_nearest_by_distance", own(_DOTS + ", " + _top("memory_id <> query_id", 5, "l2") + " select query_id, memory_id, l2 as dist, r from t"))
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked(spark, sf_dir, "true", 6, "near").where("memory_id <> query_id")
    again = found.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("r")))
    return again.where("r <= 5").select("query_id", "memory_id", (F.col("nv") + F.col("nq") - 2 * F.col("d")).alias("dist"), "r")


@registered("VEC-2_exact_dot", own("select l.from_id, l.to_id, l.link_type, DOT(a.v, b.v) as dot from links l join memories a on a.memory_id = l.from_id join memories b on b.memory_id = l.to_id"))
def link_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact product of the two ends of each link."""
    return _linked(spark, sf_dir).select("from_id", "to_id", "link_type", _dot("x", "y").alias("dot"))


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, v: s + v)


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir, "memories")
    l = model(spark, sf_dir, "links").join(m.select(F.col("memory_id").alias("from_id"), F.col("v").alias("x")), "from_id")
    return l.join(m.select(F.col("memory_id").alias("to_id"), F.col("v").alias("y")), "to_id")


@registered("VEC-9_cosine", own("select l.from_id, l.to_id, l.link_type, case when DOT(a.v, a.v) = 0 or DOT(b.v, b.v) = 0 then 0.0 else round(greatest(0.0, DOT(a.v, b.v)::double / sqrt(DOT(a.v, a.v)::double * DOT(b.v, b.v))), 6) end as cosine from links l join memories a on a.memory_id = l.from_id join memories b on b.memory_id = l.to_id"))
def link_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.sqrt(_dot("x", "x").cast("double") * _dot("y", "y"))
    return _linked(spark, sf_dir).select("from_id", "to_id", "link_type", F.when(n == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), _dot("x", "y") / n), 6)).alias("cosine"))


@registered("VEC-4_exact_recall", own(_DOTS + ", c as (select *, case when field_state = 'REINFORCED' then 1.5 else 1.0 end as w from s where custody_status = 'CLEAN' and field_state <> 'FORGOTTEN' and nv > 0), t as (select *, row_number() over (partition by query_id order by case when d > 0 then (d * w)::double * (d * w) / nv else 0 end desc, memory_id) as rank from c) select query_id, memory_id, rank, case when d > 0 then round((d * w)::double / sqrt(nv::double * nq), 6) else 0.0 end as score from t where rank <= 5"))
def plain_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall over a field without links."""
    links = model(spark, sf_dir, "links").limit(0)
    from_seed = R.recall(model(spark, sf_dir, "memories"), links, model(spark, sf_dir, "queries"))
    return from_seed.select("query_id", "memory_id", "rank", "score")


@registered("VEC-10_region_search", own(_DOTS + ", x as (select s.*, q.topic as region from s join memories q on q.memory_id = s.query_id), t as (select *, row_number() over (partition by query_id order by l2, memory_id) as r from x where topic = region and custody_status = 'CLEAN') select memory_id, count(*) as recalls, bool_or(field_state = 'FORGOTTEN') as rediscovered from t where r <= 3 group by memory_id"))
def region_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest CLEAN memories of each query's own region, with what the search leaves behind: recalls, and orphans found again."""
    m = model(spark, sf_dir, "memories").where("custody_status = 'CLEAN'").withColumn("weight", F.lit(1.0))
    q = model(spark, sf_dir, "queries").join(model(spark, sf_dir, "memories").select(F.col("memory_id").alias("query_id"), "topic"), "query_id")
    found = None
    for (topic,) in sorted(q.select("topic").distinct().collect()):  # the regions of a stated query set
        part = similarity.best(m.where(F.col("topic") == topic), q.where(F.col("topic") == topic), 3, "near")
        found = part if found is None else found.unionByName(part)
    return found.join(m.select("memory_id", "field_state"), "memory_id").groupBy("memory_id").agg(F.count("*").alias("recalls"), F.bool_or(F.col("field_state") == "FORGOTTEN").alias("rediscovered"))


def world_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id, memory_id, change between two worlds' rankings (query_id, memory_id, r)."""
    x, y = a.select("query_id", "memory_id", F.col("r").alias("ra")), b.select("query_id", "memory_id", F.col("r").alias("rb"))
    both = x.join(y, ["query_id", "memory_id"], "full")
    return both.where(~F.col("ra").eqNullSafe(F.col("rb"))).select("query_id", "memory_id", F.when(F.col("rb").isNull(), "removed").when(F.col("ra").isNull(), "entered").otherwise("rank_changed").alias("change"))


def _diff(a: str, b: str, k: int = 10) -> str:
    return own(_DOTS + ", " + _top(a, k, name="a") + ", " + _top(b, k, name="b") + " select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.memory_id, b.memory_id) as memory_id, case when b.r is null then 'removed' when a.r is null then 'entered' else 'rank_changed' end as change from a full join b on a.query_id = b.query_id and a.memory_id = b.memory_id where a.r is distinct from b.r")


LIVE, CLEAN = "field_state <> 'FORGOTTEN'", "custody_status = 'CLEAN' and field_state <> 'FORGOTTEN'"


@registered("SET-3_world_diff", _diff(LIVE, CLEAN))
def live_against_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world_diff(ranked(spark, sf_dir, LIVE, 10), ranked(spark, sf_dir, CLEAN, 10))


@registered("SET-4_excision_diff", _diff(CLEAN, CLEAN + " and memory_id % 3 <> 1"))
def excision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the top changes by, had a third of the memories not been stored."""
    return world_diff(ranked(spark, sf_dir, CLEAN, 10), ranked(spark, sf_dir, CLEAN + " and memory_id % 3 <> 1", 10))


@registered("GRF-17_containment_effect", _diff("(custody_status = 'CLEAN' or memory_id % 2 = 0) and field_state <> 'FORGOTTEN'", CLEAN))
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantined memories of even id forced CLEAN, against the actual world."""
    return world_diff(ranked(spark, sf_dir, "(custody_status = 'CLEAN' or memory_id % 2 = 0) and field_state <> 'FORGOTTEN'", 10), ranked(spark, sf_dir, CLEAN, 10))


@registered("GRF-18_exclusion_effect", _diff(CLEAN, CLEAN + " and claim <> 1"))
def exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return world_diff(ranked(spark, sf_dir, CLEAN, 10), ranked(spark, sf_dir, CLEAN + " and claim <> 1", 10))


@registered("SET-5_ablation_diff", own(_DOTS + ", " + _top(CLEAN, 6) + " select x.query_id, x.memory_id as ablated, count(*) filter (y.r > x.r) as shifted, min(case when y.r = 6 then y.memory_id end) as entered from t x join t y on y.query_id = x.query_id where x.r <= 5 group by x.query_id, x.memory_id, x.r"))
def ablation_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each served memory: how many ranks its absence shifts, and who enters."""
    t = ranked(spark, sf_dir, CLEAN, 6).select("query_id", "memory_id", "r")
    entered = t.where("r = 6").select("query_id", F.col("memory_id").alias("entered"))
    n = t.groupBy("query_id").agg(F.max("r").alias("n"))
    return t.where("r <= 5").join(n, "query_id").join(entered, "query_id", "left").select("query_id", F.col("memory_id").alias("ablated"), (F.col("n") - F.col("r")).cast("long").alias("shifted"), "entered")


@registered("GRF-11_single_ablation")
def single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the five served of a query taken away, and who enters: the sixth. The SQL is that of ``maintenance``."""
    zero = model(spark, sf_dir, "memories").where("custody_status = 'CLEAN'").where(_dot("v", "v") == 0).orderBy("memory_id").limit(6)  # no length: a product of 0
    best = ranked(spark, sf_dir, "custody_status = 'CLEAN'", 6).select("query_id", "memory_id", "d")
    both = best.unionByName(model(spark, sf_dir, "queries").select("query_id").crossJoin(F.broadcast(zero.select("memory_id", F.lit(0).cast("long").alias("d")))))
    t = both.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("d"), "memory_id"))).where("r <= 6")
    return t.where("r <= 5").select("query_id", F.col("memory_id").alias("removed")).join(t.where("r = 6").select("query_id", F.col("memory_id").alias("entered")), "query_id")


@registered("GRF-12_pairwise_ablation", own(_DOTS + ", " + _top(CLEAN, 7) + " select x.query_id, x.memory_id as a, y.memory_id as b, (select string_agg(z.memory_id::varchar, ',' order by z.r) from t z where z.query_id = x.query_id and z.r <> x.r and z.r <> y.r) as served from t x join t y on y.query_id = x.query_id and x.r < y.r where y.r <= 5"))
def pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the five served: the list without both (a list of seven holds every answer)."""
    t = ranked(spark, sf_dir, CLEAN, 7).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "memory_id"))), lambda x: x["memory_id"]).alias("ids"))
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(1, 6) for j in range(i + 1, 6)])
    t = t.select("query_id", "ids", F.explode(pairs).alias("p"))
    rest = F.filter("ids", lambda x, i: (i + 1 != F.col("p.i")) & (i + 1 != F.col("p.j")))
    return t.select("query_id", F.element_at("ids", F.col("p.i")).alias("a"), F.element_at("ids", F.col("p.j")).alias("b"), F.array_join(F.transform(rest, lambda x: x.cast("string")), ",").alias("served"))


@registered("GRF-13_subset_ablation", own(_DOTS + ", " + _top(CLEAN, 10) + " select query_id, u as draw, string_agg(memory_id::varchar, ',' order by r) as served from (select *, row_number() over (partition by query_id, u order by r) as k from t, range(4) g(u) where (substr(sha256(query_id || ':' || u || ':' || memory_id), 1, 1) >= '8' or r > 5)) x where k <= 5 group by query_id, u"))
def subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four draws a query that ablate about half of the five served, by a keyed hash, and who is served then."""
    t = ranked(spark, sf_dir, CLEAN, 10).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    drawn = F.sha2(F.concat_ws(":", F.col("query_id").cast("string"), F.col("draw").cast("string"), F.col("memory_id").cast("string")).cast("binary"), 256)
    kept = t.where((F.substring(drawn, 1, 1) >= "8") | (F.col("r") > 5)).withColumn("k", F.row_number().over(W.partitionBy("query_id", "draw").orderBy("r"))).where("k <= 5")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "memory_id"))), lambda x: x["memory_id"].cast("string"))
    return kept.groupBy("query_id", "draw").agg(F.array_join(listed, ",").alias("served"))


@registered("GRF-16_intervention", own(_DOTS + ", " + _top(CLEAN, 6) + """ select query_id, sha256('{"entered":' || coalesce(min(case when r = 6 then memory_id end)::varchar, 'null') || ',"query_id":' || query_id || ',"suppressed":' || min(case when r = 1 then memory_id end) || '}') as delta_sha256 from t group by query_id"""))
def intervention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppress the first hit of each query: the sealed difference of both worlds."""
    t = ranked(spark, sf_dir, CLEAN, 6)
    per = t.groupBy("query_id").agg(F.min(F.when(F.col("r") == 1, F.col("memory_id"))).alias("suppressed"), F.min(F.when(F.col("r") == 6, F.col("memory_id"))).alias("entered"))
    n = C.Number
    return per.select("query_id", C.sha256(C.json_object({"query_id": n(F.col("query_id")), "suppressed": n(F.col("suppressed")), "entered": n(F.col("entered"))})).alias("delta_sha256"))


@registered("WIN-14_rank_displacement", own(_DOTS + ", " + _top("true", 50, name="a") + ", " + _top(CLEAN, 50, name="b") + " select a.query_id, sum(abs(a.r - b.r)) as displacement, max(abs(a.r - b.r)) as largest, count(*) as n from a join b on a.query_id = b.query_id and a.memory_id = b.memory_id group by a.query_id"))
def displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = ranked(spark, sf_dir, "true", 50).select("query_id", "memory_id", F.col("r").cast("long").alias("x")), ranked(spark, sf_dir, CLEAN, 50).select("query_id", "memory_id", F.col("r").cast("long").alias("y"))
    far = F.abs(F.col("x") - F.col("y"))
    return a.join(b, ["query_id", "memory_id"]).groupBy("query_id").agg(F.sum(far).alias("displacement"), F.max(far).alias("largest"), F.count("*").alias("n"))


@registered("AGG-21_claim_winner", own(_DOTS + ", " + _top("custody_status = 'CLEAN'", 20) + " select query_id, topic, min_by(claim, r) as claim from t group by query_id, topic"))
def claim_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first claim of each topic in the order of rank."""
    m = model(spark, sf_dir, "memories").select("memory_id", "topic", "claim")
    return ranked(spark, sf_dir, "custody_status = 'CLEAN'", 20).join(m, "memory_id").groupBy("query_id", "topic").agg(F.min_by("claim", "r").alias("claim"))


_KNN = """
n as (select a.memory_id as a, b.memory_id as b, row_number() over (partition by a.memory_id order by L2SQ(a.v, b.v), b.memory_id) as r from memories a join memories b on a.memory_id <> b.memory_id where a.field_state <> 'FORGOTTEN' and b.field_state <> 'FORGOTTEN'),
k as (select a, b from n where r <= 6 union select b, a from n where r <= 6)"""


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b: the six nearest of every active memory, both ways; all memories are the query set, in blocks."""
    m = model(spark, sf_dir, "memories").where(LIVE).withColumn("weight", F.lit(1.0))
    found = similarity.best(m, m.select(F.col("memory_id").alias("query_id"), F.col("v").alias("q")), 7, "near").where("query_id <> memory_id")
    near = found.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(similarity.key_column("near")), "memory_id"))).where("r <= 6")
    return graph.undirected(near.select(F.col("query_id").alias("a"), F.col("memory_id").alias("b")))


@registered("VEC-7_knn_graph", own(_KNN + " select a, b from k"))
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(spark, sf_dir).select("a", "b")


_WALK = "select id, min(hop) as hops from walk group by id"


@registered("GRF-2_hop_distance", own(_KNN + ", e as (select a, b from k union select a, b from resonant union select b, a from resonant), walk as (select cast(1 as bigint) as id, 0 as hop union select e.b, walk.hop + 1 from walk join e on e.a = walk.id where walk.hop < 10), d as (" + _WALK + ") select m.memory_id as id, coalesce(d.hops, -1) as hops from memories m left join d on d.id = m.memory_id", True))
def hop_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops from memory 1 over nearest-neighbour and RESONANT links, ten at most; -1 where none leads there."""
    edges = knn(spark, sf_dir).unionByName(graph.undirected(view(spark, sf_dir, "resonant")))
    reach = graph.hops(spark.createDataFrame([(1,)], "id long"), edges, 10)
    ids = model(spark, sf_dir, "memories").select(F.col("memory_id").alias("id"))
    return ids.join(reach, "id", "left").select("id", F.coalesce("hop", F.lit(-1)).alias("hops"))


@registered("GRF-3_exposure", own("src as (select memory_id as id from memories where memory_id % 97 = 1), walk as (select id, 0 as hop from src union select r.b, w.hop + 1 from walk w join resonant r on r.a = w.id where w.hop < 6) select id, min(hop) as depth, 1.0::double / power(2, min(hop)) as exposure from walk where id not in (select id from src) group by id", True))
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = model(spark, sf_dir, "memories").where("memory_id % 97 = 1").select(F.col("memory_id").alias("id"))
    return graph.exposure(src, view(spark, sf_dir, "resonant"))


_BLAST = """
e as (select 'M' || memory_id as a, 'D' || decision_id as b from uses union select 'D' || decision_id, 'M' || memory_id from derived union select 'M' || old, 'M' || new from succession),
walk as (select 'M17' as id union select e.b from walk join e on e.a = walk.id),
direct as (select distinct 'D' || decision_id as id from uses where memory_id = 17),
sig as (select 'M' || x.memory_id as id, bool_or(x.actor = (select min(u.actor) from uses u where u.decision_id = x.decision_id)) as attested from derived x where 'D' || x.decision_id in (select id from walk) group by x.memory_id)
select case when w.id like 'M%' then 'MEMORY' else 'DECISION' end as kind, substr(w.id, 2)::bigint as id, case when d.id is not null then 'DIRECT' else 'DERIVED' end as level, case when w.id like 'M%' then coalesce(s.attested, true) end as attested
from walk w left join direct d on d.id = w.id left join sig s on s.id = w.id where w.id <> 'M17'
union all select 'MEMORY', memory_id, 'POSSIBLE', null from (select distinct memory_id from uses where 'D' || decision_id in (select id from direct)) p where 'M' || memory_id not in (select id from walk)"""


@registered("GRF-4_blast_radius", own(_BLAST, True))
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.blast_radius(spark.createDataFrame([(17,)], "id long"), view(spark, sf_dir, "uses"), view(spark, sf_dir, "derived"), view(spark, sf_dir, "succession"))


@registered("GRF-10_issuer_closure", own("walk as (select 17 as id union select s.o from walk join (select memory_id as i, decision_id % 41 as o from derived) s on s.i % 41 = walk.id) select id::bigint as id from walk", True))
def issuer_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actors (by number) who issued, directly or through others, what actor 17 holds."""
    issued = view(spark, sf_dir, "derived").select((F.col("memory_id") % 41).alias("a"), (F.col("decision_id") % 41).alias("b"))
    return graph.closure(spark.createDataFrame([(17,)], "id long"), issued)


@registered("GRF-22_reachable_closure", own("walk as (select cast(0 as bigint) as state union select case when i.x = 0 then m.next0 else m.next1 end from walk join machine m on m.state = walk.state cross join (values (0), (1)) i(x)) select state from walk", True))
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that the two inputs reach from state 0."""
    m = view(spark, sf_dir, "machine")
    edges = m.select(F.col("state").alias("a"), F.col("next0").alias("b")).unionByName(m.select(F.col("state").alias("a"), F.col("next1").alias("b")))
    return graph.closure(spark.createDataFrame([(0,)], "id long"), edges).select(F.col("id").alias("state"))


_MOORE = """
base as (select list(state order by state) as ss, list(output order by state) as os, list(next0 order by state) as n0, list(next1 order by state) as n1 from machine),
rounds as (
  select 0 as i, list_transform(os, lambda o: list_position(os, o) - 1) as c, false as last from base
  union all
  select i + 1, d, len(list_distinct(d)) = len(list_distinct(c)) from (
    select i, c, list_transform(k, lambda x: list_position(k, x) - 1) as d from (select i, c, list_transform(ss, lambda s: [c[s + 1], c[n0[s + 1] + 1], c[n1[s + 1] + 1]]) as k from rounds, base where not last)))"""


@registered("GRF-23_partition_refinement", own(_MOORE + ", f as (select c from rounds where last) select s.state, c[s.state + 1]::bigint as colour from f, machine s", True))
def partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.refined(view(spark, sf_dir, "machine"))[0].select("state", "colour")


@registered("GRF-24_distinguishing", own(_MOORE + " select s.state, min(case when r.c[s.state + 1] <> r.c[1] then r.i end)::bigint as length from rounds r, machine s where s.state > 0 group by s.state", True))
def distinguishing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many inputs tell a state from state 0 (none: they are equivalent): the first round that parts them."""
    told, n = graph.refined(view(spark, sf_dir, "machine"))
    zero = told.where("state = 0").select(*[F.col(f"round_{i}").alias(f"z{i}") for i in range(n + 1)])  # one row
    first = F.coalesce(*[F.when(F.col(f"round_{i}") != F.col(f"z{i}"), F.lit(i)) for i in range(n + 1)])
    return told.join(F.broadcast(zero)).where("state > 0").select("state", first.cast("long").alias("length"))


@registered("GRF-25_quotient", own(_MOORE + ", f as (select c from rounds where last), q as (select m.*, c[m.state + 1]::bigint as colour, c[m.next0 + 1]::bigint as c0, c[m.next1 + 1]::bigint as c1 from f, machine m) select colour, count(*) as states, min(output) as output, min(c0) as next0, min(c1) as next1 from q group by colour", True))
def quotient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The machine of the classes."""
    m = view(spark, sf_dir, "machine")
    told = graph.refined(m)[0].select("state", "colour")
    q = m.join(told, "state").join(told.select(F.col("state").alias("next0"), F.col("colour").alias("c0")), "next0").join(told.select(F.col("state").alias("next1"), F.col("colour").alias("c1")), "next1")
    return q.groupBy("colour").agg(F.count("*").alias("states"), F.min("output").alias("output"), F.min("c0").alias("next0"), F.min("c1").alias("next1"))


@registered("GRF-26_congruence", own("select a.output, count(distinct b.output) > 1 as breaks0, count(distinct c.output) > 1 as breaks1 from machine a join machine b on b.state = a.next0 join machine c on c.state = a.next1 group by a.output"))
def congruence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether states of equal output step to states of equal output: where not, equality of output is no congruence."""
    m = view(spark, sf_dir, "machine")
    o = m.select("state", "output")
    q = m.join(o.withColumnsRenamed({"state": "next0", "output": "o0"}), "next0").join(o.withColumnsRenamed({"state": "next1", "output": "o1"}), "next1")
    return q.groupBy("output").agg((F.count_distinct("o0") > 1).alias("breaks0"), (F.count_distinct("o1") > 1).alias("breaks1"))


@registered("GRF-27_dag_propagation", own("p as (select memory_id as id, 1.0::double as x from memories union all select w.b, p.x * w.w from p join weighted w on w.a = p.id) select id, round(sum(x), 6) as total from p group by id", True))
def dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    ones = model(spark, sf_dir, "memories").select(F.col("memory_id").alias("id"), F.lit(1.0).alias("x"))
    return graph.propagated(ones, view(spark, sf_dir, "weighted").withColumn("w", F.col("w").cast("double")), 1 << 20).select("id", F.round("total", 6).alias("total"))


@registered("GRF-28_simple_paths", own("p as (select [1::bigint] as path union all select list_append(path, r.b) from p join resonant r on r.a = path[len(path)] where not list_contains(path, r.b) and len(path) <= 4) select array_to_string(path, '>') as path from p where len(path) > 1", True))
def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.simple_paths(spark.createDataFrame([(1,)], "id long"), view(spark, sf_dir, "resonant"), 4)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@registered("GRF-29_cyclic_fixed_point", own("p as (select memory_id as id, 1.0::double as x, 0 as i from memories union all select r.b, p.x * 0.4, p.i + 1 from p join resonant r on r.a = p.id where p.i < 24) select id, round(sum(x), 5) as total from p group by id", True))
def cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x = 1 + 0.4 W x over the RESONANT links, whose cycles carry less each time round."""
    ones = model(spark, sf_dir, "memories").select(F.col("memory_id").alias("id"), F.lit(1.0).alias("x"))
    edges = view(spark, sf_dir, "resonant").withColumn("w", F.lit(0.4))
    return graph.propagated(ones, edges, 60, 1e-9).select("id", F.round("total", 5).alias("total"))
