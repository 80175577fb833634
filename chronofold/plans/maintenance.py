"""Maintenance, write-path views, integrity checks and experiment statistics."""

BODIES = {
    "EVT-10_forget": "select memory_id, field_state as state_from, 'FORGOTTEN' as state_to from memories where field_state <> 'FORGOTTEN' and memory_id % 19 = 0",
    "STR-5_ttl_expiry": "select event_id, user_id from events where MICROS(ts) + 1800000000 <= (select max(MICROS(ts)) from events)",
    "EXP-6_disagreement": """
p as (select a.memory_id as x, b.memory_id as y, a.topic = b.topic as within, a.claim <> b.claim as differ from queries q join memories a on a.memory_id = q.query_id cross join memories b where a.memory_id <> b.memory_id)
select within, count(*) as pairs, sum(case when differ then 1 else 0 end) as disagreements from p group by within""",
    "EXP-8_correlation": "select event_type, round(corr(value, PROP()), 6) as r, count(*) as n from events group by event_type",
    "EXP-9_mean_std": "select event_type, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(stddev_samp(value) / sqrt(count(*)), 6) as sem from events group by event_type",
    "EXP-16_quality": "select quality, toxic, count(*) as n, sum(d.n_chars) as chars from labels l join documents d on l.doc_id = d.doc_id group by quality, toxic",
    "SNK-6_graph_export": "select 'NODE' as kind, memory_id as a, cast(null as bigint) as b, field_state as label from memories union all select 'EDGE', from_id, to_id, link_type from links",
    "GRF-11_single_ablation": """
s as (select q.query_id, m.memory_id, DOT(q.q, m.v) as d from queries q cross join memories m where m.custody_status = 'CLEAN'),
t as (select query_id, memory_id, row_number() over (partition by query_id order by d desc, memory_id) as r from s)
select x.query_id, x.memory_id as removed, y.memory_id as entered from t x join t y on x.query_id = y.query_id and y.r = 6 where x.r <= 5""",
    "GRF-21_resolve_id": """
c as (select o_orderkey as id, 1 as p, 'DECISION' as kind from orders union all select vec_id, 2, 'MEMORY' from embeddings union all select event_id, 3, 'EVENT' from events)
select id, min_by(kind, p) as kind from c group by id""",
}
