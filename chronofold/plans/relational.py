"""Scans, filters, joins, aggregates, rankings and set operations over memories, links and event chains."""

BODIES = {
    # scans
    "SRC-2_filtered_scan": "select memory_id, topic, field_state from memories where topic in (1, 2, 3) and field_state = 'NEUTRAL'",
    "SRC-3_point_lookup": "select memory_id, topic, claim, custody_status from memories where memory_id = 42",
    "SRC-4_id_list_fetch": "select memory_id, topic from memories where memory_id in (select o_custkey from orders where o_orderpriority = '1-URGENT')",
    "SRC-5_link_scan": "select from_id, to_id from links where link_type = 'RESONANT'",
    "SRC-6_link_index_scan": "select to_id, count(*) as in_degree, min(from_id) as first_from from links group by to_id",
    "SRC-7_chain_scan": "select subject, seq, kind, event_id, actor from chain",
    "SRC-11_audit_page": "select event_id, user_id, event_type from events order by ts desc, event_id desc limit 50",
    "SRC-12_alert_page": "select event_id, user_id from events where event_type = 'error' order by ts desc, event_id desc limit 30",
    # filters
    "FLT-1_custody_gate": "select memory_id, topic from memories where custody_status = 'CLEAN'",
    "FLT-2_forgotten_filter": "select memory_id, topic from memories where custody_status = 'CLEAN' and field_state <> 'FORGOTTEN'",
    "FLT-3_influence_events": "select subject, seq, kind from chain where kind in ('REINFORCED', 'DECISION_USED_MEMORY')",
    # joins
    "JOIN-3_backlinks": "select l.to_id, m.memory_id as from_id, m.topic, l.link_type from links l join memories m on l.from_id = m.memory_id",
    "JOIN-4_outlinks": "select from_id, to_id, link_type from links",
    "JOIN-5_decisions_with_questions": "select o_orderkey as decision_id, o_custkey as actor, l_partkey as used from orders join lineitem on o_orderkey = l_orderkey where o_orderdate > cast('1996-01-01' as timestamp)",
    "JOIN-8_prior_state": "select subject, seq, lag(kind) over (partition by subject order by seq) as prior_kind, sum(case when kind = 'TAINT_FLAGGED' then 1 else 0 end) over (partition by subject order by seq rows between unbounded preceding and 1 preceding) as prior_taints from chain",
    "JOIN-10_relation_pairs": """
o as (select from_id as a, to_id as b from links where link_type = 'RESONANT')
select x.a, x.b from o x left join o y on x.a = y.b and x.b = y.a where y.a is null""",
    "JOIN-11_dangling": """
refs as (select 'LINK' as kind, to_id + case when to_id % 17 = 0 then 1000000000 else 0 end as id from links union all select 'ORDER', l_orderkey from lineitem where l_linenumber = 1)
select r.kind, r.id from refs r left join memories m on r.kind = 'LINK' and m.memory_id = r.id left join orders o on r.kind = 'ORDER' and o.o_orderkey = r.id where m.memory_id is null and o.o_orderkey is null""",
    "JOIN-13_region_capability": "select c.c_custkey, n.n_name from customer c join nation n on c.c_nationkey = n.n_nationkey where exists (select 1 from supplier s where s.s_nationkey = c.c_nationkey and s.s_acctbal > 0)",
    "JOIN-14_evidence_partition": """
ev as (select l_orderkey as claim_id, l_partkey as memory_id from lineitem)
select coalesce(m.custody_status, 'MISSING') as status, count(*) as n, count(distinct e.claim_id) as claims from ev e left join memories m on m.memory_id = e.memory_id group by 1""",
    # aggregates
    "AGG-1_field_statistics": """
cats as (select 'NEUTRAL' as field_state union all select 'REINFORCED' union all select 'FORGOTTEN' union all select 'TRANSITIONING')
select c.field_state, count(m.memory_id) as n, coalesce(sum(m.claim), 0) as claims, count(distinct m.topic) as topics from cats c left join memories m on m.field_state = c.field_state group by c.field_state""",
    "AGG-2_stability": """
s as (select topic, sum(case when field_state = 'REINFORCED' then 1 else 0 end) as r, sum(case when field_state = 'NEUTRAL' then 1 else 0 end) as n, count(*) as t from memories group by topic)
select topic, case when r + n = 0 then 0.0 else round(cast(1.5 * r / (1.5 * r + n) as double), 4) end as stability, round(cast(r + n as double) / t, 4) as retention from s""",
    "AGG-3_info_counts": "select custody_status, field_state, count(*) as n from memories group by grouping sets ((), (custody_status), (field_state))",
    "AGG-4_embedding_inventory": "select case when lang is null then 'undeclared' else lang end as model, source, count(*) as n from documents group by 1, 2",
    "AGG-5_embedding_drift": "select SHA(text) as input_sha256, count(distinct doc_id) as n, JOINED(STR(doc_id), doc_id) as doc_ids from documents group by SHA(text) having count(distinct doc_id) > 1",
    "AGG-8_root_subjects": "select r.r_name, count(distinct n.n_nationkey) as nations, count(s.s_suppkey) as suppliers from region r left join nation n on n.n_regionkey = r.r_regionkey left join supplier s on s.s_nationkey = n.n_nationkey group by r.r_name",
    "AGG-9_latest_head": "select subject, max(seq) as seq, max_by(event_id, seq) as head, max_by(kind, seq) as kind from chain group by subject",
    "AGG-13_consensus": """
s as (select user_id, event_type, cast(round(value * 1000000) as bigint) as vigor from events where value is not null)
select user_id, sum(case when event_type = 'purchase' then vigor else 0 end) as backing, count(*) as live, sum(case when event_type = 'purchase' then vigor else 0 end) * 2 >= count(*) * 1000000 as resolved from s group by user_id""",
    "AGG-14_resonance_density": "select topic, round(cast(sum(case when field_state = 'REINFORCED' then claim + 1 else 0 end) as double) / count(*), 6) as density from memories group by topic",
    "AGG-15_recall_counts": "select l_partkey as memory_id, count(*) as recalls, count(distinct l_orderkey) as decisions from lineitem group by l_partkey",
    "AGG-19_next_id": "select topic, coalesce(max(memory_id), -1) + 1 as next_id from memories group by topic",
    "WIN-6_custody_status": """
s as (select subject, max(case when kind in ('QUARANTINED', 'REHABILITATED') then seq end) as strong, max(case when kind = 'TAINT_FLAGGED' then seq end) as taint, count(*) as n from chain group by subject)
select s.subject, s.n, case when c.kind = 'QUARANTINED' then 'QUARANTINED' when s.taint is not null and s.taint > coalesce(s.strong, -1) then 'TAINT_FLAGGED' else 'CLEAN' end as status
from s left join chain c on c.subject = s.subject and c.seq = s.strong""",
    "WIN-13_rolling_profile": "select subject, seq, count(*) over w as n, min(seq) over w as first_seq, sum(case when kind = 'REINFORCED' then 1 else 0 end) over w as reinforced from chain window w as (partition by subject order by seq rows between 9 preceding and current row)",
    "WIN-15_adjacency": "select subject, seq from (select subject, seq, kind, lead(kind) over (partition by subject order by seq) as next_kind from chain) c where kind = 'DECISION_USED_MEMORY' and next_kind = 'REINFORCED'",
    "WIN-16_turn_history": "select subject, seq, r from (select subject, seq, row_number() over (partition by subject order by seq desc) as r from chain where kind = 'DECISION_USED_MEMORY') c where r <= 20",
    "WIN-17_window_counts": "select event_id, count(*) over (partition by user_id order by MICROS(ts) range between 3600000000 preceding and 1 preceding) as hits from events",
    # rankings
    "TOP-3_most_recalled": "select l_partkey as memory_id, count(*) as recalls from lineitem group by l_partkey order by recalls desc, memory_id limit 20",
    "TOP-5_stalest_first": "select subject, max(MICROS(ts)) as last_us from chain group by subject order by last_us, subject limit 100",
    "TOP-6_oldest_expiries": "select event_id, MICROS(ts) + 1800000000 as expires_us from events order by expires_us, event_id limit 100",
    "TOP-7_recent_decisions": "select o_orderkey as decision_id, o_custkey as actor from orders order by o_orderdate desc, o_orderkey desc limit 30",
    "TOP-8_chain_head": "select subject, seq, event_id, kind from (select *, row_number() over (partition by subject order by seq desc) as r from chain) c where r = 1",
    # set operations
    "SET-1_undirected_neighbours": """
flagged as (select memory_id from memories where custody_status <> 'CLEAN')
select n from (select to_id as n from links where from_id in (select memory_id from flagged) union select from_id from links where to_id in (select memory_id from flagged)) u where n not in (select memory_id from flagged)""",
    "SET-2_directed_neighbours": """
flagged as (select memory_id from memories where custody_status <> 'CLEAN')
select distinct to_id from links where link_type = 'RESONANT' and from_id in (select memory_id from flagged) and to_id not in (select memory_id from flagged)""",
    "SET-6_trajectory_diff": """
w as (select subject, DIV(seq, 10) as step, JOINED(kind, seq) as path, JOINED(event_type, seq) as other from chain group by subject, DIV(seq, 10))
select step, sum(case when path <> other then 1 else 0 end) as differing, count(*) as n from w group by step""",
}
