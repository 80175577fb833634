"""Vector and graph queries: exact recall, neighbour graphs, closures and exposure."""

BODIES = {
    "VEC-1_quantize": "select memory_id, SHA(LISTTEXT(v)) as vector_sha256 from memories",
    "VEC-19_int8": "select vec_id, LISTTEXT(CLIP8(embedding)) as q8 from embeddings",
    "VEC-21_merge_weights": """
w as (select topic, memory_id, case when field_state = 'REINFORCED' then 3 else 1 end as w from memories)
select topic, sum(w) as weight, min_by(memory_id, -1000000 * w + memory_id) as head from w group by topic""",
}
