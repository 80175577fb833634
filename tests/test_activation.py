"""Agent-side recall against a loop over each query."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chronofold.operators import activation as A

NOW = 1e9


def cosine(a, b):
    d, n = sum(x * y for x, y in zip(a, b, strict=True)), math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return max(-1.0, min(1.0, d / n)) if n else 0.0


def steps(seed, to, near, resonant):
    seen, front, n = {seed}, {seed}, 0
    while front and n < 10:
        n += 1
        front = {b for a in front for b in near.get(a, set()) | {t for t, k in resonant.get(a, []) if k == "RESONANT"}} - seen
        if to in front:
            return n
        seen |= front
    return -1


def plain(mem, near, links, q, k, hops, layer=None, without=(), turn=(), syn=None, tampered=()):
    syn = syn or {}
    state = {m[0]: m for m in mem}
    alive = [m for m in mem if m[1] != "FORGOTTEN" and m[0] not in without and any(m[3])]
    if not alive:
        return [], {}
    seed = min(alive, key=lambda m: (sum((x - y) ** 2 for x, y in zip(m[3], q, strict=True)), m[0]))[0]
    active, inhibited, lifts, hop, front = [], set(), {}, {seed: 0}, {seed}
    for level in range(hops + 1):
        new = set()
        for c in sorted(front):
            if c in inhibited or c in without:
                continue
            active.append(c)
            for t, kind in [(t, "NEAR") for t in near.get(c, ())] + links.get(c, []):
                if t in without:
                    continue
                if kind == "INHIBITORY":
                    inhibited.add(t)
                    continue
                new.add(t)
                hop.setdefault(t, level + 1)
                if kind == "RESONANT":
                    lifts[t] = lifts.get(t, 0) + 0.5
        front = new - set(active) - inhibited - set(without)
    why, active = {}, set(active)
    for t in sorted(inhibited):
        if t in state:
            if state[t][1] == "REINFORCED":
                inhibited.discard(t)
                active.add(t)
            else:
                why[t] = "INHIBITED"
    for t in without:
        if t in state:
            why[t] = "DIRECT_SUPPRESSION"
    scored = []
    for c in active & state.keys():
        _, s, lay, v, last = state[c]
        if layer and lay != layer:
            why[c] = "LAYER_FILTER"
        elif s == "FORGOTTEN":
            why[c] = "STATE_FILTER"
        elif c in inhibited and c != seed:
            why[c] = "INHIBITED"
        elif c in tampered:
            why[c] = "STYLOMETRY"
        else:
            sim, h = cosine(q, v), hop[c] if c in hop else steps(seed, c, near, links)
            score = sim * A.STATE_BOOST[s] * (math.exp(-0.15 * h) if h >= 0 else 1) + lifts.get(c, 0) * min(sim, 1) + 0.3 * sum(syn.get((c, t), 0) for t in turn)
            score += 0.05 * math.exp(-math.log(2) * max(0, NOW - last) / 86400) if last > 0 else 0
            scored.append((max(0.0, score), c, h))
    got = {c for _, c, _ in scored}
    for t in {b for a, b in syn if a in turn} - got:
        w = max(syn.get((a, t), 0) for a in turn)
        if w >= 0.5 and t in state and state[t][1] != "FORGOTTEN" and t not in inhibited and t not in without:
            scored.append((0.3 * w, t, -1))
            why.pop(t, None)
    scored.sort(key=lambda x: (-round(x[0], 9), x[1]))
    for _, c, _ in scored[k:]:
        why[c] = "BELOW_TOP_K"
    served = [(c, h, s) for s, c, h in scored[:k]]
    for c, *_ in served:
        why.pop(c, None)  # an inhibited seed may be served
    for c in set(state) | {999}:
        if c not in why and c not in {x[0] for x in served}:
            why[c] = "NOT_IN_FIELD" if c not in state or state[c][1] == "FORGOTTEN" else "UNREACHABLE"
    return served, why


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_and_reasons_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    n, hops = 26, seed
    mem = [(i, rng.choice(["NEUTRAL"] * 5 + ["REINFORCED"] * 2 + ["FORGOTTEN"]), rng.choice(["semantic", "episodic"]), [rng.randrange(-9, 10) for _ in range(3)], rng.choice([0.0, NOW + 50, NOW - 86400.0 * rng.random() * 3])) for i in range(n)]
    alive = [m[0] for m in mem if m[1] != "FORGOTTEN"]
    pairs = {(a, b) for a in alive for b in rng.sample(alive, 2) if a != b}
    pairs |= {(b, a) for a, b in pairs}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    raw = {(rng.randrange(n), rng.randrange(n)): rng.choice(["RESONANT", "INHIBITORY", "NEUTRAL"]) for _ in range(30)}
    links = {}
    for (a, b), k in raw.items():
        links.setdefault(a, []).append((b, k))
    syn = {(rng.randrange(n), rng.randrange(n)): rng.choice([0.2, 0.5, 0.9]) for _ in range(25)}
    turn, tampered = rng.sample(range(n), 3), rng.sample(range(n), 3)
    queries = [(j, [rng.randrange(-9, 10) for _ in range(3)], rng.choice([None, None, "semantic"]), rng.sample(range(n), rng.choice([0, 0, 2]))) for j in range(6)]
    frames = [spark.createDataFrame(*x) for x in ((mem, "memory_id long, field_state string, layer string, v array<long>, last_activation double"), (sorted(pairs), "a long, b long"), ([(a, b, k) for (a, b), k in raw.items()], "from_id long, to_id long, link_type string"), (queries, "query_id long, q array<long>, layer string, without array<long>"))]
    t = spark.createDataFrame([(j, x) for j, *_ in queries for x in turn], "query_id long, memory_id long")
    out = A.recall(*frames, NOW, 4, hops, t, spark.createDataFrame([(a, b, w) for (a, b), w in syn.items()], "from_id long, to_id long, weight double"), spark.createDataFrame([(x,) for x in tampered], "memory_id long"))
    hits, why = {}, {}
    for r in out.hits.orderBy("rank").collect():
        hits.setdefault(r.query_id, []).append((r.memory_id, r.hop, r.score))
    asked = spark.createDataFrame([(j, c) for j, *_ in queries for c in [*range(n), 999]], "query_id long, memory_id long")
    for r in A.absences(out, frames[0], asked).collect():
        if r.reason:
            why.setdefault(r.query_id, {})[r.memory_id] = r.reason
    for j, q, layer, without in queries:
        served, reasons = plain(mem, near, links, q, 4, hops, layer, without, turn, syn, tampered)
        assert [x[:2] for x in hits.get(j, [])] == [x[:2] for x in served]
        assert [x[2] for x in hits.get(j, [])] == pytest.approx([x[2] for x in served], abs=1e-9)
        assert why.get(j, {}) == reasons
    used, learned = A.effects(out, NOW, t)
    assert used.where(F.col("last_activation") == NOW).count() == len({c for x in hits.values() for c, *_ in x}) and learned.count() == 6 + len(hits)
