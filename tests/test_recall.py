"""Recall against a plain version in exact fractions, on fixed cases and random fields."""

import datetime
import hashlib
import json
import random
from fractions import Fraction as Fr

import pytest

from chronofold.operators import recall as R

MEM, LINK, QUERY = "memory_id long, custody_status string, field_state string, v array<long>", "from_id long, to_id long, link_type string, created_at timestamp", "query_id long, q array<long>"
BOOST = {"REINFORCED": Fr(3, 2), "NEUTRAL": Fr(1), "FORGOTTEN": Fr(0)}
T0 = datetime.datetime(2024, 1, 1)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def brute(mem, links, q, k, hops):
    """[(id, hop, rescued)], seed, inhibited neutral candidates."""
    info = {m[0]: m for m in mem if m[1] == "CLEAN"}
    cand = {i: (dot(q, m[3]), dot(m[3], m[3])) for i, m in info.items() if m[2] != "FORGOTTEN" and any(m[3])}
    if not cand:
        return [], None, 0
    seed = min(cand, key=lambda i: (-(Fr(cand[i][0] ** 2, cand[i][1]) if cand[i][0] > 0 else 0), i))
    hop, inhibited, boost, frontier = {}, set(), {}, {seed}
    for depth in range(min(hops, 10) + 1):
        following = set()
        for n in sorted(frontier):
            if n in inhibited or n in hop:
                continue
            hop[n] = depth
            for a, b, kind, *_ in links:
                if a == n and b in info:
                    if kind == "INHIBITORY":
                        inhibited.add(b)
                    else:
                        following.add(b)
                        boost[b] = boost.get(b, Fr(0)) + Fr(1, 2)
        frontier = following - set(hop) - inhibited
    out, left_out = [], 0
    for i, (d, n) in cand.items():
        held = i in inhibited and i != seed
        if held and info[i][2] != "REINFORCED":
            left_out += 1
            continue
        t = d * (BOOST[info[i][2]] * (Fr(43, 50) ** hop[i] if i in hop else 1) + boost.get(i, 0))
        out.append((-(t * t / n if t > 0 else Fr(0)), i, hop.get(i, -1), held))
    return [x[1:] for x in sorted(out)[:k]], seed, left_out


def told(spark, mem, links, queries, **how):
    args = spark.createDataFrame(mem, MEM), spark.createDataFrame([(*x, T0)[:4] for x in links], LINK), spark.createDataFrame(queries, QUERY)
    by: dict = {}
    for r in R.recall(*args, **how).collect():
        by.setdefault(r.query_id, []).append(r)
    return {q: sorted(rows, key=lambda r: r.rank) for q, rows in by.items()}


def test_ranking_of_five(spark):
    v = {1: [100, 0, 0], 2: [90, 10, 0], 3: [0, 100, 0], 4: [-100, 0, 0], 5: [70, 70, 0]}
    got = told(spark, [(i, "CLEAN", "NEUTRAL", x) for i, x in v.items()], [], [(0, [100, 5, 0])])[0]
    assert [r.memory_id for r in got] == [1, 2, 5, 3, 4] and got[-1].score == 0.0 and {r.hop for r in got} == {-1, 0}


def test_an_inhibited_memory_gets_no_hop(spark):
    mem = [(1, "CLEAN", "NEUTRAL", [100, 0]), (2, "CLEAN", "NEUTRAL", [60, 80]), (3, "CLEAN", "REINFORCED", [77, 64])]
    got = {r.memory_id: r for r in told(spark, mem, [(1, 2, "RESONANT"), (1, 3, "RESONANT"), (2, 3, "INHIBITORY")], [(0, [100, 0])])[0]}
    assert got[3].hop == -1 and got[3].rescued and got[3].score == pytest.approx(2 * 77 / (77**2 + 64**2) ** 0.5, abs=1e-6)


@pytest.mark.parametrize("seed", [0, 1, 3])
def test_random_fields(spark, seed):
    rng = random.Random(seed)
    n, hops, k = 14, seed, 4 + seed
    state = lambda: rng.choice(["NEUTRAL"] * 5 + ["REINFORCED"] * 2 + ["FORGOTTEN"])
    mem = [(i, rng.choice(["CLEAN"] * 6 + ["QUARANTINED", "TAINT_FLAGGED"]), state(), [rng.randrange(-9, 10) for _ in range(3)]) for i in range(n)]
    links = [(a, b, rng.choice(["RESONANT", "RESONANT", "INHIBITORY"])) for a, b in {(rng.randrange(n), rng.randrange(n)) for _ in range(40)} if a != b]
    queries = [(j, [rng.randrange(-9, 10) for _ in range(3)]) for j in range(5)]
    got = told(spark, mem, links, queries, top_k=k, hops=hops)
    for j, q in queries:
        assert [(r.memory_id, r.hop, r.rescued) for r in got.get(j, [])] == brute(mem, links, q, k, hops)[0]


def test_override_time_travel_and_receipts(spark):
    mem = [(1, "QUARANTINED", "NEUTRAL", [9, 1]), (2, "CLEAN", "NEUTRAL", [8, 3]), (3, "CLEAN", "FORGOTTEN", [9, 2]), (4, "CLEAN", "NEUTRAL", [1, 9])]
    late = datetime.datetime(2024, 6, 1)
    links = [(2, 4, "INHIBITORY", T0), (4, 2, "RESONANT", late)]
    m, x, q = spark.createDataFrame(mem, MEM), spark.createDataFrame(links, LINK), spark.createDataFrame([(7, [9, 1])], QUERY)
    assert [r.memory_id for r in R.recall(m, x, q, override={1: "CLEAN"}).orderBy("rank").collect()][0] == 1
    assert [r.memory_id for r in R.recall(m, x, q).orderBy("rank").collect()] == [2]
    r = R.receipts(m, x, q, override={2: "QUARANTINED"}).first()
    body = {"query_sha256": hashlib.sha256(b"[9,1]").hexdigest(), "seed_memory_id": "4", "served": ["4"], "excluded_custody": 2, "excluded_forgotten": 1, "excluded_inhibited": 0, "top_k": 5, "hops": 2, "ranking_protocol": "1.0.0", "custody_override": [["2", "QUARANTINED"]], "as_of": None}
    assert r.receipt_sha256 == hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    one = R.receipts(m, x, q).first()
    assert (one.seed_memory_id, one.served, one.excluded_custody, one.excluded_forgotten, one.excluded_inhibited) == (2, ["2"], 1, 1, 1)
    assert R.recall(m, x, q, at=datetime.datetime(2023, 1, 1)).count() == 2


def test_time_travel_replays_status_and_state(spark):
    """A memory forgotten later was there; one promoted later was not yet; today's columns tell nothing."""
    day = lambda i: datetime.datetime(2024, 1, 1 + i)
    rows = [(1, 0, "STORED", None, day(0)), (1, 1, "STATE_CHANGED", "FORGOTTEN", day(9)), (2, 0, "STORED", None, day(0)), (2, 1, "REINFORCED", None, day(8)), (2, 2, "STATE_CHANGED", "REINFORCED", day(8)), (3, 0, "STORED", None, day(0)), (3, 1, "TAINT_FLAGGED", None, day(1)), (3, 2, "REHABILITATED", None, day(7)), (4, 0, "STORED", None, day(6))]
    kinds = "memory_id long, seq long, kind string, to string, created_at timestamp"
    chain = spark.createDataFrame(rows, kinds)
    m = spark.createDataFrame([(1, "CLEAN", "FORGOTTEN", [9, 1]), (2, "CLEAN", "REINFORCED", [8, 3]), (3, "CLEAN", "NEUTRAL", [9, 2]), (4, "CLEAN", "NEUTRAL", [9, 1])], MEM)
    then = {r.memory_id: (r.custody_status, r.field_state) for r in R.as_of(m, chain, day(5)).collect()}
    assert then == {1: ("CLEAN", "NEUTRAL"), 2: ("CLEAN", "NEUTRAL"), 3: ("TAINT_FLAGGED", "NEUTRAL")}
    now = {r.memory_id: (r.custody_status, r.field_state) for r in R.as_of(m, chain, day(20)).collect()}
    assert now == {1: ("CLEAN", "FORGOTTEN"), 2: ("CLEAN", "REINFORCED"), 3: ("CLEAN", "NEUTRAL"), 4: ("CLEAN", "NEUTRAL")}
    q, none = spark.createDataFrame([(7, [9, 1])], QUERY), spark.createDataFrame([], LINK)
    assert [r.memory_id for r in R.recall(R.as_of(m, chain, day(5)), none, q, at=day(5)).orderBy("rank").collect()] == [1, 2]
    for bad in [(5, 1, "QUARANTINED", None, day(0)), (1, 2, "STORED", None, day(10)), (2, 3, "REHABILITATED", None, day(9))]:
        with pytest.raises(Exception, match="chain|replay"):
            R.as_of(m, chain.unionByName(spark.createDataFrame([bad], kinds)), day(20)).collect()


def test_many_touched_memories_do_not_shorten_the_list(spark):
    mem = [(i, "CLEAN", "NEUTRAL", [100, i]) for i in range(120)]
    links = [(0, i, "INHIBITORY") for i in range(1, 90)]
    got = told(spark, mem, links, [(0, [100, 0])], top_k=6)[0]
    assert [r.memory_id for r in got] == [0, 90, 91, 92, 93, 94]
