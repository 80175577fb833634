"""Counterfactuals, graphs, consolidation, spectra, limits and experiments against plain versions."""

import collections
import dataclasses
import datetime
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.operators import agent, consolidation, counterfactual, experiments, graph, spectral, states
from chronofold.operators import recall as R
from chronofold.sources import bundle, portable, vault
from chronofold.streaming import changefeed

T0 = datetime.datetime(2024, 1, 1)
CHAIN = "memory_id long, seq long, kind string, to string, created_at timestamp, caused_by long"


def hour(i):
    return T0 + datetime.timedelta(hours=i)


@pytest.fixture()
def field(spark):
    """1 is promoted by three reinforcements; decision 10 used 1, which reinforced 2 to promotion; decision 11 used 2; 12 used 3."""
    v = {1: [98, 2], 2: [90, 30], 3: [100, 0], 4: [95, 10]}
    memories = spark.createDataFrame([(i, f"memory {i} words here", "CLEAN", "REINFORCED" if i in (1, 2) else "NEUTRAL", x) for i, x in v.items()], "memory_id long, content string, custody_status string, field_state string, v array<long>")
    chain = [(i, 0, "STORED", None, hour(0), None) for i in v] + [(1, k, "REINFORCED", None, hour(k), None) for k in (1, 2, 3)] + [(2, k, "REINFORCED", None, hour(10 + k), 10) for k in (1, 2, 3)]
    decisions = [(10, hour(5), [100, 0], [1], 7), (11, hour(20), [100, 20], [2], 7), (12, hour(21), [100, 0], [3], 8)]
    links = spark.createDataFrame([], "from_id long, to_id long, link_type string, created_at timestamp")
    return agent.Field(memories, links, spark.createDataFrame(chain, CHAIN), spark.createDataFrame(decisions, "decision_id long, created_at timestamp, q array<long>, used array<long>, actor long"), 2, 2)


def test_excision_recomputes_promotion(spark, field):
    got = counterfactual.excised(field.chain, spark.createDataFrame([(1, 2)], "memory_id long, seq long")).first()
    assert (got.field_state, got.confidence) == ("NEUTRAL", 0.71875)
    assert not counterfactual.excised(field.chain, spark.createDataFrame([(1, 0)], "memory_id long, seq long")).count()


def test_a_cascade_kills_what_followed(spark, field):
    dead = spark.createDataFrame([(1, 2), (1, 3)], "memory_id long, seq long")
    events, gone = field.do(dead)
    gone = {r.decision_id for r in gone.collect()}
    assert 10 in gone and 12 not in gone
    assert {(2, 1), (2, 2), (2, 3)} <= {(r.memory_id, r.seq) for r in events.collect()}
    assert field.survives(12, dead) and not field.survives(10, dead)


def test_facade(spark, field):
    q = spark.createDataFrame([(0, [100, 0])], "query_id long, q array<long>")
    assert [r.memory_id for r in field.ask(q).orderBy("rank").collect()] == [1, 2]
    told = spark.createDataFrame([(0, "memory words")], "query_id long, answer string")
    assert {r.memory_id for r in field.decide(q, told).collect()} == {1, 2}
    assert field.ask_at(q, hour(-1)).count() == 0 and field.ask_at(q, hour(1)).count() == 2
    changes = {(r.memory_id, r.change) for r in field.what_if(q, {1: "QUARANTINED"}).collect()}
    assert (1, "removed") in changes and any(c == "entered" for _, c in changes)
    assert (1, "removed") in {(r.memory_id, r.change) for r in field.without(q, spark.createDataFrame([(1, 0)], "memory_id long, seq long")).collect()}
    assert field.receipts(q).first().served == ["1", "2"]
    assert field.provenance(10) == {"id": 10, "kind": "decision", "used": [1]}
    assert field.provenance(2, "direct")["direct"][0].kind == "STORED"
    assert {(r.kind, r.id, r.level) for r in field.provenance(1, "impact")["impact"].collect()} >= {("DECISION", 10, "DIRECT")}
    with pytest.raises(KeyError):
        field.provenance(999)


def test_hops_exposure_and_refinement_equal_loops(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(70)]
    df = spark.createDataFrame(edges, "a long, b long")
    seen, todo = {0: 0}, collections.deque([0])
    while todo:
        x = todo.popleft()
        for a, b in edges:
            if a == x and b not in seen:
                seen[b] = seen[x] + 1
                todo.append(b)
    src = spark.createDataFrame([(0,)], "id long")
    assert {r.id: r.hop for r in graph.hops(src, df, 100).collect()} == seen
    assert {r.id: r.exposure for r in graph.exposure(src, df).collect()} == {k: 0.5**h for k, h in seen.items() if 0 < h <= 6}
    machine = [(s, s % 2, rng.randrange(30), rng.randrange(30)) for s in range(30)]
    told = {r.state: r.colour for r in graph.refined(spark.createDataFrame(machine, "state long, output long, next0 long, next1 long"))[0].collect()}
    colour = {s: o for s, o, _, _ in machine}
    for _ in range(40):
        colour = {s: (colour[s], colour[a], colour[b]) for s, _, a, b in machine}
        names = {c: i for i, c in enumerate(sorted(set(colour.values()), key=repr))}
        colour = {s: names[c] for s, c in colour.items()}
    assert all((told[a] == told[b]) == (colour[a] == colour[b]) for a in told for b in told)


def test_average_linkage_and_merging(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(4)
    x = np.concatenate([centres[i] + 0.05 * rng.normal(size=(5, 4)) for i in range(3)])
    rows = [("s", i, [float(v) for v in r], i % 3) for i, r in enumerate(x)] + [("s", 99, [0.0] * 4, 1)]
    for linkage in (2000, 3):
        told = consolidation.clusters(spark.createDataFrame(rows, "session string, memory_id long, v array<double>, recalls long"), "session", 0.8, linkage).cache()
        assert {r.memory_id: r.head for r in told.collect()} == {**{i: i // 5 * 5 for i in range(15)}, 99: 99}
    for r in consolidation.merged(told).collect():
        w = np.array([max(1, i % 3) for i in range(r.head, r.head + 5)])
        mean = (w[:, None] * x[r.head : r.head + 5]).sum(0)
        assert r.members == 5 and r.weight == w.sum() and np.allclose(r.v, mean / np.linalg.norm(mean))
    memories, links = consolidation.applied(told.select("memory_id", "v", "recalls"), spark.createDataFrame([(0, 99), (99, 99)], "from_id long, to_id long"), told, 100)
    assert {r.memory_id for r in memories.collect()} == {99, 100, 101, 102} and links.count() == 1


def test_modes_equal_a_decomposition(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6)) * [5, 3, 1, 0.1, 0.01, 0.001] + 2
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<double>").repartition(4)
    b = spectral.basis(df)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    k = int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.99) + 1)
    assert b.modes.shape == (k, 6) and np.allclose(np.abs(b.modes @ vt[:k].T), np.eye(k), atol=1e-6)
    p = np.array([r.p for r in df.select(spectral.projected(F.col("v"), b).alias("p")).collect()])
    assert np.allclose(np.linalg.norm(p, axis=1), 1) and spectral.stale(221, b) and not spectral.stale(210, b)


def test_limits_and_caches_equal_loops(spark):
    rng = random.Random(5)
    hits = [(c, sum(rng.randrange(0, 40) for _ in range(i + 1)) * 10**6 // 4, i) for c in range(3) for i in range(30)]
    got = {(r.client, r.id): r.accepted for r in states.limited(spark.createDataFrame(hits, "client long, at long, id long"), 4).collect()}
    for c in range(3):
        log = []
        for _, at, i in sorted((h for h in hits if h[0] == c), key=lambda h: (h[1], h[2])):
            ok = sum(t > at - 60 * 10**6 for t in log) < 4
            log += [at] if ok else []
            assert got[c, i] == ok
    asks = [(0, i * 10**6, i, k, 0, False) for i, k in enumerate("abacabd")]
    got = {r.id: r.hit for r in states.cached(spark.createDataFrame(asks, "session long, at long, id long, key string, generation long, degraded boolean"), 300, 2).collect()}
    assert [got[i] for i in range(7)] == [False, False, True, False, True, False, False]


def test_student_and_equivalence():
    assert experiments.t_cdf(2.0, 10) == pytest.approx(0.963306, abs=1e-6) and experiments.t_cdf(-1.0, 3) == pytest.approx(0.195501, abs=1e-6)
    assert experiments.t_quantile(0.95, 9) == pytest.approx(1.833113, abs=1e-5)
    told = experiments.equivalence(0.1, 1.0, 100, 0.5)
    assert told["equivalent"] and told["p"] == pytest.approx(1 - experiments.t_cdf(4.0, 99), rel=1e-9) and not experiments.equivalence(0.45, 1.0, 100, 0.5)["equivalent"]


def test_regression_equals_least_squares(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + 0.5 * x[:, 0] * x[:, 1] + 0.1 * rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    got = experiments.regression(df, {"a": F.col("a"), "b": F.col("b"), "ab": F.col("a") * F.col("b")}, F.col("y"))
    design = np.column_stack([np.ones(300), x, x[:, 0] * x[:, 1]])
    beta, rest, *_ = np.linalg.lstsq(design, y, rcond=None)
    se = np.sqrt(rest[0] / 296 * np.diag(np.linalg.inv(design.T @ design)))
    assert np.allclose([r["beta"] for r in got], beta) and np.allclose([r["se"] for r in got], se) and got[0]["r2"] == pytest.approx(1 - rest[0] / ((y - y.mean()) ** 2).sum())


def test_notes_from_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "One.md").write_text("---\ntitle: First\ntags: [x, y]\n---\nSee [[two]] and [[ONE]] and [[missing]].\n")
    (tmp_path / "sub" / "Two.md").write_text("Back to [[One#part|label]].\n")
    (tmp_path / "other.txt").write_text("[[One]]")
    memories, links = vault.imported(vault.read_notes(spark, str(tmp_path)))
    assert {(r.name, r.title, tuple(r.tags)) for r in memories.collect()} == {("One", "First", ("x", "y")), ("Two", "Two", ())}
    assert {(r.from_name, r.to_name) for r in links.collect()} == {("One", "Two"), ("Two", "One")}


def test_lines_out_and_in(spark, tmp_path):
    from chronofold.operators import audit

    tables = {
        "memory": spark.createDataFrame([(1, 'a "é"\n', "NEUTRAL", bytearray(b"\x00\xff"))], portable.KINDS["memory"]), "link": spark.createDataFrame([(1, 2, "RESONANT")], portable.KINDS["link"]),
        "audit": audit.append(spark.createDataFrame([(1, 0, "p"), (1, 1, "q")], "log long, seq long, payload string")), "alert": spark.createDataFrame([], portable.KINDS["alert"]),
    }
    portable.write(tables, str(tmp_path / "out"))
    back = portable.read(spark, str(tmp_path / "out"))
    for k, df in tables.items():
        assert sorted(map(str, back[k].collect())) == sorted(map(str, df.select(*back[k].columns).collect()))
    with pytest.raises(ValueError, match="not empty"):
        portable.read(spark, str(tmp_path / "out"), tables["link"])
    with pytest.raises(ValueError, match="unknown kind"):
        portable.parsed(spark.createDataFrame([('{"kind":"x"}',)], "value string"))


def test_a_signature_covers_type_and_payload():
    import base64
    import hashlib
    import hmac

    told = bundle.signed({"a": 1}, lambda m: hmac.new(b"k", m, hashlib.sha256).digest(), "k1")
    assert base64.b64decode(told["signatures"][0]["sig"]) == hmac.new(b"k", b'DSSEv1 27 application/vnd.bundle+json 7 {"a":1}', hashlib.sha256).digest()


def test_a_stream_of_envelopes_attempts_each_pair_once(spark, tmp_path):
    image = lambda m, s="PENDING": '{"after":{"memory_id":"%s","origin_region":"r","status":"%s"}}' % (m, s)  # noqa: E731, UP031
    deliveries = [f'{{"payload":[{image("m1")},{image("m1")},{image("m2", "ACCEPTED")}],"length":3}}', f'{{"payload":[{image("m1")},{image("m3")},{{"key":["k"]}}],"length":3}}', '{"resolved":"1.0"}', "not json"]
    for i, d in enumerate(deliveries):
        (tmp_path / f"{i}.json").write_text(d)
    stream = spark.readStream.option("wholetext", "true").text(str(tmp_path)).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    query = changefeed.attempts(stream).writeStream.format("memory").queryName("attempted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(120)
    assert sorted((r.memory_id, r.origin_region) for r in spark.table("attempted").collect()) == [("m1", "r"), ("m3", "r")]
    rows = changefeed.parsed(spark.createDataFrame([(i, d) for i, d in enumerate(deliveries)], "batch long, value string")).collect()
    assert collections.Counter((r.batch, r.outcome) for r in rows) == {(0, "ATTEMPT"): 1, (0, "IGNORED"): 2, (1, "ATTEMPT"): 2, (1, "IGNORED"): 1, (2, "IGNORED"): 1, (3, "MALFORMED"): 1}


def test_answers_become_decisions_and_reinforce(spark, field):
    """Declared and shown memories are reinforced, declared ones only are used, and what was not served counts for nothing."""
    q = spark.createDataFrame([(0, [100, 0]), (1, [100, 20])], "query_id long, q array<long>")
    served = {(r.query_id, r.memory_id) for r in field.ask(q).collect()}
    told = spark.createDataFrame([(0, "memory 1 words here", [1, 4]), (1, "nothing of that", [1, 2])], "query_id long, answer string, declared array<long>")
    after, events = field.answered(q, told, 9, hour(30))
    got = sorted((r.memory_id, r.seq, r.kind, r.caused_by) for r in events.collect())
    uses = sorted(m for query, m in served if m in ({1, 4} if query == 0 else {1, 2}))
    assert [m for m, _, k, _ in got if k == "DECISION_USED_MEMORY"] == uses and {k for *_, k, _ in got} <= {"DECISION_USED_MEMORY", "REINFORCED"}
    assert (1, 4, "DECISION_USED_MEMORY", 13) in got and (1, 5, "REINFORCED", 13) in got and max(c for *_, c in got) == 14
    made = {r.decision_id: (r.used, r.actor) for r in after.decisions.where("decision_id > 12").collect()}
    assert made[13] == ([m for m in (1, 4) if (0, m) in served], 9) and after.chain.count() == field.chain.count() + len(got)
    assert {(r.kind, r.id, r.level) for r in after.impact(spark.createDataFrame([(1,)], "id long")).collect()} >= {("DECISION", 13, "DIRECT"), ("RECEIPT", 0, "DIRECT")}


def test_promotion_by_answers(spark, field):
    fresh = dataclasses.replace(field, memories=field.memories.where("memory_id in (3, 4)"), decisions=field.decisions.limit(0))
    q = spark.createDataFrame([(i, [100, 0]) for i in range(4)], "query_id long, q array<long>")
    told = spark.createDataFrame([(i, "memory 3 words here", [3]) for i in range(4)], "query_id long, answer string, declared array<long>")
    after, events = fresh.answered(q, told, 9, hour(30))
    kinds = [r.kind for r in events.where("memory_id = 3").orderBy("seq").collect()]
    assert kinds == ["DECISION_USED_MEMORY", "REINFORCED"] * 3 + ["STATE_CHANGED"] + ["DECISION_USED_MEMORY", "REINFORCED"]
    assert {r.memory_id: r.field_state for r in after.memories.collect()}[3] == "REINFORCED"
    assert {r.memory_id: r.field_state for r in R.as_of(after.memories, after.chain, hour(40)).collect()}[3] == "REINFORCED"


def test_impact_tells_descent_and_who_attests(spark, field):
    chain = field.chain.withColumn("actor", F.lit(7)).unionByName(spark.createDataFrame([(5, 0, "STORED", None, hour(22), 10, 7), (6, 0, "STORED", None, hour(22), 10, 8)], CHAIN + ", actor int"))
    memories = field.memories.withColumn("superseded_by", F.when(F.col("memory_id") == 1, F.lit(4).cast("long")))
    links = spark.createDataFrame([(1, 3, "RESONANT", hour(0))], "from_id long, to_id long, link_type string, created_at timestamp")
    f = dataclasses.replace(field, chain=chain, memories=memories, links=links, served=spark.createDataFrame([(70, 1), (70, 2), (71, 3)], "receipt_id long, memory_id long"))
    got = {(r.kind, r.id): (r.level, r.attested) for r in f.impact(spark.createDataFrame([(1,)], "id long")).collect()}
    assert got == {("DECISION", 10): ("DIRECT", None), ("RECEIPT", 70): ("DIRECT", None), ("MEMORY", 4): ("DERIVED", True), ("MEMORY", 5): ("DERIVED", True), ("MEMORY", 6): ("DERIVED", False), ("MEMORY", 2): ("POSSIBLE", None), ("MEMORY", 3): ("POSSIBLE", None)}
    lost = f.evidence_without(f.decisions.where("decision_id = 10").select("decision_id"), spark.createDataFrame([(1, 0)], "memory_id long, seq long")).collect()
    assert [(r.decision_id, r.memory_id, r.still_served) for r in lost] == [(10, 1, False)]


def test_dependence_and_rescue_against_single_worlds(spark):
    """3 hangs on 1 and 2: either lifts it enough alone."""
    from chronofold.operators import ablation

    mem = [(i, "CLEAN", "REINFORCED" if i in (3, 9) else "NEUTRAL", [100 - 3 * i, 10 + 7 * i]) for i in range(1, 12)]
    links = [(1, 2, "RESONANT", T0), (1, 9, "RESONANT", T0), (2, 9, "RESONANT", T0), (1, 7, "RESONANT", T0), (2, 4, "INHIBITORY", T0), (4, 3, "INHIBITORY", T0)]
    m, x = spark.createDataFrame(mem, "memory_id long, custody_status string, field_state string, v array<long>"), spark.createDataFrame(links, "from_id long, to_id long, link_type string, created_at timestamp")
    queries = spark.createDataFrame([(0, [100, 0])], "query_id long, q array<long>")
    world = lambda gone: {r.memory_id for r in R.recall(m, x, queries, 3, 2, {g: "QUARANTINED" for g in gone}).collect()}
    base = world(())
    got = {r.watched: (r.verdict, {tuple(k) for k in r.killers}) for r in ablation.dependence(m, x, queries, spark.createDataFrame([(0, c) for c in sorted(base)], "query_id long, memory_id long"), 3, 2).collect()}
    worlds = {s: world(s) for n in (1, 2) for s in itertools.combinations(sorted(base), n)}
    assert set(got) == base
    for w in base:
        kills = {s for s, served in worlds.items() if w not in s and w not in served}
        least = {s for s in kills if not any(set(t) < set(s) for t in kills)}
        single = sum(len(s) == 1 for s in least)
        assert got[w] == (ablation.NONE if not kills else ablation.SINGLE if single == 1 else ablation.MULTIPLE if single else ablation.REDUNDANT, least)
    for r in ablation.rescue_fuzz(m, x, queries, 2, 4, top_k=3).collect():
        assert r.reason in ("OUTRANKED", "UNREACHABLE") and r.memory_id in base and r.memory_id not in world(tuple(r.suppressed))


def test_seeded_vectors_are_the_generator_s_stream(spark):
    """Against another implementation of the same generator."""
    import hashlib

    texts = ["hello", "é 😀", "hello"]
    got = {r.id: r.v for r in agent.PROVIDERS["seeded-384"](spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    for i, t in enumerate(texts):
        seed = int.from_bytes(hashlib.sha256(t.encode()).digest(), "big")
        words = [seed >> 32 * k & 0xFFFFFFFF for k in range(8)]
        raw = [-1.0 + 2.0 * x for x in np.random.RandomState(np.array(words, np.uint32)).random_sample(384).tolist()]
        norm = math.sqrt(sum(x * x for x in raw))
        assert got[i] == [x / norm for x in raw]
    with pytest.raises(Exception, match="blank"):
        agent.PROVIDERS["seeded-384"](spark.createDataFrame([(1, " ")], "id long, text string")).collect()


def test_token_vectors(spark):
    import hashlib
    import re

    def plain(text):
        v = [0.0] * 64
        for t in re.findall("[a-z0-9]+", text.lower()):
            h = hashlib.sha256(f"tok:{t}".encode()).digest()
            v[int.from_bytes(h[:4], "big") % 64] += 1.0 if h[4] & 1 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n if n else 0.0 for x in v]

    texts = ["Hello, hello world 42", "", "é!"]
    got = {r.id: r.v for r in agent.PROVIDERS["token-hash-64"](spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    assert all(np.allclose(got[i], plain(t)) for i, t in enumerate(texts))
