"""The toxicity model learns from all rows, and its voters are those of the plain greedy choice."""

import random

from chronofold.llm import toxicity


def test_every_labelled_row_teaches(spark):
    """A word of a few toxic rows only becomes a voter, though there are more labelled rows than any bound there was."""
    n = 9000
    rows = [(i, f"plain words about {i % 97} gardens" + (" you zorblax now" if i % 300 == 1 else "")) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 300 == 1)) for i in range(n)], "doc_id long, toxic int")
    seen, voters = [], toxicity._voters
    toxicity._voters = lambda d: seen.append(d.count()) or voters(d)
    try:
        model = toxicity.fit(docs, labels)
    finally:
        toxicity._voters = voters
    assert seen == [docs.where(~toxicity.held_out(toxicity.F.col("doc_id"))).count()] and seen[0] > 6000
    assert any("zorblax".startswith(v) for v in model.voters)
    got = {r.predicted for r in toxicity.score(docs.where("doc_id % 300 = 1"), model).collect()}
    assert got == {1} and toxicity.score(docs.where("doc_id % 300 <> 1"), model).where("predicted = 1").count() == 0


def test_covering_equals_the_plain_greedy_choice(spark):
    rng = random.Random(4)
    good = [f"{chr(97 + i % 26)}{i:02d}" for i in range(40)]
    precise = [rng.uniform(0.7, 1) for _ in good]
    rows = [rng.sample(range(40), rng.randrange(0, 9)) for _ in range(300)]
    chosen, need = [], [toxicity.COVER] * len(rows)
    while True:
        free = [v for v in range(40) if v not in chosen]
        add = lambda v: sum(n > 0 and v in r for r, n in zip(rows, need, strict=True))  # noqa: B023, E731
        best = max(free, key=lambda v: (add(v) * precise[v] ** 4, len(good[v])), default=None)
        if best is None or add(best) < 20:
            break
        chosen.append(best)
        need = [n - (best in r) for r, n in zip(rows, need, strict=True)]
    toxic = spark.createDataFrame([(r,) for r in rows], "v array<int>")
    assert toxicity._covering(toxic, good, precise, 20) == chosen and len(chosen) > toxicity.ABREAST
