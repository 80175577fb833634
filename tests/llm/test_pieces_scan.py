"""The scan over chunks of giant texts in Spark, against the library."""

import random

import sentencepiece
from pyspark.sql import functions as F

from chronofold.llm import pieces


def texts():
    rng = random.Random(7)
    words = [f"{w}{i}" for i, w in enumerate("the reading überall niño 東京 данные aaa ing".split() * 40)]
    spaced = " ".join(rng.choice(words) for _ in range(2500))
    unspaced = "".join(rng.choice("abcdeéß東京данiong") for _ in range(6000))
    emoji = "".join(rng.choice("a😀b 👩‍🚀c") for _ in range(5000))
    spaces = "   ".join(rng.choice(["a", "", "  b"]) for _ in range(1500))
    return [spaced, unspaced, emoji, spaces, " " * 3000, "x" * 4000, spaced, "", None, "short one", "edge" * 50]


def test_giant_texts_equal_the_library_and_round_trip(spark, monkeypatch):
    monkeypatch.setattr(pieces, "FAN", 3)
    rows = [(i, t, "kept", i) for i, t in enumerate(texts())] + [(2, texts()[2], "kept", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string, row long")
    got = pieces.decode(pieces.encode(docs, chunk=200, decoded="also").withColumn("doc", F.lit(1))).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert len(got) == len(rows) and {r.row for r in got} == {r[3] for r in rows}
    for r in got:
        assert r.tokens == sp.encode(r.text or ""), r.doc_id
        assert r.decoded == r.also == (r.text or "")


def test_products_in_a_tree_equal_a_chain(spark):
    m = pieces.Pieces(open(pieces.MODEL, "rb").read())
    u = pieces.MARK + texts()[1]
    cs, size = [], 100
    for i in range(-(-len(u) // size)):
        at, to = max(i * size - m.longest - 1, 0), min((i + 1) * size, len(u))
        cs.append(pieces.Chunk(m, u[at : to + m.longest], i * size - at, to - at, i == 0, to == len(u)))
    ms = [c.matrix() for c in cs]
    left = right = ms[0]
    for x in ms[1:]:
        left = pieces.times(left, x)
    right = ms[-1]
    for x in reversed(ms[:-1]):
        right = pieces.times(x, right)
    assert (left == right).all()


def test_a_matrix_of_spaces_takes_one_pass():
    """A whole chunk of spaces, and the matrix against one walk for each left state on smaller ones."""
    import time

    m = pieces.Pieces(open(pieces.MODEL, "rb").read())

    def chunk(u, size):
        return pieces.Chunk(m, u, m.longest + 1, m.longest + 1 + size, False, False)

    for u in (pieces.MARK * 400, "x" * 400, (pieces.MARK * 7 + "ab") * 60, "abcdeé東" * 60):
        c = chunk(u, 200)
        got = c.matrix()
        stop = c.cuts[0] if c.cuts else c.q
        told = c.origins(stop)
        for i, a in enumerate(c.left):
            walked = c._paths(a, stop) if a[1] < stop else {}
            assert {n for n, states in told.items() if states >> i & 1} == set(walked)
        assert got.shape == (len(c.left), len(c.right))
    began = time.time()
    chunk(pieces.MARK * (pieces.CHUNK + 3 * m.longest), pieces.CHUNK).matrix()
    assert time.time() - began < 8
