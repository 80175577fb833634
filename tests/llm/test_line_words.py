"""Blocks of long lines: every word counts, in pieces of any size."""

import random

import xxhash

from chronofold.llm import line_dedup as L


def plain(n):
    """The blocks of a normal form by all of its words, repeated ones each time."""
    total, sums = [0] * L.BLOCKS, [[0] * 16 for _ in range(L.BLOCKS)]
    for w in n.split(" "):
        a = xxhash.xxh64_intdigest(w, 42)
        b = xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)
        u = xxhash.xxh64_intdigest(b.to_bytes(8, "little"), 42)
        for k in range(L.BLOCKS):
            weight = min(L.HEAVIEST, max(1, int(min(L.LONGEST_WORD, len(w)) ** 2 * (L.SCALE / (((u >> 10 * k & 1023) + L.OFFSET) / 1024) ** 1.5))))
            total[k] += weight
            for i in range(16):
                sums[k][i] += weight * ((a, b)[k // 4] >> (4 * (k % 4) + i % 4 + 16 * (i // 4)) & 1)
    return [sum((2 * s > total[k]) << i for i, s in zip([4 * (i // 4) + i % 4 for i in range(16)], sums[k], strict=True)) for k in range(L.BLOCKS)]


def blocks(df):
    return {r["doc_id"]: [r["sim1"] >> 16 * k & 0xFFFF for k in range(4)] + [r["sim2"]] for r in df.collect()}


def test_all_words_of_long_lines_count(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 14))) for _ in range(900)]
    lines = [" ".join(rng.choices(vocabulary, k=n)) for n in (5, 64, 65, 200, 511, 512, 513, 1500, 6000)] + ["wordlonger " * 3000]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    want = {i: plain(x.strip()) for i, x in enumerate(lines)}
    assert blocks(L.occurrences(docs)) == want
    assert blocks(L.occurrences(docs, piece=7)) == want
