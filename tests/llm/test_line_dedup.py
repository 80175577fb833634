"""Fuzzy lines against a brute-force version, and the share of alike pairs that the blocks meet."""

import math
import random
import re

import pytest
import xxhash

from chronofold.llm import line_dedup as L

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def norm(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def sims(n):
    """The blocks of a normal form."""
    total, sums = [0] * L.BLOCKS, [[0] * 16 for _ in range(L.BLOCKS)]
    words = n.split(" ")
    words = list(dict.fromkeys(words)) if len(words) > L.MANY else words
    sample = (1 << min(14, max(0, math.ceil(math.log2(len(words) / L.WORDS))))) - 1
    for w in words:
        a = xxhash.xxh64_intdigest(w, 42)
        b = xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)
        u = xxhash.xxh64_intdigest(b.to_bytes(8, "little"), 42)
        if u >> 50 & sample:
            continue
        for k in range(L.BLOCKS):
            weight = min(L.HEAVIEST, max(1, int(min(L.LONGEST_WORD, len(w)) ** 2 * (L.SCALE / (((u >> 10 * k & 1023) + L.OFFSET) / 1024) ** 1.5))))
            total[k] += weight
            for j in range(4):
                h = (a, b)[k // 4] >> (4 * (k % 4) + j)
                for lane in range(4):
                    sums[k][4 * lane + j] += weight * (h >> 16 * lane & 1)
    return [tuple(2 * s > total[k] for s in sums[k]) for k in range(L.BLOCKS)]


def meet(a, b):
    x, y, most = sims(a), sims(b), L.SHORT_BITS if max(len(a), len(b)) < L.SHORT else L.BITS
    return sum(p == q for p, q in zip(x, y, strict=True)) >= L.AGREE and sum(p != q for u, v in zip(x, y, strict=True) for p, q in zip(u, v, strict=True)) <= most


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def alike(a, b):
    longer = max(len(a), len(b))
    return min(len(a), len(b)) >= 0.9 * longer and distance(a, b) <= int(0.1 * longer + 1e-9)


def brute(rows):
    """The text that each row keeps."""
    at = [(i, j, norm(x)) for i, (_, t, *_) in enumerate(rows) for j, x in enumerate((t or "").split("\n")) if norm(x)]
    forms = sorted({n for *_, n in at})
    parent = {n: n for n in forms}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(forms):
        for b in forms[:i]:
            if len(a) >= 9 and len(b) >= 9 and alike(a, b) and meet(a, b):
                parent[find(a)] = find(b)
    first = {}
    for i, j, n in sorted(at, key=lambda x: (rows[x[0]][0] is not None, rows[x[0]][0] or 0, x[0], x[1])):
        first.setdefault(find(n), (i, j))
    out = []
    for i, r in enumerate(rows):
        keep = [x for j, x in enumerate((r[1] or "").split("\n")) if not norm(x) or first[find(norm(x))] == (i, j)]
        out.append(None if r[1] is None else "\n".join(keep))
    return [r for r in zip((r[0] for r in rows), out, (r[1] for r in rows), strict=True) if r[1] == r[2] or norm(r[1])]


def edited(rng, words, line, k):
    w = line.split(" ")
    for i in rng.sample(range(len(w)), min(k, len(w))):
        w[i] = rng.choice(words)
    return " ".join(w)


def fixture(seed=5, docs=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.choice([2, 3, 5, 6, 7, 9]))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 8, 12, 25, 60]))) for _ in range(60)]
    rows = [(i, "\n".join(edited(rng, words, rng.choice(base), rng.choice([0, 0, 1, 1, 2])) for _ in range(rng.randrange(1, 5)))) for i in range(docs)]
    return [*rows, (100, None), (101, ""), (102, " \n--\n"), (103, base[0] + "!\n\n" + base[0].upper())]


@pytest.mark.parametrize("tile", [2])
def test_equals_brute_force(spark, tile):
    rows = [(*r, "en", "s", 1) for r in fixture()]
    got = L.dedup_documents(spark.createDataFrame(rows, SCHEMA).coalesce(1), tile=tile, across=4)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id, repr(r.text)) for r in got.collect()) == sorted((r[0], repr(r[1])) for r in brute(rows))


def test_repeated_rows_clashing_names_and_empty(spark):
    rows = [(1, "alpha beta gamma delta\nkeep me whole please", 1, 2, "g"), (1, "alpha beta gamma delta\nkeep me whole please", 3, 4, "h"), (None, "alpha beta gamma delta\n-", 5, 6, "i"), (2, "\n", 0, 0, "j"), (2, "\n", 0, 0, "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, txh int, `all` int, gone string")
    got = sorted(((r.doc_id or 0, r.text) for r in L.dedup_documents(docs).collect()))
    assert got == [(0, "alpha beta gamma delta\n-"), (1, "keep me whole please"), (2, "\n"), (2, "\n")]
    assert L.dedup_documents(docs).columns == docs.columns
    assert L.dedup_documents(docs.limit(0)).count() == 0


def test_very_long_lines_and_hot_keys(spark, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(5000)]
    giant = " ".join(rng.choice(words) for _ in range(9000))
    template = " ".join(words[:30])
    rows = [(0, giant), (1, giant.replace(words[7], "other") + " end"), *[(10 + i, f"{template} {i}") for i in range(300)]]
    full = L._candidates
    monkeypatch.setattr(L, "_candidates", lambda nodes, similarity, tile: full(nodes, similarity, tile, 2))
    got = {r.doc_id for r in L.dedup_documents(spark.createDataFrame(rows, "doc_id long, text string"), tile=8, across=32).collect()}
    assert got == {0, 10}


def test_share_of_alike_pairs_met():
    """One replaced word of lines of 5 to 80 words, two of 20 to 80: the blocks meet most pairs."""
    rng = random.Random(11)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.choice([2, 3, 3, 4, 5, 6, 7, 8, 10]))) for _ in range(20000)]
    share = {}
    for n, k in [(5, 1), (10, 1), (20, 1), (40, 1), (80, 1), (20, 2), (40, 2), (80, 2)]:
        met = 0
        for _ in range(150):
            line = " ".join(rng.choice(words) for _ in range(n))
            met += meet(line, edited(rng, words, line, k))
        share[n, k] = met / 150
    print(share)
    assert min(share.values()) >= 0.5 and share[20, 1] >= 0.75 and share[40, 1] >= 0.8, share
