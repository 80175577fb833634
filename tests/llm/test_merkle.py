"""The manifest against a plain one."""

import hashlib
import random
import zlib

import pytest

from chronofold.llm import merkle

SCHEMA = "node string, doc_id long, text string, lang string, source string, n_chars long, i string, block string, tampered string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(nodes):
    """The root and each leaf's list of (before, after), level by level."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(where):
            lo = at // 16 * 16
            paths[k].append(("".join(nodes[lo:at]), "".join(nodes[at + 1 : lo + 16])))
        nodes = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
        where = [at // 16 for at in where]
    return nodes[0], paths


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(*(r[c] for c in merkle.FIELDS))))
        trees[s] = (own, *tree([leaf(*(r[c] for c in merkle.FIELDS)) for r in own]))
    root, above = tree([trees[s][1] for s in names])
    out = []
    for s, more in zip(names, above, strict=True):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            path = path + more
            first = leaf(*(r[c] for c in merkle.FIELDS))
            node = first
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
                node = leaf(r["doc_id"], s, r["lang"], r["n_chars"], low)
            for x, y in path:
                node = sha(x + node + y)
            out.append((r["doc_id"], first, subroot, root, sha("".join(x + y for x, y in path)), node, node == root))
    return sorted(out, key=str)


def rows(n, rng):
    out = []
    for k in range(n):
        source = rng.choice(["hot", "hot", "b", None, "é", "Z", f"own{k % 40}"])
        text = rng.choice(["Some Text", "lower only", "", None, "É 😀 A", "x" * 5000 + "Q"])
        out.append({"doc_id": rng.choice([None, k, k, k, k // 2]), "text": text, "lang": rng.choice(["en", None]), "source": source, "n_chars": rng.choice([None, k])})
    return out + out[:5]


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(spark, data):
    told = [("x", r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", "x", "x") for r in data]
    return sorted((tuple(r) for r in merkle.manifest(spark.createDataFrame(told, SCHEMA)).select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("n", [1, 15, 600])
def test_manifest_is_the_plain_one(spark, n):
    data = rows(n, random.Random(n))
    assert got(spark, data) == plain(data)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 256, 257, 4095, 4096])
def test_levels_of_a_block(n):
    leaves = [sha(str(k)) for k in range(n)]
    root, paths = tree(leaves)
    levels = merkle._levels(merkle._matrix(leaves), 0)
    assert bytes(levels[-1]).decode() == root
    for i in {0, n // 2, n - 1}:
        assert [(bytes(x).decode(), bytes(y).decode()) for x, y in merkle._siblings(levels, i)] == paths[i]
    assert len(merkle._levels(merkle._matrix(leaves), 3)) == merkle.DEPTH + 1, "a later block keeps step with the first"


def test_more_leaves_than_a_block(spark):
    data = [{"doc_id": k, "text": f"Text {k}", "lang": "en", "source": "hot" if k % 50 else "small", "n_chars": k} for k in range(9000)]
    assert got(spark, data) == plain(data)


def test_empty(spark):
    assert got(spark, []) == []
