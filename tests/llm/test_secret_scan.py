"""Secret scans: base spans against plain regular expressions, the battery against a plain version, recall of planted runs."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from chronofold.llm import secrets as S

SCHEMA = "doc_id long, text string"
ALPHABETS = {
    "base64": S.UPPER + S.LOWER + S.DIGITS + "+/", "base36": S.LOWER + S.DIGITS, "base36_upper": S.UPPER + S.DIGITS,
    "base32": S.UPPER + "234567", "hex_upper": S.DIGITS + "ABCDEF", "lower": S.LOWER,
}


def base(text):
    out = []
    for rank, (kind, (pattern, group, least)) in enumerate(S.BASE.items()):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def prose(rng, n):
    words = "the of and some words that people write about things when they tell of what happened in the long night before morning came to our little town".split()
    return " ".join(rng.choice(words) for _ in range(n))


def planted(seed=3):
    """Documents (text, kind of run, run) with one run each."""
    rng = random.Random(seed)
    out = []
    for kind, alphabet in ALPHABETS.items():
        for n in (20, 24, 32, 48):
            for _ in range(25):
                run = "".join(rng.choice(alphabet) for _ in range(n))
                out.append((f"{prose(rng, 60)} ({run}) {prose(rng, 20)}", (kind, n), run))
    for run in ("a" * 40, "thethingsthatpeoplewriteabout", "getTheThingThatPeopleWroteAbout", "some/long/path/of/words/and/things", "0123456789" * 4, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "-" * 30, "=" * 25):
        for _ in range(20):
            out.append((f"{prose(rng, 60)} {run} {prose(rng, 20)}", "plain", run))
    return out


def test_base_spans_equal_regular_expressions(spark):
    rng = random.Random(1)
    rows = [
        (1, 'Password: "hunter22" and API_KEY=abc123, token = short secret:longenough'), (2, "AKIA" + "Z" * 16 + " AKIAshort " + "0a" * 20), (3, ""), (4, None), (4, None),
        (5, "é😀 passwd='x+/_.=-yz' " + "f" * 30), (None, "api-key=abcdefgh"), (6, " ".join(f"token=abcde{i} " + "0f" * rng.randrange(8, 20) for i in range(1500))),
    ]
    got = S.scan(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", base int, row string")).select("doc_id", S._told(F.col("base")).alias("b")).collect()
    assert sorted((repr(r.doc_id), r.b) for r in got) == sorted((repr(i), base(t or "")) for i, t in rows)
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


@pytest.fixture(scope="module")
def found(spark):
    docs = planted()
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(docs)], SCHEMA)
    got = S.scan(rows).select("doc_id", S._told(F.col("spans")).alias("s")).collect()
    return docs, {r.doc_id: r.s for r in got}


def test_recall_of_random_runs_and_quiet_on_plain_ones(found):
    docs, got = found
    hits = {}
    for i, (text, kind, run) in enumerate(docs):
        at = text.index(run)
        hits.setdefault(kind, []).append(any(x == f"random:{at}:{at + len(run)}" for x in got[i].split(",")))
    share = {k: sum(v) / len(v) for k, v in hits.items()}
    print(share)
    assert share.pop("plain") == 0
    assert min(v for (k, n), v in share.items() if n >= 24 and k != "lower") >= 0.9 and min(v for (k, n), v in share.items() if n >= 32) >= 0.9
    assert min(share.values()) >= 0.5, share


def test_battery_equals_a_plain_version(spark):
    rng = random.Random(9)
    runs = ["".join(rng.choice(a) for _ in range(rng.randrange(20, 60))) for a in ALPHABETS.values() for _ in range(4)]
    got = S.battery(spark.createDataFrame([(r,) for r in runs], "run string")).collect()
    for r in got:
        alphabet = S.ENCODINGS[r.encoding][1]
        n, k = len(r.run), len(alphabet)
        x2 = k / n * sum(r.run.count(c) ** 2 for c in alphabet) - n
        at = [alphabet.index(c) + 1 for c in r.run]
        bits = [c > len(alphabet) // 2 for c in at]
        turns = 1 + sum(x != y for x, y in zip(bits, bits[1:], strict=False))
        both = 2 * sum(bits) * (n - sum(bits))
        mean = sum(at) / n
        dev = [x - mean for x in at]
        lag = sum(a * b for a, b in zip(dev, dev[1:], strict=False)) / sum(d * d for d in dev)

        def phi(z):
            import math

            z = max(-8, min(8, z))
            return 1 / (1 + math.exp(-(1.5976 * z + 0.07056 * z**3)))

        assert r.x2 == pytest.approx(x2)
        assert r.p_chi == pytest.approx(1 - phi((x2 - (k - 1)) / (2 * (k - 1) * (n - 1) / n) ** 0.5), abs=1e-9)
        assert r.p_runs == pytest.approx(2 * phi(-abs((turns - 1 - both / n) / (both * (both - n) / (n * n * (n - 1))) ** 0.5)), abs=1e-9)
        assert r.p_serial == pytest.approx(2 * phi(-abs((lag + 1 / n) * n**0.5)), abs=1e-9)


def test_text_model_is_over_all_tokens(spark):
    m = S.text_model(spark.createDataFrame([(1, "ab ab abc"), (2, "b" * 30), (3, None)], SCHEMA))
    assert m.log["ab"] > m.log["aa"] and m.log["bc"] > m.log["bb"]
    assert S.text_model(spark.createDataFrame([], SCHEMA)).variance < 1e-9
