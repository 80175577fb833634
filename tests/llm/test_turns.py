"""Repair of conversations against a search over all edits, row by row."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from chronofold.llm import turns

SCHEMA = "audit string, conv_id long, turn long, role string, text string, cost long, kinds string, seg long"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (1 + (k == 3))
    return out


def order(r):
    digest = hashlib.sha256(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).hexdigest()
    return (r[1] is not None, r[1] or 0, r[2].encode(), digest)


def cheapest(rows, faults):
    """The least (cost, audit, turns) by Dijkstra's search over (rows read, state)."""
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, k, initials, out = heapq.heappop(queue)
        state = initials[-1:] if initials != "s" else "s"
        if (k, state) in seen:
            continue
        seen.add((k, state))
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, out
        want = "a" if state == "u" else "u"
        heapq.heappush(queue, (cost + 3, audit + "I", k, initials + want, (*out, ({"u": "user", "a": "assistant"}[want], ""))))
        if k < len(rows):
            _, _, role, text = rows[k]
            heapq.heappush(queue, (cost + 4, audit + "D", k + 1, initials, out))
            if faults[k] not in ("blank", "duplicate"):
                more = 3 * (faults[k] == "truncated")
                heapq.heappush(queue, (cost + 3 + more, audit + "R", k + 1, initials + want, (*out, ({"u": "user", "a": "assistant"}[want], text))))
                if role[:1] == want or (role[:1] == "s" and not initials):
                    heapq.heappush(queue, (cost + more, audit + "K", k + 1, initials + role[0], (*out, (role, text))))


def plain(rows):
    out, after = [], damage(rows)
    for c in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == c), key=order)
        seen, faults = set(), []
        for r in own:
            words = WORD.findall(r[3])
            faults.append("blank" if not words else "duplicate" if r[2:] in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add(r[2:])
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, kept = cheapest(own, faults)
        text = "\n".join(f"{a}:{b}" for a, b in kept)
        out.append((c, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, tmp_path, rows):
    spark.createDataFrame([("x", *r, 1, "x", 1) for r in rows], SCHEMA).write.mode("overwrite").parquet(str(tmp_path / "conversations.parquet"))
    return sorted((tuple(r) for r in turns.op11_repair_conversations(spark, str(tmp_path)).collect()), key=str)


def conversation(rng, c, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "unknown", None]
    texts = ["Yes.", "No!", "cut off", "", " \n\t", None, "Why? \n", "é", "One. Two"] + [f"own {k}." for k in range(20)]
    return [(c, rng.choice([k, k, k, k, k + 1, None]), rng.choice(roles if rng.random() < 0.4 else roles[1:3]), rng.choice(texts)) for k in range(n)]


def test_repair_is_the_cheapest(spark, tmp_path):
    rng = random.Random(4)
    rows = [r for c in range(150) for r in conversation(rng, c, rng.randrange(1, 12))] + conversation(rng, None, 9)
    assert got(spark, tmp_path, rows) == plain(rows)


@pytest.mark.parametrize("n", [63, 64, 65, 200, 1500])
def test_long_conversations_over_segments(spark, tmp_path, n):
    rng = random.Random(n)
    rows = conversation(rng, 1, n) + conversation(rng, 2, 3) + [(3, k, "user" if k % 2 else "assistant", f"line {k}.") for k in range(n)]
    assert got(spark, tmp_path, rows) == plain(rows)


def test_all_rows_dropped_and_empty(spark, tmp_path):
    c = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert got(spark, tmp_path, [(c, 0, "user", "Hi.")]) == [(c, 0, 0, 0, 0, 0, 0, "", empty)]
    assert got(spark, tmp_path, []) == []


def test_repaired_turns_without_damage(spark):
    rows = spark.createDataFrame([(7, 0, "user", "Hi."), (7, 1, "user", "You there?"), (7, 2, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    out = [(r.place, r.edit, r.role, r.text) for r in turns.repaired(rows).orderBy("place").collect()]
    assert out == [(0, "K", "user", "Hi."), (1, "I", "assistant", ""), (2, "K", "user", "You there?"), (3, "K", "assistant", "Yes.")]
