"""Operator 8: PII surrogates, keyed and of the same type, gender, script and format.

Detected: e-mail and IPv4 addresses, phone and card numbers, social-security numbers, IBANs and names after
a title. An entity is replaced by a keyed permutation of the values of its format: characters keep their
class (digit; lower or upper case of their script; punctuation stays), address octets stay octets, card and
IBAN check digits are made anew with the validity that they had, given names go to given names of the same
gender. As permutations, they keep different entities different, and the same entity gets the same
surrogate everywhere (coreference): a surname also without its given name, a number however it is spaced or
punctuated, with or without its country code, a name or address in whatever case. The layout and the case of
each place stay.

Collision check over the whole corpus: a surrogate that is itself an entity of the corpus would tie two
people together, so its entity tries further permutations until its surrogate is neither an entity nor the
surrogate of another. Given names are compared without their gender. The given names of the fixed lists are
the exception: they are permuted within their list, whose names may all be in the corpus; no other given
name gets one of them. Only entities that need more than the first permutation are looked up; all others
are replaced where they stand. A format with fewer values than its entities and their surrogates need
raises a ValueError (as with 339 surnames of two letters, of 676).

The key is an argument: whoever knows it can invert the permutations.

Edge cases: null texts stay null with no entities; empty texts stay empty; very long texts are read whole, about
1 MB of texts at a time; two surrogates that tie on a free value go by the number of the permutation, then the
entity; repeated rows get equal results; values outside any format stay; null ids pass through; other columns,
whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import hmac
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm._util import by_bitmap, materialize, sliced, table

#: After SINGLE permutations one by one, each round tries twice as many as the last, WIDEST at most.
ROUNDS, SINGLE, WIDEST = 8, 8, 256
#: Fixed lists of given names by gender.
FEMALE = "Alice Anna Carmen Clara Elena Emma Eva Greta Hannah Ines Julia Laura Lea Lucia Maria Marie Nora Olivia Paula Rosa Sara Sofia Sophie Teresa".split()
MALE = "Adam Alan Carlos David Diego Emil Felix Finn Hans Hugo Jack James Jean John Karl Leo Louis Lucas Marco Martin Noah Oscar Paul Pedro Peter Tom".split()
#: Title: gender.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Srta": "f", "Dr": "", "Prof": ""}
#: Alphabets whose characters may replace one another.
SCRIPTS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâäãåçèéêëìíîïñòóôöõùúûü", "ÀÁÂÄÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜ", "".join(map(chr, range(0x430, 0x450))), "".join(map(chr, range(0x410, 0x430))), "".join(chr(c) for c in range(0x3B1, 0x3CA) if c != 0x3C2), "".join(chr(c) for c in range(0x391, 0x3AA) if c != 0x3A2)]
CLASS = {c: (a, i) for a in SCRIPTS for i, c in enumerate(a)}
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_CAP = r"[^\W\d_a-zà-ÿ][^\W\d_]+"
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w))"
    rf"|(?P<name>\b(?:{_TITLE})\.? {_CAP}(?: {_CAP})?)"
)
MAYBE = re.compile(rf"[0-9@]|\b(?:{_TITLE})\b")


#: Country codes of one digit and of two; the others have three.
ONE_DIGIT = frozenset("17")
TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _draw(key: bytes, *what) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, what)).encode(), hashlib.sha256).digest(), "big")


def _feistel(values: list[int], radix: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of the vectors below the radixes."""
    v, n = list(values), len(values)
    half = n // 2
    for r in range(ROUNDS):
        move = range(half) if r % 2 else range(half, n)
        seed = ",".join(str(v[i]) for i in range(n) if i not in move)
        x = _draw(key, tweak, r, seed)
        for i in move:
            if not x:
                x = _draw(key, tweak, r, seed, i)
            x, step = divmod(x, radix[i])
            v[i] = (v[i] + step) % radix[i]
    return v


def _form(text: str) -> str:
    """The text with the number of its alphabet for each character that may be replaced."""
    return "".join(str(SCRIPTS.index(CLASS[c][0])) if c in CLASS else c for c in text)


def _spelled(text: str, key: bytes, kind: str) -> str:
    """Characters of an alphabet become others of it; the rest stays."""
    at = [i for i, c in enumerate(text) if c in CLASS]
    if not at:
        return text
    new = _feistel([CLASS[text[i]][1] for i in at], [len(CLASS[text[i]][0]) for i in at], key, f"{kind}:{_form(text)}")
    out = list(text)
    for i, v in zip(at, new, strict=True):
        out[i] = CLASS[text[i]][0][v]
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit that follows the digits."""
    total = sum(sum(divmod(int(d) * (2 if i % 2 == 0 else 1), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _fill(layout: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in layout)


def _lead(phone: str) -> int:
    """Where the number after the country code begins: after its separator, or its digits where there is none."""
    m = re.match(r"\+\d{1,3}(?=[ .(-])", phone)
    if m or phone[:1] != "+":
        return m.end() if m else 0
    return 2 if phone[1] in ONE_DIGIT else 3 if phone[1:3] in TWO_DIGITS else 4


def canonical(kind: str, value: str) -> str:
    """What all spellings of an entity have in common."""
    if kind == "phone":
        return re.sub(r"\D", "", value[_lead(value) :])
    if kind == "card":
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "email":
        return value.lower()
    return value[:1] + value[1:].lower() if kind in ("given", "surname") else value


def rendered(kind: str, value: str, new: str) -> str:
    """The surrogate in the layout and case of the value."""
    if kind == "phone":
        return value[: _lead(value)] + _fill(value[_lead(value) :], new)
    if kind in ("card", "iban"):
        return _fill(value, new)
    if kind == "email" or kind in ("given", "surname") and not value[1:].islower():
        upper = value.isupper()
        return "".join(c.upper() if upper or i < len(value) and value[i].isupper() else c for i, c in enumerate(new))
    return new


def surrogate(kind: str, value: str, key: bytes) -> str:
    """One step of the permutation of the values of a kind and format (in canonical form)."""
    if kind == "ip":
        return ".".join(map(str, _feistel([int(x) for x in value.split(".")], [256] * 4, key, "ip")))
    if kind == "card":
        new = _spelled(value[:-1], key, f"card{len(value)}")
        return new + str((luhn(new) + int(value[-1]) - luhn(value[:-1])) % 10)
    if kind == "iban":
        new = _spelled(value[4:], key, f"iban{value[:2]}")
        return f"{value[:2]}{iban_check(value[:2], new):02d}{new}"
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        labels = domain.rsplit(".", 1)
        return f"{_spelled(local, key, 'local')}@{_spelled(labels[0], key, 'domain')}.{labels[1]}"
    if kind == "given":
        gender, name = value.split(":", 1)
        names = FEMALE if gender == "f" else MALE
        if name in names:
            order = sorted(range(len(names)), key=lambda i: _draw(key, "given", gender, i))
            return f"{gender}:{names[order[(order.index(names.index(name)) + 1) % len(names)]]}"
        return f"{gender}:{_spelled(name, key, 'given')}"
    return _spelled(value, key, kind)


def room(kind: str, value: str) -> tuple[str, int]:
    """The format of a value and how many values the permutations reach in it, 2 ** 62 at most."""
    if kind == "ip":
        return "", 256**4
    form, spelled = _form(value), value
    if kind == "card":
        spelled = value[:-1]
        form += f"/{(int(value[-1]) - luhn(spelled)) % 10}"
    elif kind == "iban":
        spelled = value[4:]
        form = value[:2] + form[2:]
    elif kind == "email":
        spelled, _, last = value.rpartition(".")
        form = f"{_form(spelled)}.{last}"
    return form, min(math.prod(len(CLASS[c][0]) for c in spelled if c in CLASS), 1 << 62)


def valid(kind: str, value: str) -> bool:
    if kind != "iban":
        return True
    d = value.replace(" ", "")
    return 15 <= len(d) <= 34 and int(d[2:4]) == iban_check(d[:2], d[4:])


def parts(kind: str, value: str) -> list[tuple[str, str, int, int]]:
    """(kind, entity, start, end) of what is replaced in a match: an address as a whole, a name by its words."""
    if kind != "name":
        return [(kind, canonical(kind, value), 0, len(value))]
    title, rest = value.split(" ", 1)
    gender = TITLES[title.rstrip(".")]
    words, at = rest.split(" "), len(title) + 1
    out = []
    for i, w in enumerate(words):
        if len(words) == 2 and i == 0:
            name = canonical("given", w)
            g = gender or ("f" if name in FEMALE else "m" if name in MALE else "")
            out.append(("given", f"{g}:{name}", at, at + len(w)))
        else:
            out.append(("surname", canonical("surname", w), at, at + len(w)))
        at += len(w) + 1
    return out


def entities(text: str | None) -> list[tuple[str, str, int, int]]:
    """(kind, entity, start, end) of all entities of a text, in order."""
    if not text or not MAYBE.search(text):
        return []
    out = []
    for m in PATTERN.finditer(text):
        if valid(m.lastgroup, m[0]):
            out += [(k, e, m.start() + a, m.start() + b) for k, e, a, b in parts(m.lastgroup, m[0])]
    return _again(text, out)


def _again(text: str, found: list[tuple[str, str, int, int]]) -> list[tuple[str, str, int, int]]:
    """The entities with the names that a title introduced, wherever the text has them without it.

    A surname counts as a word of its own, a given name only before its surname.
    """
    names: dict[str, dict[str, str]] = {}  # of a surname, the given names before it and their entities
    for k, (kind, _, a, b) in enumerate(found):
        if kind == "surname":
            own = names.setdefault(text[a:b], {})
            if k and found[k - 1][0] == "given" and found[k - 1][3] + 1 == a:
                own[text[found[k - 1][2] : found[k - 1][3]]] = found[k - 1][1]
    if not names:
        return found
    taken = {a for _, _, a, _ in found}
    spans = sorted((a, b) for _, _, a, b in found)
    starts = [a for a, _ in spans]
    more = []
    for m in re.finditer(r"\b(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")\b", text):
        at = bisect.bisect_right(starts, m.start()) - 1
        if m.start() in taken or at >= 0 and spans[at][1] > m.start():
            continue
        for given, entity in names[m[0]].items():
            a = m.start() - len(given) - 1
            if a >= 0 and text[a : m.start()] == given + " " and (a == 0 or not text[a - 1].isalnum()):
                more.append(("given", entity, a, a + len(given)))
                break
        more.append(("surname", canonical("surname", m[0]), m.start(), m.end()))
    return sorted(found + more, key=lambda x: x[2])


def _nth(key: bytes, n: int) -> bytes:
    return key if n == 1 else key + b":%d" % n


@functools.lru_cache(maxsize=1 << 16)
def replaced(kind: str, value: str, n: int, key: bytes) -> str:
    """The surrogate by the n-th permutation."""
    return surrogate(kind, value, _nth(key, n))


def _found(docs: DataFrame) -> DataFrame:
    """txh, kind, entity of the entities of each text."""

    def run(batches):
        for b in (part for whole in batches for part in sliced(whole, "text")):
            got = [(t, k, e) for t, text in zip(b.column("txh").to_pylist(), b.column("text").to_pylist(), strict=True) for k, e in {(k, e) for k, e, _, _ in entities(text)}]
            cols = list(zip(*got, strict=True)) if got else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["txh", "kind", "entity"])

    return materialize(docs.select("txh", "text").mapInArrow(run, "txh long, kind string, entity string"))


def _bare() -> Column:
    """The entity, a given name without its gender."""
    return F.when(F.col("kind") == "given", F.substring_index("entity", ":", -1)).otherwise(F.col("entity"))


def _roomed(batches):
    for b in batches:
        got = [room(k, v) for k, v in zip(b.column("kind").to_pylist(), b.column("s").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("s"), b.column("own"), pa.array([f for f, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())], names=["kind", "s", "own", "form", "size"])


def _tries(found: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, n: the entities that need the n-th permutation, n > 1."""

    def at(low: int, high: int):
        def run(batches):
            for b in batches:
                kinds, values = b.column("kind").to_pylist(), b.column("entity").to_pylist()
                for n in range(low, high):
                    k = _nth(key, n)
                    s = [_spelled(v, k, "given") if kind == "given" else surrogate(kind, v, k) for kind, v in zip(kinds, values, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("entity"), pa.array([n] * len(s), pa.int32()), pa.array(s, pa.string())], names=["kind", "entity", "n", "s"])

        return run

    schema = "kind string, entity string, n int, s string"
    listed = (F.col("kind") == "given") & F.col("entity").isin([f"f:{x}" for x in FEMALE] + [f"{g}:{x}" for g in ("m", "") for x in MALE])
    real = materialize(found.select("kind", "entity").distinct().select("kind", "entity", _bare().alias("s"), (~listed).alias("own")))
    lists = found.sparkSession.createDataFrame([("given", x, False) for x in [*FEMALE, *MALE]], "kind string, s string, own boolean")
    known = real.select("kind", "s", "own").unionByName(lists).groupBy("kind", "s").agg(F.max("own").alias("own"))
    known = materialize(known.mapInArrow(_roomed, "kind string, s string, own boolean, form string, size long"))
    full = known.where("size > 1").groupBy("kind", "form").agg(F.count("*").alias("there"), F.count_if("own").alias("new"), F.max("size").alias("size")).where("there + new > size").first()
    if full:
        raise ValueError(f"{full.kind} {full.form}: {full.size} values are too few for {full.there} entities and {full.new} surrogates")
    taken = known.select("kind", "s")
    first = materialize(known.where("own and size > 1").select("kind", F.col("s").alias("entity")).mapInArrow(at(1, 2), schema).drop("n"))
    todo = materialize(first.join(taken, ["kind", "s"], "left_semi").select("kind", "entity"))
    used = first.join(todo, ["kind", "entity"], "left_anti").select("kind", "s").unionByName(taken)
    out = todo.withColumn("n", F.lit(1)).limit(0)
    n = wide = 1
    while todo.limit(1).count():
        low, n = n + 1, n + wide
        again = materialize(todo.mapInArrow(at(low, n + 1), schema))
        open_ = again.join(used, ["kind", "s"], "left_anti").groupBy("kind", "entity").agg(F.min(F.struct("n", "s")).alias("x")).select("kind", "entity", "x.n", "x.s")
        free = materialize(open_.groupBy("kind", "s").agg(F.min(F.struct("n", "entity")).alias("x")).select("kind", "s", "x.n", "x.entity"))
        out = out.unionByName(free.select("kind", "entity", "n"))
        used = used.unionByName(free.select("kind", "s"))
        todo = materialize(todo.join(free, ["kind", "entity"], "left_anti"))
        if n >= SINGLE:
            wide = min(2 * wide, WIDEST)
    return materialize(real.where("own").join(out.withColumnRenamed("entity", "s"), ["kind", "s"]).select("kind", "entity", "n"))


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, n_entities, spans (kind:start:end, of the original text) and the text with surrogates."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("txh"))
    found = _found(docs)
    far = _tries(found, key)
    exact = materialize(found.join(far, ["kind", "entity"]).groupBy("txh").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "entity"), "n"))).alias("tries")))
    told = by_bitmap(docs, F.col("txh"), exact, F.col("txh"))
    none = F.lit(None).cast("map<string,int>")
    ready = told.where("not hit").select("row.*", none.alias("tries")).unionByName(told.where("hit").select("row.*").join(exact, "txh", "left").select("doc_id", "text", "txh", "tries"))

    def run(batches):
        for b in (part for whole in batches for part in sliced(whole, "text")):
            counts, spans, texts = [], [], []
            for text, tries in zip(b.column("text").to_pylist(), b.column("tries").to_pylist(), strict=True):
                got, tries = entities(text), dict(tries or [])
                out, at = [], 0
                for k, e, s, t in got:
                    new = replaced(k, e, tries.get(f"{k}:{e}", 1), key)
                    out += [text[at:s], rendered(k, text[s:t], new.split(":", 1)[1] if k == "given" else new)]
                    at = t
                counts.append(len(got))
                spans.append(",".join(f"{k}:{s}:{t}" for k, _, s, t in got))
                texts.append("".join([*out, text[at:]]) if got else text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_entities", "spans", "text"])

    kind = dict(docs.dtypes)["doc_id"]
    return ready.select("doc_id", "text", "tries").mapInArrow(run, f"doc_id {kind}, n_entities long, spans string, text string")


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the key of the session's chronofold.surrogates.key, or one for demonstration only."""
    key = spark.conf.get("chronofold.surrogates.key", "for demonstration only")
    return pseudonymise(table(spark, sf_dir, "documents"), key.encode())
