"""Texts of notes, answers and contexts: links, front matter, declarations, corroboration, clipping and style."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

WIKILINK = r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"
FRONT = r"(?s)\A---[ \t\n\x0B\f\r]*\n(.*?)\n---[ \t\n\x0B\f\r]*\n"
TOKEN = "[a-z0-9]+"
#: Fixed values of the corroboration rule.
STOP = "the a an to for of in on at is are was be by or and it its this that with via as if all any can do does run see".split()
LEAST_TOKEN, LEAST_HITS, LEAST_SHARE = 4, 2, 0.4
#: Fixed lists of function words by language, and words of both; punctuation of a style.
SPANISH = (
    "el la de que y en un es se por con para los las del al lo le me te su mi nos les pero como más sin sobre entre hasta desde todo también ya sí ni"
).split()
ENGLISH = (
    "the an and or but in on at to for of with by from as is was are were be been have has had do does did will would could should may might must can so very just"
    " now then here there when where all each both some only same than also after even new any"
).split()
BOTH = "a no o".split()
PUNCTUATION = ",;:.!?"
CLIP, BUDGET, HEADING = 400, 6000, "=== CONTEXT ==="


def wikilinks(text: Column) -> Column:
    """Targets of [[target#part|label]], in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(1)), lambda x: F.trim(x))


def front_matter(text: Column) -> Column:
    """map<string,string> of the `key: value` lines between the leading fences; of a repeated key the last counts."""
    head = F.regexp_extract(text, FRONT, 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.when(text.rlike(FRONT), F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>"))


def list_value(value: Column) -> Column:
    """The items of a value in brackets, else the value alone."""
    inner = F.filter(F.transform(F.split(F.regexp_extract(value, r"^\[(.*)\]$", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(value.rlike(r"^\[.*\]$"), inner).otherwise(F.array(value))


def body(text: Column) -> Column:
    """The text after its front matter."""
    return F.regexp_replace(text, FRONT, "")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def corroborated(content: Column, answer: Column) -> Column:
    """Whether an answer holds two content words of a memory, or two fifths of them; a memory without any passes."""
    own = F.filter(tokens(content), lambda t: (F.length(t) >= LEAST_TOKEN) & ~t.isin(*STOP))
    hits = F.size(F.array_intersect(own, tokens(answer)))
    return (F.size(own) == 0) | (hits >= LEAST_HITS) | (hits / F.greatest(F.size(own), F.lit(1)) >= LEAST_SHARE)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as hex, by two hashes with the padded key."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ p for b in key).hex())) for p in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def nonce(secret: bytes, material: Column) -> Column:
    """The first 12 hex digits of the HMAC."""
    return F.substring(hmac_sha256(secret, material), 1, 12)


def nonce_of(secret: bytes, material: str) -> str:
    return hmac.new(secret, material.encode(), hashlib.sha256).hexdigest()[:12]


def declared(raw: Column, nonce_: Column, served: Column) -> Column:
    """struct<answer, ids, forged>: the first line `USED:<nonce>: a, b` tells what was used, as far as it was served.

    Without such a line all served ids count, and another USED line is forged.
    """
    pattern = F.concat(F.lit(r"(?m)^USED:"), nonce_, F.lit(r":[ \t]*(.*)$"))
    has = F.regexp_like(raw, pattern)
    ids = F.filter(F.transform(F.split(F.call_function("regexp_extract", raw, pattern, F.lit(1)), ","), lambda x: F.trim(x)), lambda x: F.array_contains(served, x))
    answer = F.rtrim(F.element_at(F.call_function("split", raw, pattern, F.lit(2)), 1))
    return F.struct(F.when(has, answer).otherwise(raw).alias("answer"), F.when(has, ids).otherwise(served).alias("ids"), (~has & raw.rlike(r"(?mi)^USED\s*:")).alias("forged"))


def clipped(text: Column, most: int = CLIP) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` characters, then three dots in place of the last."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("...")))


def cache_key(query: Column, top_k: Column, hops: Column, layer: Column, session: Column, generation: Column) -> Column:
    parts = [F.lower(F.trim(query)), top_k.cast("string"), hops.cast("string"), F.coalesce(layer, F.lit("")), session, generation.cast("string")]
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def decayed(strength: Column, rate: Column, age_s: Column) -> Column:
    return strength * F.exp(-rate * age_s)


def recency(age_s: Column, weight: float = 0.05, half_life_s: float = 86400.0) -> Column:
    import math

    return weight * F.exp(-math.log(2) * F.greatest(F.lit(0.0), age_s) / half_life_s)


def _let(value: Column, f) -> Column:
    """f(value), the value being computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def style(text: Column) -> Column:
    """struct<words map, language, sentence double, punctuation map> of a text: shares of function words, mean words a sentence, shares of marks.

    A text is split once, and its function words are found once, however many differ.
    """

    def told(text: Column) -> Column:
        words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
        own = lambda ws: F.filter(F.transform(ws, lambda w: F.btrim(w, F.lit(".,;:!?\"'"))), lambda w: w.isin(*SPANISH, *ENGLISH, *BOTH))
        return _let(words, lambda ws: _let(F.struct(own(ws).alias("own"), F.greatest(F.size(ws), F.lit(1)).cast("double").alias("total")), lambda x: by_words(text, x)))

    def by_words(text: Column, x: Column) -> Column:
        own = x["own"]
        shares = F.map_from_entries(F.transform(F.array_distinct(own), lambda w: F.struct(w.alias("w"), (F.size(F.filter(own, lambda y: y == w)) / x["total"]).alias("s"))))
        es, en = F.size(F.filter(own, lambda w: w.isin(*SPANISH))), F.size(F.filter(own, lambda w: w.isin(*ENGLISH)))
        language = _let(F.struct(es.alias("es"), en.alias("en")), lambda n: F.when(n["es"] > n["en"], "es").when(n["en"] > n["es"], "en").otherwise("und"))
        lengths = F.filter(F.transform(F.split(text, "[.!?]"), lambda y: F.regexp_count(y, F.lit(r"\S+")).cast("double")), lambda n: n > 0)
        mean = _let(lengths, lambda ls: F.when(F.size(ls) > 0, F.aggregate(ls, F.lit(0.0), lambda a, n: a + n) / F.size(ls)).otherwise(0.0))
        long = F.greatest(F.length(text), F.lit(1)).cast("double")
        marks = F.create_map(*[y for c in PUNCTUATION for y in (F.lit(c), (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / long)])
        return F.struct(shares.alias("words"), language.alias("language"), mean.alias("sentence"), marks.alias("punctuation"))

    return _let(F.coalesce(text, F.lit("")), told)


def _cosine(a: Column, b: Column) -> Column:
    """Cosine of two sparse maps, 0 where one has no length."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))

    def total(f):
        return F.aggregate(keys, F.lit(0.0), lambda acc, k: acc + f(k))

    x, y = (lambda k: F.coalesce(F.element_at(a, k), F.lit(0.0))), (lambda k: F.coalesce(F.element_at(b, k), F.lit(0.0)))
    norm = F.sqrt(total(lambda k: x(k) * x(k))) * F.sqrt(total(lambda k: y(k) * y(k)))
    return F.when(norm > 0, total(lambda k: x(k) * y(k)) / norm).otherwise(0.0)


def style_distance(a: Column, b: Column) -> Column:
    """0.5 for words, 0.3 for the length of sentences, 0.2 for punctuation."""
    words = F.when((F.size(a["words"]) == 0) & (F.size(b["words"]) == 0), 0.0).otherwise(1.0 - _cosine(a["words"], b["words"]))
    most = F.greatest(a["sentence"], b["sentence"], F.lit(1.0))
    return 0.5 * words + 0.3 * F.abs(a["sentence"] - b["sentence"]) / most + 0.2 * (1.0 - _cosine(a["punctuation"], b["punctuation"]))
