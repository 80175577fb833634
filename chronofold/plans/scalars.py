"""Scalar functions over whole tables, each with SQL of its own."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions import canonical as C
from chronofold.functions import text as T
from chronofold.plans.ledger import duck, registered, view

SECRET = b"for demonstration only"
NOTES = """
notes as (
  select 'n' || STR(doc_id) as name, '---' || chr(10) || 'title: Note ' || STR(doc_id) || chr(10) || 'tags: [a' || STR(doc_id % 3) || ', b]' || chr(10) || 'title: Last: ' || lang || chr(10) || '---' || chr(10)
         || 'See [[n' || STR(doc_id * 7 % 50) || ']] and [[ N' || STR(doc_id % 11) || '#part|label]] or [none].' || chr(10) as text
  from documents)"""
TURNS = """
turns as (
  select conv_id, turn, role, text, lead(text) over (partition by conv_id order by turn) as answer,
         case when turn % 3 = 0 then text || chr(10) || 'USED: m1' when turn % 3 = 1 then text else text || chr(10) || 'USED:' || substr(SHA(STR(conv_id)), 1, 12) || ': m1, zz,m3' end as raw,
         substr(SHA(STR(conv_id)), 1, 12) as nonce
  from conversations)"""
USES = """
uses as (select distinct l_orderkey as decision_id, 'm' || STR(l_partkey) as memory_id from lineitem)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@registered("FN-1_quantize", "select event_id, (n // 10000000000)::varchar || '.' || lpad((n % 10000000000)::varchar, 10, '0') as amount from (select event_id, x // 10 + case when x % 10 > 5 or x % 10 = 5 and x // 10 % 2 = 1 then 1 else 0 end as n from (select event_id, event_id * 5 as x from events))")
def quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("event_id").cast("decimal(20,0)") * F.lit("0.00000000005").cast("decimal(12,11)")
    return read(spark, sf_dir, "events").select("event_id", C.fixed(x).alias("amount"))


@registered("FN-2_canonical_json", """select doc_id, sha256('{"doc_id":' || doc_id || ',"lang":' || coalesce(to_json(lang)::varchar, 'null') || ',"none":null,"text":' || coalesce(to_json(text)::varchar, 'null') || '}') as json_sha256 from documents""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    json = C.json_object({"text": F.col("text"), "doc_id": C.Number(F.col("doc_id")), "lang": F.col("lang"), "none": None})
    return read(spark, sf_dir, "documents").select("doc_id", C.sha256(json).alias("json_sha256"))


@registered("FN-3_content_hash", "select doc_id, sha256(text) as content_sha256 from documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", C.sha256(F.col("text")).alias("content_sha256"))


@registered("FN-4_timestamp", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' as stamp from events")
def timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", C.timestamp_string(F.col("ts")).alias("stamp"))


_LISTED = ", ".join(f"'{w}'" for w in [*T.SPANISH, *T.ENGLISH, *T.BOTH])
_STYLE = f"""
t as (select doc_id, source, coalesce(text, '') as text from documents),
w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') as ws, text from t),
o as (select doc_id, text, len(ws) as total, list_filter(list_transform(ws, lambda x: regexp_replace(x, '^[.,;:!?"'']+|[.,;:!?"'']+$', '', 'g')), lambda x: list_contains([{_LISTED}], x)) as own from w),
s as (select doc_id, own, greatest(total, 1)::double as total, text,
             len(list_filter(own, lambda x: list_contains([{", ".join(f"'{x}'" for x in T.SPANISH)}], x))) as es, len(list_filter(own, lambda x: list_contains([{", ".join(f"'{x}'" for x in T.ENGLISH)}], x))) as en,
             list_transform(list_filter(string_split_regex(text, '[.!?]'), lambda x: regexp_matches(x, '\\S')), lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> ''))) as sentences from o)"""


@registered(
    "FN-5_style",
    "with " + _STYLE.strip() + """
select doc_id, len(list_distinct(own)) as words, round(len(list_filter(own, lambda x: x = 'the')) / total, 9) as the, case when es > en then 'es' when en > es then 'en' else 'und' end as language,
       round(coalesce(list_avg(sentences), 0.0), 9) as sentence, round((len(text) - len(replace(text, ',', ''))) / greatest(len(text), 1)::double, 9) as commas from s""",
)
def style(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "documents").select("doc_id", T.style(F.col("text")).alias("s"))
    return s.select(
        "doc_id", F.size("s.words").cast("long").alias("words"), F.round(F.coalesce(F.element_at("s.words", F.lit("the")), F.lit(0.0)), 9).alias("the"), "s.language", F.round("s.sentence", 9).alias("sentence"),
        F.round(F.element_at("s.punctuation", F.lit(",")), 9).alias("commas"),
    )


@registered(
    "FN-6_style_distance",
    "with " + _STYLE.strip() + """,
f as (select doc_id, unnest(own) as w, total from s),
g as (select doc_id, w, count(*) / total as x from f group by doc_id, w, total),
m as (select doc_id, c, (len(text) - len(replace(text, c, ''))) / greatest(len(text), 1)::double as x from s, (values (','), (';'), (':'), ('.'), ('!'), ('?')) p(c)),
b as (select doc_id, lag(doc_id) over (partition by source order by doc_id) as before from t),
n as (select b.doc_id, b.before, coalesce(list_avg(x.sentences), 0.0) as u, coalesce(list_avg(y.sentences), 0.0) as v, len(x.own) + len(y.own) as n_own from b join s x on x.doc_id = b.doc_id join s y on y.doc_id = b.before),
d1 as (select n.doc_id, sum(p.x * q.x) as dot from n join g p on p.doc_id = n.doc_id join g q on q.doc_id = n.before and q.w = p.w group by n.doc_id),
d2 as (select n.doc_id, sum(p.x * q.x) as dot from n join m p on p.doc_id = n.doc_id join m q on q.doc_id = n.before and q.c = p.c group by n.doc_id),
l1 as (select doc_id, sqrt(sum(x * x)) as l from g group by doc_id), l2 as (select doc_id, sqrt(sum(x * x)) as l from m group by doc_id)
select n.doc_id, round(0.5 * case when n_own = 0 then 0 when coalesce(a.l, 0) * coalesce(c.l, 0) > 0 then 1 - coalesce(d1.dot, 0) / (a.l * c.l) else 1 end + 0.3 * abs(u - v) / greatest(u, v, 1.0)
         + 0.2 * case when e.l * h.l > 0 then 1 - d2.dot / (e.l * h.l) else 1 end, 6) as distance
from n left join d1 using (doc_id) left join d2 using (doc_id) left join l1 a on a.doc_id = n.doc_id left join l1 c on c.doc_id = n.before left join l2 e on e.doc_id = n.doc_id left join l2 h on h.doc_id = n.before""",
)
def style_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the one before it of its source."""
    s = read(spark, sf_dir, "documents").select("doc_id", "source", T.style(F.col("text")).alias("s")).withColumn("b", F.lag("s").over(W.partitionBy("source").orderBy("doc_id")))
    return s.where("b is not null").select("doc_id", F.round(T.style_distance(F.col("s"), F.col("b")), 6).alias("distance"))


@registered(
    "FN-7_corroboration",
    duck(
        f"""
k as (select conv_id, turn, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: len(x) >= 4 and not list_contains([{", ".join(f"'{x}'" for x in T.STOP)}], x)) as own,
             list_distinct(regexp_extract_all(lower(answer), '[a-z0-9]+')) as given from turns where answer is not null)
select conv_id, turn, len(own) = 0 or len(list_intersect(own, given)) >= 2 or len(list_intersect(own, given)) * 5 >= 2 * len(own) as corroborated from k""",
        TURNS,
    ),
)
def corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "turns", TURNS).where("answer is not null").select("conv_id", "turn", T.corroborated(F.col("text"), F.col("answer")).alias("corroborated"))


@registered(
    "FN-8_declaration",
    duck("select conv_id, turn, sha256(rtrim(text, ' ' || chr(10) || chr(9) || chr(13))) as answer_sha256, case when turn % 3 = 2 then 'm1,m3' else 'm1,m2,m3' end as ids, turn % 3 = 0 as forged from turns where turn % 3 = 2 union all select conv_id, turn, sha256(raw), 'm1,m2,m3', turn % 3 = 0 from turns where turn % 3 <> 2", TURNS),
)
def declaration(spark: SparkSession, sf_dir: str) -> DataFrame:
    served = F.array(*map(F.lit, ("m1", "m2", "m3")))
    d = view(spark, sf_dir, "turns", TURNS).withColumn("d", T.declared(F.col("raw"), F.col("nonce"), served))
    return d.select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, C.sha256(F.regexp_replace("d.answer", r"[ \n\t\r]+$", ""))).otherwise(C.sha256(F.col("d.answer"))).alias("answer_sha256"), F.array_join("d.ids", ",").alias("ids"), F.col("d.forged").alias("forged"))


def _pads(secret: bytes) -> tuple[str, str]:
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


@registered("FN-9_nonce", f"select conv_id, substr(sha256(unhex('{_pads(SECRET)[1]}') || unhex(sha256(unhex('{_pads(SECRET)[0]}') || encode('s' || conv_id)))), 1, 12) as nonce from (select distinct conv_id from conversations)")
def nonces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("nonce", T.nonce(SECRET, F.concat(F.lit("s"), F.col("conv_id").cast("string"))))


@registered("FN-10_front_matter", duck("select name, 'Last: ' || split_part(split_part(text, 'Last: ', 2), chr(10), 1) as title, 'a' || substr(split_part(text, '[a', 2), 1, 1) || '|b' as tags, len(split_part(text, chr(10) || '---' || chr(10), 2)) as body_chars from notes", NOTES))
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = view(spark, sf_dir, "notes", NOTES).withColumn("m", T.front_matter(F.col("text")))
    return n.select("name", F.element_at("m", F.lit("title")).alias("title"), F.array_join(T.list_value(F.element_at("m", F.lit("tags"))), "|").alias("tags"), F.length(T.body(F.col("text"))).cast("long").alias("body_chars"))


@registered("FN-11_wikilinks", duck("select name, trim(unnest(regexp_extract_all(text, '\\[\\[([^\\]|#]+)(?:#[^\\]|]*)?(?:\\|[^\\]]*)?\\]\\]', 1))) as target from notes", NOTES))
def wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "notes", NOTES).select("name", F.explode(T.wikilinks(F.col("text"))).alias("target"))


@registered("FN-12_decay", "select event_id, round(value / 100.0 * exp(-0.0001 * (event_id % 5000)), 9) as strength from events")
def decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.round(T.decayed(F.col("value") / 100.0, F.lit(0.0001), F.col("event_id") % 5000), 9).alias("strength"))


@registered("FN-13_recency", "select event_id, round(0.05 * exp(-ln(2) * greatest(0.0, event_id * 60.0 - 600) / 86400.0), 9) as recency from events")
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.round(T.recency(F.col("event_id") * 60.0 - 600), 9).alias("recency"))


@registered("FN-14_audit_hash", """select event_id, sha256('{"operation":"' || event_type || '"}' || sha256(event_id::varchar)) as audit_hash from events""")
def audit_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = C.json_object({"operation": F.col("event_type")})
    return read(spark, sf_dir, "events").select("event_id", C.sha256(F.concat(payload, C.sha256(F.col("event_id").cast("string")))).alias("audit_hash"))


@registered("FN-15_cache_key", "select conv_id, turn, sha256(lower(trim(text)) || '|5|2||s' || conv_id || '|' || turn) as cache_key from conversations")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = F.concat(F.lit("s"), F.col("conv_id").cast("string"))
    key = T.cache_key(F.col("text"), F.lit(5), F.lit(2), F.lit(None).cast("string"), session, F.col("turn"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", key.alias("cache_key"))


@registered(
    "FN-16_context",
    """with l as (select conv_id, turn, '[' || turn || '] [' || role || '] ' || case when len(text) > 400 then substr(text, 1, 400) || '…' else text end as line from conversations),
r as (select *, 23 + sum(len(line)) over (partition by conv_id order by turn) as used from l)
select conv_id, count(*) filter (used <= 6000) as kept, bool_or(used > 6000) as truncated, sha256(coalesce(string_agg(case when used <= 6000 then line end, chr(10) order by turn), '')) as context_sha256 from r group by conv_id""",
)
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in order, each clipped, until one does not fit the budget of the context."""
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] ["), F.col("role"), F.lit("] "), T.clipped(F.col("text")))
    run = F.sum(F.length("line")).over(W.partitionBy("conv_id").orderBy("turn")) + 23
    r = read(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line")).withColumn("used", run)
    fits = F.col("used") <= T.BUDGET
    lines = F.array_sort(F.collect_list(F.when(fits, F.struct("turn", "line"))))  # at most the budget's characters
    return r.groupBy("conv_id").agg(F.count_if(fits).alias("kept"), F.bool_or(~fits).alias("truncated"), C.sha256(F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("context_sha256"))


@registered("FN-17_sanitised", "select page_id, trim(url) as id, len(trim(url)) <= 24 as accepted, case when len(url) <= 24 then url else substr(url, 1, 23) || '...' end as shown from pages")
def sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.trim("url").alias("id"), (F.length(F.trim("url")) <= 24).alias("accepted"), T.truncated(F.col("url"), 24).alias("shown"))


REQUIRED = ["provider", "model", "revision", "dimension", "preprocessing", "input_content_hash", "output_vector_hash", "quantization_protocol"]


def provenance_faults(p: str, vector_sha256, content_sha256):
    """Names of the faults of a provenance map, in order."""
    get = lambda k: F.element_at(p, F.lit(k))
    missing = F.exists(F.array(*map(F.lit, REQUIRED)), lambda k: ~F.map_contains_key(p, k))
    rest = F.array(
        F.when(get("quantization_protocol") != "1.0.0", "QUANTIZATION"), F.when(~F.coalesce(get("dimension").rlike("^[1-9][0-9]*$"), F.lit(False)), "DIMENSION"),
        F.when(get("output_vector_hash") != vector_sha256, "VECTOR"), F.when((get("preprocessing") == "none") & (get("input_content_hash") != content_sha256), "CONTENT"),
    )
    return F.when(missing, F.array(F.lit("MISSING"))).otherwise(F.array_compact(rest))


@registered("FN-18_provenance", "select vec_id, case vec_id % 6 when 1 then 'MISSING' when 2 then 'QUANTIZATION' when 3 then 'DIMENSION' when 4 then 'VECTOR,CONTENT' when 5 then 'CONTENT' else '' end as faults from embeddings")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id") % 6
    v, c = F.sha2(F.col("vec_id").cast("string").cast("binary"), 256), F.sha2(F.col("label").cast("string").cast("binary"), 256)
    fields = {
        "provider": F.lit("p"), "model": F.lit("m"), "revision": F.lit("1"), "dimension": F.when(k == 3, "0").otherwise("64"), "preprocessing": F.lit("none"), "input_content_hash": F.when(k.isin(4, 5), "x").otherwise(c),
        "output_vector_hash": F.when(k == 4, "x").otherwise(v), "quantization_protocol": F.when(k == 2, "9.0.0").otherwise("1.0.0"),
    }
    p = F.map_filter(F.create_map(*[x for n, f in fields.items() for x in (F.lit(n), f)]), lambda n, _: (k != 1) | (n != "model"))
    return read(spark, sf_dir, "embeddings").withColumn("p", p).select("vec_id", F.array_join(provenance_faults("p", v, c), ",").alias("faults"))


def used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decision_id and the sorted ids that it used (the lines of one order)."""
    return view(spark, sf_dir, "uses", USES).groupBy("decision_id").agg(F.array_sort(F.collect_set("memory_id")).alias("used"))


def decision_body(policy: str = "p1") -> dict:
    return {"decision_id": F.concat(F.lit("d"), F.col("decision_id").cast("string")), "policy_version": policy, "used": C.Raw(C.json_array(F.col("used")))}


@registered("FN-19_decision_hash", duck("""select decision_id, sha256('{"decision_id":"d' || decision_id || '","policy_version":"p1","used":[' || string_agg('"' || memory_id || '"', ',' order by memory_id) || ']}') as record_sha256 from uses group by decision_id""", USES))
def decision_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return used(spark, sf_dir).select("decision_id", C.sha256(C.json_object(decision_body())).alias("record_sha256"))


def receipt_body() -> dict:
    n = lambda x: C.Number(F.lit(x))
    return {
        "query_sha256": C.sha256(F.concat(F.lit("q"), F.col("decision_id").cast("string"))), "seed_memory_id": F.element_at("used", 1), "served": C.Raw(C.json_array(F.col("used"))), "excluded_custody": n(0), "excluded_forgotten": n(0),
        "excluded_inhibited": n(0), "top_k": C.Number(F.size("used")), "hops": n(2), "ranking_protocol": "1.0.0", "custody_override": [], "as_of": None,
    }


_RECEIPT = """
r as (select decision_id, sha256('{"as_of":null,"custody_override":[],"excluded_custody":0,"excluded_forgotten":0,"excluded_inhibited":0,"hops":2,"query_sha256":"' || sha256('q' || decision_id) || '","ranking_protocol":"1.0.0","seed_memory_id":"' || min(memory_id)
             || '","served":[' || string_agg('"' || memory_id || '"', ',' order by memory_id) || '],"top_k":' || count(*) || '}') as receipt_sha256 from uses group by decision_id)"""


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return used(spark, sf_dir).withColumn("receipt_sha256", C.sha256(C.json_object(receipt_body())))


@registered("FN-20_receipt_digest", duck(_RECEIPT + "\nselect * from r", USES))
def receipt_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts(spark, sf_dir).select("decision_id", "receipt_sha256")


@registered("VER-11_receipts", duck("select decision_id, decision_id % 5 = 2 as edited from uses group by decision_id", USES))
def verified_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts whose key does not follow from their columns; every fifth had an id added after it was sealed."""
    r = receipts(spark, sf_dir).withColumn("used", F.when(F.col("decision_id") % 5 == 2, F.concat("used", F.array(F.lit("zz")))).otherwise(F.col("used")))
    return r.select("decision_id", (C.sha256(C.json_object(receipt_body())) != F.col("receipt_sha256")).alias("edited"))


@registered("SNK-11_persist_receipt", duck(_RECEIPT + "\nselect receipt_sha256, min(decision_id) as decision_id from r where decision_id % 4 <> 1 and decision_id % 5 <> 2 group by receipt_sha256", USES))
def persisted_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows of the receipt table: those whose digest recomputes and that are not in it yet; the same receipt twice is one row."""
    r = receipts(spark, sf_dir)
    held = r.where("decision_id % 4 = 1").select("receipt_sha256")
    edited = r.withColumn("used", F.when(F.col("decision_id") % 5 == 2, F.concat("used", F.array(F.lit("zz")))).otherwise(F.col("used")))
    sound = edited.where(C.sha256(C.json_object(receipt_body())) == F.col("receipt_sha256"))
    twice = sound.unionByName(sound)
    return twice.join(held, "receipt_sha256", "left_anti").groupBy("receipt_sha256").agg(F.min("decision_id").alias("decision_id"))


@registered("FN-21_json_extract", "select event_id, json_extract_string(props, '$.k') as k from events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@registered("FN-22_strict_json", "select event_id, case event_id % 4 when 0 then 'NOT_JSON' when 1 then 'NOT_JSON' when 2 then 'NOT_CANONICAL' end as fault from events")
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeated key, NaN, white space and a sound payload in turn."""
    k = F.col("event_id") % 4
    text = F.when(k == 0, '{"a":1,"a":2}').when(k == 1, '{"a":NaN}').when(k == 2, '{"a": 1}').otherwise('{"a":{"b":"é"},"c":[1,null]}')
    return read(spark, sf_dir, "events").select("event_id", C.payload_faults(text).alias("fault"))
