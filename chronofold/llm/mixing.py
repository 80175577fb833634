"""Operator 2: mix sources to target weights by weighted fair queueing.

Every document gets a size in words (null text: 0). Sources, ordered by code point with null last,
weigh 1, 2, 3, 1, 2, 3, ... and share the whole budget (the sum of all sizes); a target stops at
``max_repeats`` times its source's size and the excess is shared again by weight. Each source's
documents are put in keyed pseudo-random order and repeated up to ``max_repeats`` times; an item's
virtual finish time is the cumulative source tokens up to its end divided by the source's target.
Items are range-sorted by virtual finish time over the whole mix and the sequence is cut at the budget.

Running sums never gather a source or the mix in one task: rows are dealt to many buckets along the
sort order, buckets get an offset from their sums, and a window runs inside each bucket only.

Edge cases: null or empty text has size 0 and is never taken (taken 0); null sources form one source,
ordered last; null ids are ids; repeated rows are separate documents, with keys of their own; a very long text is
one item, taken whole or not; items of equal finish time go by source, epoch, key and id; an empty table gives an
empty result; a corpus without words has all targets 0. Extra columns, whatever their names, are ignored by ``mix``
and kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm._util import materialize, n_words, numbered, ranked, settled, table

ROWS_PER_BUCKET = 1000
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(skey, source_size, weight, target): water-filling of the budget over the sources."""
    per = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    per = ranked(per, [F.col("source").isNull(), F.col("source")], "rank")
    per = materialize(per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))))
    cap = F.lit(max_repeats) * F.col("source_size")
    level, capped = None, -1
    while True:  # at most once a source; only sums come to the driver
        over = F.lit(False) if level is None else cap < F.lit(level) * F.col("weight")
        x = per.agg(
            F.sum("source_size").alias("budget"),
            F.sum(F.when(over, cap).otherwise(0)).alias("fixed"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(F.when(over, 1).otherwise(0)).alias("n"),
        ).first()
        if x["budget"] is None or x["n"] == capped or not x["weight"]:
            break
        capped, level = x["n"], (x["budget"] - x["fixed"]) / x["weight"]
    return per.select("skey", "source_size", "weight", F.least(cap.cast("double"), F.lit(level or 0.0) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The mix as (items, sizes).

    items: doc_id, source, size, epoch, finish, begins; one row per taken repeat, ``begins`` being the
    words of the mix before it. sizes: doc_id, source, size, source_size, target, taken; one row per document.
    """
    row = ["row"]
    ident = F.col("doc_id.id") if dict(docs.dtypes)["doc_id"].startswith("struct") else F.col("doc_id")
    sized = materialize(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), "text")
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("skey", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))))
        .withColumn("ident", F.concat_ws(":", F.coalesce(ident.cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))
        .drop("text")
    )
    # equal rows get keys of their own, so that they spread like others
    several = materialize(sized.groupBy("ident").agg(F.count("*").alias("n")).where("n > 1").select("ident"))
    copies = F.lit(0).cast("long")
    if several.limit(1).count():
        again = numbered(sized.join(several, "ident", "left_semi").select("row", "ident"), ["ident"], "copy").select("row", "copy")
        sized = sized.join(again, "row", "left")
        copies = F.coalesce("copy", copies)
    sized = materialize(sized.withColumn("key", F.md5(F.concat_ws(":", "ident", copies.cast("string"), F.lit(seed)).cast("binary"))).drop("ident", "copy"))
    buckets = max(16, sized.count() // ROWS_PER_BUCKET)
    targets = materialize(source_targets(sized, weights, max_repeats))
    budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    order = [F.col("key"), F.col("doc_id"), F.col("size"), F.col("row")]
    dealt = sized.where("size > 0").withColumn("b", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * buckets / float(1 << 32)))
    sums = dealt.groupBy("skey", "b").agg(F.sum("size").alias("s"))
    before = sums.select("skey", "b", (F.sum("s").over(W.partitionBy("skey").orderBy("b")) - F.col("s")).alias("before"))
    placed = (
        dealt.withColumn("upto", F.sum("size").over(W.partitionBy("skey", "b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
        .join(before, ["skey", "b"])
        .join(targets, "skey")
        .withColumn("upto", F.col("upto") + F.col("before"))
    )
    items = (
        placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("epoch"))
        .withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("upto")).cast("double") / F.col("target"))
        .withColumn("g", F.floor(F.col("finish") * buckets))
        .select("doc_id", "source", "size", "row", "key", "skey", "epoch", "finish", "g")
    )
    items = materialize(items)
    totals = ranked(items.groupBy("g").agg(F.sum("size").alias("s")), [F.col("g")], "r")
    # offsets of the buckets along the mix: blocks of buckets first, then buckets inside a block
    totals = materialize(totals.withColumn("block", F.floor(F.col("r") / 1024)))
    blocks = totals.groupBy("block").agg(F.sum("s").alias("bs"))
    blocks = blocks.select("block", (F.sum("bs").over(W.orderBy("block")) - F.col("bs")).alias("block_before"))
    offsets = (
        totals.withColumn("in_block", F.sum("s").over(W.partitionBy("block").orderBy("g")) - F.col("s"))
        .join(blocks, "block")
        .select("g", (F.col("in_block") + F.col("block_before")).alias("offset"))
        .where(F.col("offset") < F.lit(budget))
    )
    along = W.partitionBy("g").orderBy("finish", F.col("skey") == "n", "skey", "epoch", *order)
    taken = (
        items.join(offsets, "g")
        .withColumn("begins", F.sum("size").over(along.rowsBetween(W.unboundedPreceding, 0)) - F.col("size") + F.col("offset"))
        .where(F.col("begins") + F.col("size") <= F.lit(budget))
    )
    per_doc = taken.groupBy("row").agg(F.sum("size").alias("taken"))
    sizes = (
        sized.join(per_doc, row, "left")
        .join(targets, "skey")
        .select("doc_id", "source", "row", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )
    return taken.select("doc_id", "source", "row", "size", "epoch", "finish", "begins"), sizes


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, a row for each time that the mix takes one."""
    doc = F.col("doc")
    packed = docs.select(F.struct(*docs.columns).alias("doc"))
    packed = packed.select("doc", doc["doc_id"].alias("id"), F.xxhash64(doc["text"].cast("string")).alias("txh"), doc["source"].cast("string").alias("source"))
    asked = packed.select(F.struct("id", "txh").alias("doc_id"), "source", doc["text"].alias("text"))
    sizes = settled(docs.sparkSession, lambda: mix(asked, **how)[1].select("doc_id", "source", "size", "taken"))
    per = sizes.where("taken > 0").groupBy(F.col("doc_id.id").alias("of_id"), F.col("doc_id.txh").alias("of_txh"), F.col("source").alias("of_source"))
    per = materialize(per.agg(F.sum((F.col("taken") / F.col("size")).cast("int")).alias("times")))
    joined = packed.join(per, (F.col("txh") == F.col("of_txh")) & F.col("id").eqNullSafe(F.col("of_id")) & F.col("source").eqNullSafe(F.col("of_source")))
    several = materialize(sizes.where("size > 0").groupBy(F.col("doc_id.id").alias("s_id"), F.col("doc_id.txh").alias("s_txh"), F.col("source").alias("s_source")).agg(F.count("*").alias("rows")).where("rows > 1"))
    out = joined.select("doc", F.col("times").cast("int").alias("times"))
    if several.limit(1).count():  # equal rows share their repeats
        same = (F.col("txh") == F.col("s_txh")) & F.col("id").eqNullSafe(F.col("s_id")) & F.col("source").eqNullSafe(F.col("s_source"))
        again = numbered(joined.join(several, same).select("doc", "id", "txh", "source", "times", "rows"), ["txh", "id", "source"], "k")
        share = F.floor(F.col("times") / F.col("rows")) + F.when(F.col("k") < F.col("times") % F.col("rows"), 1).otherwise(0)
        out = joined.join(several, same, "left_anti").select("doc", F.col("times").cast("int").alias("times")).unionByName(again.select("doc", share.cast("int").alias("times")))
    return out.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("again")).select("doc.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sizes = mix(table(spark, sf_dir, "documents"))
    return sizes.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         md5(concat_ws(':', coalesce(cast(doc_id as varchar), 'null'), md5(coalesce(text, '')),
                       cast(row_number() over (partition by doc_id, md5(coalesce(text, ''))) - 1 as varchar), 'mix')) as key
  from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, (row_number() over (order by source is null, source) - 1) % 3 + 1 as weight from s0),
s2 as (select *, row_number() over (order by 3.0 * source_size / weight, source is null, source) as k from s1),
s3 as (select *, ((select sum(source_size) from s2) - coalesce(sum(3 * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0))::double
              / (sum(weight) over (order by k rows between current row and unbounded following))::double as level from s2),
lv as (select min_by(level, k) as level from s3 where level * weight <= 3 * source_size),
t as (select source, source_size, least((3 * source_size)::double, coalesce((select level from lv), 0.0) * weight) as target from s1),
p as (
  select d.*, t.source_size, t.target,
         sum(size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and current row) as upto
  from d join t on d.source is not distinct from t.source where size > 0),
i as (select *, (epoch * source_size + upto)::double / target as finish from p, (values (0), (1), (2)) e(epoch)),
c as (select *, sum(size) over (order by finish, source is null, source, epoch, key, doc_id, size rows between unbounded preceding and current row) as ends from i),
k as (select doc_id, source, size, sum(size)::bigint as taken from c where ends <= (select sum(size) from d) group by all)
select d.doc_id, d.size::bigint as size, t.source_size, t.target, coalesce(k.taken, 0)::bigint as taken
from d join t on d.source is not distinct from t.source
left join k on k.doc_id = d.doc_id and k.source is not distinct from d.source and k.size = d.size
"""
