"""Operator 3: fuzzy line deduplication (native: SQL functions only).

A line is normalised (lower case, runs of anything but letters and digits as one space, trimmed). Lines of
equal normal form are one node. A node's SimHash has ``BLOCKS`` blocks of 16 bits. Every block sums the
hashed words of the line with weights of its own: longer words weigh more, and a hash of word and block
gives a long-tailed factor, so that a few words decide a block and a small edit leaves most blocks as they
are. Two nodes link if ``AGREE`` blocks or more are equal (pigeonhole: an edit must change all but one to
part them), at most ``BITS`` bits differ in all (``SHORT_BITS`` in short lines), and their edit similarity, 1 -
distance / longer length, is ``SIMILARITY`` or more. Candidates come from a join on each choice of ``AGREE`` blocks as a key of 32 bits. Of each connected group of nodes, the
occurrence with the smallest doc_id, then the first in the table, stays.

The blocks do not depend on the corpus or its size. How many pairs of that edit similarity have too few equal
blocks is measured by ``tests/llm/test_line_dedup.py`` and told in the README.

Large keys are parted by length, as lines of unlike lengths cannot link, and dealt to tiles. The ``LEADERS`` of
each tile are compared with its other nodes first; then nodes outside the largest component of a key's part are
compared with all others of it that are not joined to them yet, block by block. A pair that meets in several keys is
compared in the first of them. So a large group of alike lines gives a number of pairs in proportion to its size, and
no link is lost.

Edge cases: null and empty texts have no lines to drop; blank lines (no letter or digit) always stay; a line is
hashed by all its words, however long: in pieces of ``PIECE`` words, whose sums are added; ties of a bit's weights give 0; repeated rows are documents of their own, so all but one of them lose their
lines; null ids sort first; other columns are kept by ``dedup_documents``, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.llm._util import components, materialize, maybe_in, settled, table

BLOCKS, AGREE, SIMILARITY, TILE, ACROSS = 5, 2, 0.9, 16, 1024
#: Nodes of a tile that are compared with all others of it at first.
LEADERS = 2
#: Bits that may differ, and in lines of fewer characters, whose few words weigh more each.
BITS, SHORT, SHORT_BITS = 12, 80, 17
#: The largest weight, and the scale and offset of the weights.
HEAVIEST, SCALE, OFFSET, LONGEST_WORD = 31, 0.02, 20, 12
#: Words summed at once: the sums of as many stay in their lanes (PIECE * HEAVIEST <= 2^14).
PIECE = 512
#: Words of a line beyond which some are left out, or repeated ones count once: no line has as many, so none are.
WORDS = MANY = 1 << 31
#: A bit's weights are summed four a long, in lanes of 16 bits; a block takes 4 longs, and a hash of a word 4 blocks.
LANES, LANE_TOP, PER_BLOCK = 0x0001000100010001, 0x4000400040004000, 4
#: A small distance is tried before the whole budget, as the cost goes with the distance allowed.
FIRST_TRY, PAIRS_A_TASK = 16, 2000
#: Nodes sampled to find hot keys, and a bound of their number.
ONE_IN, MOST_HOT = 64, 10000
#: Tables that grow with the corpus are not broadcast, however small they are here.
MERGE = "merge"
NOT_BLANK = r"[\p{L}\p{N}]"


def words_of(line: Column) -> Column:
    """Words of the normal form."""
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), "")


def normal(line: Column) -> Column:
    return F.array_join(words_of(line), " ")


def _lines(docs: DataFrame) -> DataFrame:
    """Lines that are not blank: doc_id, row, txh, line, lid, two hashes of the normal form, its length and words."""
    text = F.col("text").cast("string")
    rows = docs.where("text is not null").select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("txh"), text.alias("text"))
    lines = rows.select("doc_id", "row", "txh", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    lines = lines.where(F.col("raw").rlike(NOT_BLANK)).select("doc_id", "row", "txh", "line", F.monotonically_increasing_id().alias("lid"), words_of(F.col("raw")).alias("words"))
    return lines.select("doc_id", "row", "txh", "line", "lid", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"), F.length(F.array_join("words", " ")).alias("len"), "words")


def _bits(h: Column, at: int, mask: int) -> Column:
    return F.shiftrightunsigned(h, at).bitwiseAND(F.lit(mask).cast("long"))


def occurrences(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """Lines that are not blank: doc_id, row, txh, line, lid, h1, h2, len, and the blocks in sim1 (four) and sim2."""
    kept = ["doc_id", "row", "txh", "line", "h1", "h2", "len"]
    words = _lines(docs).select("lid", *kept, (F.size("words") > piece).alias("long_line"), F.posexplode("words").alias("i", "w"))
    words = words.select("lid", *kept, "long_line", F.floor(F.col("i") / piece).alias("piece"), F.xxhash64("w").alias("a"), F.least(F.lit(LONGEST_WORD), F.length("w")).alias("long"))
    words = words.withColumn("b", F.xxhash64("a")).withColumn("u", F.xxhash64("b"))
    words = words.select("lid", *kept, "long_line", "piece", "a", "b", *[_weight(k).alias(f"w{k}") for k in range(BLOCKS)])
    sums = [F.sum(f"w{k}").alias(f"t{k}") for k in range(BLOCKS)]
    for k in range(BLOCKS):
        for j in range(PER_BLOCK):
            sums.append(F.sum(_bits(F.col("ab"[k // 4]), k % 4 * PER_BLOCK + j, LANES) * F.col(f"w{k}")).alias(f"s{k}_{j}"))
    one = {f.name: F.max if isinstance(f.dataType, T.NumericType) else F.first for f in words.schema.fields}
    of = [*kept, "long_line"]
    parts = words.groupBy("lid", "piece").agg(*[one[c](c).alias(c) for c in of], *sums)
    raw = F.struct(*[f"t{k}" for k in range(BLOCKS)], *[f"s{k}_{j}" for k in range(BLOCKS) for j in range(PER_BLOCK)])
    parts = parts.select("lid", *kept, F.when(F.col("long_line"), raw).alias("raw"), *[_block(k).alias(f"v{k}") for k in range(BLOCKS)])
    parts = materialize(_packed(parts, kept, "raw"))
    lines, long = parts.where("raw is null").drop("raw"), parts.where("raw is not null")
    return lines.unionByName(materialize(_packed(_added(long, kept, one), kept))) if long.limit(1).count() else lines


def _packed(lines: DataFrame, kept: list[str], *more: str) -> DataFrame:
    """The blocks v0 to v4 in sim1 and sim2."""
    sim1 = F.col("v0")
    for k in (1, 2, 3):
        sim1 = sim1.bitwiseOR(F.shiftleft(f"v{k}", 16 * k))
    return lines.select("lid", *kept, sim1.alias("sim1"), F.col("v4").alias("sim2"), *more)


def _added(parts: DataFrame, kept: list[str], one: dict) -> DataFrame:
    """Lines of several pieces: each bit's weights are added on their own, as many as there are."""
    lane = lambda k, j, n: _bits(F.col(f"raw.s{k}_{j}"), 16 * n, 0xFFFF)
    places = [(k, j, n) for k in range(BLOCKS) for j in range(PER_BLOCK) for n in range(4)]
    sums = [F.sum(f"raw.t{k}").alias(f"t{k}") for k in range(BLOCKS)] + [F.sum(lane(k, j, n)).alias(f"c{k}_{j}_{n}") for k, j, n in places]
    lines = parts.groupBy("lid").agg(*[one[c](c).alias(c) for c in kept], *sums)

    def block(k: int) -> Column:
        out = F.lit(0).cast("long")
        for j in range(PER_BLOCK):
            for n in range(4):
                out = out.bitwiseOR(F.when(2 * F.col(f"c{k}_{j}_{n}") > F.col(f"t{k}"), F.lit(1 << (4 * n + j))).otherwise(F.lit(0)).cast("long"))
        return out

    return lines.select("lid", *kept, *[block(k).alias(f"v{k}") for k in range(BLOCKS)])


#: The factor of a word's weight by ten bits of its hash, with a long tail.
FACTORS = [SCALE / ((u + OFFSET) / 1024) ** 1.5 for u in range(1024)]


def _weight(k: int) -> Column:
    """Weight of a word in block k: its squared length times a factor by its hash."""
    factor = F.element_at(F.lit(FACTORS), (_bits(F.col("u"), 10 * k, 1023) + 1).cast("int"))
    return F.least(F.lit(HEAVIEST), F.greatest(F.lit(1), F.floor(F.col("long") * F.col("long") * factor))).cast("long")


def _block(k: int) -> Column:
    """16 bits, each set where more than half of the weight has it: in a lane, bit 14 of 2 s + (2^14 - 1 - t)."""
    out = F.lit(0).cast("long")
    for j in range(PER_BLOCK):
        over = (2 * F.col(f"s{k}_{j}") + (F.lit(0x3FFF) - F.col(f"t{k}")) * F.lit(LANES)).bitwiseAND(F.lit(LANE_TOP))
        out = out.bitwiseOR(F.shiftrightunsigned(over, 14 - j))
    # the lanes hold 4 bits each
    out = out.bitwiseOR(F.shiftrightunsigned(out, 12)).bitwiseOR(F.shiftrightunsigned(out, 24)).bitwiseOR(F.shiftrightunsigned(out, 36))
    return out.bitwiseAND(F.lit(0xFFFF).cast("long"))


def _keys() -> Column:
    """A long for each choice of blocks that agree: the number of the choice and the blocks."""
    blocks = [_bits(F.col("sim1" if k < 4 else "sim2"), 16 * (k % 4), 0xFFFF) for k in range(BLOCKS)]
    return F.array(*[F.lit(i << 32).cast("long").bitwiseOR(F.shiftleft(blocks[a], 16)).bitwiseOR(blocks[b]) for i, (a, b) in enumerate(combinations(range(BLOCKS), AGREE))])


def _near(a: str, b: str, similarity: float) -> Column:
    far = F.bit_count(F.col(f"{a}.sim1").bitwiseXOR(F.col(f"{b}.sim1"))) + F.bit_count(F.col(f"{a}.sim2").bitwiseXOR(F.col(f"{b}.sim2")))
    return (F.least(f"{a}.len", f"{b}.len") >= F.ceil(F.lit(similarity) * F.greatest(f"{a}.len", f"{b}.len") - 1e-9)) & (far <= F.when(F.greatest(f"{a}.len", f"{b}.len") < SHORT, SHORT_BITS).otherwise(BITS))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose normal forms are alike enough."""
    pairs = materialize(pairs)
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    at = used.join(nodes.select("node", "first").hint(MERGE), "node").select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.txh").alias("txh"), F.col("first.line").alias("line"))
    source = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("txh", F.xxhash64("text"))
    where = materialize(at.groupBy("txh", "doc_id").agg(F.collect_list(F.struct("node", "line")).alias("want")))  # lines of one document
    source = maybe_in(source, F.col("txh"), where, F.col("txh"))
    got = source.join(where.hint(MERGE), (source["txh"] == where["txh"]) & source["doc_id"].eqNullSafe(where["doc_id"]))
    parts = got.select(F.split("text", "\n", -1).alias("parts"), "want").select(F.explode("want").alias("w"), "parts")
    lines = materialize(parts.select(F.col("w.node").alias("node"), normal(F.element_at("parts", F.col("w.line") + 1)).alias("norm")).dropDuplicates(["node"]))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // PAIRS_A_TASK))
    both = pairs.join(lines.select(F.col("node").alias("a"), F.col("norm").alias("x")).hint(MERGE), "a").repartition(tasks, "b").join(lines.select(F.col("node").alias("b"), F.col("norm").alias("y")).hint(MERGE), "b")
    return materialize(both.where(_alike(F.col("x"), F.col("y"), similarity)).select("a", "b"))


def _let(value: Column, f) -> Column:
    """f(value), the value being computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _alike(x: Column, y: Column, similarity: float) -> Column:
    """Whether the edit distance is within the budget of the longer text.

    What both begin and end with is cut off first, found by halving, which leaves the distance as it is. Then the
    cheap bounds of the distance go first: the longer rest, unequal words replaced one by one, a small distance.
    """
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])

    def shared(p: Column, q: Column, part) -> Column:
        def halve(m: Column) -> Column:  # the lengths are counted once
            least = F.least(m["p"], m["q"])
            return F.aggregate(F.filter(steps, lambda s: s <= least), F.lit(0), lambda n, s: F.when((n + s <= least) & (part(p, m["p"], n, s) == part(q, m["q"], n, s)), n + s).otherwise(n))

        return _let(F.struct(F.length(p).alias("p"), F.length(q).alias("q")), halve)

    def within(c: Column) -> Column:
        p, q, budget = c["x"], c["y"], c["budget"]
        return (
            F.when(F.greatest(F.length(p), F.length(q)) <= budget, True)
            .when(F.coalesce(word_by_word(p, q) <= budget, F.lit(False)), True)
            .when(F.call_function("levenshtein", p, q, F.least(budget, F.lit(FIRST_TRY))) >= 0, True)
            .when(budget <= FIRST_TRY, False)
            .otherwise(F.call_function("levenshtein", p, q, budget) >= 0)
        )

    def word_by_word(p: Column, q: Column) -> Column:
        """Replace each unequal word; null if the numbers of words differ."""

        def cost(w: Column) -> Column:
            far = F.zip_with(w["p"], w["q"], lambda u, v: F.when(u == v, 0).otherwise(F.greatest(F.length(u), F.length(v))))
            return F.when(F.size(w["p"]) == F.size(w["q"]), F.aggregate(far, F.lit(0), lambda n, d: n + d))

        return _let(F.struct(F.split(p, " ").alias("p"), F.split(q, " ").alias("q")), cost)

    def begun(c: Column) -> Column:
        head = shared(c["x"], c["y"], lambda t, m, n, s: F.substring(t, n + 1, s))
        return _let(head, lambda h: _let(F.struct(F.substring(c["x"], h + 1, F.length(c["x"])).alias("x"), F.substring(c["y"], h + 1, F.length(c["y"])).alias("y"), c["budget"].alias("budget")), ended))

    def ended(c: Column) -> Column:
        tail = shared(c["x"], c["y"], lambda t, m, n, s: F.substring(t, m - n - s + 1, s))
        return _let(tail, lambda h: _let(F.struct(F.substring(c["x"], F.lit(1), F.length(c["x"]) - h).alias("x"), F.substring(c["y"], F.lit(1), F.length(c["y"]) - h).alias("y"), c["budget"].alias("budget")), within))

    budget = F.floor((1 - similarity) * F.greatest(F.length(x), F.length(y)) + 1e-9).cast("int")
    return _let(F.struct(x.alias("x"), y.alias("y"), budget.alias("budget")), begun)


def _first_met(a: str, b: str, tiled: bool) -> Column:
    """Whether the key (of one tile hash, if tiled) and part are the first of all in which two nodes meet.

    Two nodes meet in the keys of the blocks that they have in common, there in the larger of their own classes of length.
    """
    same = [_bits(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}")), 16 * (k % 4), 0xFFFF) == 0 for k in range(BLOCKS) for s in ["sim1" if k < 4 else "sim2"]]
    of = [F.when(same[x] & same[y], F.lit(i)) for i, (x, y) in enumerate(combinations(range(BLOCKS), AGREE))]
    number = F.shiftrightunsigned(f"{a}.key", 32).cast("int")
    first = F.when(number % 2 == 0, F.coalesce(*of[::2])).otherwise(F.coalesce(*of[1::2])) if tiled else F.coalesce(*of)
    return (number == first) & ((F.col(f"{a}.part") == 0) | (F.col(f"{a}.part") == F.greatest(f"{a}.size", f"{b}.size")))


def _candidates(nodes: DataFrame, similarity: float, tile: int, one_in: int = ONE_IN) -> DataFrame:
    """node, len, size, sim1, sim2, key, part, n, tile: nodes that share a key, parted by length where many (part 0: not parted).

    The number of tiles is a power of two and their hash one of two, so that most pairs that meet again in tiles of
    other keys are the same pairs, while tiles of both hashes together join a group of alike lines.

    Keys that stand out in a sample of the nodes are parted at once, with counts by the sample, so that no task
    holds such a key. The counts only set the tiles.
    """
    least = int(1 / (1 - similarity) + 1e-9) - 1  # shorter lines have no other within the similarity
    size = F.floor(F.log(F.col("len").cast("double")) / F.lit(-math.log(similarity))).cast("int") + 1 if similarity < 1 else F.col("len")
    parts = F.array(size, size + 1)
    keyed = nodes.where(F.col("len") >= least).select("node", "len", F.explode(_keys()).alias("key"))
    sample = keyed.where(F.pmod(F.xxhash64("node"), F.lit(one_in)) == 0).select("key", F.explode(parts).alias("part")).groupBy("key", "part").agg(F.count("*").alias("c"))
    seen = materialize(sample.where("c >= 8"))
    stands_out = max(32, (nodes.count() // one_in) // MOST_HOT)
    hot = materialize(seen.groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") >= 2 * stands_out).select("key"))  # at most 10 x MOST_HOT keys
    if hot.limit(1).count():
        of_hot = keyed.join(F.broadcast(hot), "key").withColumn("part", F.explode(parts))
        counted = F.broadcast(seen.join(F.broadcast(hot), "key"))  # by length, some 100 parts of such a key
        split = of_hot.join(counted, ["key", "part"], "left").select("node", "len", "key", F.coalesce(F.col("c") * one_in, F.lit(tile)).cast("long").alias("n"), "part")
        keyed = keyed.join(F.broadcast(hot), "key", "left_anti")
    # the count of a key comes with the rows in one shuffle
    met = keyed.withColumn("n", F.count("*").over(W.partitionBy("key"))).where("n > 1")
    met = materialize(met.select("node", "len", "key", "n", F.explode(F.when(F.col("n") <= tile, F.array(F.lit(0))).otherwise(parts)).alias("part")))
    large = met.where("part > 0").withColumn("n", F.count("*").over(W.partitionBy("key", "part"))).where("n > 1")
    both = met.where("part = 0").unionByName(large)
    both = both.unionByName(split) if hot.limit(1).count() else both
    tiles = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n") / tile, F.lit(1.0))))).cast("long")
    both = both.withColumn("tile", F.pmod(F.xxhash64("node", F.shiftrightunsigned("key", 32) % 2), tiles))
    return materialize(both.withColumn("size", size).join(nodes.select("node", "sim1", "sim2").hint(MERGE), "node"))


def _links(nodes: DataFrame, docs: DataFrame, similarity: float, tile: int, across: int) -> DataFrame:
    """Links (a, b) that join all nodes which the definition joins."""
    met = _candidates(nodes, similarity, tile)
    place = F.row_number().over(W.partitionBy("key", "part", "tile").orderBy("node"))
    l, r = met.withColumn("place", place).where(F.col("place") <= LEADERS).alias("l"), met.alias("r")
    same = (F.col("l.key") == F.col("r.key")) & (F.col("l.part") == F.col("r.part"))
    led = l.join(r, same & (F.col("l.tile") == F.col("r.tile")) & (F.col("l.node") < F.col("r.node")) & _first_met("l", "r", True) & _near("l", "r", similarity))
    told = materialize(led.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct())
    links = _verified(told, nodes, docs, similarity)
    large = met.where(F.col("n") > min(tile, LEADERS + 1))  # smaller groups are one tile, whose leaders meet all others
    if not large.limit(1).count():
        return links
    roots = components(links, "a", "b")
    named = materialize(large.join(roots.hint(MERGE), "node", "left").withColumn("root", F.coalesce("root", "node")))
    of_root = named.groupBy("key", "part", "root").agg(F.count("*").alias("m"))
    main = of_root.groupBy("key", "part").agg(F.max(F.struct("m", (-F.col("root")).alias("r"))).alias("x"), F.count("*").alias("roots")).where("roots > 1").select("key", "part", (-F.col("x.r")).alias("main"))
    blocks = F.ceil(F.col("n") / across)
    named = materialize(named.join(main.hint(MERGE), ["key", "part"]))  # of parts that are not joined whole
    inner = named.withColumn("block", F.pmod(F.xxhash64("node", "part"), blocks))
    outside = named.where("root <> main").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    l, r = outside.alias("l"), inner.alias("r")
    once = (F.col("r.root") == F.col("r.main")) | (F.col("l.node") < F.col("r.node"))
    pairs = l.join(r, same & (F.col("l.block") == F.col("r.block")) & (F.col("l.root") != F.col("r.root")) & once & _first_met("l", "r", False) & _near("l", "r", similarity))
    pairs = pairs.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()
    return links.unionByName(_verified(pairs.join(told.hint(MERGE), ["a", "b"], "left_anti"), nodes, docs, similarity))


def group_lines(docs: DataFrame, similarity: float = SIMILARITY, tile: int = TILE, across: int = ACROSS) -> tuple[DataFrame, DataFrame]:
    """(occurrences, nodes): nodes, by h1 and h2, that have several occurrences or a link, with keep, the lid that stays."""
    lines = occurrences(docs)
    nodes = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "lid", "txh", "line")).alias("first"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("len", "sim1", "sim2")])
    nodes = materialize(nodes.withColumn("node", F.col("first.lid")))
    spark = docs.sparkSession
    links = settled(spark, lambda: _links(nodes, docs, similarity, tile, across))
    linked = settled(spark, lambda: components(links, "a", "b").join(nodes.select("node", "first").hint(MERGE), "node"))
    keep = linked.groupBy("root").agg(F.min("first").alias("keep"))
    kept = linked.join(keep.hint(MERGE), "root").select("node", F.col("keep.lid").alias("keep"))
    named = nodes.select("h1", "h2", "node", "copies").join(kept.hint(MERGE), "node", "left")
    return lines, named.where("copies > 1 or keep is not null").select("h1", "h2", F.coalesce("keep", "node").alias("keep"))


def dropped_lines(docs: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """(occurrences, dropped): dropped has doc_id, txh, row and the sorted numbers of its dropped lines."""
    lines, nodes = group_lines(docs, **how)
    gone = lines.join(nodes.hint(MERGE), ["h1", "h2"]).where(F.col("lid") != F.col("keep"))
    return lines, materialize(gone.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("txh").alias("txh"), F.array_sort(F.collect_list("line")).alias("gone")))


def dedup_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents with their text rid of dropped lines; a document that loses all its lines goes."""
    dropped = settled(docs.sparkSession, lambda: dropped_lines(docs, **how)[1])
    text = F.col("doc")["text"].cast("string")
    packed = docs.select(F.struct(*docs.columns).alias("doc")).select("doc", F.col("doc")["doc_id"].alias("own"), F.xxhash64(text).alias("own_txh"))
    on = (F.col("own_txh") == F.col("txh")) & F.col("own").eqNullSafe(F.col("doc_id"))
    # of rows with equal id and text, one may keep lines and the others lose all
    one = materialize(dropped.groupBy("doc_id", "txh").agg(F.min_by("gone", F.size("gone")).alias("gone"), F.count("*").alias("rows")))
    repeated = materialize(packed.groupBy("own", "own_txh").agg(F.count("*").alias("all")).where(F.col("all") > 1))
    joined = packed.join(one.select("doc_id", "txh", "gone").hint(MERGE), on, "left").drop("doc_id", "txh")
    if repeated.limit(1).count():
        again = materialize(packed.join(repeated.select(F.col("own").alias("doc_id"), F.col("own_txh").alias("txh"), "all"), on).withColumn("at", F.monotonically_increasing_id()).drop("doc_id", "txh"))
        first = again.groupBy("own", "own_txh").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("is_first"))
        every = F.filter(F.sequence(F.lit(0), F.size(F.split(text, "\n", -1)) - 1), lambda i: F.element_at(F.split(text, "\n", -1), i + 1).rlike(NOT_BLANK))
        gone = F.when(F.col("rows").isNull(), None).when(F.col("is_first"), F.when(F.col("rows") >= F.col("all"), F.col("gone"))).otherwise(every)
        again = again.join(first, "at", "left").join(one, on, "left").select("doc", gone.alias("gone"))
        other = repeated.select(F.col("own").alias("i"), F.col("own_txh").alias("t"))
        joined = joined.join(other, (F.col("own_txh") == F.col("t")) & F.col("own").eqNullSafe(F.col("i")), "left_anti").select("doc", "gone").unionByName(again)
    joined = joined.select("doc", "gone")
    kept = F.filter(F.split(text, "\n", -1), lambda p, i: ~F.array_contains(F.col("gone"), i))
    left = F.when(F.col("gone").isNull(), text).otherwise(F.concat_ws("\n", kept))
    joined = joined.select("doc", "gone", left.alias("left"))
    alone = F.col("gone").isNotNull() & ~F.col("left").rlike(NOT_BLANK)
    return joined.where(~F.coalesce(alone, F.lit(False))).select(*[F.col("left").alias(c) if c.lower() == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines, dropped = dropped_lines(docs)
    totals = lines.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n_lines"))
    told = totals.join(dropped.select("row", "gone").hint(MERGE), "row", "left").select("doc_id", "n_lines", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    blank = docs.where(~F.coalesce(F.col("text").cast("string").rlike(NOT_BLANK), F.lit(False))).select("doc_id", F.lit(0).cast("long").alias("n_lines"), F.array().cast("array<int>").alias("gone"))
    out = told.unionByName(blank)
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("gone")).alias("n_kept"), F.concat_ws(",", F.transform("gone", lambda x: x.cast("string"))).alias("dropped_lines"))
