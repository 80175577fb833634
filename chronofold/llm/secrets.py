"""Operator 5: secret scans with a battery of randomness tests (native: SQL functions only).

Base spans, leftmost and non-overlapping per kind: assign, access, hex (see ``BASE``). Further candidates
are runs of 20 or more characters of base64 or base64url that overlap no base span. For each, the encoding
is inferred from its characters, and three statistics are taken of it: chi-squared of the character counts,
runs (changes of class or half of the alphabet) and serial dependence of neighbours.

Against a uniform draw from the alphabet, a run that any of the three rejects at ``REJECT`` is regular (one
character over and over, an ordered alphabet) and no candidate. Against running text, each statistic has a
mean and variance by the shorter tokens of all documents: the evenness of a text of that length under their
letter frequencies, changes between lower case, upper case and digits at their rate, and the log-likelihood of
pairs of neighbours under their transitions (case folded, digits as one). The three deviations are combined by
Stouffer's method, with correlation ``TIED`` between tests, to the probability that text looks so random.
These probabilities are controlled by Benjamini and Hochberg's procedure, in classes of length over the whole
corpus, on a grid of logarithms of fixed size. Survivors are spans of kind ``random``. Decimal runs are no
candidates: plain numbers look as random as drawn ones.

Offsets are code points, ends exclusive. Edge cases: null and empty texts have no spans, zero counts and the
hash of the empty string; very long texts are read whole, in time in proportion to their length; rows are
independent but for the corpus statistics, so repeated rows and ids give repeated results; ties at the threshold
are kept together; extra columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm._util import materialize, table

#: kind: (pattern, group whose length counts, least length)
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
RUN = r"[A-Za-z0-9+/_=-]{20,}"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: encoding: (pattern of the whole run, alphabet in order); the first that fits holds.
ENCODINGS = {
    "decimal": ("^[0-9]+$", DIGITS),
    "hex": ("^[0-9a-f]+$", DIGITS + "abcdef"),
    "hex_upper": ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    "lower": ("^[a-z]+$", LOWER),
    "upper": ("^[A-Z]+$", UPPER),
    "letters": ("^[A-Za-z]+$", UPPER + LOWER),
    "base32": ("^[A-Z2-7]+$", UPPER + "234567"),
    "base36": ("^[a-z0-9]+$", DIGITS + LOWER),
    "base36_upper": ("^[A-Z0-9]+$", DIGITS + UPPER),
    "base64": ("", UPPER + LOWER + DIGITS + "+/"),
}
#: Encodings of one class of characters, whose changes of class say nothing.
ONE_CLASS = ("decimal", "lower", "upper")
REJECT, FDR, GRID, TIED = 0.001, 0.01, 20, 0.5
#: Share of characters of running text that are not letters, in encodings that have others.
OTHER = 0.1
FOLD = 256
TOKEN, SHORTER = r"[A-Za-z0-9]{2,}", 20


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end>> of the matches whose group has the least length.

    Offsets are running sums of the lengths of gaps and matches: folds over blocks of ``FOLD`` matches, then a fold
    over the blocks, so that many matches of one text do not cost their square.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    none = F.array().cast("array<struct<start:int,end:int,n:int>>")
    sizes = F.zip_with(F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own"))), counted, lambda x, c: F.struct(x["gap"].alias("gap"), x["own"].alias("own"), F.length(c).alias("n")))

    def block(part: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            span = F.struct(start.alias("start"), (start + x["own"]).alias("end"), x["n"].alias("n"))
            return F.struct((start + x["own"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / FOLD).cast("int")), lambda i: block(F.slice(sizes, i * FOLD + 1, F.lit(FOLD))))

    def follow(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))

    def shifted(x: Column, by: Column) -> Column:
        return F.transform(x["out"], lambda y: F.struct((y["start"] + by).alias("start"), (y["end"] + by).alias("end"), y["n"].alias("n")))

    starts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), follow, lambda acc: acc["starts"])
    spans = F.filter(F.flatten(F.zip_with(blocks, starts, shifted)), lambda y: y["n"] >= least)
    kept = F.transform(spans, lambda y: F.struct(y["start"].alias("start"), y["end"].alias("end")))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def phi(z: Column) -> Column:
    """The normal distribution function, by a logistic fit."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1.0 / (1.0 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _by_encoding(name: Column, f) -> Column:
    out = F.lit(None)
    for k, (_, alphabet) in ENCODINGS.items():
        out = F.when(name == k, f(k, alphabet)).otherwise(out)
    return out


def battery(runs: DataFrame) -> DataFrame:
    """Adds encoding, n, k, x2 and the p-values p_chi, p_runs, p_serial to rows with a column run."""
    plain = F.translate(F.regexp_replace("run", "=+", ""), "-_", "+/")
    df = runs.withColumn("body", plain).where(F.length("body") > 1)
    kind = F.lit("base64")
    for k, (pattern, _) in reversed(ENCODINGS.items()):
        if pattern:
            kind = F.when(F.col("body").rlike(pattern), k).otherwise(kind)
    df = df.withColumn("encoding", kind).withColumn("n", F.length("body").cast("double"))
    df = df.withColumn("alphabet", _by_encoding(F.col("encoding"), lambda _, a: F.lit(a)))
    df = df.withColumn("k", F.length("alphabet").cast("double"))
    squares = F.aggregate(F.split("alphabet", ""), F.lit(0.0), lambda a, c: a + F.pow(F.length("body") - F.length(F.replace(F.col("body"), c, F.lit(""))), F.lit(2.0)))
    df = df.withColumn("x2", F.col("k") / F.col("n") * squares - F.col("n"))
    df = df.withColumn("p_chi", 1.0 - phi((F.col("x2") - (F.col("k") - 1)) / F.sqrt(2 * (F.col("k") - 1) * (F.col("n") - 1) / F.col("n"))))
    bits = _by_encoding(F.col("encoding"), lambda _, a: F.translate("body", a, "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2)))
    df = df.withColumn("bits", bits)
    df = df.withColumn("n1", F.length(F.translate("bits", "0", "")).cast("double")).withColumn("n0", F.col("n") - F.col("n1"))
    turns = 1.0 + F.regexp_count("bits", F.lit("01")) + F.regexp_count("bits", F.lit("10"))
    both = 2 * F.col("n1") * F.col("n0")
    variance = both * (both - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1))
    df = df.withColumn("p_runs", F.when(variance > 0, 2 * phi(-F.abs((turns - 1 - both / F.col("n")) / F.sqrt(variance)))).otherwise(0.0))
    df = df.withColumn("at", F.transform(F.split("body", ""), lambda c: F.instr(F.col("alphabet"), c).cast("double")))
    df = df.withColumn("mean", F.aggregate("at", F.lit(0.0), lambda a, v: a + v) / F.col("n"))
    df = df.withColumn("dev", F.transform("at", lambda v: v - F.col("mean")))
    total = F.aggregate("dev", F.lit(0.0), lambda a, v: a + v * v)
    lagged = F.aggregate(F.zip_with("dev", F.slice("dev", F.lit(2), F.size("dev")), lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)
    df = df.withColumn("p_serial", F.when(total > 0, 2 * phi(-F.abs((lagged / total + 1 / F.col("n")) * F.sqrt("n")))).otherwise(0.0))
    return df.drop("body", "alphabet", "bits", "n1", "n0", "at", "mean", "dev")


def length_class(n: Column) -> Column:
    """20-23, 24-31, 32-47, 48-95, ...: two classes in each doubling from 24."""
    return F.when(n < 24, 0).otherwise(1 + F.floor(2 * F.log2(n / 24.0 + 1e-9)).cast("int"))


class Text:
    """What running text looks like, by the counts of pairs of neighbours in its tokens."""

    def __init__(self, pairs: dict[str, int]):
        import math

        symbols = LOWER + "0"
        fold = lambda c: "0" if c in DIGITS else c.lower()
        kind = lambda c: (c in DIGITS) + 2 * (c in UPPER)
        n = {a: dict.fromkeys(symbols, 0.5) for a in symbols}
        for p, c in pairs.items():
            n[fold(p[0])][fold(p[1])] += c
        total = sum(sum(x.values()) for x in n.values())
        self.log = {a + b: math.log(n[a][b] / sum(n[a].values())) for a in symbols for b in symbols}
        share = {a + b: n[a][b] / total for a in symbols for b in symbols}
        self.mean = sum(share[p] * self.log[p] for p in share)
        self.variance = sum(share[p] * (self.log[p] - self.mean) ** 2 for p in share)
        changes = sum(c for p, c in pairs.items() if kind(p[0]) != kind(p[1]))
        self.changes = min(0.5, max(0.05, changes / max(1, sum(pairs.values()))))
        first = {a: sum(n[a].values()) for a in LOWER}
        letters = sum(first.values())
        self.q2, self.q3 = (sum((x / letters) ** k for x in first.values()) for k in (2, 3))


def text_model(docs: DataFrame) -> Text:
    """From all tokens of all documents that are too short to be candidates; 62 x 62 counts at most come to the driver."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(TOKEN), F.lit(0))).alias("w")).where(F.length("w") < SHORTER)
    pairs = words.groupBy("w").agg(F.count("*").alias("c")).select("c", F.explode(F.regexp_extract_all("w", F.lit("(?=(..))"), F.lit(1))).alias("p"))
    return Text({r["p"]: r["c"] for r in pairs.groupBy("p").agg(F.sum("c").alias("c")).collect()})


def against_text(tested: DataFrame, model: Text) -> DataFrame:
    """Adds z_even, z_runs, z_serial (positive: less like text) and p_text, which combines them."""
    others = _by_encoding(F.col("encoding"), lambda _, a: F.lit(float(sum(c not in UPPER + LOWER for c in a))))
    share = F.when(others > 0, F.lit(1 - OTHER)).otherwise(1.0)
    s2 = share * share * model.q2 + F.when(others > 0, OTHER * OTHER / others).otherwise(0.0)
    s3 = share * share * share * model.q3 + F.when(others > 0, OTHER**3 / (others * others)).otherwise(0.0)
    n, k = F.col("n"), F.col("k")
    # moments of the number of equal pairs of characters in a draw from these frequencies
    mean = k * ((n - 1) * s2 + 1) - n
    pairs = n * (n - 1) / 2
    variance = pairs * (s2 - s2 * s2) + n * (n - 1) * (n - 2) * (s3 - s2 * s2)
    df = tested.withColumn("z_even", (mean - F.col("x2")) / (2 * k / n * F.sqrt(F.greatest(variance, F.lit(1e-9)))))
    near = F.regexp_extract_all("run", F.lit("(?=([A-Za-z0-9]{2}))"), F.lit(1))
    df = df.withColumn("near", near).withColumn("m", F.size("near").cast("double"))
    kinds = F.translate("run", LOWER + UPPER + DIGITS, "a" * 26 + "A" * 26 + "0" * 10)
    changes = F.size(F.regexp_extract_all(kinds, F.lit("(?=(aA|Aa|a0|0a|A0|0A))"), F.lit(1))).cast("double")
    r = model.changes
    df = df.withColumn("z_runs", F.when((F.col("m") > 0) & ~F.col("encoding").isin(*ONE_CLASS), (changes - 0.5 - F.col("m") * r) / F.sqrt(F.col("m") * r * (1 - r))))
    logs = F.create_map(*[F.lit(x) for p, v in model.log.items() for x in (p, v)])
    total = F.aggregate("near", F.lit(0.0), lambda a, p: a + F.element_at(logs, F.translate(F.lower(p), DIGITS, "0" * 10)))
    df = df.withColumn("z_serial", F.when(F.col("m") > 0, (F.col("m") * model.mean - total) / F.sqrt(F.col("m") * max(model.variance, 1e-9))))
    tests = F.filter(F.array("z_even", "z_runs", "z_serial"), lambda z: z.isNotNull())
    many = F.size(tests)
    z = F.aggregate(tests, F.lit(0.0), lambda a, z: a + z) / F.sqrt(many + many * (many - 1) * F.lit(TIED))
    return df.withColumn("p_text", F.when(F.col("encoding") == "decimal", F.lit(1.0)).otherwise(phi(-z))).drop("near", "m")


def discoveries(tested: DataFrame, model: Text) -> DataFrame:
    """Rows that no test rejects as a uniform draw and that stay under the false-discovery rate of their length class."""
    alpha = F.lit(REJECT)
    df = materialize(against_text(tested, model).select("row", "start", "end", "run", "n", "p_chi", "p_runs", "p_serial", "p_text")).withColumn("length_class", length_class(F.col("n")))
    df = df.withColumn("p", F.when((F.col("p_chi") >= alpha) & (F.col("p_runs") >= alpha) & (F.col("p_serial") >= alpha), F.col("p_text")).otherwise(1.0))
    df = df.withColumn("bin", F.floor(-F.log10(F.greatest("p", F.lit(1e-20))) * GRID).cast("int"))
    bins = df.groupBy("length_class", "bin").agg(F.count("*").alias("c"))  # at most 401 bins a class
    w = W.partitionBy("length_class")
    bins = bins.withColumn("m", F.sum("c").over(w)).withColumn("r", F.sum("c").over(w.orderBy(F.desc("bin"))))
    least = bins.where(F.pow(F.lit(10.0), -F.col("bin") / GRID) <= FDR * F.col("r") / F.col("m")).groupBy("length_class").agg(F.min("bin").alias("least"))
    return df.join(F.broadcast(least), "length_class").where("bin >= least").drop("least")


def _named(kind: str, rank: int) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans array<struct<start, rank, end, kind>> of each document, sorted."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select("doc_id", text.alias("text"))
    for kind, (pattern, group, least) in BASE.items():
        df = df.withColumn(kind, _spans(F.col("text"), kind, pattern, group, least))
    df = df.withColumn("run", _spans(F.col("text"), "run", RUN, 0, 20))
    base = F.concat(*[_named(k, i) for i, k in enumerate(BASE)])
    free = F.filter("run", lambda r: ~F.exists("base", lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"])))
    df = df.withColumn("base", base).withColumn("free", F.transform(free, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.substring(F.col("text"), r["start"] + 1, r["end"] - r["start"]).alias("run"))))
    found = materialize(df.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.array_sort("base").alias("base"), "free"))
    runs = found.where(F.size("free") > 0).select("row", F.explode("free").alias("f")).select("row", "f.*")
    tested = materialize(battery(runs))
    more = discoveries(tested, text_model(df)).groupBy("row").agg(F.collect_list(F.struct(F.col("start"), F.lit(len(BASE)).alias("rank"), F.col("end"), F.lit("random").alias("kind"))).alias("more"))
    out = found.join(more, "row", "left")
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", empty))).alias("spans"))


def _told(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(_count, BASE), F.sha2(_told(F.col("base")).cast("binary"), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))
