"""Operator 1: toxicity by weak supervision.

Many voters look at a text: lexicon voters (beginnings of words) and pattern voters (repeated hits, dense
hits, and the patterns of ``RULES``: shouting, strings of exclamation marks, masked words, threats, wishes of
harm). Lexicon voters come from a fixed list of insults and from beginnings of words that the labelled rows, all of
them, have nearly only in toxic texts, the ``CANDIDATES`` most frequent of which are tried and ``MAX_VOTERS`` taken at
most; a rule votes if the labelled rows bear it out. Votes of all documents
give first and second moments; a generative label model turns them into accuracies (from triplets of voters
of one block of correlated voters) and residual correlations (which discount voters that say the same
thing twice), and so into a posterior label for any pattern of votes. A logistic regression is trained on the
posterior labels of all rows and scores every document: tasks add up the sums of each Newton step, rows without a vote
being one row that counts as many.

Labels are used only where crc32 of the id's text mod 5 is not 0, and ids, languages and sources are never
inputs of a score. The score is a column expression over the whole text.

Edge cases: null and empty texts get the score of a text without any vote; very long texts are scored whole, by
one pass for the lexicon and one for each rule; rows with equal texts get equal scores; a score of exactly 0.5
predicts 1; voters that tie go by length and code points; an id labelled twice counts as toxic if any label says so; null labels and ids teach nothing; no
labels or only one class leave the fixed list alone; extra columns, whatever their names, are kept by ``clean``, and by
``score`` but for those it adds; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm._util import MERGE, materialize, maybe_in, passing, table

#: Candidates whose sets are counted at once when voters are chosen, and beginnings of words that a task counts at once.
ABREAST, COUNTED = 12, 200000
CANDIDATES, MAX_VOTERS, COVER, LENGTHS = 4000, 160, 4, (3, 4, 5, 6, 7, 8)
#: Fixed list of insults.
INSULTS = ("bastard", "clown", "disgusting", "dumb", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
LETTERS = re.compile(r"[^\W\d_]+")
PATTERNS = ("repeat", "dense")
#: Pattern voters on the text itself.
RULES = {
    "shout": r"(?:\b\p{Lu}{4,}\b[\s!]+){4,}",
    "bangs": r"!{3,}|(?:\?!|!\?){2,}",
    "masked": r"\b\p{L}[*#@$%]{2,}\p{L}*",
    "threat": r"(?i)\b(?:i|we)(?:'ll| will| am going to| are going to) (?:kill|hurt|hit|beat|destroy|find) (?:you|them|him|her)\b",
    "harm": r"(?i)\b(?:go (?:and )?die|shut up|drop dead|hate you|kill yourself|hope you die)\b",
}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    voters: list[str] = field(default_factory=list)
    rules: list[str] = field(default_factory=list)
    accuracy: dict[str, tuple[float, float]] = field(default_factory=dict)  # P(vote | toxic), P(vote | clean)
    correlated: list[tuple[str, str]] = field(default_factory=list)
    weights: dict[str, float] = field(default_factory=dict)  # of the classifier, "" being its constant

    def hits(self, text: Column) -> Column:
        """The voters that hit a text, with repeats."""
        if not self.voters:
            return F.array().cast("array<string>")
        return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(rf"(?<!\p{{L}})({_trie(self.voters)})"), 1), F.array().cast("array<string>"))

    def features(self, hits: Column, text: Column) -> dict[str, Column]:
        n = F.size(hits)
        rules = {k: F.coalesce(text.rlike(RULES[k]), F.lit(False)).cast("double") for k in self.rules}
        return {"repeat": F.log1p(n.cast("double")), "dense": F.least(F.lit(1.0), n * 100.0 / (F.coalesce(F.length(text), F.lit(0)) + 1.0)), **rules}

    def score(self, text: Column) -> Column:
        hits = self.hits(text)
        return self.score_of(hits, text)

    def score_of(self, hits: Column, text: Column) -> Column:
        w = self.weights
        lexicon = F.lit(0.0)
        if self.voters:
            table = F.create_map(*[F.lit(x) for v in self.voters for x in (v, float(w.get(v, 0.0)))])
            lexicon = F.aggregate(F.array_distinct(hits), F.lit(0.0), lambda a, h: a + F.coalesce(F.element_at(table, h), F.lit(0.0)))
        extra = self.features(hits, text)
        z = F.lit(w.get("", -4.0)) + lexicon
        for k, c in extra.items():
            z = z + F.lit(w.get(k, 0.0)) * c
        return 1.0 / (1.0 + F.exp(-z))


def _trie(words: list[str]) -> str:
    """A regular expression for any of the words, by common beginnings; none is the beginning of another."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})

    def walk(t: dict) -> str:
        parts = [c + walk(x) for c, x in sorted(t.items())]
        return "" if not parts else parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return walk(tree)


def _starts(text: str | None) -> set[str]:
    words = set(LETTERS.findall((text or "").lower()))
    return {w[:k] for w in words for k in LENGTHS if len(w) >= k} | words


def _voters(rows: DataFrame) -> tuple[list[str], float, float]:
    """Voters from labelled rows (text, toxic); share of toxic rows, share of them that is hit."""

    def told(seen: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *[pa.array([x[i] for x in seen.values()], pa.int64()) for i in (0, 1)]], names=["s", "pos", "n"])

    def count(batches):
        seen: dict[str, list[int]] = {}
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                for s in _starts(text):
                    x = seen.setdefault(s, [0, 0])
                    x[0] += toxic
                    x[1] += 1
                if len(seen) > COUNTED:
                    yield told(seen)
                    seen = {}
        yield told(seen)

    tallies = rows.mapInArrow(count, "s string, pos long, n long").groupBy("s").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    found = tallies.where((F.col("pos") >= 5) & ((F.col("pos") + 1) / (F.col("n") + 2) >= 0.75) | F.col("s").isin(*INSULTS))
    found = found.orderBy(F.desc("pos"), F.length("s"), "s").limit(CANDIDATES).collect()
    known = {r["s"]: (r["pos"], r["n"]) for r in found}
    good = [s for s, (p, n) in known.items() if (p + 1) / (n + 2) >= 0.5]
    at = {s: i for i, s in enumerate(good)}

    def cover(batches):
        for b in batches:
            got = [[at[s] for s in _starts(t) if s in at] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32()))], names=["v"])

    toxic = materialize(rows.where("toxic = 1").mapInArrow(cover, "v array<int>"))
    precise = [(known[s][0] + 1) / (known[s][1] + 2) for s in good]
    total, n_toxic = rows.count(), toxic.count()
    chosen = _covering(toxic, good, precise, max(3, 0.004 * n_toxic))
    voters = [good[c] for c in chosen]
    contradicted = {s for s, (p, n) in known.items() if (p + 1) / (n + 2) < 0.5}
    for w in INSULTS:
        if w not in contradicted and not any(w.startswith(v) or v.startswith(w) for v in voters):
            voters.append(w)
    hit = toxic.where(_among("v", chosen) > 0).count() / n_toxic if n_toxic else 0.9
    return sorted(voters), (n_toxic + 1) / (total + 10), min(hit, 1 - 1 / (n_toxic + 2))


def _among(v: str, chosen: list[int]) -> Column:
    return F.size(F.array_intersect(v, F.lit(chosen).cast("array<int>"))) if chosen else F.lit(0)


def _covering(toxic: DataFrame, good: list[str], precise: list[float], least: float) -> list[int]:
    """Numbers of good ones, one by one the best of those left, until each toxic row (v) has ``COVER`` or the best adds too little.

    What one adds only falls as others are chosen. So the rows are counted by which of the ``ABREAST`` best they have, and these
    are chosen among by exact counts as long as none of the others can be better; then all are counted again.
    """
    chosen: list[int] = []
    while len(chosen) < MAX_VOTERS:
        free = [v for v in range(len(good)) if not any(good[v].startswith(good[c]) or good[c].startswith(good[v]) for c in chosen)]
        needy = toxic.withColumn("have", _among("v", chosen)).where(F.col("have") < COVER)
        adds = dict(needy.select(F.explode("v").alias("c")).groupBy("c").count().collect())  # at most CANDIDATES rows
        worth = lambda v, n: (n * precise[v] ** 4, len(good[v]), -v)
        order = sorted(free, key=lambda v: worth(v, adds.get(v, 0)), reverse=True)
        best, bound = order[:ABREAST], worth(order[ABREAST], adds.get(order[ABREAST], 0)) if len(order) > ABREAST else None
        if not best or adds.get(best[0], 0) < least:
            break
        mask = F.lit(0)
        for i, v in enumerate(best):
            mask = mask + F.when(F.array_contains("v", F.lit(v)), 1 << i).otherwise(0)
        sets = needy.groupBy(mask.alias("mask"), "have").count().collect()  # at most 2^ABREAST * COVER rows
        masks, have, n = (np.array([r[i] for r in sets], np.int64) for i in range(3))
        while len(chosen) < MAX_VOTERS:
            left = [(worth(v, int(n[(masks >> i & 1 == 1) & (have < COVER)].sum())), i, v) for i, v in enumerate(best) if not any(good[v].startswith(good[c]) or good[c].startswith(good[v]) for c in chosen)]
            if not left:
                break
            top, i, v = max(left)
            hits = (masks >> i & 1 == 1) & (have < COVER)
            if bound and top < bound:
                break
            if n[hits].sum() < least:
                return chosen
            chosen.append(v)
            have = have + (masks >> i & 1)
    return chosen


def _label_model(names: list[str], m: np.ndarray, total: int, prior: float) -> tuple[dict[str, tuple[float, float]], np.ndarray, np.ndarray]:
    """Accuracies, block of each voter and discounts, from the joint vote counts m (diagonal: votes)."""
    v = len(names)
    p = np.diag(m) / total
    sigma = m / total - np.outer(p, p)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = sigma / np.outer(dev, dev)
    np.fill_diagonal(corr, 0)
    block = np.arange(v)
    for i, j in zip(*np.nonzero(corr > 0.05), strict=True):  # voters that move together share a latent class
        a, b = block[i], block[j]
        block[block == max(a, b)] = min(a, b)
    acc, spread = np.zeros(v), np.zeros(v)
    for b in set(block.tolist()):
        own = np.flatnonzero(block == b)
        share = max(1e-9, min(0.5, max(p[own].max(), min(prior, p[own].sum()))))  # of this latent class
        for i in own:
            got = []
            for j in own:
                for k in own:
                    if i < j < k or j < i < k or j < k < i:
                        if sigma[j, k] > 1e-9 and sigma[i, j] > 0 and sigma[i, k] > 0:
                            got.append(sigma[i, j] * sigma[i, k] / sigma[j, k])
            spread[i] = np.sqrt(np.median(got) / (share * (1 - share))) if got else p[i] / max(share, 1e-9)
        for i in own:
            low = max(1e-6, (p[i] - share * min(0.99, spread[i])) / (1 - share))
            acc[i] = min(0.99, max(0.02, spread[i] + low))
    share_of = np.array([min(0.5, max(p[block == b].max(), min(prior, p[block == b].sum()))) for b in block]) if v else np.zeros(0)
    false = np.clip((p - share_of * acc) / (1 - share_of), 1e-5, 0.5)
    fit = np.outer(spread, spread) * np.sqrt(np.outer(share_of * (1 - share_of), share_of * (1 - share_of)))
    residual = np.where(block[:, None] == block[None, :], sigma - fit, 0) / np.outer(dev, dev)
    np.fill_diagonal(residual, 0)
    tied = residual > 0.2
    return {n: (float(acc[i]), float(false[i])) for i, n in enumerate(names)}, block, tied


def _posterior(fired: list[int], acc: np.ndarray, false: np.ndarray, block: np.ndarray, tied: np.ndarray, prior: float, miss: float) -> float:
    z = np.log(prior / (1 - prior))
    if not fired:
        return 1 / (1 + np.exp(-(z + np.log(miss))))
    weight = 1 / (1 + tied[np.ix_(fired, fired)].sum(1))
    z += float((weight * np.log(acc[fired] / false[fired])).sum())
    for b in set(block[fired].tolist()):
        quiet = [i for i in np.flatnonzero(block == b) if i not in fired]
        if quiet:
            z += float(np.mean(np.log((1 - acc[quiet]) / (1 - false[quiet]))))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _logistic(width: int, sums, l2: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method on soft labels; ``sums`` gives the gradient and the Hessian of all rows; the last weight is the constant."""
    w = np.zeros(width)
    ridge = np.full(width, l2)
    ridge[-1] = 1e-6
    for _ in range(steps):
        grad, hess = sums(w)
        step = np.clip(np.linalg.solve(hess + np.diag(ridge), grad + ridge * w), -2, 2)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sums(rows: DataFrame, width: int, quiet: int, label: float):
    """Gradient and Hessian by weights, over rows (on, repeat, dense, y, with the places of the two) and ``quiet`` ones without a vote."""

    def at(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def part(batches):
            total = np.zeros((width + 1, width))
            for b in batches:
                on = b.column("on")
                x = np.zeros((b.num_rows, width))
                x[np.repeat(np.arange(b.num_rows), np.diff(on.offsets.to_numpy())), on.flatten().to_numpy()] = 1
                x[np.arange(b.num_rows), b.column("at_repeat").to_numpy()] = b.column("repeat").to_numpy()
                x[np.arange(b.num_rows), b.column("at_dense").to_numpy()] = b.column("dense").to_numpy()
                x[:, -1] = 1
                q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                total[-1] += x.T @ (q - b.column("y").to_numpy())
                total[:-1] += (x * (q * (1 - q) + 1e-9)[:, None]).T @ x
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total.ravel()[some])], names=["k", "s"])

        total = np.zeros((width + 1) * width)
        got = rows.mapInArrow(part, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).toArrow()  # one row a cell
        total[got.column("k").to_numpy()] = got.column("s").to_numpy()
        total = total.reshape(width + 1, width)
        q = 1 / (1 + np.exp(-np.clip(w[-1], -30, 30)))
        total[-1, -1] += quiet * (q - label)
        total[-2, -1] += quiet * (q * (1 - q) + 1e-9)
        return total[-1], total[:-1]

    return at


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Voters, label model and classifier for the documents."""
    with passing(docs.sparkSession):
        return _fit(docs, labels)


def _fit(docs: DataFrame, labels: DataFrame) -> Model:
    taught = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    taught = materialize(taught.where(~held_out(F.col("doc_id"))))
    known = maybe_in(docs.select("doc_id", "text"), F.col("doc_id"), taught, F.col("doc_id"))
    rows = materialize(known.join(taught.hint(MERGE), "doc_id").select("text", "toxic"))
    model = Model()
    model.voters, prior, hit = _voters(rows)
    borne = {k: F.coalesce(F.col("text").rlike(p), F.lit(False)).cast("int") for k, p in RULES.items()}
    told = rows.agg(*[F.sum(c).alias(f"n_{k}") for k, c in borne.items()], *[F.sum(c * F.col("toxic")).alias(f"p_{k}") for k, c in borne.items()]).first()
    model.rules = [k for k in RULES if (told[f"p_{k}"] or 0) >= 5 and (told[f"p_{k}"] + 1) / (told[f"n_{k}"] + 2) >= 0.75]

    votes = materialize(
        docs.select("doc_id", model.hits(F.col("text")).alias("hits"), F.length("text").alias("n"), F.array_compact(F.array(*[F.when(F.col("text").rlike(RULES[k]), F.lit(k)) for k in model.rules], F.lit(None).cast("string"))).alias("ruled"))
        .withColumn("dense", F.size("hits") * 100.0 / (F.coalesce("n", F.lit(0)) + 1.0))
        .withColumn("v", F.concat(F.array_distinct("hits"), F.when(F.size("hits") >= 3, F.array(F.lit("repeat"))).otherwise(F.array()), F.when(F.col("dense") >= 0.2, F.array(F.lit("dense"))).otherwise(F.array()), "ruled"))
    )
    names = [*model.voters, *PATTERNS, *model.rules]
    number = {n: i for i, n in enumerate(names)}
    moments = np.zeros((len(names), len(names)))
    pairs = votes.where(F.size("v") > 0).select(F.explode("v").alias("a"), "v").select("a", F.explode("v").alias("b")).groupBy("a", "b").count()
    for r in pairs.collect():  # at most one row for two voters
        moments[number[r["a"]], number[r["b"]]] = r["count"]
    total = max(1, votes.count())
    model.accuracy, block, tied = _label_model(names, moments, total, prior)
    for i in (number[x] for x in PATTERNS):  # patterns follow from the lexicon's hits
        tied[i, :] = tied[:, i] = True
        tied[i, i] = False
    model.correlated = [(names[i], names[j]) for i, j in zip(*np.nonzero(np.triu(tied)), strict=True)]
    acc = np.array([model.accuracy[n][0] for n in names])
    false = np.array([model.accuracy[n][1] for n in names])

    def posterior(batches):
        cache: dict[tuple, float] = {}
        for b in batches:
            on, ys = [], []
            for v in b.column("v").to_pylist():
                fired = tuple(sorted(number[x] for x in v))
                if len(cache) > COUNTED:
                    cache = {}
                if fired not in cache:
                    cache[fired] = _posterior(list(fired), acc, false, block, tied, prior, 1 - hit)
                on.append([i for i in fired if names[i] not in PATTERNS])
                ys.append(cache[fired])
            yield pa.RecordBatch.from_arrays([pa.array(on, pa.list_(pa.int32())), pa.array(ys, pa.float64()), b.column("repeat"), b.column("dense")], names=["on", "y", "repeat", "dense"])

    learn = votes.where(~held_out(F.col("doc_id")))
    quiet, some = learn.agg(F.count_if(F.size("v") == 0), F.count_if(F.size("v") > 0)).first()
    if quiet or some:
        voted = learn.where(F.size("v") > 0).select("v", F.log1p(F.size("hits").cast("double")).alias("repeat"), F.least(F.lit(1.0), "dense").alias("dense"))
        voted = materialize(voted.mapInArrow(posterior, "on array<int>, y double, repeat double, dense double"))
        voted = voted.withColumns({f"at_{p}": F.lit(number[p]) for p in PATTERNS})
        w = _logistic(len(names) + 1, _sums(voted, len(names) + 1, quiet, _posterior([], acc, false, block, tied, prior, 1 - hit)))
        model.weights = {n: float(w[i]) for i, n in enumerate(names)} | {"": float(w[-1])}
    return model


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score is below 0.5, with their own columns."""
    return docs.where(model.score(F.col("text")) < 0.5)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with score (double, 0 to 1) and predicted (int)."""
    scored = docs.withColumn("score", model.score(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
