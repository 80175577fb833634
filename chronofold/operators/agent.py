"""The facade: a field of memories, asked now, asked as it was, and asked what would be otherwise."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions import text as T
from chronofold.operators import counterfactual, graph
from chronofold.operators import recall as R
from chronofold.operators.replay import lived
from chronofold.storage import positioned, written


@dataclass
class Field:
    """memories (memory_id, content, custody_status, field_state, v, maybe superseded_by), links (from_id, to_id, link_type,
    created_at), chain (memory_id, seq, kind, to, created_at, caused_by, maybe actor), decisions (decision_id, created_at,
    q, used, actor), and maybe served (receipt_id, memory_id), what persisted receipts served."""

    memories: DataFrame
    links: DataFrame
    chain: DataFrame
    decisions: DataFrame
    top_k: int = 5
    hops: int = 2
    served: DataFrame | None = None

    def _state(self) -> DataFrame:
        return self.memories.select("memory_id", "custody_status", "field_state", "v")

    def ask(self, queries: DataFrame) -> DataFrame:
        """query_id, memory_id, rank, score, hop, rescued and content."""
        hits = R.recall(self._state(), self.links, queries, self.top_k, self.hops)
        return hits.join(self.memories.select("memory_id", "content"), "memory_id")

    def receipts(self, queries: DataFrame) -> DataFrame:
        return R.receipts(self._state(), self.links, queries, self.top_k, self.hops)

    def decide(self, queries: DataFrame, answers: DataFrame) -> DataFrame:
        """query_id and the served memories that an answer (query_id, answer) corroborates: what a decision may record as used."""
        told = self.ask(queries).join(answers, "query_id")
        return told.where(T.corroborated(F.col("content"), F.col("answer"))).select("query_id", "memory_id", "rank")

    def ask_at(self, queries: DataFrame, at) -> DataFrame:
        """The same, as it would have been answered at an instant."""
        past = R.as_of(self._state(), self.chain, at).select("memory_id", "custody_status", "field_state", "v")
        return R.recall(past, self.links, queries, self.top_k, self.hops, at=at)

    def what_if(self, queries: DataFrame, override: Mapping[int, str]) -> DataFrame:
        """query_id, memory_id, change: what serving would differ by, with other statuses."""
        now = R.recall(self._state(), self.links, queries, self.top_k, self.hops)
        other = R.recall(self._state(), self.links, queries, self.top_k, self.hops, override)
        return _changes(now, other)

    def without(self, queries: DataFrame, dead: DataFrame) -> DataFrame:
        """The changes, had the events (memory_id, seq) not happened."""
        now = R.recall(self._state(), self.links, queries, self.top_k, self.hops)
        other = R.recall(counterfactual.world(self._state(), self.chain, dead), self.links, queries, self.top_k, self.hops)
        return _changes(now, other)

    def do(self, dead: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(dead events, dead decisions) of the cascade."""
        return counterfactual.cascade(self._state(), self.links, self.chain, self.decisions, dead, self.top_k, self.hops)

    def survives(self, decision_id: int, dead: DataFrame) -> bool:
        """Whether what a decision used would still have been served."""
        return not self.do(dead)[1].where(F.col("decision_id") == decision_id).limit(1).count()

    def evidence_without(self, decisions: DataFrame, dead: DataFrame) -> DataFrame:
        """decision_id, memory_id, still_served, rank of all that decisions (decision_id) used, in the world without the events."""
        asked = self.decisions.join(decisions.select("decision_id").distinct(), "decision_id", "left_semi")
        other = counterfactual.world(self._state(), self.chain, dead)
        hits = R.recall(other, self.links, asked.select(F.col("decision_id").alias("query_id"), "q"), self.top_k, self.hops)
        used = asked.select("decision_id", F.explode("used").alias("memory_id"))
        found = used.join(hits.select(F.col("query_id").alias("decision_id"), "memory_id", "rank"), ["decision_id", "memory_id"], "left")
        return found.select("decision_id", "memory_id", F.col("rank").isNotNull().alias("still_served"), "rank")

    def answered(self, queries: DataFrame, answers: DataFrame, actor: int, at) -> tuple[Field, DataFrame]:
        """Ask, record what the answers declare, and reinforce what they show: the field after it, and the new events.

        answers: query_id, answer, declared (ids). An answer that declares something that was served becomes a decision that
        used it, numbered on in order of query_id. Each use is an event of its memory; a used memory whose words the answer
        has is reinforced, and promoted once its confidence is due. What is declared but was not served counts for nothing.
        """
        hits = self.ask(queries)
        told = hits.join(answers.select("query_id", "answer", "declared"), "query_id").where(F.array_contains("declared", F.col("memory_id")))
        used = written(told.select("query_id", "memory_id", "rank", T.corroborated(F.col("content"), F.col("answer")).alias("shown")))
        made = used.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "memory_id"))), lambda x: x["memory_id"]).alias("used"))
        after = self.decisions.agg(F.max("decision_id")).first()[0] or 0
        numbered = written(positioned(made, [F.col("query_id")], "n").select((F.col("n") + 1 + after).alias("decision_id"), "query_id", "used"))
        instant = F.lit(at).cast(self.chain.schema["created_at"].dataType)
        decisions = numbered.join(queries.select("query_id", "q"), "query_id").select("decision_id", instant.alias("created_at"), "q", "used", F.lit(actor).cast("long").alias("actor"))
        ids = used.select("memory_id").distinct()
        own = self.chain.join(ids, "memory_id", "left_semi")
        state = own.groupBy("memory_id").agg(F.max("seq").alias("head")).join(lived(own).select("memory_id", "field_state", "confidence"), "memory_id")
        uses = used.join(numbered.select("query_id", "decision_id"), "query_id").join(state, "memory_id")
        order = W.partitionBy("memory_id").orderBy("decision_id")
        nth = F.sum(F.col("shown").cast("int")).over(order)
        grown = uses.withColumn("now", 1 - (1 - F.col("confidence")) * F.pow(F.lit(0.75), nth)).withColumn("past", 1 - (1 - F.col("confidence")) * F.pow(F.lit(0.75), nth - F.col("shown").cast("int")))
        due = F.col("shown") & (F.col("field_state") == "NEUTRAL") & (F.col("now") >= 0.75) & ((F.col("past") < 0.75) | (nth == 1))
        event = lambda kind, to=None: F.struct(F.lit(kind).alias("kind"), F.lit(to).cast("string").alias("to"))
        due = F.coalesce(due, F.lit(False))
        kinds = F.filter(F.array(event("DECISION_USED_MEMORY"), F.when(F.col("shown"), event("REINFORCED")), F.when(due, event("STATE_CHANGED", "REINFORCED"))), lambda e: e.isNotNull())
        rows = grown.select("memory_id", "head", "decision_id", kinds.alias("kinds")).select("memory_id", "head", "decision_id", F.posexplode("kinds").alias("i", "e"))
        seq = F.col("head") + F.row_number().over(W.partitionBy("memory_id").orderBy("decision_id", "i"))
        columns = {"memory_id": F.col("memory_id"), "seq": seq.cast("long"), "kind": F.col("e.kind"), "to": F.col("e.to"), "created_at": instant, "caused_by": F.col("decision_id"), "actor": F.lit(actor).cast("long")}
        events = written(rows.select(*[columns[c].alias(c) for c in self.chain.columns]))
        promoted = events.where("kind = 'STATE_CHANGED'").select("memory_id", F.lit("REINFORCED").alias("new")).distinct()
        memories = self.memories.join(promoted, "memory_id", "left").withColumn("field_state", F.coalesce("new", "field_state")).select(*self.memories.columns)
        served = hits.join(queries.select("query_id"), "query_id").select(F.col("query_id").alias("receipt_id"), "memory_id")
        served = served if self.served is None else self.served.unionByName(served)
        return replace(self, memories=memories, chain=self.chain.unionByName(events), decisions=self.decisions.unionByName(written(decisions).select(*self.decisions.columns)), served=served), events

    def impact(self, ids: DataFrame) -> DataFrame:
        """The blast radius of memories (id).

        Descent goes over succession (superseded_by) and over memories stored from decisions; that is attested if whoever
        stored the memory made the decision. What receipts served together, or RESONANT links join, is possible.
        """
        uses = self.decisions.select("decision_id", F.explode("used").alias("memory_id"), "actor")
        by = F.col("actor") if "actor" in self.chain.columns else F.lit(None).cast("long").alias("actor")
        made = self.chain.where("seq = 0 and kind = 'STORED' and caused_by is not null").select("memory_id", F.col("caused_by").alias("decision_id"), by)
        if "superseded_by" in self.memories.columns:
            succession = self.memories.where("superseded_by is not null").select(F.col("memory_id").alias("old"), F.col("superseded_by").alias("new"))
        else:
            succession = self.links.limit(0).select(F.col("from_id").alias("old"), F.col("to_id").alias("new"))
        resonant = self.links.where("link_type = 'RESONANT'").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
        return graph.blast_radius(ids, uses, made, succession, self.served, resonant)

    def provenance(self, id_: int, depth: str = "summary") -> dict:
        """What an id is (a decision first, then a memory), and as deep as asked: summary, direct, impact, counterfactual."""
        d = self.decisions.where(F.col("decision_id") == id_).limit(1).collect()
        m = self.memories.where(F.col("memory_id") == id_).select("memory_id", "custody_status", "field_state").limit(1).collect()
        if not d and not m:
            raise KeyError(id_)
        out = {"id": id_, "kind": "decision", "used": list(d[0]["used"])} if d else {"id": id_, "kind": "memory", **m[0].asDict()}
        if depth == "summary":
            return out
        spark = self.memories.sparkSession
        seed = spark.createDataFrame([(x,) for x in (out["used"] if d else [id_])], "id long")
        out["direct"] = self.chain.join(seed, F.col("memory_id") == F.col("id"), "left_semi").orderBy("memory_id", "seq").select("memory_id", "seq", "kind").collect()
        if depth in ("impact", "counterfactual"):
            out["impact"] = self.impact(seed)
        if depth == "counterfactual":
            out["counterfactual"] = self.do(self.chain.join(seed, F.col("memory_id") == F.col("id"), "left_semi").where("seq = 0").select("memory_id", "seq"))
        return out


def _changes(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.select("query_id", "memory_id", F.col("rank").alias("ra")), b.select("query_id", "memory_id", F.col("rank").alias("rb"))
    both = x.join(y, ["query_id", "memory_id"], "full").where("not (ra <=> rb)")
    return both.select("query_id", "memory_id", F.when(F.col("rb").isNull(), "removed").when(F.col("ra").isNull(), "entered").otherwise("rank_changed").alias("change"))


#: Text to vectors; a provider is any such function, by name.
#: Texts embedded at once: what a task holds goes with them, not with a batch.
EMBEDDED = 256
PROVIDERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def provider(name: str):
    def add(f: Callable[[DataFrame], DataFrame]):
        PROVIDERS[name] = f
        return f

    return add


@provider("token-hash-64")
def token_hash(texts: DataFrame, dim: int = 64) -> DataFrame:
    """id and v of texts (id, text): each token adds or takes 1 in a dimension by its hash; of unit length, or zero without tokens."""
    tokens = texts.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("t"))
    s = F.sha2(F.concat(F.lit("tok:"), F.col("t")).cast("binary"), 256)
    sign = F.when(F.conv(F.substring(s, 10, 1), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
    cells = tokens.select("id", (F.conv(F.substring(s, 1, 8), 16, 10).cast("long") % dim).cast("int").alias("i"), sign.alias("x")).groupBy("id", "i").agg(F.sum("x").alias("x"))
    per = cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    zero = F.array_repeat(F.lit(0.0), dim)
    v = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0))
    return texts.select("id").join(per, "id", "left").select("id", F.when(F.col("m").isNull(), zero).otherwise(v).alias("v"))


@provider("seeded-384")
def seeded(texts: DataFrame, dim: int = 384) -> DataFrame:
    """id and v of texts (id, text): uniform numbers of (-1, 1) from a Mersenne Twister seeded with the text's SHA-256, of unit length.

    The stream and the sum are the standard generator's, in order, so vectors agree to the bit wherever they are made. Null
    or blank texts have none and stop the job.
    """

    def vector(text: str | None) -> list[float]:
        if text is None or not text.strip():
            raise ValueError("a text to embed is blank")
        rng = random.Random(int(hashlib.sha256(text.encode()).hexdigest(), 16))
        raw = [rng.uniform(-1.0, 1.0) for _ in range(dim)]
        norm = math.sqrt(sum(x * x for x in raw))
        return [x / norm for x in raw]

    def run(batches):
        for b in (x.slice(s, EMBEDDED) for x in batches for s in range(0, x.num_rows, EMBEDDED)):
            known = {t: vector(t) for t in set(b.column("text").to_pylist())}
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([known[t] for t in b.column("text").to_pylist()], pa.list_(pa.float64()))], names=["id", "v"])

    return texts.select("id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, v array<double>")
