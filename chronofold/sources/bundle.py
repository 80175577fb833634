"""Evidence bundles: sealed sections that a reader can check without the writer.

A bundle is a set of tables (its sections) and a manifest: the protocols, for each section the Merkle root over the
canonical form of its rows, and the seal over all of that. ``verify`` finds what fails, check by check.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import canonical as C
from chronofold.operators import chains

PROTOCOLS = {"bundle": "1.0.0", "custody": "1.1.0", "ranking": "1.0.0"}


def section_root(df: DataFrame) -> str:
    """The Merkle root over the canonical JSON of the rows, in order of it."""
    fields = {f.name: C.Number(F.col(f.name)) if f.dataType.typeName() in ("long", "integer") else F.col(f.name).cast("string") for f in df.schema.fields}
    rows = df.select(C.json_object(fields).alias("row"))
    return chains.merkle_root(rows.withColumn("leaf", C.sha256(F.col("row"))), [F.col("row")]).first()["root"]


def manifest(sections: dict[str, DataFrame]) -> dict:
    """Protocols, roots by section, and the seal."""
    body = {"protocols": dict(PROTOCOLS), "sections": {k: section_root(df) for k, df in sorted(sections.items())}}
    return {**body, "seal": hashlib.sha256(C.dumps(body).encode()).hexdigest()}


def partitioned(uses: DataFrame, exported: DataFrame) -> DataFrame:
    """decision_id and included: whether all that a decision (decision_id, memory_id) used is exported (memory_id)."""
    held = uses.join(exported.select("memory_id").distinct().withColumn("there", F.lit(True)), "memory_id", "left")
    return held.groupBy("decision_id").agg(F.min(F.coalesce("there", F.lit(False))).alias("included"))


def envelope(payload: str, kind: str = "application/vnd.bundle+json") -> bytes:
    """What a signature covers: the type and the payload, each after its length."""
    parts = [b"DSSEv1"]
    for x in (kind.encode(), payload.encode()):
        parts += [str(len(x)).encode(), x]
    return b" ".join(parts)


def signed(told: dict, signer: Callable[[bytes], bytes], keyid: str = "") -> dict:
    """The manifest in an envelope with the signer's signature (a callback for the actor's key)."""
    import base64

    payload = C.dumps(told)
    return {"payloadType": "application/vnd.bundle+json", "payload": base64.b64encode(payload.encode()).decode(), "signatures": [{"keyid": keyid, "sig": base64.b64encode(signer(envelope(payload))).decode()}]}


def verify(spark: SparkSession, told: dict, sections: dict[str, DataFrame]) -> DataFrame:
    """check, subject, code of what fails; nothing if the bundle holds.

    B0 protocols, B1 seal and roots, B2 chains, B3 content against its birth seal, B4 declared against replayed status.
    Sections: memories (memory_id, content, custody_status) and custody (chain rows).
    """
    found: list[tuple[str, str, str]] = []
    if set(told.get("protocols", {})) != set(PROTOCOLS):
        found.append(("B0", "protocols", "KEYS"))
    elif told["protocols"] != PROTOCOLS:
        found.append(("B0", "protocols", "VERSION"))
    body = {k: told.get(k) for k in ("protocols", "sections")}
    if hashlib.sha256(C.dumps(body).encode()).hexdigest() != told.get("seal"):
        found.append(("B1", "seal", "SEAL"))
    for k, df in sorted(sections.items()):
        if told.get("sections", {}).get(k) != section_root(df):
            found.append(("B1", k, "ROOT"))
    out = spark.createDataFrame(found, "check string, subject string, code string")
    custody, memories = sections["custody"], sections["memories"]
    broken = chains.verify(chains.CUSTODY, custody).where("code is not null").select(F.lit("B2").alias("check"), "subject", "code")
    born = custody.where("seq = 0").select("subject", F.get_json_object("payload_json", "$.content_sha256").alias("sealed"))
    content = memories.join(born, F.col("memory_id") == F.col("subject"), "left").where(~F.col("sealed").eqNullSafe(C.sha256(F.col("content"))))
    strong = F.max(F.when(F.col("event_type").isin("QUARANTINED", "SUPERSEDED_BY", "REHABILITATED"), F.struct("seq", "event_type")))
    per = custody.groupBy("subject").agg(strong.alias("s"), F.max(F.when(F.col("event_type") == "TAINT_FLAGGED", F.col("seq"))).alias("t"))
    status = F.when(F.col("s.event_type") == "QUARANTINED", "QUARANTINED").when(F.col("s.event_type") == "SUPERSEDED_BY", "SUPERSEDED").when(F.col("t") > F.coalesce("s.seq", F.lit(-1)), "TAINT_FLAGGED").otherwise("CLEAN")
    state = memories.join(per.select(F.col("subject").alias("of"), status.alias("replayed")), F.col("memory_id") == F.col("of"), "left").where(~F.col("replayed").eqNullSafe(F.col("custody_status")))
    out = out.unionByName(broken).unionByName(content.select(F.lit("B3").alias("check"), F.col("memory_id").alias("subject"), F.lit("CONTENT").alias("code")))
    return out.unionByName(state.select(F.lit("B4").alias("check"), F.col("memory_id").alias("subject"), F.lit("STATE").alias("code")))
