"""A whole field as lines of JSON, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators import audit

FORMAT = "1"
#: kind: schema of its lines.
KINDS = {
    "memory": "memory_id long, content string, state string, embedding binary",
    "link": "from_id long, to_id long, link_type string",
    "audit": "log long, seq long, payload string, prev_hash string, audit_hash string",
    "alert": "alert_id long, message string",
}
ORDER = {"header": 0, "memory": 1, "link": 2, "audit": 3, "alert": 4}


def lines(tables: dict[str, DataFrame]) -> DataFrame:
    """rank, key and line: a header, then the rows of each kind in order; binary values are in base64."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([(0, "", '{"kind":"header","format":"' + FORMAT + '"}')], "rank int, key string, line string")
    for kind, df in tables.items():
        cols = [F.base64(f.name).alias(f.name) if f.dataType.typeName() == "binary" else F.col(f.name) for f in df.schema.fields]
        row = F.struct(F.lit(kind).alias("kind"), *cols)
        key = F.concat_ws("/", *[F.lpad(F.col(c).cast("string"), 20, "0") for c in df.columns[:2]])
        out = out.unionByName(df.select(F.lit(ORDER[kind]).alias("rank"), key.alias("key"), F.to_json(row).alias("line")))
    return out


def write(tables: dict[str, DataFrame], path: str) -> None:
    """The lines in order over several files, named in that order."""
    lines(tables).orderBy("rank", "key").select("line").write.text(path)


def parsed(text: DataFrame) -> dict[str, DataFrame]:
    """The tables of lines (a column value); lines of an unknown kind are refused."""
    kind = F.get_json_object("value", "$.kind")
    odd = text.where(kind.isNull() | ~kind.isin("header", *KINDS)).limit(1).collect()
    if odd:
        raise ValueError(f"a line of unknown kind: {odd[0][0][:80]}")
    out = {}
    for k, schema in KINDS.items():
        rows = text.where(kind == k).select(F.from_json("value", schema.replace("binary", "string")).alias("r")).select("r.*")
        out[k] = rows.withColumn("embedding", F.unbase64("embedding")) if "binary" in schema else rows
    return out


def read(spark: SparkSession, path: str, into: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of the files; refused if the target has rows or the audit log does not verify."""
    if into is not None and into.limit(1).count():
        raise ValueError("the target is not empty")
    tables = parsed(spark.read.text(path))
    if audit.issues(tables["audit"]).limit(1).count():
        raise ValueError("the audit log does not verify")
    return tables
