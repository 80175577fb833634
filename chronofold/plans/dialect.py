"""One query text for Spark and for the checking engine: macros hide what differs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: macro: (Spark, DuckDB), with $1, $2 for arguments.
MACROS = {
    "QUANT": ("transform($1, x -> cast(round(cast(x as double) * 1000000) as bigint))", "list_transform($1, lambda x: cast(round(cast(x as double) * 1000000) as bigint))"),
    "DOT": ("aggregate(zip_with($1, $2, (x, y) -> x * y), 0L, (a, x) -> a + x)", "cast(list_sum(list_transform(list_zip($1, $2), lambda p: p[1] * p[2])) as bigint)"),
    "L2SQ": ("aggregate(zip_with($1, $2, (x, y) -> (x - y) * (x - y)), 0L, (a, x) -> a + x)", "cast(list_sum(list_transform(list_zip($1, $2), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint)"),
    "SHA": ("sha2($1, 256)", "sha256($1)"),
    "MICROS": ("unix_micros(cast($1 as timestamp))", "epoch_us($1)"),
    "PROP": ("cast(get_json_object(props, '$.k') as int)", "cast(json_extract_string(props, '$.k') as int)"),
    "JOINED": ("listagg($1, ',') within group (order by $2)", "string_agg($1, ',' order by $2)"),
    "STR": ("cast($1 as string)", "cast($1 as varchar)"),
    "DIV": ("($1 div $2)", "($1 // $2)"),
    "WORDS": ("explode(regexp_extract_all(lower($1), '[a-z0-9]+', 0))", "unnest(regexp_extract_all(lower($1), '[a-z0-9]+'))"),
    "EACH": ("explode($1)", "unnest($1)"),
    "HEX": ("cast(conv($1, 16, 10) as bigint)", "cast(('0x' || $1) as bigint)"),
    "RECURSIVE": ("recursive", "recursive"),
    "CLIP8": ("transform($1, x -> cast(greatest(-127, least(127, round(cast(x as double) * 127))) as int))", "list_transform($1, lambda x: cast(greatest(-127, least(127, round(cast(x as double) * 127))) as int))"),
    "LISTTEXT": ("array_join($1, ',')", "array_to_string($1, ',')"),
    "SORTED": ("array_sort(collect_list($1))", "list_sort(list($1))"),
    "STAMP": ("date_format($1, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") || '+00:00'", "strftime($1, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"),
    "SLICE": ("slice($1, $2, $3)", "list_slice($1, $2, $2 + $3 - 1)"),
}

MODEL = """
memories as (
  select vec_id as memory_id, label as topic, vec_id % 3 as claim, QUANT(embedding) as v,
         case when vec_id % 11 = 0 then 'QUARANTINED' else 'CLEAN' end as custody_status,
         case when vec_id % 13 = 0 then 'FORGOTTEN' when vec_id % 7 = 0 then 'REINFORCED' else 'NEUTRAL' end as field_state
  from embeddings),
links as (
  select vec_id as from_id, (7 * vec_id + 1) % (select count(*) from embeddings) as to_id, 'RESONANT' as link_type from embeddings
  union all
  select vec_id, (3 * vec_id + 2) % (select count(*) from embeddings), 'INHIBITORY' from embeddings where vec_id % 4 = 0),
chain as (
  select *, case when seq = 0 then 'STORED' when event_type = 'click' then 'REINFORCED' when event_type = 'view' then 'DECISION_USED_MEMORY'
                 when event_type = 'error' then 'TAINT_FLAGGED' when event_type = 'purchase' then 'REHABILITATED' else 'QUARANTINED' end as kind
  from (select user_id as subject, event_id, ts, event_type, value, PROP() % 10 as actor,
               row_number() over (partition by user_id order by ts, event_id) - 1 as seq from events) e),
queries as (select memory_id as query_id, v as q from memories where memory_id % 50 = 0)
"""


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    depth, out, start = 0, [], at
    for i in range(at, len(text)):
        c = text[i]
        if c == "(":
            depth += 1
        elif c == ")":
            if not depth:
                return [*out, text[start:i]], i + 1
            depth -= 1
        elif c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    raise ValueError("unbalanced macro")


def expand(text: str, dialect: int) -> str:
    """The text with all macros of a dialect (0: Spark, 1: DuckDB)."""
    while m := re.search(r"\b(" + "|".join(MACROS) + r")\(", text):
        args, end = _arguments(text, m.end())
        body = MACROS[m[1]][dialect]
        for i, a in enumerate(args, 1):
            body = body.replace(f"${i}", a.strip())
        text = text[: m.start()] + body + text[end:]
    return text


def statement(body: str) -> str:
    """The body after the model's views; a body may start with further views and ``recursive``."""
    extra = body.strip()
    lead = "with recursive " if extra.startswith("recursive ") else "with "
    extra = extra.removeprefix("recursive ")
    return lead + MODEL.strip() + (",\n" if not extra.startswith("select") else "\n") + extra


def query(body: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query (spark, sf_dir) of the text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = expand(statement(body), 0)
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(text)

    return run


def oracle(body: str) -> str:
    return expand(statement(body), 1)
