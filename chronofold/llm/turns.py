"""Operator 11: repair of conversation structure by recursive queries inside hash-partitioned batches.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. A row may be kept (0), given the role
user or assistant (3), or deleted (4), a turn without text may be inserted anywhere (3), and a truncated row that stays
adds 3; blank rows and duplicates must go. The cheapest edits win, ties by the least string of their initials.

The grammar has four states: nothing yet (0), and after a system (S), user (U) or assistant turn (A). Conversations are
cut into segments of ``SEGMENT`` rows, dealt by hash. In each batch of segments one recursive DuckDB query advances all
of them by one turn a step, and keeps the least cost and audit from each entry state to each state reached. Two audits
of one state have read as many rows, so neither begins with the other unless it costs less: the least strings of parts
give the least string of the whole. Long conversations then have their segments combined ``FAN`` at a time by the same
recursion over segments in place of rows; so only a conversation's answer, never its rows, is in one place. The edits are
applied in one pass over rows dealt by conversation and sorted, of which a task holds a batch at a time; a digest of
a conversation is sequential by nature, and follows in the same pass.

Edge cases: a null id is a conversation of its own; null roles, texts and turns read as one space, and null turns stand
before others; rows of one turn stand by role and then by the text's digest, an adjacent repeat after its row; roles other
than system, user and assistant count by their initial, and fit where it fits; conversations whose rows are all dropped
have an empty repair; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm._util import indexed, materialize, sliced, table

SEGMENT, FAN = 64, 16
#: Costs of edits.
RENAME, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
BLANKS, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
STATES, NEXT = "0SUA", {"0": "U", "S": "U", "U": "A", "A": "U"}
ROLES = {"U": "user", "A": "assistant"}


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after damage: conv_id, turn, role, text, copy (1 for the repeat of a row)."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(read("conv_id"), F.lit(":"), read("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(read("text"), "".join(ENDS), "")).otherwise(read("text"))
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    told = rows.select("conv_id", "turn", fault.alias("fault"), F.when(fault == 4, "user").otherwise(read("role")).alias("role"), text.alias("text"), copies.alias("copies"))
    return told.where("fault <> 0").select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy"))


def _key(conv_id: str = "conv_id") -> Column:
    return F.coalesce(F.concat(F.lit("c"), F.col(conv_id).cast("string")), F.lit("n")).alias("ck")


def read_rows(rows: DataFrame) -> DataFrame:
    """Rows with the key of their conversation, the digest of role and text, and their faults."""
    end = F.rtrim("text", F.lit(BLANKS))
    told = rows.select("conv_id", _key(), "turn", "role", "text", "copy", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256).alias("th"), end.alias("end"))
    return told.select("*", (F.col("end") == "").alias("blank"), (~F.right("end", F.lit(1)).isin(*ENDS)).alias("cut_off")).drop("end")


_ORDER = ["turn", "role", "th", "copy"]


def marked(rows: DataFrame) -> DataFrame:
    """Rows of read_rows without texts: their place i in the conversation and their first fault (b, d, t or none)."""
    slim = rows.select("ck", *_ORDER, F.substring("role", 1, 1).alias("initial"), "blank", "cut_off")
    placed = materialize(indexed(slim, ["ck"], [F.col(c) for c in ("ck", *_ORDER)], "i"))
    told = placed.groupBy("ck", "th", (F.col("i") / SEGMENT).cast("long").alias("seg")).agg(F.min("i").alias("i"))
    first = told.withColumn("n", F.row_number().over(W.partitionBy("ck", "th").orderBy("i"))).where("n = 1").select("ck", "i", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d").when(F.col("cut_off"), "t").otherwise("")
    return placed.join(first, ["ck", "i"], "left").select("ck", "i", "initial", fault.alias("fault"))


def _moves() -> list[tuple[str, str, str, int, str]]:
    """What one row can do: its kind, the states before and after, the cost and the edits; turns may be inserted before it.

    A row's kind is a letter, of its initial (s, u, a, any other) and its fault (none, truncated, to be deleted).
    """
    out = []
    for (k, initial), (j, fault) in product(enumerate("sua*"), enumerate(("", "t", "d"))):
        for entry in STATES:
            state, inserted = entry, 0
            while inserted < 3:
                before = (inserted * INSERT, "I" * inserted)
                steps = [(state, DELETE, "D")]
                if fault != "d":
                    extra = CUT_OFF if fault else 0
                    steps.append((NEXT[state], RENAME + extra, "R"))
                    if initial == NEXT[state].lower() or (initial == "s" and state == "0"):
                        steps.append((initial.upper(), extra, "K"))
                out += [(chr(97 + 3 * k + j), entry, to, before[0] + cost, before[1] + edit) for to, cost, edit in steps]
                state, inserted = NEXT[state], inserted + 1
    least: dict = {}
    for kind, entry, to, cost, edits in out:
        least[kind, entry, to] = min(least.get((kind, entry, to), (cost, edits)), (cost, edits))
    return [(*k, *v) for k, v in least.items()]


#: All segments of a batch advance by one turn a step: g, the entry state and the state reached keep their least (cost, audit).
BY_TURN = """
WITH RECURSIVE walk(g, kinds, n, entry, state, cost, audit) AS (
  SELECT g, kinds, 0, e.entry, e.entry, 0::BIGINT, '' FROM seg JOIN entries e ON seg.seg > 0 OR e.entry = '0'
  UNION ALL
  SELECT g, kinds, n + 1, entry, dst, best.cost, best.audit FROM (
    SELECT w.g, w.kinds, w.n, w.entry, m.dst, min({'cost': w.cost + m.cost, 'audit': w.audit || m.audit}) AS best
    FROM walk w JOIN move m ON m.kind = substr(w.kinds, w.n + 1, 1) AND m.src = w.state
    GROUP BY w.g, w.kinds, w.n, w.entry, m.dst)
)
SELECT seg.ck, seg.seg, w.entry, w.state, w.cost, w.audit FROM walk w JOIN seg USING (g) WHERE w.n = length(w.kinds)
"""

#: The same over segments in place of turns: a step's moves are the entries, states, costs and audits of one segment.
BY_SEGMENT = """
WITH RECURSIVE step AS (SELECT g, unnest(steps, recursive := true) FROM seg),
place AS (SELECT *, dense_rank() OVER (PARTITION BY g ORDER BY part) AS k FROM step),
walk(g, n, entry, state, cost, audit) AS (
  SELECT g, 0::BIGINT, e.entry, e.entry, 0::BIGINT, '' FROM seg JOIN entries e ON seg.seg > 0 OR e.entry = '0'
  UNION ALL
  SELECT g, n + 1, entry, state, best.cost, best.audit FROM (
    SELECT w.g, w.n, w.entry, p.state, min({'cost': w.cost + p.cost, 'audit': w.audit || p.audit}) AS best
    FROM walk w JOIN place p ON p.g = w.g AND p.k = w.n + 1 AND p.entry = w.state
    GROUP BY w.g, w.n, w.entry, p.state)
)
SELECT seg.ck, seg.seg, w.entry, w.state, w.cost, w.audit FROM walk w JOIN seg USING (g) WHERE w.n = (SELECT max(k) FROM place p WHERE p.g = w.g)
"""

_MATRIX = pa.schema([("ck", pa.string()), ("seg", pa.int64()), ("entry", pa.string()), ("state", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])


def _recursive(sql: str, column: str):
    """A batch function: DuckDB runs ``sql`` over runs of rows (seg) of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        con.execute("CREATE TABLE move (kind VARCHAR, src VARCHAR, dst VARCHAR, cost BIGINT, audit VARCHAR)")
        con.executemany("INSERT INTO move VALUES (?, ?, ?, ?, ?)", _moves())
        con.execute("CREATE TABLE entries AS SELECT unnest(?) AS entry", [list(STATES)])
        for b in batches:
            for part in sliced(b, column, 1 << 18 if column == "kinds" else 1 << 12, 1 << 14):
                con.register("given", pa.Table.from_batches([part]))
                con.execute("CREATE OR REPLACE TEMP TABLE seg AS SELECT row_number() OVER () AS g, * FROM given")
                con.unregister("given")
                made = con.sql(sql).to_arrow_table().cast(_MATRIX)
                yield from made.to_batches()
        con.close()

    return run


_MATRIX_SQL = "ck string, seg long, entry string, state string, cost long, audit string"


def answers(marks: DataFrame) -> DataFrame:
    """The least cost and audit of each conversation that has rows, with counts of faults: ck, cost, audit, blank, duplicate, truncated."""
    fault = F.when(F.col("fault").isin("b", "d"), 2).when(F.col("fault") == "t", 1).otherwise(0)
    letter = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    kind = F.char(F.lit(97) + 3 * letter + fault)
    seg = (F.col("i") / SEGMENT).cast("long").alias("seg")
    lines = F.array_sort(F.collect_list(F.struct("i", kind.alias("kind"))))  # SEGMENT rows at most
    kinds = marks.groupBy("ck", seg).agg(F.array_join(F.transform(lines, lambda x: x["kind"]), "").alias("kinds"))
    made = materialize(kinds.mapInArrow(_recursive(BY_TURN, "kinds"), _MATRIX_SQL))
    most = made.agg(F.max("seg")).first()[0] or 0
    long_ = made.where("seg > 0").select("ck").distinct()
    done, rest = made.join(long_, "ck", "left_anti"), materialize(made.join(long_, "ck", "left_semi"))
    while most > 0:
        most //= FAN
        step = F.struct(F.col("seg").alias("part"), "entry", "state", "cost", "audit")
        runs = rest.groupBy("ck", (F.col("seg") / FAN).cast("long").alias("up")).agg(F.collect_list(step).alias("steps"))  # FAN segments at most
        rest = materialize(runs.select("ck", F.col("up").alias("seg"), "steps").mapInArrow(_recursive(BY_SEGMENT, "steps"), _MATRIX_SQL))
    end = F.when(F.col("state") == "U", F.struct((F.col("cost") + INSERT).alias("cost"), F.concat("audit", F.lit("I")).alias("audit")))
    end = end.when(F.col("state") == "S", F.struct((F.col("cost") + 2 * INSERT).alias("cost"), F.concat("audit", F.lit("II")).alias("audit"))).otherwise(F.struct("cost", "audit"))
    best = done.unionByName(rest).groupBy("ck").agg(F.min(end).alias("best")).select("ck", "best.cost", "best.audit")
    counts = marks.groupBy("ck").agg(*[F.count_if(F.col("fault") == k).alias(name) for k, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))])
    return best.join(counts, "ck")


_TURNS = "ck string, conv_id {id}, place long, edit string, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _applied(id_type: pa.DataType):
    """A batch function over sorted rows, each conversation led by its answer: the repaired turns, then a row of totals (place null)."""
    schema = pa.schema([("ck", pa.string()), ("conv_id", id_type), *[(c, pa.int64() if c in ("place", "gaps", "blank", "duplicate", "truncated", "illegal", "cost") else pa.string()) for c in ("place", "edit", "role", "text", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")]])

    class Conversation:
        def __init__(self, head: dict):
            self.head, self.at, self.state, self.place = head, 0, "0", 0
            self.least = self.most = self.last = None
            self.turns = self.illegal = 0

        def turn(self, edit: str, role: str, text: str) -> dict:
            self.place += 1
            return {"ck": self.head["ck"], "conv_id": self.head["conv_id"], "place": self.place - 1, "edit": edit, "role": role, "text": text}

        def inserted(self) -> Iterator[dict]:
            audit = self.head["audit"]
            while self.at < len(audit) and audit[self.at] == "I":
                self.at, self.state = self.at + 1, NEXT[self.state]
                yield self.turn("I", ROLES[self.state], "")

        def row(self, r: dict) -> Iterator[dict]:
            if r["turn"] is not None:
                self.turns += self.most is None or r["turn"] != self.most
                self.least, self.most = r["turn"] if self.least is None else self.least, r["turn"]
            if self.last is not None and self.last[:1] + r["role"][:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.last = r["role"]
            yield from self.inserted()
            edit, self.at = self.head["audit"][self.at], self.at + 1
            if edit != "D":
                self.state = r["role"][0].upper() if edit == "K" else NEXT[self.state]
                yield self.turn(edit, r["role"] if edit == "K" else ROLES[self.state], r["text"])

        def end(self) -> Iterator[dict]:
            yield from self.inserted()
            gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
            yield {c: self.head[c] for c in ("ck", "conv_id", "blank", "duplicate", "truncated", "cost", "audit")} | {"gaps": gaps, "illegal": self.illegal}

    def run(batches):
        now = None
        for b in batches:
            for part in sliced(b, "text", 1 << 23, 1 << 13):
                out: list[dict] = []
                for r in part.to_pylist():
                    if r["audit"] is not None:
                        out += now.end() if now else ()
                        now = Conversation(r)
                    else:
                        out += now.row(r)
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now:
            yield pa.RecordBatch.from_pylist(list(now.end()), schema=schema)

    return run


def _stream(original: DataFrame, rows: DataFrame) -> DataFrame:
    """Repaired turns and totals of all conversations of ``original``; ``rows`` are its rows after damage. Sorted in each task."""
    read = read_rows(rows)
    ids = original.groupBy(_key()).agg(F.first("conv_id").alias("conv_id"))
    told = ids.join(answers(marked(read)), "ck", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "cost")]
    head = told.select("ck", "conv_id", F.coalesce("audit", F.lit("")).alias("audit"), *zero, F.lit(0).alias("kind"))
    body = read.select("ck", *_ORDER, "text", F.lit(1).alias("kind"))
    both = head.unionByName(body, allowMissingColumns=True).repartition("ck").sortWithinPartitions("ck", "kind", *_ORDER)
    field = original.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return both.mapInArrow(_applied(to_arrow_type(field)), _TURNS.format(id=field.simpleString()))


def repaired(original: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place, edit (K, R or I), role, text; ``rows`` are the rows to repair, by default those given."""
    rows = original.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(0).alias("copy")) if rows is None else rows
    return _stream(original, rows).where("place IS NOT NULL").select("conv_id", "place", "edit", "role", "text")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals with the digest of the turns that stand before them."""
    h = hashlib.sha256()
    for b in batches:
        at, ends = 0, []
        for place, role, text in zip(*(b.column(c).to_pylist() for c in ("place", "role", "text")), strict=True):
            if place is None:
                ends.append((at, h.hexdigest()))
                h = hashlib.sha256()
            else:
                h.update(("\n" * (place > 0) + f"{role}:{text}").encode())
            at += 1
        if ends:
            kept = b.take(pa.array([k for k, _ in ends])).drop_columns(["ck", "place", "edit", "role", "text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([d for _, d in ends], pa.string())], names=[*kept.schema.names, "repaired_sha256"])


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    field = rows.schema["conv_id"].dataType.simpleString()
    return _stream(rows, damaged(rows)).mapInArrow(_digests, f"conv_id {field}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


#: The CRC-32 of an ASCII text, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::BIGINT) else x >> 1 end)), 4294967295::BIGINT)"""

#: The same in SQL: edits row by row from primitive moves, and the repair read off the audit letter by letter.
SQL = f"""
with recursive given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
hit as (select *, {CRC32.format("k")} % 20 as h from given),
damaged as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role, case h when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case when h = 3 then [0, 1] else [0] end) as copy from hit where h <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(length(role) || ':' || role || ':' || text), copy) as n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body from damaged),
faulty as (
  select *, case when body = '' then 'b' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'd' when right(body, 1) not in ('.', '!', '?') then 't' else '' end as fault, substr(role, 1, 1) as initial,
         lag(substr(role, 1, 1)) over (partition by conv_id order by n) as earlier from placed),
told as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
         count(*) filter (n > 1 and earlier || initial not in ('su', 'ua', 'au')) as illegal, count(*) as rows_ from faulty group by conv_id),
inserted(src, dst, cost, audit) as (values ('0', '0', 0, ''), ('0', 'U', 3, 'I'), ('0', 'A', 6, 'II'), ('S', 'S', 0, ''), ('S', 'U', 3, 'I'), ('S', 'A', 6, 'II'), ('U', 'U', 0, ''), ('U', 'A', 3, 'I'), ('A', 'A', 0, ''), ('A', 'U', 3, 'I')),
walk as (
  select conv_id, 0::bigint as n, '0' as state, 0::bigint as cost, '' as audit from told
  union all
  select conv_id, n, state, best.cost, best.audit from (
    select conv_id, n, e.state, min({{'cost': base + e.cost, 'audit': so_far || e.edit}}) as best from (
      select w.conv_id, f.n, w.cost + i.cost as base, w.audit || i.audit as so_far, unnest(list_filter([
        {{'state': i.dst, 'cost': 4, 'edit': 'D', 'ok': true}},
        {{'state': case when i.dst = 'U' then 'A' else 'U' end, 'cost': 3 + case when f.fault = 't' then 3 else 0 end, 'edit': 'R', 'ok': f.fault not in ('b', 'd')}},
        {{'state': upper(f.initial), 'cost': case when f.fault = 't' then 3 else 0 end, 'edit': 'K', 'ok': f.fault not in ('b', 'd') and (f.initial = 's' and i.dst = '0' or f.initial = 'u' and i.dst <> 'U' or f.initial = 'a' and i.dst = 'U')}}], lambda x: x.ok)) as e
      from walk w join inserted i on i.src = w.state join faulty f on f.conv_id is not distinct from w.conv_id and f.n = w.n + 1) x
    group by conv_id, n, e.state) y),
ended as (
  select w.conv_id, min({{'cost': w.cost + case state when 'U' then 3 when 'S' then 6 else 0 end, 'audit': w.audit || case state when 'U' then 'I' when 'S' then 'II' else '' end}}) as best
  from walk w join told t on t.conv_id is not distinct from w.conv_id and t.rows_ = w.n group by w.conv_id),
spelled as (
  select conv_id, best.audit as audit, 0 as p, '0' as state, 0::bigint as n, '' as told from ended
  union all
  select conv_id, audit, p + 1, now, n, told || case when edit = 'D' then '' else case when state = '0' then '' else chr(10) end || case when edit = 'K' then role when now = 'U' then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else text end end from (
    select s.conv_id, s.audit, s.p, s.state, s.told, substr(s.audit, s.p + 1, 1) as edit, case when substr(s.audit, s.p + 1, 1) = 'I' then s.n else s.n + 1 end as n, f.role, f.text,
           case substr(s.audit, s.p + 1, 1) when 'D' then s.state when 'K' then upper(f.initial) else case when s.state = 'U' then 'A' else 'U' end end as now
    from spelled s left join faulty f on f.conv_id is not distinct from s.conv_id and f.n = s.n + 1 where s.p < length(s.audit)) z)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(e.best.cost, 0) as cost, coalesce(e.best.audit, '') as audit, sha256(coalesce(s.told, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join told t on t.conv_id is not distinct from c.conv_id left join ended e on e.conv_id is not distinct from c.conv_id
left join spelled s on s.conv_id is not distinct from c.conv_id and s.p = length(s.audit)"""
