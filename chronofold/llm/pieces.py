"""Operator 7: SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

The model is a BPE model. Its encoding is the one segmentation in which each piece and each pair of adjacent
pieces is its own encoding, so it is the best path of a max-plus system whose weights are 0 for such pairs and
minus infinity for others. A text of more than ``CHUNK`` characters is split into chunks at fixed places. The
states at a cut are the pieces that may cover the character before it. Each chunk gives a matrix of the
weights from its left states to its right states. The matrices are combined associatively in a tree over
tasks, ``FAN`` adjacent ones at a time, up to one for each text; then the states at the cuts are settled down
the tree, and each chunk is traced back on its own. Inside a chunk the matrix factors at the starts of words,
which no piece crosses, so only the parts up to the first and from the last start of a word are searched and
the rest is encoded by the library. Texts of one chunk (``CHUNK`` characters at most) never see the scan: the
library encodes them as a whole, with the same result.

The model file is read on the driver (path by parameter) and sent to the tasks.

Edge cases: null and empty texts have no tokens and decode to the empty text; very long texts are the scan's
case; U+2581 is the model's own mark for a space and decodes to one (``round_trip`` is false then); there is
one best path, so no ties; rows are independent, so repeated rows and ids give repeated results; other
columns, whatever their names, are kept by ``encode`` and ``decode``, but one named like the result is
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.llm._util import materialize, sliced, table

MODEL, CHUNK, MARK = "/opt/tokenizers/piece_bpe_32k.model", 32768, "▁"
#: Matrices combined in one task, pairs of pieces that a worker remembers, and characters dealt to a task.
FAN, PAIRS, PART = 32, 1 << 16, 1 << 23
CHUNKS = "row long, i long, u string, p int, q int, first boolean, last boolean"


class Pieces:
    """The model with its merges."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.sp.get_piece_size()
        self.ids = {self.sp.id_to_piece(i): i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))}
        self.longest = max(map(len, self.ids))
        self.prefixes = {x[:k] for x in self.ids for k in range(1, len(x) + 1)}
        self._whole: dict[str, bool] = {}  # of pieces of the vocabulary only
        self.fits = functools.lru_cache(PAIRS)(self._fits)

    def bpe(self, text: str) -> list[str]:
        """Merge the pair of the best score, leftmost first, until none is left (for short texts)."""
        s, score = list(text), self.sp.get_score
        while True:
            options = [(-score(self.ids[s[i] + s[i + 1]]), i) for i in range(len(s) - 1) if s[i] + s[i + 1] in self.ids]
            if not options:
                return s
            i = min(options)[1]
            s[i : i + 2] = [s[i] + s[i + 1]]

    def whole(self, a: str) -> bool:
        if len(a) == 1 or a not in self.ids:
            return len(a) == 1
        if a not in self._whole:
            self._whole[a] = self.bpe(a) == [a]
        return self._whole[a]

    def _fits(self, a: str, b: str) -> bool:
        return self.bpe(a + b) == [a, b]

    def starting(self, u: str, s: int) -> list[str]:
        out = []
        for k in range(1, min(self.longest, len(u) - s) + 1):
            x = u[s : s + k]
            if k > 1 and x not in self.prefixes:
                break
            if self.whole(x):
                out.append(x)
        return out

    def states(self, u: str, p: int) -> list[tuple[int, int]]:
        """(start, end) of the pieces that may cover the character before p, in a fixed order."""
        return [(s, s + len(x)) for s in range(max(0, p - self.longest), p) for x in self.starting(u, s) if s + len(x) >= p]

    def to_ids(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.sp.piece_to_id(f"<0x{b:02X}>") for b in piece.encode()]

    def encode_marked(self, u: str) -> list[int]:
        """Ids of a stretch of marked text that starts with a mark."""
        return self.sp.encode(u[1:].replace(MARK, " ")) if len(u) > 1 else [self.ids[MARK]] if u else []

    def walk(self, u: str, start: int, last: str | None, stop: int) -> dict[tuple[int, int], tuple[int, int] | None]:
        """Pieces reachable from ``start`` after the piece ``last``, starting before ``stop``, with their predecessors."""
        back: dict[tuple[int, int], tuple[int, int] | None] = {}
        todo = [(start, None)]
        while todo:
            at, before = todo.pop()
            if at >= stop:
                continue
            left = last if before is None else u[before[0] : before[1]]
            for x in self.starting(u, at):
                node = (at, at + len(x))
                if node not in back and (left is None or self.fits(left, x)):
                    back[node] = before
                    todo.append((node[1], node))
        return back


def _starts(u: str, a: int, b: int) -> list[int]:
    """The first and the last start of a word in [a, b], if any."""
    first, last = -1, -1
    i = u.find(MARK, a)
    while i >= 0 and i <= b:
        if i == 0 or u[i - 1] != MARK:
            first = i
            break
        i = u.find(MARK, i + 1)
    i = u.rfind(MARK, a, b + 1)
    while i >= a:
        if i == 0 or u[i - 1] != MARK:
            last = i
            break
        i = u.rfind(MARK, a, i)
    return [first, last] if first >= 0 else []


class Chunk:
    """u is the marked text of the chunk with its context; p and q are its cuts in u; ``last`` if q is the text's end."""

    def __init__(self, m: Pieces, u: str, p: int, q: int, first: bool, last: bool):
        self.m, self.u, self.p, self.q, self.first, self.last = m, u, p, q, first, last
        self.left = [(0, 0)] if first else m.states(u, p)
        self.right = [(x, y) for x, y in m.states(u, q) if y == q] if last else m.states(u, q)
        self.cuts = _starts(u, p, q)

    def _paths(self, state: tuple[int, int], stop: int) -> dict:
        return self.m.walk(self.u, state[1], None if self.first else self.u[state[0] : state[1]], stop)

    def origins(self, stop: int) -> dict[tuple[int, int], int]:
        """Pieces that start before ``stop`` with the left states they can follow from, a bit each: one pass for all states."""
        m, u = self.m, self.u
        waiting: dict[int, dict[str | None, int]] = {}  # by place, the piece that ends there and its states
        for i, (s, e) in enumerate(self.left):
            if e < stop:
                here = waiting.setdefault(e, {})
                last = None if self.first else u[s:e]
                here[last] = here.get(last, 0) | 1 << i
        out: dict[tuple[int, int], int] = {}
        places = list(waiting)
        heapq.heapify(places)
        while places:
            at = heapq.heappop(places)
            before = waiting.pop(at)
            for x in m.starting(u, at):
                states = 0
                for last, own in before.items():
                    if own & ~states and (last is None or m.fits(last, x)):
                        states |= own
                if not states:
                    continue
                end = at + len(x)
                out[at, end] = states
                if end < stop:
                    if end not in waiting:
                        waiting[end] = {}
                        heapq.heappush(places, end)
                    waiting[end][x] = waiting[end].get(x, 0) | states
        return out

    def matrix(self) -> np.ndarray:
        out = np.full((len(self.left), len(self.right)), -np.inf)
        if self.cuts:
            ends = 0
            for (_, e), states in self.origins(self.cuts[0]).items():
                ends |= states if e == self.cuts[0] else 0
            ok = np.array([a[1] == self.cuts[0] or bool(ends >> i & 1) for i, a in enumerate(self.left)])
            from_last = self.m.walk(self.u, self.cuts[1], None, self.q)
            # a state before the last start of a word can only end at it
            right = np.array([b in from_last if self.cuts[1] < self.q else b[1] == self.q for b in self.right])
            if self.cuts[1] >= self.q:
                right &= self._ending(self.q)
            out[np.ix_(ok, right)] = 0
            return out
        got = self.origins(self.q)
        for j, b in enumerate(self.right):
            states = got.get(b, 0)
            for i, a in enumerate(self.left):
                if states >> i & 1 or b == a:
                    out[i, j] = 0
        return out

    def _ending(self, q: int) -> np.ndarray:
        """Right states that end the segmentation of the word before q."""
        start = self._word_before(q)
        got = self.m.walk(self.u, start, None, q) if start >= 0 else None
        return np.array([got is None or b in got for b in self.right])

    def _word_before(self, q: int) -> int:
        i = self.u.rfind(MARK, self.p, q)
        while i > 0 and self.u[i - 1] == MARK and i > self.p:
            i -= 1
        return i if i >= 0 and (i == 0 or self.u[i - 1] != MARK) else -1

    def trace(self, a: tuple[int, int], b: tuple[int, int]) -> list[int]:
        """Ids of the pieces after state a up to state b."""

        def back(paths: dict, node: tuple[int, int]) -> list[int]:
            out = []
            while node is not None:
                out.append(self.m.to_ids(self.u[node[0] : node[1]]))
                node = paths[node]
            return [i for x in reversed(out) for i in x]

        if a == b:
            return []
        if not self.cuts:
            return back(self._paths(a, self.q), b)
        first, last = self.cuts
        ids: list[int] = []
        if a[1] < first:
            paths = self._paths(a, first)
            ids += back(paths, next(n for n in paths if n[1] == first))
        ids += self.m.encode_marked(self.u[first:last])
        if last < self.q:
            ids += back(self.m.walk(self.u, last, None, self.q), b)
        return ids


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None]).max(1)


def settle(matrices: list[np.ndarray], a: int, b: int) -> list[int]:
    """The state at each cut, given those at both ends, from products with the matrices from both ends."""
    n = len(matrices)
    forward = [np.where(np.arange(matrices[0].shape[0]) == a, 0.0, -np.inf)[None]]
    for m in matrices:
        forward.append(times(forward[-1], m))
    backward = [np.where(np.arange(matrices[-1].shape[1]) == b, 0.0, -np.inf)[:, None]]
    for m in reversed(matrices):
        backward.append(times(m, backward[-1]))
    best = forward[n][0, b]
    return [int(np.argmax(forward[i][0] + backward[n - i][:, 0] >= best)) for i in range(n + 1)]


@functools.lru_cache(maxsize=2)
def _model(proto: bytes) -> Pieces:
    return Pieces(proto)


def _read(spark: SparkSession, path: str) -> bytes:
    if path.startswith("/"):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def _packed(m: np.ndarray) -> bytes:
    return np.packbits(np.isfinite(m)).tobytes()


def _unpacked(cells: bytes, high: int, wide: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(cells, np.uint8), count=high * wide)
    return np.where(bits, 0.0, -np.inf).reshape(high, wide)


def _ordered(t: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
    """The rows of a node in chunk order, with their matrices."""
    t = t.sort_by("i")
    return t, [_unpacked(c, h, w) for c, h, w in zip(t["cells"].to_pylist(), t["high"].to_pylist(), t["wide"].to_pylist(), strict=True)]


def _combine(t: pa.Table) -> pa.Table:
    """One matrix for up to ``FAN`` adjacent ones (the product is associative)."""
    t, ms = _ordered(t)
    m = functools.reduce(times, ms)
    return pa.table({"row": t["row"][:1], "i": t["node"][:1], "high": pa.array([m.shape[0]], pa.int32()), "wide": pa.array([m.shape[1]], pa.int32()), "cells": pa.array([_packed(m)], pa.binary())})


def _ends(t: pa.Table) -> pa.Table:
    """The states at both ends of a whole text, from its one matrix."""
    _, (m,) = _ordered(t)
    return pa.table({"row": t["row"], "i": t["i"], "a": pa.array([0], pa.int32()), "b": pa.array([int(np.argmax(m[0]))], pa.int32())})


def _between(t: pa.Table) -> pa.Table:
    """The states at both ends of each child, from those of their node."""
    t, ms = _ordered(t)
    at = settle(ms, t["a"][0].as_py(), t["b"][0].as_py())
    return pa.table({"row": t["row"], "i": t["i"], "a": pa.array(at[:-1], pa.int32()), "b": pa.array(at[1:], pa.int32())})


MATRIX, STATES = "row long, i long, high int, wide int, cells binary", "row long, i long, a int, b int"


def _scan(matrices: DataFrame, n: int) -> DataFrame:
    """row, i, a, b: the states at the ends of each chunk, for texts of at most ``n`` chunks.

    A tree of fan ``FAN``: products go up, level by level, until each text has one matrix; then states go down.
    A task holds the matrices of one node only.
    """
    levels = [matrices]
    while n > 1:
        up = levels[-1].withColumn("node", F.floor(F.col("i") / FAN)).groupBy("row", "node").applyInArrow(_combine, MATRIX)
        levels.append(materialize(up))
        n = -(-n // FAN)
    states = levels.pop().groupBy("row", "i").applyInArrow(_ends, STATES)
    while levels:
        children = levels.pop().withColumn("node", F.floor(F.col("i") / FAN))
        nodes = states.select("row", F.col("i").alias("node"), "a", "b")
        states = children.join(nodes, ["row", "node"]).groupBy("row", "node").applyInArrow(_between, STATES)
    return states


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, column: str = "tokens", decoded: str | None = None) -> DataFrame:
    """The documents with the ids of their text as array<int>; a column of that name is replaced.

    ``decoded`` names a further column for the text of the ids, decoded in the same pass.
    """
    spark = docs.sparkSession
    proto = _read(spark, model)
    longest = Pieces(proto).longest
    if chunk <= longest + 1:
        raise ValueError(f"a chunk holds more than {longest + 1} characters")
    docs = docs.drop(column, *[decoded] * bool(decoded))
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType()))])
    if decoded:
        schema = schema.add(decoded, T.StringType())
    name = next(f.name for f in docs.schema.fields if f.name.lower() == "text")

    def short(batches):
        sp = _model(proto).sp
        for b in batches:
            for part in sliced(b, name):
                ids = sp.encode([x or "" for x in part.column(name).to_pylist()], num_threads=1)
                at = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                flat = np.fromiter(chain.from_iterable(ids), np.int32, at[-1].as_py())
                told = [pa.array(sp.decode(ids, num_threads=1), pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(at, pa.array(flat)), *told], names=schema.names)

    is_giant = F.coalesce(F.length("text") > chunk, F.lit(False))
    out = docs.where(~is_giant).mapInArrow(short, schema)
    giant = materialize(docs.where(is_giant).select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")))
    most, total = giant.agg(F.max(F.length("doc.text")), F.sum(F.length("doc.text"))).first()
    if most is None:
        return out
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART)

    def cut(batches):
        for b in batches:
            for row, text in zip(b.column("row").to_pylist(), b.column("text"), strict=True):
                u = MARK + text.as_py().replace(" ", MARK)
                for i in range(-(-len(u) // chunk)):
                    at, to = max(i * chunk - longest - 1, 0), min((i + 1) * chunk, len(u))
                    told = {"row": row, "i": i, "u": u[at : to + longest], "p": i * chunk - at, "q": to - at, "first": i == 0, "last": to == len(u)}
                    yield pa.RecordBatch.from_pylist([told], schema=b_schema)

    b_schema = pa.schema([("row", pa.int64()), ("i", pa.int64()), ("u", pa.string()), ("p", pa.int32()), ("q", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_())])
    dealt = giant.select("row", F.col("doc.text").alias("text")).repartition(parts, "row").mapInArrow(cut, CHUNKS)
    chunks = materialize(dealt.repartition(parts, "row", "i"))  # the chunks of one text go to many tasks

    def of_chunk(make, names, schema):
        def run(batches):
            pieces = _model(proto)
            for b in batches:
                for part in sliced(b, "u"):
                    rows = part.to_pylist()
                    made = [make(Chunk(pieces, r["u"], r["p"], r["q"], r["first"], r["last"]), r) for r in rows]
                    yield pa.RecordBatch.from_pylist([{"row": r["row"], "i": r["i"], **dict(zip(names, x, strict=True))} for r, x in zip(rows, made, strict=True)], schema=schema)

        return run

    def matrix(c, r):
        m = c.matrix()
        return m.shape[0], m.shape[1], _packed(m)

    ids = [("row", pa.int64()), ("i", pa.int64())]
    cells = of_chunk(matrix, ["high", "wide", "cells"], pa.schema([*ids, ("high", pa.int32()), ("wide", pa.int32()), ("cells", pa.binary())]))
    settled = _scan(materialize(chunks.mapInArrow(cells, MATRIX)), -(-(most + 1) // chunk))
    trace = of_chunk(lambda c, r: [c.trace(c.left[r["a"]], c.right[r["b"]])], ["ids"], pa.schema([*ids, ("ids", pa.list_(pa.int32()))]))
    traced = chunks.join(settled, ["row", "i"]).mapInArrow(trace, "row long, i long, ids array<int>")
    whole = materialize(traced.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "ids"))), lambda x: x["ids"])).alias("ids")))
    long = giant.join(whole, "row").select("doc.*", F.col("ids").alias(column))
    return out.unionByName(decode(long, model, column, decoded) if decoded else long)


def decode(encoded: DataFrame, model: str = MODEL, column: str = "tokens", out: str = "decoded") -> DataFrame:
    """The rows with the text of their ids; a column named ``out`` is replaced."""
    proto = _read(encoded.sparkSession, model)
    encoded = encoded.drop(out)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        sp = _model(proto).sp
        for b in batches:
            for part in sliced(b, column):
                text = sp.decode([x or [] for x in part.column(column).to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], names=[*part.schema.names, out])

    return encoded.mapInArrow(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return told.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens", same.alias("round_trip"))
