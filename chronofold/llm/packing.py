"""Operator 13: packing of documents into sequences by a configuration linear program.

Documents become token ids, closed by id 0; longer ones than ``CAPACITY`` are cut so that only the first piece may be
shorter. What is packed is the histogram of the pieces' lengths, which has CAPACITY numbers however many rows there are.
Its linear program has a variable for each configuration (lengths that fit together) and a row for each length. It is
solved by multiplicative weights: a length's price is its share of a sequence times the exponential of how much of it
is left against the whole, and knapsack dynamic programming over the prices gives, for each length, the dearest
configuration that holds it. Each round takes all configurations near the dearest a whole number of times, up to
``STEP`` of what the scarcest of their lengths allows, so rounding down happens as the solution grows. What is left
after ``ROUNDS`` rounds is rounded by best fit from the longest on. The learning rate with the fewest sequences of
``RATES`` counts. On the given tables that is within 0.01 % of the total length divided by CAPACITY, which no packing can
beat. Pieces of one length are numbered, and a number tells the sequence and the offset, so rows only look up a plan of
bounded size; a length that a third of all pieces have is numbered task by task.

Ids are those of the ``tokenizers`` library for the vocabulary file (a parameter). Texts are cut before runs of spaces and
line ends, which no token crosses, and ids of the cut parts are remembered up to ``PARTS`` parts. New parts are encoded
together with the same vocabulary as ranks, some ten times faster; tests hold both to the same ids. Parts with the
text of a special token, and parts of more than ``LONG`` characters, go to ``tokenizers`` themselves.

Edge cases: null and empty texts are the one id 0; a text of any length is read whole; rows are independent, so repeated
rows and ids are packed each by itself; an empty table has no sequences; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm._util import numbered, sliced, table

CAPACITY, END = 2048, 0
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
ROUNDS, STEP, NEAR, RATES = 64, 0.5, 0.02, (0.02, 0.5)
PARTS, LONG = 1 << 19, 1 << 14
_PART = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space of other kinds, which may join a run of spaces across a cut.
_OTHER = re.compile(r"[^\S \n]")


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit numbers."""

    def __init__(self, vocabulary: bytes, ranks: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        told = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=told, special_tokens={})
        self.size = np.zeros(max(told.values()) + 1, np.int64)
        self.size[list(told.values())] = [len(x) for x in told]
        self.parts: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _odd(self, text: str) -> bool:
        return len(text) > LONG or any(s in text for s in self.special)

    def _learn(self, new: list[str]) -> None:
        """Remember the ids of parts; those that begin with white space are encoded in one go, cut at the ends of their bytes."""
        if len(self.parts) + len(new) > PARTS:
            self.parts.clear()
        joined = [p for p in new if p[0] in " \n" and not p.isspace() and not self._odd(p)]
        known = set(joined)
        for p in new:
            if p not in known:
                self.parts[p] = self.plain(p) if self._odd(p) else np.array(self.bpe.encode_ordinary(p), "<u4").tobytes()
        if joined:
            ids = np.array(self.bpe.encode_ordinary("".join(joined)), "<u4")
            ends = np.cumsum([len(p.encode()) for p in joined])
            at = np.append(0, np.searchsorted(np.cumsum(self.size[ids]), ends) + 1).tolist()
            raw = ids.tobytes()
            self.parts.update((p, raw[4 * a : 4 * b]) for p, a, b in zip(joined, at, at[1:], strict=False))

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = {k: self.plain(t) for k, t in enumerate(texts) if _OTHER.search(t)}
        cut = [[] if k in whole else _PART.findall(t) for k, t in enumerate(texts)]
        new = {p for parts in cut for p in parts} - self.parts.keys()
        if len(self.parts) + len(new) > PARTS:
            new = {p for parts in cut for p in parts}
        self._learn(list(new))
        return [whole[k] if k in whole else b"".join(map(self.parts.__getitem__, parts)) for k, parts in enumerate(cut)]


_encoders: dict[tuple[int, int], Encoder] = {}


def pieces(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, ids: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32 (and ids)."""
    files = [open(f or public_tokenizers.path(name), "rb").read() for f, name in ((vocabulary, VOCABULARY), (ranks, RANKS))]
    files = docs.sparkSession.sparkContext.broadcast(files)  # two files of fixed size
    more = [("ids", pa.list_(pa.int64()))] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tuple(map(zlib.crc32, files.value))
        encoder = _encoders.get(key) or _encoders.setdefault(key, Encoder(*files.value))
        for b in batches:
            for part in sliced(b, "text", 1 << 21):
                rows: list[tuple] = []
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), encoder.encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    raw += END.to_bytes(4, "little")
                    n = len(raw) // 4
                    cuts = [0, *range(n % CAPACITY or CAPACITY, n + 1, CAPACITY)] if n > CAPACITY else [0, n]
                    for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        own = raw[4 * a : 4 * z]
                        rows.append((doc_id, k, a, z - a, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype(np.int64)] * ids)))
                columns = list(zip(*rows, strict=True))
                kinds = [part.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[t for _, t in more]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", *[n for n, _ in more]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids)


def _knapsack(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to CAPACITY the dearest set of lengths, and one length of it (0: leave a place empty)."""
    best, pick = np.zeros(len(price)), np.zeros(len(price), np.int64)
    for room in range(1, len(price)):
        value = best[room - 1 :: -1] + price[1 : room + 1]  # of the lengths 1 to room
        k = int(value.argmax())
        best[room], pick[room] = (value[k], k + 1) if value[k] > best[room - 1] else (best[room - 1], 0)
    return best, pick


def _configuration(first: int, pick: np.ndarray) -> dict[int, int]:
    """The dearest configuration that holds a length."""
    own, room = {first: 1}, len(pick) - 1 - first
    while room > 0:
        if pick[room]:
            own[int(pick[room])] = own.get(int(pick[room]), 0) + 1
        room -= int(pick[room]) or 1
    return own


def best_fit(left: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Configurations of what is left, the longest first, each into the fullest sequence that has room."""
    top = len(left) - 1
    by_room: dict[int, dict[tuple[int, ...], int]] = {}
    free = np.zeros(top + 1, np.int64)

    def put(own: tuple[int, ...], n: int) -> None:
        room = top - sum(own)
        by_room.setdefault(room, {})
        by_room[room][own] = by_room[room].get(own, 0) + n
        free[room] += n

    for length in range(top, 0, -1):
        n = int(left[length])
        while n:
            rooms = np.flatnonzero(free[length:])
            if len(rooms):
                room = length + int(rooms[0])
                own, have = by_room[room].popitem()
                used = min(n, have)
                free[room] -= have
                if have > used:
                    put(own, have - used)
                put((*own, length), used)
                n -= used
            else:
                each = top // length
                if n >= each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                n = 0
    return [({x: own.count(x) for x in own}, n) for sets in by_room.values() for own, n in sets.items()]


def _solved(counts: np.ndarray, rate: float) -> list[tuple[dict[int, int], int]]:
    lengths, top = np.arange(len(counts)), len(counts) - 1
    left, weight, out = counts.astype(np.int64).copy(), np.zeros(len(counts)), []
    total = float((counts * lengths).sum())
    for _ in range(ROUNDS):
        if not left.any():
            break
        price = np.where(left > 0, lengths / top * np.exp(weight), -1.0)
        best, pick = _knapsack(price)
        taken = 0
        for first in np.flatnonzero(left)[::-1].tolist():
            if not left[first] or price[first] + best[top - first] < best[top] * (1 - NEAR):
                continue
            own = _configuration(first, pick)
            most = min(int(left[x]) // k for x, k in own.items())
            if most:
                times = max(1, int(most * STEP))
                for x, k in own.items():
                    left[x] -= k * times
                out.append((own, times))
                taken += times
        if not taken:
            break
        weight += rate * (left / np.maximum(counts, 1) - float((left * lengths).sum()) / total)
    return out + best_fit(left)


def solve(counts: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Configurations (how often each length) and their times, which hold exactly ``counts`` pieces of each length."""
    least, best, found = -(-int((counts * np.arange(len(counts))).sum()) // (len(counts) - 1)), [], 0
    for rate in RATES:
        own = _solved(counts, rate)
        used = sum(n for _, n in own)
        if not best or used < found:
            best, found = own, used
        if found == least:  # no packing has fewer
            break
    return best


def _plan(solution: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For runs of numbered pieces of a length: where the run starts, its first sequence, pieces a sequence, first offset."""
    rows, given, sequence = [], {}, 0
    for own, times in solution:
        offset = 0
        for length in sorted(own, reverse=True):
            k = given.get(length, 0)
            rows.append((length, k, sequence, own[length], offset))
            given[length] = k + own[length] * times
            offset += length * own[length]
        sequence += times
    rows.sort()
    return dict(zip(("length", "start", "sequence", "each", "offset"), np.array(rows or [(0, 0, 0, 1, 0)], np.int64).T, strict=True))


def packed(parts: DataFrame) -> DataFrame:
    """The pieces with sequence_id and offset; ``parts`` has one row a piece and its length."""
    rows = numbered(parts, ["length"], "nth")
    counts = np.zeros(CAPACITY + 1, np.int64)
    for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect():  # CAPACITY rows at most
        counts[r.length] = r.n
    plan = parts.sparkSession.sparkContext.broadcast(_plan(solve(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        wide = 1 << 50  # beyond the number of pieces of a length
        runs = p["length"] * wide + p["start"]
        for b in batches:
            length, nth = (b.column(c).to_numpy() for c in ("length", "nth"))
            k = np.searchsorted(runs, length * wide + nth, "right") - 1
            nth = nth - p["start"][k]
            made = [p["sequence"][k] + nth // p["each"][k], p["offset"][k] + nth % p["each"][k] * length]
            kept = b.drop_columns(["nth"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, made)], names=[*kept.schema.names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return rows.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def sequences(docs: DataFrame, **files: str) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (CAPACITY at most), doc_ids in order."""
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # CAPACITY pieces at most
    rows = packed(pieces(docs, ids=True, **files)).groupBy("sequence_id").agg(own.alias("own"))
    return rows.select("sequence_id", F.flatten("own.ids").alias("ids"), F.col("own.doc_id").alias("doc_ids"))


def op13_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(pieces(table(spark, sf_dir, "documents")))
