"""Packing: ids as the library gives them, whole sequences, few of them."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronofold.llm import packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
ENCODER = packing.Encoder(*(open(public_tokenizers.path(f), "rb").read() for f in (packing.VOCABULARY, packing.RANKS)))
SCHEMA = "length long, doc_id long, text string, nth long, sequence_id string, `offset` int"


def library(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'.,sé0a  \x1c")), max_size=40), max_size=5))
def test_ids_are_the_library_s(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode(texts)] == [library(t) for t in texts]


def test_ids_of_special_and_long_texts():
    texts = ["a <|endoftext|> b", "x<|endoftext|>  \n y", "x" * 40_000, " " * 40_000 + "z", "it's they're  I'll\n\n don't", "", "don't\tstop  \n", "\n\n", " ", "a \n", "end  "]
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode(texts)] == [library(t) for t in texts]


def test_a_full_memory_is_emptied(monkeypatch):
    monkeypatch.setattr(packing, "PARTS", 10)
    texts = [f"word{k} other{k % 3} and more words than fit" for k in range(30)]
    for k in range(0, 30, 5):
        assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode(texts[k : k + 5])] == [library(t) for t in texts[k : k + 5]]


def fits(counts):
    out = packing.solve(counts)
    held = collections.Counter()
    for own, times in out:
        assert times > 0 and sum(x * k for x, k in own.items()) < len(counts)
        for x, k in own.items():
            held[x] += k * times
    assert {x: int(n) for x, n in enumerate(counts) if n} == held
    return sum(n for _, n in out)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=24))
def test_every_piece_has_a_place(counts):
    counts = np.array([0, *counts])
    volume = -(-int((counts * np.arange(len(counts))).sum()) // (len(counts) - 1))
    used = fits(counts)
    assert volume <= used <= 1 + 11 / 9 * best(counts, volume)


def best(counts, least):
    """Sequences that best fit alone would need, which is at least what the best packing needs."""
    return max(least, sum(n for _, n in packing.best_fit(counts)))


def test_sequences_are_few():
    rng = np.random.default_rng(2)
    for name, lengths in {"documents": rng.lognormal(6, 1.2, 20_000).astype(int) % 2048 + 1, "no small ones": rng.integers(500, 900, 5000)}.items():
        counts = np.bincount(lengths, minlength=packing.CAPACITY + 1)
        used, plain = fits(counts), sum(n for _, n in packing.best_fit(counts))
        volume = -(-int(lengths.sum()) // packing.CAPACITY)
        assert used <= 1.001 * volume if name == "documents" else used < 0.97 * plain


@pytest.mark.parametrize("n", [1, 40, 300])
def test_rows_against_the_library(spark, n):
    rng = random.Random(n)
    words = ["alpha", "beta", "Gamma's", "12", "é", "x\ty", "\n\n", "  "]
    texts = [rng.choice([None, "", "one word", " ".join(rng.choices(words, k=rng.randrange(1, 400))), " ".join(rng.choices(words, k=4000))]) for _ in range(n)]
    data = [(1, k if k % 7 else None, t, 1, "x", 1) for k, t in enumerate(texts)] + [(1, 1, "one word", 1, "x", 1)] * 3
    docs = spark.createDataFrame(data, SCHEMA)
    rows = packing.packed(packing.pieces(docs, ids=True)).collect()
    want = collections.Counter()
    for _, doc_id, text, *_ in data:
        ids = [*library(text or ""), 0]
        first = len(ids) % 2048 or 2048 if len(ids) > 2048 else len(ids)
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc_id, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r["offset"], r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    volume = -(-sum(r.length for r in rows) // 2048)
    assert len(by) <= 1.1 * volume + 1
    made = {r.sequence_id: r.ids for r in packing.sequences(docs).collect()}
    assert sum(map(len, made.values())) == sum(r.length for r in rows) and max(map(len, made.values())) <= 2048


def test_empty(spark):
    assert packing.packed(packing.pieces(spark.createDataFrame([], SCHEMA))).collect() == []
