"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import collections
import random

import corpus_pipeline
import pytest

from chronofold.llm import line_dedup, media, mixing, ngram_join, pieces, secrets, surrogates, toxicity

CLASH = ["txh", "row", "tokens", "score", "predicted", "all", "hit", "v", "bucket", "doc", "gone", "lid", "words", "size", "key", "target", "taken", "_id", "_s", "_txh", "_hit", "h1", "base", "raw", "spans", "id", "own", "times"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def rows():
    rng = random.Random(8)
    words = [f"word{i}" for i in range(500)]
    long = " ".join(rng.choice(words) for _ in range(12_000)) + "\n" + "x" * 20_000
    texts = [
        (1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (None, "a null id has a text too"), (None, None), (3, None), (4, ""), (5, " \n\t "),
        (6, long), (7, long), (8, "mail a@b.org or password=hunter22 idiot"), (9, "é😀\nline two of this text\nline two of this text"), (10, "Mr Smith called 555-123-4567"),
    ]
    return [(i, t, "en", None if k % 4 == 0 else f"s{k % 2}", 1, *["kept"] * len(CLASH)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    df.cache().count()
    return df


@pytest.fixture(scope="module")
def model(spark, docs):
    return toxicity.fit(docs, spark.createDataFrame([(8, 1), (8, None), (1, 0), (None, 1)], "doc_id long, toxic int"))


def ids(df):
    return collections.Counter(r.doc_id for r in df.select("doc_id").collect())


ALL = collections.Counter(r[0] for r in rows())
PER_ROW = {
    "op1": lambda d, m: toxicity.score(d, m).select("doc_id", "text", "score"),
    "op2": lambda d, m: mixing.mix(d)[1].drop("row"),
    "op4": lambda d, m: media.media_digests(d),
    "op5": lambda d, m: secrets.scan(d),
    "op7": lambda d, m: pieces.encode(d, chunk=4096).select("doc_id", "text", "tokens"),
    "op8": lambda d, m: surrogates.pseudonymise(d, b"k"),
    "op10": lambda d, m: ngram_join.jaccard_components(d),
}


@pytest.mark.parametrize("op", sorted(PER_ROW))
def test_a_row_for_each_document_and_equal_results_for_equal_rows(docs, model, op):
    got = PER_ROW[op](docs, model).collect()
    assert collections.Counter(r.doc_id for r in got) == ALL
    assert len({str(r) for r in got if r.doc_id == 1}) == 1 or op == "op2"  # equal rows share what the mix takes of them
    assert PER_ROW[op](docs.limit(0), model).count() == 0


STAGES = {
    "toxicity": (lambda d, m: toxicity.clean(d, m), lambda n: n),
    "line dedup": (lambda d, m: line_dedup.dedup_documents(d), None),
    "n-gram join": (lambda d, m: ngram_join.one_of_each(d, n=5), None),
    "mixing": (lambda d, m: mixing.mixed_documents(d), None),
}


@pytest.mark.parametrize("stage", sorted(STAGES))
def test_stages_keep_all_columns(docs, model, stage):
    out = STAGES[stage][0](docs, model)
    assert out.columns == docs.columns
    got = out.collect()
    assert all(r[c] == "kept" for r in got for c in CLASH)
    texts = {(r[0], r[1]) for r in rows()}
    if stage != "line dedup":
        assert {(r.doc_id, r.text) for r in got} <= texts
    left = collections.Counter(r.doc_id for r in got)
    if stage == "toxicity":
        assert left == ALL - collections.Counter([8]) or left == ALL
    if stage == "n-gram join":  # one of documents 1, 1 and 2, one of 6 and 7; those without words stay
        assert left[1] == 1 and not left[2] and left[6] == 1 and not left[7] and left[3] == left[4] == left[5] == 1
    if stage == "line dedup":
        by = {r.doc_id: r.text for r in got}
        assert left[1] == 1 and not left[2] and by[9] == "é😀\nline two of this text" and left[4] == left[5] == 1 and not left[7]
    assert STAGES[stage][0](docs.limit(0), model).count() == 0


def test_mixing_shares_repeats_of_equal_rows(spark):
    d = spark.createDataFrame([(1, "a b", "en", "x", 1)] * 3 + [(2, " ".join("w" for _ in range(30)), "en", "y", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    _, sizes = mixing.mix(d)
    want = collections.Counter()
    for r in sizes.collect():
        want[r.doc_id] += r.taken // r.size if r.size else 0
    assert ids(mixing.mixed_documents(d)) == want


def test_a_token_column_replaces_one_of_its_name(docs):
    out = pieces.encode(docs, chunk=4096)
    assert sorted(out.columns) == sorted(docs.columns) and dict(out.dtypes)["tokens"] == "array<int>"


def test_the_pipeline_end_to_end(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(60)]
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    docs += [(100 + i, base[i], "en", "s0", 1) for i in range(5)] + [(200, base[7] + " w1 w2", "en", "s1", 1), (300, None, None, None, None), (301, "", "en", "s1", 0)]
    docs += [(400 + i, " ".join(rng.choice(words) for _ in range(30)) + " idiot moron scum vermin", "en", "s2", 1) for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d[0], int(d[0] >= 400)) for d in docs], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {r.doc_id for r in got}
    assert not left & set(range(400, 430)), "toxic documents go"
    assert not left & set(range(100, 105)), "copies lose all their lines"
    assert len({7, 200} & left) == 1, "one of the near copies stays"
    texts = {d[0]: d[1] for d in docs}
    assert all(r.text == texts[r.doc_id] for r in got)
    taken = collections.Counter(r.doc_id for r in got)
    assert max(taken.values()) <= 3
    m = pieces.Pieces(open(pieces.MODEL, "rb").read())
    assert all(r.tokens == m.sp.encode(r.text) for r in got)
