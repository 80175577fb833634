"""Surrogates of names are neither names of the corpus nor shared."""

import re

import pytest

from chronofold.llm import surrogates

KEY = b"test"
SCHEMA = "doc_id long, text string"
SHORT = [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "abcdefghijklmnopqrstuvwxyz"]


def test_names_never_become_names_of_the_corpus(spark):
    given = ["Zoe", "Kai", surrogates.surrogate("given", "m:Kai", KEY)[2:], surrogates.surrogate("given", "f:Zoe", KEY)[2:]]
    rows = [(i, f"Mr {s}") for i, s in enumerate(SHORT[:300])]
    rows += [(1000 + i, f"{t} {g} Longname") for i, g in enumerate(given) for t in ("Frau",)] + [(1100 + i, f"Herr {g} Longname") for i, g in enumerate(given)]
    rows += [(1200, "Frau Anna Longname"), (1201, "Mr \u4e00\u4e01")]
    got = {r.doc_id: r.text for r in surrogates.pseudonymise(spark.createDataFrame(rows, SCHEMA), KEY).collect()}
    short = [got[i].split(" ")[1] for i in range(300)]
    assert not set(short) & set(SHORT[:300]) and len(set(short)) == 300
    assert all(re.fullmatch("[A-Z][a-z]", s) for s in short)
    new = [got[1000 + i].split(" ")[1] for i in range(4)]
    assert not set(new) & {*given, *surrogates.FEMALE, *surrogates.MALE} and len(set(new)) == 4
    assert [got[1100 + i].split(" ")[1] for i in range(4)] == new
    assert got[1200].split(" ")[1] in surrogates.FEMALE and got[1201] == rows[-1][1]


def test_a_format_without_free_values_raises(spark):
    rows = [(i, f"Mr {s}") for i, s in enumerate(SHORT[:339])]
    with pytest.raises(ValueError, match="too few"):
        surrogates.pseudonymise(spark.createDataFrame(rows, SCHEMA), KEY).collect()


def test_one_surrogate_for_all_spellings(spark):
    texts = [
        "555-123-4567", "(555) 123-4567", "555.123.4567", "+1 555 123 4567",
        "Mail Jo.Doe@Example.org or jo.doe@example.org", "JO.DOE@EXAMPLE.ORG",
        "4111 1111 1111 1111", "4111-1111-1111-1111", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "Mr Smith", "Mr SMITH", "Dr Smith",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, None), (50, ""), (51, texts[0] + " x" * 400_000)]
    got = surrogates.pseudonymise(spark.createDataFrame(rows, SCHEMA), KEY).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.text for r in got}
    assert by[None] is None and by[50] == "" and by[51].startswith(by[0])
    digits = {re.sub(r"\D", "", by[i])[-10:] for i in range(4)}
    assert len(digits) == 1 and digits != {"5551234567"}
    assert all(re.sub(r"\d", "0", by[i]) == re.sub(r"\d", "0", texts[i]) for i in range(4)) and by[3].startswith("+1 ")
    a, b = re.findall(r"\S+@\S+", by[4])
    assert a.lower() == b == by[5].lower() and a != b and by[5].isupper() and b != "jo.doe@example.org"
    assert by[6].replace(" ", "") == by[7].replace("-", "") and surrogates.luhn(by[6].replace(" ", "")[:-1]) == int(by[6][-1])
    assert by[8].replace(" ", "") == by[9] != texts[9]
    assert by[10][3:].upper() == by[11][3:] and by[10][3:] == by[12][3:] != "Smith"
    assert {r.text for r in got if r.doc_id == 0} == {by[0]}


def test_collisions_by_brute_force():
    for kind, values in {"phone": [f"{i:07d}" for i in range(300)], "email": [f"a{i}@b.org" for i in range(300)], "surname": [f"Name{c}" for c in "abcdefghij"]}.items():
        new = [surrogates.surrogate(kind, v, KEY) for v in values]
        assert len(set(new)) == len(values)


def test_a_number_without_separators_and_names_without_their_title(spark):
    texts = ["+1 555-123-4567, 555-123-4567 and +15551234567", "+49 30 1234 5678", "+493012345678", "Dr Maria Smith came. Later Maria Smith left, and Smith too; Smithers and Maria stayed.", "Maria Smith of another text", "smith, SMITH and Mr Smith"]
    got = {r.doc_id: r.text for r in surrogates.pseudonymise(spark.createDataFrame(list(enumerate(texts)), SCHEMA), KEY).collect()}
    a, b, c = (re.sub(r"\D", "", x)[-10:] for x in re.split(", | and ", got[0]))
    assert a == b == c != "5551234567" and got[0].endswith("+1" + c)
    assert re.sub(r"\D", "", got[1]) == re.sub(r"\D", "", got[2]) != "493012345678" and got[2].startswith("+49")
    m = re.fullmatch(r"Dr (\w+) (\w+) came\. Later (\w+) (\w+) left, and (\w+) too; Smithers and Maria stayed\.", got[3])
    assert m and m[1] == m[3] != "Maria" and m[2] == m[4] == m[5] != "Smith"
    assert got[4] == texts[4], "a name that no title introduced in its text stays"
    assert got[5].startswith("smith, SMITH and Mr ") and not got[5].endswith("Smith")
