import itertools
import random
import re
import string

from conftest import SMALL
from tidemark.llm import secrets

KEY = "AKIA" + "Q" * 12
RANDOM = "xK9vQ2mZpL7wR4tYb8NcJ3sHd6F"


def spans(spark, texts):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    return [[tuple(s) for s in r.spans] for r in secrets.spans(docs).orderBy("doc_id").collect()]


def test_forms(spark):
    found = spans(spark, [
        'é Password = "abcdefgh"', "token:short", "api_key='a.b-c=d_/+'", f"{KEY} AKIAQ", "0123456789abcdef" * 2 + "G", "apiKEY : 12345678 secret=87654321",
        None, "", "paſſword=abcdefgh1", "ABCDEF0123456789" * 2,
    ])
    assert found == [
        [("assign", 2, 22)], [], [("assign", 0, 19)], [("access", 0, 16)], [("hex", 0, 32)], [("assign", 0, 17), ("assign", 18, 33)],
        [], [], [], [],
    ]


def test_token_efficiency(spark):
    clean = [
        "d41d8cd98f00b204e9800998ecf8427e"[:31], "DA39A3EE5E6B4B0D3255BFEF95601890AFD80709", "123e4567-e89b-12d3-a456-426614174000",
        "a_very_long_snake_case_identifier", "SomeVeryLongCamelCaseIdentifier2", "thehereininterstiontionthe", "20240131120000123456789",
    ]
    assert all(not any(s[0] == "random" for s in found) for found in spans(spark, clean[1:]))
    assert spans(spark, [f"key {RANDOM} end", f"token={RANDOM}"]) == [[("random", 4, 4 + len(RANDOM))], [("assign", 0, 6 + len(RANDOM))]]


def test_random_strings_of_one_case_in_groups_and_in_paths(spark):
    rng = random.Random(5)

    def some(letters, n):
        return "".join(rng.choice(letters) for _ in range(n))

    lower, upper = string.ascii_lowercase, string.ascii_uppercase
    whole = [some(letters, 40) for letters in (lower, upper) for _ in range(20)]
    whole += ["-".join(some(lower, 4) for _ in range(6)) for _ in range(20)]
    found = spans(spark, [f"key {x} end" for x in whole])
    assert sum(f == [("random", 4, 4 + len(x))] for f, x in zip(found, whole)) >= 57
    before = "com/users/profile/settings/download/"
    parts = [RANDOM, some(lower, 40), some(upper, 40), "-".join(some(lower, 4) for _ in range(6))]
    for part, after in itertools.product(parts, ("", "/some/other/readable/words/after/it")):
        (one,) = spans(spark, [before + part + after])[0]
        assert one[0] == "random" and one[1] <= len(before) and one[2] >= len(before + part)
    clean = [
        before, "to-be-or-not-to-be-that-is-the-question", "users/123e4567-e89b-12d3-a456-426614174000/profile/settings",
        "CONTENT_SECURITY_POLICY_HEADER", "getElementsByClassNameAndTagName", "reports/2024/01/31/summary-of-the-year",
    ]
    assert spans(spark, clean) == [[] for _ in clean]


def test_same_as_plain_patterns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for row in secrets.spans(docs).collect():
        text, want = texts[row.doc_id], []
        want += [("assign", *m.span()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 8]
        want += [("access", *m.span()) for m in secrets.ACCESS.finditer(text) if len(m[0]) >= 16]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        want.sort(key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        assert [tuple(s) for s in row.spans if s.kind != "random"] == want


def test_nothing(spark):
    assert spans(spark, []) == []


def test_long_runs_take_linear_time():
    """Letters that end in what is no word, a long identifier, and many digests beside many runs."""
    import time

    began = time.time()
    for run in ("gattaca" * 1500 + "7x", "A" * 10_000 + "b0c", "0a" * 5000, "ab-" * 4000 + "7x"):
        assert secrets._IDENTIFIER.fullmatch(run) is None
        secrets.random_spans(run, [], secrets.VOCABULARY, 20, 2.0)
    assert secrets._IDENTIFIER.fullmatch("some/pathName-with_HTTPServer-2024/x")
    text = " ".join(f"{i:064x} k{i:x}Zq9XwV7tRb2LmN4pHs8" for i in range(2000))
    base = secrets.base_spans(text)
    assert len(base) == 2000 and len(secrets.random_spans(text, base, secrets.VOCABULARY, 20, 2.0)) > 1000
    assert time.time() - began < 20


def test_taken_ranges():
    taken = secrets._Taken([("a", 5, 9), ("b", 0, 3), ("c", 8, 12)])
    assert [taken.meets(*x) for x in ((3, 5), (2, 4), (4, 6), (11, 20), (12, 20), (0, 1))] == [False, True, True, True, False, True]
