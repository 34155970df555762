import random

from conftest import SMALL
from tidemark.llm import decontaminate

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
HALVES = "x y z iota kappa lambda mu, other words Eta theta alpha beta gamma delta epsilon zeta! more"
SCHEMA = "doc_id long, text string, items string, coverage int"


def report(spark, texts, items, **options):
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)], SCHEMA)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.report(docs, benchmark, **options).orderBy("doc_id").collect()
    return [[(x.item_id, round(x.coverage, 3)) for x in r["items"]] for r in rows]


def test_reordered_passages_count(spark):
    texts = [ITEM, HALVES, "alpha beta gamma delta only", " ".join(reversed(ITEM.split())), None, "", ITEM.upper() + " " + ITEM]
    want = [[(1, 1.0)], [(1, 0.833)], [], [], [], [], [(1, 1.0)]]
    assert report(spark, texts, [(1, ITEM), (2, "nothing of this kind stands anywhere"), (3, None), (4, "...")]) == want


def test_matches_do_not_overlap(spark):
    # the words stand once in the text, so they tile only one half of an item that has them twice
    assert report(spark, ["a b c d e"], [(1, "a b c d e a b c d e")], coverage=0.4) == [[(1, 0.5)]]
    assert report(spark, ["a b c d e " * 2], [(1, "a b c d e a b c d e")], coverage=0.4) == [[(1, 1.0)]]


def plain_share(text, item, least):
    """Greedy string tiling by definition, over all pairs of places."""
    t, p = decontaminate._WORD.findall(text.lower()), decontaminate._WORD.findall(item.lower())
    free_t, free_p, covered = [True] * len(t), [True] * len(p), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and free_p[i + k] and free_t[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return covered / len(p)
        for d in range(k):
            free_p[i + d] = free_t[j + d] = False
        covered += k


def test_same_as_definition():
    rng = random.Random(2)
    for _ in range(200):
        item = " ".join(rng.choices("abc", k=rng.randrange(3, 14)))
        text = " ".join(rng.choices("abcd", k=rng.randrange(0, 40)))
        index = decontaminate.Index([(1, item)], seed=3)
        share = plain_share(text, item, 3)
        found = index.matches(text, 0.01)
        assert (found[0][1] if found else 0) == share


def test_blocks_of_text_and_benchmark(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    whole = sorted(decontaminate.report(docs, benchmark).collect())
    assert sorted(decontaminate.report(docs, benchmark, block_words=200).collect()) == whole
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    assert {r.doc_id for r in whole if r.contaminated} >= {d.doc_id for d in docs.collect() if any(t in (d.text or "") for _, t in items)}
    index = decontaminate.Index(items)
    texts = [d.text for d in docs.collect()]
    want = [index.matches(t) for t in texts]
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 64)
    assert [index.matches(t) for t in texts] == want


def test_filter_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, ITEM, "a", 1), (None, "clean", "b", 2), (1, None, "c", 3)], SCHEMA)
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert sorted(r["items"] for r in decontaminate.keep_clean(docs, benchmark).collect()) == ["b", "c"]
    assert decontaminate.keep_clean(docs, benchmark.limit(0)).count() == 3
    assert decontaminate.report(docs.limit(0), benchmark).count() == 0
