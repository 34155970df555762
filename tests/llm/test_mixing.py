import re

import pytest

from conftest import SMALL
from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target long, bucket long"


def rows_of(spark, sizes):
    """Documents ``(id, words, source)``."""
    return spark.createDataFrame([(i, "w " * n if n is not None else None, s, "x", 1, 2) for i, n, s in sizes], SCHEMA)


def plain_targets(totals, weights=(5, 2, 1)):
    order = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = sum(totals.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 3 * totals[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = 3 * totals[s]
            left -= target[s]
        open_ -= full
    return target


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = mixing.mix(docs, bucket_rows=7).collect()
    again = mixing.mix(docs, bucket_rows=1000).collect()
    assert sorted(found) == sorted(again)
    texts = {r.doc_id: r for r in docs.collect()}
    totals = {}
    for r in found:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id].text or ""))
        assert r.source == texts[r.doc_id].source and r.taken in [r["size"] * k for k in range(4)]
        totals[r.source] = totals.get(r.source, 0) + r["size"]
    want = plain_targets(totals)
    for source, target in want.items():
        mine = [r for r in found if r.source == source]
        assert all(r.target == pytest.approx(target) and r.source_size == totals[source] for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= max(r["size"] for r in mine) / 2


def test_ceilings_and_odd_rows(spark):
    docs = rows_of(spark, [(1, 2, "a"), (2, 3, "a"), (3, 400, "b"), (3, 400, "b"), (4, None, "c"), (5, 0, "c"), (6, 10, None), (None, 50, "d")])
    found = mixing.mix(docs).collect()
    assert len(found) == 8
    totals = {"a": 5, "b": 800, "c": 0, "d": 50, None: 10}
    want = plain_targets(totals)
    assert want["a"] == 15 and want["c"] == 0
    for r in found:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == totals[r.source]
    assert sorted(r.taken for r in found if r.source == "a") == [6, 9]


def test_better_documents_come_more_often(spark):
    docs = spark.createDataFrame([(i, ("plain words here " if i % 2 else "12# 4$5 6%7 ") * 3, "a") for i in range(400)] + [(i, "w " * 12, "b") for i in range(400, 1200)], "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs, weights=(1, 7)).collect()}
    assert sum(taken[i] for i in range(1, 400, 2)) > 1.5 * sum(taken[i] for i in range(0, 400, 2))


def test_nothing(spark):
    assert mixing.mix(rows_of(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(rows_of(spark, [(1, 0, "a"), (2, None, None)])).collect()] == [0, 0]
