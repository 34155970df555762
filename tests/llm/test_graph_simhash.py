import random

import pytest
import xxhash

from conftest import SMALL
from tidemark.llm import graph, simhash


def union_find(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_of_random_links(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7), (None, 3)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert found == union_find({n for p in real for n in p}, real)


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = bytes(text or "", "utf-8").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    nodes = sorted(set(prints))
    near = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a ^ b).bit_count() <= 4]
    roots = union_find(nodes, near)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    return sorted(((i, f"{p:016x}", least.get(roots[p])) for (i, _), p in zip(rows, prints)), key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_near_duplicates_of_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert got(simhash.near_duplicates(docs)) == expected([(r.doc_id, r.text) for r in docs.collect()])


ODD = [
    (5, None), (6, ""), (7, " \t\n"), (2, "one two"), (3, "ONE\x0btwo"), (3, "ONE\x0btwo"), (None, "one two"), (None, "alone here so far"),
    (9, "É a b c d e"), (10, "word " * 3000),
]


def test_odd_rows_and_other_columns(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in ODD], "doc_id long, text string, fp long, n string")
    assert got(simhash.near_duplicates(docs)) == expected(ODD)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)[0][0] == 10
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["10", "2", "5", "9", "None"]


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300)) for _ in range(12)]
    rows = [(None, t) for t in texts[:8]] + [(1, texts[0]), (2, texts[1].upper()), (3, texts[8]), (3, texts[9]), (3, texts[9])]
    rows += [(None, texts[7])] * 3 + [(5, texts[10]), (4, texts[10]), (None, None), (None, None), (6, ""), (7, texts[11])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    want = [(None, t) for t in texts[2:8]] + [(1, texts[0]), (2, texts[1].upper()), (3, texts[8]), (3, texts[9]), (4, texts[10]), (6, ""), (7, texts[11])]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)).encode()
    whole = simhash.fingerprint_of(text)
    monkeypatch.setattr(simhash, "BLOCK", 100)
    assert simhash.fingerprint_of(text) == whole == plain_fingerprint(text.decode())


@pytest.mark.parametrize("crowd", [2, 1000])
def test_links_are_exact_in_crowds(spark, crowd):
    rng = random.Random(1)
    near = {rng.getrandbits(64)}
    base = next(iter(near))
    while len(near) < 120:
        x = base
        for _ in range(rng.randrange(7)):
            x ^= 1 << rng.randrange(64)
        near.add(x)
    near |= {rng.getrandbits(64) for _ in range(50)}
    signed = sorted(x - (1 << 64 if x >> 63 else 0) for x in near)
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}
    found = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, crowd).collect()]
    assert len(found) == len(set(found)) and set(found) == want
