"""The Jaccard join against a comparison of all pairs."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import jaccard


def plain_set(text, size=3):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_join(rows, size=3, share=90):
    sets = [plain_set(t, size) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc_id)
    told = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((d, len(s), told[find(i)], n) for i, ((d, _), s, n) in enumerate(zip(rows, sets, links))), key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def copies(rng, n, edits, length, words=4000):
    """Copies of one text, each with some words replaced."""
    base = [f"w{rng.randrange(words)}" for _ in range(length)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randint(*edits)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(words)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("leaf, pivots, share, seed", [(128, 16, 90, 1), (4, 3, 90, 2), (6, 4, 70, 3)])
def test_join_is_that_of_all_pairs(spark, monkeypatch, leaf, pivots, share, seed):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    rng = random.Random(seed)
    texts = [*copies(rng, 25, (0, 3), 120), *copies(rng, 12, (0, 6), 300), *copies(rng, 10, (0, 1), 12), *copies(rng, 8, (0, 2), 31)]
    chain = copies(rng, 1, (0, 0), 200)[0].split()
    for i in range(20):  # each is linked to the next ones only, areas with room for Voronoi regions
        texts.append(" ".join(chain))
        for k in range(4):
            chain[(37 * i + 11 * k) % 200] = f"y{i}{k}"
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} {t}" for t in copies(rng, 10, (20, 40), 60)]  # many share a passage, none are alike
    texts += [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randint(1, 15))) for _ in range(40)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(jaccard.jaccard_join(frame, share=share)) == plain_join(rows, share=share)


def test_regions_are_split_around_pivots(spark, monkeypatch):
    """A chain of texts falls into several regions, some texts stand in more than one, and linked ones meet at home."""
    monkeypatch.setattr(jaccard, "LEAF", 8)
    monkeypatch.setattr(jaccard, "PIVOTS", 24)
    sets = [(np.arange(5 * k, 5 * k + 100, dtype=np.uint64)) for k in range(200)]  # a chain
    rows = [(7, k, k, 100, True) for k in range(200)]
    elements = spark.createDataFrame([(k, k, s.tobytes()) for k, s in enumerate(sets)], "k1 long, k2 long, elements binary")
    regions = jaccard._regions(spark.createDataFrame(rows, "region long, k1 long, k2 long, n long, own boolean"), elements, 90).collect()
    homes = [r.k1 for r in regions if r.own]
    assert sorted(homes) == list(range(200)) and len({r.region for r in regions}) > 3 and len(regions) > 200
    together = {(a.k1, b.k1) for a, b in itertools.permutations(regions, 2) if a.region == b.region and a.own}
    assert all((k, k + 1) in together for k in range(199))  # d = 1 - 95/105 < 0.1


def test_sets_and_parts():
    a, b, c, d, e = jaccard.shingle_sets(pa.array(["A b\tc  d", "a B c d e", None, " ", "a b"]), 3)
    assert [len(x) for x in (a, b, c, d, e)] == [2, 3, 0, 0, 1]
    assert set(a.tolist()) <= set(b.tolist())
    rng = np.random.default_rng(2)
    for share, n in itertools.product((60, 90), (1, 2, 5, 19, 20, 21, 300, 1500)):
        for _ in range(8):
            x = np.unique(rng.integers(0, 2**62, n).astype(np.uint64))
            gone = rng.integers(0, n + 1)
            y = np.unique(np.concatenate((x[gone:], rng.integers(0, 2**62, rng.integers(0, n // 3 + 1)).astype(np.uint64))))
            both = len(np.intersect1d(x, y))
            if len(y) and 100 * both >= share * (len(x) + len(y) - both):
                assert np.intersect1d(jaccard.parts_of(x, share), jaccard.parts_of(y, share)).size


def test_odd_rows(spark):
    """Null and empty texts and ids, repeated rows, long texts, columns with the names used inside."""
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n "), (None, "a b"), (None, "A B"), (9, "a  b"), (4, long), (5, long + " z"), (6, "é É"), (7, "É é"), (9, "a  b"), (None, "q r s t")]
    frame = spark.createDataFrame([(*r, 0, "p") for r in rows], "doc_id long, text string, k1 int, parts string")
    words = [(d, t.replace("\n", " ") if t else t) for d, t in rows]
    assert found(jaccard.jaccard_join(frame)) == plain_join(words)
    assert jaccard.jaccard_join(frame.where("false")).count() == 0
