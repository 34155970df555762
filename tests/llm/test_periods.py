"""Periodic runs against a plain search of every period."""

import random
import zlib

import numpy as np
import pytest

from tidemark.llm import periods, queries


def smallest_period(words) -> int:
    border = [0] * len(words)
    for i in range(1, len(words)):
        k = border[i - 1]
        while k and words[i] != words[k]:
            k = border[k - 1]
        border[i] = k + (words[i] == words[k])
    return len(words) - border[-1]


def plain_runs(words, shortest=24):
    found = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, 3 * q) and smallest_period(words[i : j + q]) == q:
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def some_words(rng: random.Random) -> list[int]:
    """A text of a few stretches: random words of a small or large alphabet, or a repeated root that may hold a repeated root itself."""
    words: list[int] = []
    for _ in range(rng.randint(0, 5)):
        size = rng.choice([1, 2, 3, 50])
        root = [rng.randrange(size) for _ in range(rng.choice([1, 2, 5, 16, 17, 31, 33, 40, 64, 65, 100, 130]))]
        if rng.random() < 0.4:
            root = root + root[: rng.randint(1, len(root))] * rng.randint(1, 9) + [rng.randrange(60)]
        if rng.random() < 0.7:
            n = int(len(root) * rng.uniform(2.5, 6))
            root = (root * 7)[:n]
        words += root
    return words


@pytest.mark.parametrize("seed", range(12))
def test_runs_are_those_of_the_definition(seed):
    rng = random.Random(seed)
    texts = [some_words(rng) for _ in range(rng.choice([1, 3, 30]))]
    sizes = np.array([len(t) for t in texts], np.int64)
    table = periods.runs(np.array([w for t in texts for w in t], np.int64), sizes)
    for k, words in enumerate(texts):
        assert [tuple(r[1:]) for r in table.tolist() if r[0] == k] == plain_runs(words), (seed, k)


def test_hashes_that_meet_change_nothing(monkeypatch):
    """With a hash that can't tell words apart every answer comes from the words."""
    monkeypatch.setattr(periods._Factors, "equal", lambda self, a, b, size: np.ones(len(a), bool))
    words = np.array(([1, 2, 3] * 7 + list(range(10, 29))) * 4 + [7] * 40)
    found = [tuple(r[1:]) for r in periods.runs(words, np.array([len(words)]))]
    assert found == plain_runs(words.tolist())


def test_synchronising_places_depend_on_the_text_around():
    rng = np.random.default_rng(5)
    part, window = rng.integers(0, 9, 200).astype(np.uint64), 7
    a, b = (np.concatenate((rng.integers(0, 9, n).astype(np.uint64), part)) for n in (31, 58))
    inner = lambda x: {int(i) - (len(x) - 200) for i in periods.synchronising(x, window)} & set(range(window, 200 - window))
    assert inner(a) == inner(b)
    gaps = np.diff(periods.synchronising(a, window))
    assert gaps.max() <= window


def test_odd_rows(spark):
    """Null and empty texts, a null id, repeated rows, only white space, a very long text, columns with the names used inside."""
    long = "a b c d " * 60_000
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, "x " * 30), (None, "x " * 30), (4, long), (5, "a b c\x1cd e"), (6, "y\n" * 24)]
    docs = spark.createDataFrame([(*r, 0, "w") for r in rows], "doc_id long, text string, runs int, collapsed string")
    found = {}
    for r in periods.periodic_runs(docs).collect():
        found.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert found[1] == found[2] == found[3] == [(0, [], "")]
    assert found[None] == [(30, [(0, 30, 1)], "x")] * 2
    assert found[4] == [(240_000, [(0, 240_000, 4)], "a b c d")]
    assert found[5] == [(3, [], "a b c\x1cd e")]
    assert found[6] == [(24, [(0, 24, 1)], "y")]
    assert periods.periodic_runs(docs.where("false")).count() == 0


def test_query_against_the_definition(spark, tmp_path):
    """The planted tails, the longest run by exact exponent, and all digests."""
    import hashlib

    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([0, 1, 30, 200])))) for i in range(400)]
    rows += [(900, None), (None, "a b " * 20), (901, "  p  q" * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    some = 0
    for doc_id, text in rows:
        words = (text or "").split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        plain, r = plain_runs(words), found[doc_id]
        some += len(plain)
        assert r.n_runs == len(plain)
        best = None
        for s, n, q in plain:
            if best is None or n * best[2] > best[1] * q:
                best = (s, n, q)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in plain).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(plain_collapsed(words, plain)).encode()).hexdigest()
    assert some > 10
