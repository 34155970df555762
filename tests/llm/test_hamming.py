import numpy as np
import pytest

from tidemark.llm import hamming

SCHEMA = "vec_id long, embedding array<float>, code string"


def brute(rows, queries, k):
    code = {i: hamming.sign_code(v) for i, v in rows if i is not None and v}
    found = []
    for q in sorted({i for i, v in queries if i is not None and v}):
        near = sorted(((code[q] ^ c) & ((1 << 64) - 1)).bit_count() * 10**6 + i for i, c in code.items() if i != q)[:k]
        found += [(q, n + 1, x % 10**6, x // 10**6) for n, x in enumerate(near)]
    return found


@pytest.mark.parametrize("dims, k", [(64, 5), (20, 3), (100, 4)])
def test_same_as_brute_force(spark, dims, k):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(5, dims))
    rows = [(i, (centres[i % 5] * (i % 3) + rng.normal(size=dims) * 0.5).tolist()) for i in range(260)]
    rows += [(i, rows[0][1]) for i in range(300, 340)] + [(900, None), (901, []), (None, rows[3][1])]
    frame = spark.createDataFrame([(*r, "c") for r in rows], SCHEMA)
    asked = frame.where("vec_id % 50 = 0 OR vec_id >= 900")
    found = sorted(tuple(r) for r in hamming.nearest(frame, asked, k).collect())
    assert found == brute(rows, [r for r in rows if r[0] is not None and (r[0] % 50 == 0 or r[0] >= 900)], k)


def test_few_and_none(spark):
    frame = spark.createDataFrame([(1, [1.0, -1.0], "c"), (1, [1.0, -1.0], "c"), (2, [None, -1.0], "c")], SCHEMA)
    assert sorted(tuple(r) for r in hamming.nearest(frame, frame, 10).collect()) == [(1, 1, 2, 1), (2, 1, 1, 1)]
    assert hamming.nearest(frame.limit(0), frame.limit(0), 10).count() == 0
    assert hamming.nearest(frame, frame.limit(0), 10).count() == 0
