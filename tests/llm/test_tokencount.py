import numpy as np

from conftest import SMALL
from tidemark.llm import tokencount
from tidemark.llm.secrets import encoding


def count(text):
    return len(encoding(tokencount.VOCABULARY).encode_ordinary(text or ""))


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)
    found = {r.doc_id: r.n_tokens for r in tokencount.document_tokens(docs).collect()}
    assert found == {r.doc_id: count(r.text) for r in docs.collect()}


def test_documents_across_blocks(spark, tmp_path):
    rng = np.random.default_rng(4)
    files, want = [], []
    for f in range(3):
        tokens = rng.choice([tokencount.END, 1, 2, 3], 500, p=[0.05, 0.35, 0.3, 0.3]).astype("<u2")
        path = tmp_path / f"{f}.tokens"
        path.write_bytes(tokens.tobytes())
        files.append((str(path), 500))
        start = 0
        for n, end in enumerate(np.flatnonzero(tokens == tokencount.END)):
            want.append((str(path), n, start, int(end) - start))
            start = int(end) + 1
    (tmp_path / "none.tokens").write_bytes(b"")
    frame = spark.createDataFrame([*files, (str(tmp_path / "none.tokens"), 0)], "path string, tokens long")
    for block in (1, 7, 64, 1000):
        assert sorted(tuple(r) for r in tokencount.scan(frame, block_tokens=block).collect()) == sorted(want)
    assert tokencount.scan(frame.limit(0)).count() == 0


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "<|endoftext|>"), (3, "<|endoftext|>"), (4, "word " * 20_000)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_tokens int")
    found = sorted(((r.doc_id, r.n_tokens) for r in tokencount.document_tokens(docs).collect()), key=repr)
    assert found == sorted(((i, count(t)) for i, t in rows), key=repr)
    assert tokencount.document_tokens(docs.limit(0)).count() == 0


def test_blocks_of_a_long_text(monkeypatch):
    text = "Some words, don't  split badly 123 456\n\nÜber alles " * 50
    monkeypatch.setattr(tokencount, "TEXT_BLOCK", 10)
    blocks = list(tokencount.token_blocks(text, tokencount.VOCABULARY))
    assert len(blocks) > 20 and np.concatenate(blocks).tolist() == encoding(tokencount.VOCABULARY).encode_ordinary(text)
