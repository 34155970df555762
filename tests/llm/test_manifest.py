"""The Merkle manifest against a plain recursive definition."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(*values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_proofs(leaves: list[str], fanout: int) -> tuple[str, list[list[str]]]:
    """The root, and each leaf's siblings level by level."""
    paths, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for path, i in zip(paths, range(len(leaves))):
            run = at[i] - at[i] % fanout
            path += [nodes[k] for k in range(run, min(run + fanout, len(nodes))) if k != at[i]]
            at[i] //= fanout
        nodes = [sha("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
    return nodes[0], paths


@pytest.mark.parametrize("fanout, block, sizes", [(2, 4, [1, 2, 37, 64, 65]), (3, 9, [1, 28, 100]), (2, 2, [3, 17, 0])])
def test_proofs_are_those_of_the_definition(spark, fanout, block, sizes):
    rows = [(f"t{t}", k, sha(f"{t} {k}"), "x" if k % 3 else None) for t, n in enumerate(sizes) for k in range(n)]
    random.Random(1).shuffle(rows)
    leaves = spark.createDataFrame(rows, "tree string, key long, leaf string, changed string").repartition(5)
    found = manifest.proofs(leaves, fanout, block)
    found = found.select("tree", "key", "leaf", "changed", "root", manifest.proof_digest(F.col("path")).alias("proof"), manifest.fold(F.col("leaf"), F.col("path")).alias("folded"))
    got = {(r.tree, r.key): r for r in found.collect()}
    assert len(got) == len(rows)
    for t, n in enumerate(sizes):
        if n:
            root, paths = plain_proofs([sha(f"{t} {k}") for k in range(n)], fanout)
            for k, path in enumerate(paths):
                r = got[f"t{t}", k]
                assert (r.root, r.folded, r.proof) == (root, root, sha("".join(path)))
                assert r.changed == ("x" if k % 3 else None)


def test_odd_rows(spark):
    """Nulls in any column, equal ids and rows, empty and long texts, columns with the names used inside."""
    rows = [(None, "s", None, None, None), (3, None, "de", 2, "ab"), (3, None, "de", 2, "ab"), (3, None, "de", 2, ""), (-1, "é", "", 0, None), (9, "s", "é", 9, "x" * 300_000)]
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos int, root string")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    found = manifest.manifest(docs, "doc_id", "lang", fields, block=2).collect()
    leaves = {}
    for r in rows:
        leaves.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(*r)))
    trees = sorted(leaves, key=lambda lang: (lang is not None, (lang or "").encode()))
    subroots = {lang: plain_proofs([x[2] for x in sorted(leaves[lang])], 2)[0] for lang in trees}
    root, _ = plain_proofs([subroots[lang] for lang in trees], 2)
    assert len(found) == len(rows)
    assert all(r.root == root and r.subroot == subroots[r.tree] for r in found)
    assert sorted(r.leaf for r in found) == sorted(plain_leaf(*r) for r in rows)


def test_empty_table_and_single_row(spark):
    docs = spark.createDataFrame([(1, "en", "a")], "doc_id long, lang string, text string")
    fields = [F.col("doc_id"), F.col("text")]
    assert manifest.manifest(docs.where("false"), "doc_id", "lang", fields).count() == 0
    row = manifest.manifest(docs, "doc_id", "lang", fields).first()
    assert row.leaf == row.subroot == row.root == plain_leaf(1, "a") and row.path == []


def test_a_changed_leaf_is_told(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("lang"))
    found = manifest.manifest(docs, "doc_id", "lang", [F.col("doc_id")], manifest.leaf_digest(F.col("doc_id") + 1), block=4)
    good, bad = (manifest.fold(F.col(c), F.col("path")) == F.col("root") for c in ("leaf", "changed"))
    assert found.where(good).count() == 50 and found.where(bad).count() == 0


def test_block_must_be_a_power(spark):
    with pytest.raises(ValueError):
        manifest._depth(6, 2)
