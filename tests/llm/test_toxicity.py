import numpy as np
import pytest

from tidemark.llm import toxicity

WORDS = "the cat sat on a mat and saw some birds fly over old houses near rivers while children play games".split()
RUDE = ["grumblefoot", "snotwaffle", "dungbeetle"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        words = list(rng.choice(WORDS, 40))
        if i % 4 == 0:
            for _ in range(2):
                words[rng.integers(40)] = RUDE[rng.integers(3)] + "sy"[rng.integers(2)]
        rows.append((i, " ".join(words), "en", 1.0, int(i % 4 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, toxic int")
    return frame.drop("toxic"), frame.select("doc_id", "toxic", "lang")


@pytest.fixture(scope="module")
def model(labelled):
    return toxicity.train(*labelled, sample=400)


def test_held_out_rows(spark, labelled, model):
    docs, labels = labelled
    found = toxicity.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert 80 < len(held) < 160 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert sum(r.predicted == r.toxic for r in held) >= 0.98 * len(held)


def test_labels_of_held_out_rows_are_not_used(spark, labelled, model):
    from pyspark.sql import functions as F

    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.train(docs, turned, sample=400)
    assert np.allclose(other.weights, model.weights) and other.bias == pytest.approx(model.bias)


def test_filter_keeps_columns(labelled, model):
    docs, labels = labelled
    kept = toxicity.keep_clean(docs, labels, sample=400)
    assert kept.columns == docs.columns and 430 < kept.count() < 470


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (None, "snotwaffles are grumblefooty"), (3, "a"), (3, "a"), (4, "cat " * 200_000 + "snotwaffles grumblefooty")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, predicted int")
    found = toxicity.score(docs, model).collect()
    assert len(found) == 6 and {r.doc_id: r.predicted for r in found} == {1: 0, 2: 0, None: 1, 3: 0, 4: 1}
    assert not [r for r in found if r.doc_id is None][0].held_out
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_blocks_of_a_long_text(monkeypatch):
    text = " ".join(WORDS) * 20
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "BLOCK", 50)
    assert np.array_equal(whole, toxicity.features(text))


def test_no_or_one_class(spark, labelled):
    docs, labels = labelled
    for few in (labels.limit(0), labels.where("toxic = 0")):
        nothing = toxicity.train(docs, few, sample=400)
        assert not nothing.weights.any() and nothing.bias < 0
