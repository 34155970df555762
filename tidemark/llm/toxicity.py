"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable

ORDERS = (3, 4, 5)
#: N-grams are hashed to 2 ** BITS features.
BITS = 20
#: Characters of a text that are hashed at once.
BLOCK = 1 << 19


def feature_blocks(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of the n-grams of the lower-cased text with a space at both ends, with repeats, block by block."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, len(codes), BLOCK):
        part = codes[start : start + BLOCK + max(ORDERS) - 1]
        own = min(BLOCK, len(codes) - start)
        rolling = part
        for order in range(2, max(ORDERS) + 1):
            if len(part) < order:
                break
            rolling = rolling[:-1] * np.uint32(0x9E3779B1) + part[order - 1 :]
            if order in ORDERS:
                mixed = (rolling[:own] ^ (rolling[:own] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(order * 0x27D4EB2F & 0xFFFFFFFF)
                yield ((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)


def features(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct feature numbers of a text; only those with ``wanted[number]`` nonzero if it is given."""
    found = [block if wanted is None else block[wanted[block] != 0] for block in feature_blocks(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


class Model(NamedTuple):
    """A weight for each feature (log-count ratio times coefficient) and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights[features(text, self.weights)].sum(dtype=np.float64))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves no remainder by 5. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _chosen_labels(labels: DataFrame, label_col: str, sample: int) -> tuple[DataFrame, float]:
    """``(doc_id, y)`` of at most ``sample`` rows to train on, half of either class if there are enough, and the share of ones in all.

    Rows with the smallest hashes of the id are taken, so that reruns agree. Null ids, null labels and labels other than 0 and 1 are left out, of
    several labels of an id the largest counts.
    """
    known = labels.select(F.col("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).dropna()
    known = known.where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = known.agg(F.avg("y")).first()[0] or 0.0
    order = F.xxhash64("doc_id")
    half = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(sample // 2) for y in (0, 1)]
    return half[0].union(half[1]), share


def _count_table(rows: DataFrame) -> DataFrame:
    """``(feature, y, n)``: in how many training texts of a class a feature occurs; tasks add up what they have read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts[y][features(text.as_py())] += 1
        for y in (0, 1):
            seen = np.flatnonzero(counts[y])
            arrays = [pa.array(seen.astype(np.int32)), pa.array(np.full(len(seen), y, np.int32)), pa.array(counts[y][seen])]
            yield pa.RecordBatch.from_arrays(arrays, ["feature", "y", "n"])

    return rows.mapInArrow(run, "feature int, y int, n int")


def _log_count_ratios(rows: DataFrame, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and ratios of the ``most`` features that tell the classes apart best, out of those in ``least`` texts or more.

    The ratio is log((p + 1) / (n1 + 2)) - log((q + 1) / (n0 + 2)) with p and q the texts of either class that have the feature. Features are
    ranked by the likelihood-ratio statistic of presence against class, so that rare n-grams that stand in
    few texts of one class by chance don't crowd out the telling ones.
    """
    counts = _count_table(rows).groupBy("feature").pivot("y", [0, 1]).agg(F.sum("n").cast("double")).na.fill(0)
    sizes = {row.y: row["count"] for row in rows.groupBy("y").count().collect()}
    n0, n1 = float(sizes.get(0, 0)), float(sizes.get(1, 0))
    q, p = F.col("0"), F.col("1")
    ratio = F.log((p + 1) / (n1 + 2)) - F.log((q + 1) / (n0 + 2))
    have, total = p + q, max(n0 + n1, 1.0)

    def part(seen: Column, texts: Column, size: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen * total / (texts * size))).otherwise(0.0)

    surprise = part(p, have, n1) + part(q, have, n0) + part(n1 - p, total - have, n1) + part(n0 - q, total - have, n0)
    best = counts.where(have >= least).select("feature", ratio.alias("r"), surprise.alias("w"))
    best = best.orderBy(F.desc("w"), "feature").limit(most).select("feature", "r").toPandas()
    return best["feature"].to_numpy(np.int64), best["r"].to_numpy(np.float64)


def _minimise(function, start: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """A minimum of a smooth convex function ``x -> (value, gradient)`` by limited-memory quasi-Newton steps with backtracking."""
    x, (value, gradient), pairs = start, function(start), []
    for _ in range(rounds):
        direction, alphas = -gradient, []
        for s, y in reversed(pairs):
            alphas.append(s @ direction / (s @ y))
            direction = direction - alphas[-1] * y
        if pairs:
            s, y = pairs[-1]
            direction = direction * (s @ y) / (y @ y)
        for (s, y), alpha in zip(pairs, reversed(alphas)):
            direction = direction + (alpha - y @ direction / (s @ y)) * s
        slope, step = gradient @ direction, 1.0 if pairs else 1 / max(np.abs(gradient).sum(), 1e-12)
        if slope > -1e-9:
            break
        while True:
            new = x + step * direction
            new_value, new_gradient = function(new)
            if new_value <= value + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = new - x, new_gradient - gradient
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        x, value, gradient = new, new_value, new_gradient
    return x


def _fit(x: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty on the coefficients (not the bias); a present feature's value is its ratio."""
    columns, owner = np.concatenate(x), np.repeat(np.arange(len(x)), [len(row) for row in x])
    values, sign = ratios[columns], 2 * y - 1

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        margin = sign * (np.bincount(owner, values * at[columns], len(x)) + at[-1])
        error = -sign / (1 + np.exp(np.clip(margin, -500, 500)))
        gradient = np.append(np.bincount(columns, values * error[owner], len(ratios)) + penalty * at[:-1], error.sum())
        return np.logaddexp(0, -margin).sum() + penalty / 2 * (at[:-1] @ at[:-1]), gradient

    best = _minimise(loss, np.zeros(len(ratios) + 1), rounds)
    return best[:-1], float(best[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    sample: int = 8_000,
    least: int = 3,
    most: int = 4_000,
    penalty: float = 1.0,
    rounds: int = 200,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """A model of ``labels[label_col]`` (0 or 1) fitted on at most ``sample`` labelled texts that are not held out.

    Spark counts n-grams by class and picks the ``most`` best features; the driver fits their coefficients on the sample's features, so it
    receives at most ``most`` ratios and ``sample`` short rows. The bias is moved from the sample's share of ones to that of all
    labels. Without labels, or with one class only, all weights are zero and the bias is the share's log odds, clipped to 1e-3.
    """
    chosen, share = _chosen_labels(labels, label_col, sample)
    chosen = F.broadcast(durable(chosen, "training-ids"))  # at most ``sample`` rows
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = durable(texts.join(chosen, "doc_id").select("y", "text", "doc_id"), "training-texts")
    share = min(max(share, 1e-3), 1 - 1e-3)
    table, prior = np.zeros(1 << BITS, np.float32), math.log(share / (1 - share))
    numbers, ratios = _log_count_ratios(rows, least, most)
    wanted = np.zeros(1 << BITS, bool)
    wanted[numbers] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(text.as_py(), wanted).astype(np.int32) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "y", "f"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    sparse = rows.mapInArrow(run, f"doc_id {kind}, y int, f array<int>").toArrow().sort_by("doc_id")
    y = sparse.column("y").to_numpy().astype(np.float64)
    if not len(ratios) or y.min() == y.max():
        return Model(table, prior)
    place = np.zeros(1 << BITS, np.int64)
    place[numbers] = np.arange(len(numbers))
    x = [place[np.asarray(row, np.int64)] for row in sparse.column("f").to_pylist()]
    beta, bias = _fit(x, y, ratios, penalty, rounds)
    table[numbers] = beta * ratios
    ones = y.mean()
    return Model(table, bias + prior - math.log(ones / (1 - ones)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row, from its whole text alone.

    The score lies between 0 and 1, predicted is 1 from 0.5 on. A null text counts as empty and gets the score of the bias. Repeated rows
    get equal results, an empty table gives none, other columns are not read. The model (a table of 4 MB) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([shared.value.score(text.as_py() or "") for text in batch.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that a model fitted on ``labels`` doesn't reject, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col, **options))

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: model.value.score(text or ""))

    return docs.where(toxicity(F.col(f"`{text_col}`")) < 0.5)
