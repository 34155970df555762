"""SimHash near-duplicates, found by multi-index hashing of the fingerprints."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.graph import components, unused
from tidemark.session import durable

HALF = 0xFFFFFFFF
QUARTER = 0xFFFF
#: Bytes of text whose words are in memory at once.
BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _shingle_hashes(words: list[bytes], size: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, taken as slices of the space-joined words."""
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    slices = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.fromiter((digest(line[i:j], seed) for i, j in slices), np.uint64, len(words) - size + 1)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set, lowest bit first."""
    table = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(table, axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint_of(text: bytes | None, size: int = 4, seed: int = 42) -> int:
    """The SimHash of one text as an unsigned 64-bit number; no words give zero.

    A-Z is lower-cased, words are runs of anything but ASCII white space, shingles are ``size`` words
    with repeats (the whole sequence if it is shorter). Words are read a block at a time, so a
    very long text needs little more memory than itself.
    """
    text = (text or b"").lower()
    counts, n, carry, start = np.zeros(64, np.int64), 0, [], 0
    while start < len(text):
        gap = _SPACE.search(text, start + BLOCK)
        stop = gap.start() if gap else len(text)
        words = carry + text[start:stop].split()
        if len(words) >= size:
            hashes = _shingle_hashes(words, size, seed)
            counts, n = counts + _bit_counts(hashes), n + len(hashes)
            words = words[len(words) - size + 1 :]
        carry, start = words, stop
    if not n and carry:
        counts, n = _bit_counts(np.array([xxhash.xxh64_intdigest(b" ".join(carry), seed)], np.uint64)), 1
    return sum(1 << int(bit) for bit in np.flatnonzero(2 * counts > n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, digest: bool = False) -> DataFrame:
    """``(doc_id, fp)`` for each row; ``fp`` is the fingerprint's bits as a signed long. A null text counts as empty.

    With ``digest`` also the text's digest, empty for a null text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint_of(t.as_py(), size) for t in batch.column(1)), np.uint64, batch.num_rows)
            told = [batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(told, ["doc_id", "fp", *batch.schema.names[2:]])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    if digest:
        rows = rows.withColumn("digest", _digest(F.col("text")))
    return rows.mapInArrow(run, "doc_id long, fp long" + ", digest string" * digest)


def _digest(text: Column) -> Column:
    return F.coalesce(F.sha1(text), F.lit(""))


def _low_bit(x: Column) -> Column:
    return x.bitwiseAND(-x)


def _half(fp: Column, segment: Column) -> Column:
    return F.when(segment == 0, fp.bitwiseAND(F.lit(HALF))).otherwise(F.shiftrightunsigned(fp, 32))


def _ball(row: DataFrame, value: Column, width: int, name: str) -> DataFrame:
    """A row for each point of the Hamming balls of radius 1 around the two ``width``-bit parts of ``value``.

    The point is a long whose bits above ``width`` name the part.
    """
    step = F.col("_step")
    part = F.floor(step / (width + 1))
    bit = step - part * (width + 1)
    mask = F.when(bit == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, CAST(_bit AS INT) - 1)"))
    low = value.bitwiseAND(F.lit((1 << width) - 1))
    high = F.shiftrightunsigned(value, width)
    return (
        row.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(2 * width + 1))))
        .withColumn("_bit", bit)
        .withColumn(name, F.when(part == 0, low).otherwise(high).bitwiseXOR(mask) + part.cast("long") * (1 << width))
        .drop("_step", "_bit")
    )


def _met_here(a: Column, x: Column, width: int, key: Column) -> Column:
    """Whether two values, the smaller being ``a`` and their difference ``x``, are to be reported at this shared ball point.

    They share several points if they are close; the one that counts lies in the first part that differs in at most two
    bits, one step (over the lowest differing bit) away from ``a``.
    """
    low, high = x.bitwiseAND(F.lit((1 << width) - 1)), F.shiftrightunsigned(x, width)
    at_low = a.bitwiseAND(F.lit((1 << width) - 1)).bitwiseXOR(_low_bit(low))
    at_high = F.shiftrightunsigned(a, width).bitwiseXOR(_low_bit(high)) + F.lit(1 << width)
    return key == F.when(F.bit_count(low) <= 2, at_low).otherwise(at_high)


def _crowds(points: DataFrame, *keys: str) -> DataFrame:
    """The points where at least two fingerprints meet, with their number ``n``."""
    return points.select(*keys, "fp").withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n > 1")


def links(prints: DataFrame, distance: int = 4, crowd: int = 512) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct fingerprints that differ in at most ``distance`` bits. Exact.

    ``prints`` has one column ``fp`` of distinct longs. Of two 32-bit halves one differs in at most two bits,
    so the radius-1 balls around that half meet: each fingerprint is entered at the 2 x 33 points of its
    balls, and those that meet at a point are compared over all 64 bits. At a point where more than
    ``crowd`` fingerprints meet, they are entered once more by the balls around the two 16-bit parts of the other half,
    which differ in at most four or five bits, hence one of them in two: only those that meet in both are compared. Each
    pair is reported at one point only.
    """
    if not 0 <= distance <= 5:
        raise ValueError("distance must lie between 0 and 5")
    met = durable(_crowds(_ball(prints.select("fp"), F.col("fp"), 32, "key"), "key"), "ball-points")

    def pairs(points: DataFrame, *keys: str) -> DataFrame:
        left = points.select(*keys, F.col("fp").alias("a"))
        right = points.select(*keys, F.col("fp").alias("b"))
        x = F.col("a").bitwiseXOR(F.col("b"))
        segment = F.shiftrightunsigned(F.col("key"), 32)
        close = (F.bit_count(x) <= distance) & _met_here(F.col("a"), x, 32, F.col("key"))
        if "key2" in keys:
            other = 1 - segment
            close &= _met_here(_half(F.col("a"), other), _half(x, other), 16, F.col("key2"))
        return left.join(right, list(keys)).where((F.col("a") < F.col("b")) & close).select("a", "b")

    few = pairs(met.where(F.col("n") <= crowd), "key")
    many = met.where(F.col("n") > crowd).select("key", "fp")
    other = _half(F.col("fp"), 1 - F.shiftrightunsigned(F.col("key"), 32))
    return few.union(pairs(_crowds(_ball(many, other, 16, "key2"), "key", "key2"), "key", "key2"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, distance: int = 4, crowd: int = 512
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs``.

    Documents are linked if their fingerprints differ in at most ``distance`` bits; ``component_id`` is the smallest id
    reachable over links. Equal fingerprints are one node, so a crowd of copies costs one row. Null and empty texts have fingerprint
    zero and are linked like others. A row without an id takes part but never names a component, unless
    none of its component has one (then the component is null). Repeated rows are returned as often as they come, with one result;
    other columns of ``docs`` are not read. No rows give no rows.
    """
    prints = durable(fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = components(links(nodes.select("fp"), distance, crowd))
    named = linked.join(nodes.withColumnRenamed("fp", "node"), "node")
    best = named.groupBy("root").agg(F.min("least").alias("reached"))
    reached = linked.join(best, "root").select(F.col("node").alias("fp"), "reached")
    classes = nodes.join(reached, "fp", "left").select("fp", F.coalesce("reached", "least").alias("component_id"))
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, distance: int = 4, crowd: int = 512
) -> DataFrame:
    """One row of each component of near-duplicates; all columns of ``docs`` are kept.

    It is the row with the smallest id, and of those that share it the one with the smallest digest of its text; a row without an id stays
    only where none of its component has one. Rows alike in id and text count as one.
    """
    prints = durable(fingerprints(docs, id_col, text_col, size, digest=True), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    nodes = durable(prints.groupBy("fp").agg(F.min(first).alias("least")), "fingerprint-nodes")
    linked = components(links(nodes.select("fp"), distance, crowd)).withColumnRenamed("node", "fp")
    best = nodes.join(linked, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
    name = unused(docs, "_row")
    stay = best.select(F.concat_ws(":", "least.doc_id", "least.digest").alias(name))
    row = F.concat_ws(":", F.col(f"`{id_col}`").cast("long"), _digest(F.col(f"`{text_col}`").cast("binary")))
    return docs.withColumn(name, row).join(stay, name, "left_semi").dropDuplicates([name]).drop(name)
