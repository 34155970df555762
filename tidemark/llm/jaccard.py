"""Exact Jaccard join of texts as sets of word n-grams: Voronoi regions around pivots, windows by the triangle inequality, recursion.

The Jaccard distance ``d = 1 - J`` is a metric. Texts that have nothing in common all lie at distance near 1 from each other, where
no pivot tells them apart, so the space first falls into areas proven to be farther apart than the threshold
(``_areas``); each area is a region, and regions that are too large for one task are split around pivots (``_split``) until they fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.session import durable

#: Texts that are compared with each other at once, and the shingles they may have together.
LEAF, LEAF_SHINGLES = 128, 1 << 20
#: Pivots of a region in one round.
PIVOTS = 16
#: Sizes from one class to the next.
GROWTH = 1.5
#: At most so many texts are sought by a broadcast of their digests (16 bytes each).
BROADCAST_TEXTS = 1_000_000
#: Bytes of text whose words are hashed at once; a longer text is taken alone.
CHUNK = 1 << 21


def _mixed(z: np.ndarray) -> np.ndarray:
    """64 bits scrambled (the finaliser of SplitMix64)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct hashes of the ``size``-word shingles of each text, ascending; the whole sequence if it is shorter, nothing without words.

    A-Z is lower-cased, words stand between ASCII white space. A hash has 64 bits.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, parents = parts.flatten(), pc.list_parent_indices(parts)
    there = pc.greater(pc.binary_length(words), 0)
    words, parents = words.filter(there).dictionary_encode(), parents.filter(there).to_numpy(zero_copy_only=False)
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    hashes = known[words.indices.to_numpy(zero_copy_only=False)] if len(known) else np.empty(0, np.uint64)
    ends = np.cumsum(np.bincount(parents, minlength=len(texts)))
    found, start = [], 0
    for end in ends.tolist():
        own = hashes[start:end]
        n = max(1, len(own) - size + 1) if len(own) else 0
        width = min(size, len(own))
        h = np.full(n, width, np.uint64)
        for k in range(width):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n])
        found.append(np.unique(h))
        start = end
    return found


class _Classes:
    """Classes of set sizes, and how many elements two linked sets of a class can differ in."""

    def __init__(self, share: int):
        self.share = share

    def first(self, k: int) -> int:
        """The smallest size of class k."""
        return math.ceil(GROWTH**k)

    def of(self, n: int) -> list[int]:
        """The class of a size, and the next one if sets of that class can be linked to it."""
        k = max(0, int(math.log(n) / math.log(GROWTH)) - 1)
        while self.first(k + 1) <= n:
            k += 1
        return [k, k + 1] if 100 * n >= self.share * self.first(k + 1) else [k]

    def apart(self, k: int) -> int:
        """The most elements that linked sets differ in, the larger of class k: J >= s means |x ^ y| <= (1 - s) / (1 + s) (|x| + |y|)."""
        return 2 * (self.first(k + 1) - 1) * (100 - self.share) // (100 + self.share)


def parts_of(elements: np.ndarray, share: int) -> np.ndarray:
    """Keys of which linked sets have one in common.

    In the class of the larger set, linked sets differ in at most D elements, which lie in at most D of the M parts the
    elements fall into by hash, so M - D parts are alike. Each set names its D + 1 largest parts (ties by content): the parts alike are ordered alike in both,
    so one of them is among these. Large parts are alike in unrelated sets only if these have them all in common.
    """
    keys = []
    classes = _Classes(share)
    for k in classes.of(len(elements)) if len(elements) else ():
        apart = classes.apart(k)
        n = apart + 1 + (apart + 3) // 4
        scrambled = _mixed(elements + np.uint64(0xD1B54A32D192ED03))
        part = (scrambled % np.uint64(n)).astype(np.int64)
        sizes = np.bincount(part, minlength=n)
        order = np.argsort(part, kind="stable")
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scrambled[order], dtype=np.uint64)))
        ends = np.cumsum(sizes)
        content = _mixed((sums[ends] - sums[ends - sizes]) * np.uint64(0x9E3779B97F4A7C15) + np.arange(n, dtype=np.uint64) + np.uint64(k << 32))
        best = np.lexsort((content, -sizes))[: apart + 1]
        keys.append(content[best])
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


_ROW = "doc_id long, t1 long, t2 long, n long, k1 long, k2 long, parts array<long>"


def _rows(docs: DataFrame, id_col: str, text_col: str, size: int, share: int) -> DataFrame:
    """A row for each of ``docs``: digests of its text (t1, t2) and of its set (k1, k2), the set's size and its parts' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, 1):
            sets = shingle_sets(part.column(1), size)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            keys = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            parts = [parts_of(s, share) for s in sets]
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            values = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
            n = pa.array([len(s) for s in sets], pa.int64())
            columns = [part.column(0), part.column(2), part.column(3), n, pa.array(keys[:, 0]), pa.array(keys[:, 1])]
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([*columns, listed], ["doc_id", "t1", "t2", "n", "k1", "k2", "parts"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.select("doc_id", "text", *_digests(F.col("text"))).mapInArrow(run, _ROW)


def _digests(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2")]


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows in parts of about ``CHUNK`` bytes of text."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (int(ends[start - 1]) if start else 0) + CHUNK)))
            yield batch.slice(start, stop - start)
            start = stop


def _areas(rows: DataFrame) -> DataFrame:
    """``(k1, area)`` of the sets that share a part with another set; sets of different areas aren't linked.

    Copies of one text count once from each task; one shuffle serves both the least and greatest set of each key and the rows that meet
    them, and nothing is kept for a key but these two.
    """
    named = rows.select("k1", F.explode("parts").alias("key")).repartition("key")
    shared = named.groupBy("key").agg(F.min("k1").alias("least"), F.max("k1").alias("most")).where("least <> most")
    met = named.join(shared.hint("shuffle_hash"), "key").select("k1", "least").distinct()
    return components(met).select(F.col("node").alias("k1"), F.col("root").alias("area"))


def _sets(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(k1, k2, elements)`` of the chosen sets ``(t1, t2)``, made of the texts again; one text for each digest is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches, 0):
            sets = shingle_sets(part.column(0), size)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            keys = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            elements = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), elements], ["k1", "k2", "elements"])

    if chosen.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        chosen = F.broadcast(chosen)
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).select("text", *_digests(F.col("text")))
    first = texts.join(chosen, ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.first("text").alias("text"))
    return first.select("text").mapInArrow(run, "k1 long, k2 long, elements binary")


def _distance(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 1 - both / (len(a) + len(b) - both)


def _chunk_of(*salt) -> Column:
    return F.xxhash64("k1", "k2", *salt)


def _split(regions: DataFrame, sets: DataFrame, sizes: DataFrame, share: int, turn: int) -> DataFrame:
    """Each region (larger than a leaf) as Voronoi regions of its pivots: ``(region, k1, k2, own, child, home)``.

    A set belongs (``own``) to the region of its nearest pivot p, and a copy goes to every region q with d(x, q) <= d(x, p) + 2 (1 - s): whoever is linked
    to x and has its home in q lies within that window. Pivots are drawn by hash; the region's sets are dealt into chunks, each
    of which meets all pivots of its region in one task.
    """
    window = 2 * (100 - share) / 100 + 1e-9
    drawn = F.pmod(_chunk_of(F.lit(turn)), F.col("count")) < PIVOTS
    rows = regions.join(sizes.select("region", "count"), "region")
    chunks = F.ceil(F.col("count") / LEAF)
    rows = rows.join(sets, ["k1", "k2"])
    each = F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("_chunk")
    pivots = rows.where(drawn).select(F.col("region").alias("_region"), F.col("k1").alias("_k1"), F.col("elements").alias("_elements"), each)
    dealt = rows.select("region", "k1", "k2", "own", "elements", F.pmod(_chunk_of(F.lit("chunk")), chunks).alias("chunk"))

    def assign(own: pa.Table, pivots: pa.Table) -> pa.Table:
        centres = sorted(zip(pivots["_k1"].to_pylist(), (np.frombuffer(e, np.uint64) for e in pivots["_elements"].to_pylist())), key=lambda p: p[0])
        out: dict[str, list] = {c: [] for c in ("region", "k1", "k2", "own", "child")}
        for region, k1, k2, mine, elements in zip(*(own[c].to_pylist() for c in ("region", "k1", "k2", "own", "elements"))):
            elements = np.frombuffer(elements, np.uint64)
            far = np.array([_distance(elements, c) for _, c in centres])
            near = int(far.argmin()) if len(far) else -1
            for i in np.flatnonzero(far <= far[near] + window).tolist() if len(far) else [-1]:
                for c, v in zip(out, (region, k1, k2, mine and i == near, centres[i][0] if len(far) else 0)):
                    out[c].append(v)
        kinds = [pa.int64()] * 3 + [pa.bool_(), pa.int64()]
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})

    return dealt.groupBy("region", "chunk").cogroup(pivots.groupBy("_region", "_chunk")).applyInArrow(
        assign, "region long, k1 long, k2 long, own boolean, child long"
    )


def _regions(members: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """``(region, k1, k2, own, chunks)``: regions to be compared, of ``chunks`` chunks each.

    Splitting ends where a region is a leaf, or where the windows are so wide that comparing within its parts would take over half of the work of
    comparing all of it: such a region is a cloud within the threshold's reach, and every two of its chunks are compared in a task of their own.
    """
    done: list[DataFrame] = []
    rest, turn = members, 0
    while True:
        sizes = durable(rest.groupBy("region").agg(F.count("*").alias("count"), F.sum("n").alias("shingles"), F.max(F.col("own").cast("int")).alias("owns")), "region-sizes")
        leaf = (F.col("count") <= LEAF) & (F.col("shingles") <= LEAF_SHINGLES) | (F.col("count") <= 2)
        done.append(rest.join(sizes.where(leaf & (F.col("owns") == 1)).select("region"), "region").withColumn("chunks", F.lit(1).cast("long")))
        large = sizes.where(~leaf & (F.col("owns") == 1))
        if large.isEmpty():
            break
        told = durable(_split(rest.drop("n"), sets, large, share, turn), "regions-split")
        children = told.groupBy("region", "child").agg(F.count("*").alias("n"), F.max(F.col("own").cast("int")).alias("owns")).where("owns = 1")
        work = children.groupBy("region").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("work"))
        judged = durable(large.join(work, "region", "left").withColumn("cloud", F.coalesce(F.col("work") > 0.5 * F.col("count") * F.col("count"), F.lit(True))), "regions-judged")
        pieces = F.ceil(F.greatest(F.col("count") / LEAF, F.col("shingles") / LEAF_SHINGLES))
        done.append(rest.join(judged.where("cloud").select("region", pieces.alias("chunks")), "region"))
        split = told.join(judged.where("NOT cloud").select("region"), "region", "left_semi")
        kept = split.join(children.select("region", "child"), ["region", "child"])
        kept = kept.select(F.xxhash64("region", "child", F.lit(turn)).alias("region"), "k1", "k2", "own")
        rest = durable(kept.join(members.select("k1", "k2", "n"), ["k1", "k2"]).select("region", "k1", "k2", "n", "own"), "regions")
        turn += 1
    return reduce(DataFrame.unionByName, [d.select("region", "k1", "k2", "own", "chunks") for d in done])


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs."""
    which = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    which, column = which[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    shared = count[column] > 1  # what one set has alone is common to no two
    which, column = which[shared], np.unique(column[shared], return_inverse=True)[1] if shared.any() else column[:0]
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        block = np.zeros((len(sets), width), np.float32)
        block[which[a:b], column[a:b] - low] = 1
        both += block @ block.T
    return both.astype(np.int64)


def _compare(regions: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """``(k1, k2, r1, r2, links)``: of each set compared, the least set it is joined to here and the texts linked to it that are counted here.

    A pair is counted where the lesser of its sets has its home. In a region of several chunks every two of them meet in one task.
    """
    own = F.pmod(_chunk_of(F.lit("cell")), F.col("chunks"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda i: F.struct(F.least(i, F.col("cell")).alias("a"), F.greatest(i, F.col("cell")).alias("b")))
    rows = regions.withColumn("cell", own).select("region", "k1", "k2", "own", "cell", F.inline(cells))
    rows = rows.join(sets, ["k1", "k2"])

    def links(table: pa.Table) -> pa.Table:
        table = table.sort_by([("k1", "ascending"), ("k2", "ascending")])
        elements = [np.frombuffer(e, np.uint64) for e in table["elements"].to_pylist()]
        n = np.array([len(e) for e in elements])
        both = _common(elements)
        linked = 100 * both >= share * (n[:, None] + n[None, :] - both)
        np.fill_diagonal(linked, False)
        cell, home, times = (table[c].to_numpy() for c in ("cell", "own", "times"))
        if table["a"][0].as_py() != table["b"][0].as_py():
            linked &= cell[:, None] != cell[None, :]
        upper = np.triu(linked) & home[:, None]
        linked = upper | upper.T  # the rows ascend
        root = np.arange(len(n))
        while True:
            lower = np.minimum(root, np.where(linked, root[None, :], len(n)).min(1))
            if (lower == root).all():
                break
            root = lower
        some = np.flatnonzero(linked.any(1))
        k1, k2 = table["k1"].to_numpy(), table["k2"].to_numpy()
        count = (linked * times[None, :]).sum(1)
        columns = (k1[some], k2[some], k1[root[some]], k2[root[some]], count[some])
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("k1", "k2", "r1", "r2", "links"), columns)})

    return rows.groupBy("region", "a", "b").applyInArrow(links, "k1 long, k2 long, r1 long, r2 long, links long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, share: int = 90) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)`` for each row of ``docs``.

    Two rows are linked if their sets of ``size``-word shingles have at least ``share`` hundredths of their union in common; ``n_links`` counts the
    rows a row is linked to, ``component_id`` is the smallest id reachable over links, itself included. Null texts and texts without
    words have an empty set and no links. Rows with equal sets are compared once. A row without an id takes part, but names a component only
    where no other can (then it is null). Repeated rows are returned as often as they come; other columns are not read. No rows give no rows.
    """
    if not 50 <= share <= 100:
        raise ValueError("share must lie between 50 and 100")
    rows = durable(_rows(docs, id_col, text_col, size, share), "shingled")
    full = rows.where("n > 0")
    areas = durable(_areas(full), "areas")
    told = full.join(areas.select("k1"), "k1", "left_semi").groupBy("k1", "k2").agg(
        F.max("n").alias("n"), F.count("*").alias("times"), F.min_by(F.struct("t1", "t2"), "t1").alias("text")
    )
    nodes = durable(told, "area-sets")
    chosen = nodes.select("text.t1", "text.t2")
    sets = _sets(docs, chosen, id_col, text_col, size).join(nodes.select("k1", "k2", "times"), ["k1", "k2"])
    sets = durable(sets, "area-elements")
    members = durable(nodes.join(areas, "k1").select(F.col("area").alias("region"), "k1", "k2", "n", F.lit(True).alias("own")), "regions")
    found = durable(_compare(_regions(members, sets.drop("times"), share), sets, share), "set-links")
    edges = found.select(F.struct("k1", "k2").alias("a"), F.struct(F.col("r1").alias("k1"), F.col("r2").alias("k2")).alias("b"))
    roots = components(edges).select("node.k1", "node.k2", "root")
    degrees = found.groupBy("k1", "k2").agg(F.sum("links").alias("links")).join(roots, ["k1", "k2"], "left")
    degrees = degrees.select("k1", "k2", "links", F.coalesce("root", F.struct("k1", "k2")).alias("root"))
    alike = full.groupBy("k1", "k2").agg(F.count("*").alias("times"), F.min("doc_id").alias("least"))
    classes = durable(alike.join(degrees, ["k1", "k2"], "left"), "set-classes")
    best = classes.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("reached"))
    classes = classes.join(best, "root", "left").select(
        "k1", "k2", F.coalesce("reached", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")
    )
    named = full.select("doc_id", "n", "k1", "k2").join(classes, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return named.union(alone)
