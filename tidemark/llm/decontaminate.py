"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a passage must share in a row to count (shorter items: all their words).
SEED = 4
#: Share of an item's words that must be found again.
COVERAGE = 0.8
#: Words of benchmark items that one broadcast index holds.
BLOCK_WORDS = 250_000
#: Characters of a text whose words are in memory at once.
BLOCK_CHARS = 1 << 20

_WORD = re.compile(r"\w+")
_GAP = re.compile(r"\W")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _windows(ids: np.ndarray, size: int) -> np.ndarray:
    """The Karp-Rabin hash of every window of ``size`` word numbers."""
    n = max(len(ids) - size + 1, 0)
    found = np.zeros(n, np.uint64)
    for i in range(size):
        found = found * _BASE + ids[i : i + n].astype(np.uint64)
    return found


class Tile(NamedTuple):
    item_start: int
    text_start: int
    length: int


def tiles(runs: list[Tile], least: int, length: int) -> list[Tile]:
    """Greedy string tiling: again and again the longest match of unmarked words is marked, in item and text.

    ``runs`` are the maximal matches. Of one that meets marked words what lies between them is tried again. Ties go to the match that
    stands first in the item, then in the text.
    """
    queue = [(-r.length, r.item_start, r.text_start) for r in runs if r.length >= least]
    heapq.heapify(queue)
    in_item, in_text, found = np.zeros(length, bool), set(), []
    while queue:
        size, i, t = heapq.heappop(queue)
        free = ~in_item[i : i - size] & np.fromiter((t + k not in in_text for k in range(-size)), bool, -size)
        if free.all():
            found.append(Tile(i, t, -size))
            in_item[i : i - size] = True
            in_text.update(range(t, t - size))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a >= least:
                heapq.heappush(queue, (a - b, i + a, t + a))
    return found


class Index:
    """The words and seeds of a bounded set of items. Items are numbered from 0 in the order given."""

    def __init__(self, items: list[tuple[object, str | None]], seed: int = SEED):
        words = [_WORD.findall((text or "").lower()) for _, text in items]
        self.names = [name for name, _ in items]
        self.vocabulary: dict[str, int] = {}
        for word in (w for row in words for w in row):
            self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
        self.lengths = [len(row) for row in words]
        self.ids = np.array([self.vocabulary[w] for row in words for w in row], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths))).astype(np.int64)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.least = [min(seed, n) for n in self.lengths]
        for size in sorted({n for n in self.least if n}):
            places = [self.starts[k] + np.arange(n - size + 1) for k, n in enumerate(self.lengths) if self.least[k] == size]
            owners = np.repeat([k for k, n in enumerate(self.least) if n == size], [len(p) for p in places])
            place = np.concatenate(places)
            hashes = _windows(self.ids, size)[place]
            order = np.argsort(hashes, kind="stable")
            self.seeds[size] = hashes[order], place[order], owners[order]

    def _ids_of(self, text: str) -> Iterator[np.ndarray]:
        """Word numbers of the text, zero for words that no item has, block by block."""
        text, start = text.lower(), 0
        while start < len(text):
            gap = _GAP.search(text, start + BLOCK_CHARS)
            stop = gap.start() if gap else len(text)
            words = _WORD.findall(text, start, stop)
            yield np.fromiter(map(self.vocabulary.get, words, iter(lambda: 0, 1)), np.int64, len(words))
            start = stop

    def _hits(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Seeds that text and items share: places in the text and in the joined items, and the items."""
        carry, offset, longest = np.zeros(0, np.int64), 0, max(self.seeds, default=1)
        for block in self._ids_of(text):
            ids = np.concatenate((carry, block))
            empty = np.concatenate(([0], np.cumsum(ids == 0)))
            for size, (hashes, places, owners) in self.seeds.items():
                # a block's first windows were seen with the block before, unless they reach into this one
                first = max(len(carry) - size + 1, 0)
                at = np.flatnonzero(empty[size:][first:] == empty[: len(empty) - size][first:]) + first if len(ids) >= size else carry[:0]
                if not len(at):
                    continue
                wanted = _windows(ids, size)[at]
                low, high = np.searchsorted(hashes, wanted, "left"), np.searchsorted(hashes, wanted, "right")
                met = np.flatnonzero(high > low)
                if not len(met):
                    continue
                many = (high - low)[met]
                at = np.repeat(at[met], many)
                which = np.repeat(low[met], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                same = np.ones(len(at), bool)
                for k in range(size):  # equal hashes are only a hint
                    same &= ids[at + k] == self.ids[places[which] + k]
                yield at[same] + offset, places[which][same], owners[which][same]
            offset += max(len(ids) - longest + 1, 0)
            carry = ids[max(len(ids) - longest + 1, 0) :]

    def matches(self, text: str | None, coverage: float = COVERAGE) -> list[tuple[object, float]]:
        """Items of which at least the share ``coverage`` is tiled by the text, with the share, in the order of the index."""
        hits = list(self._hits(text or ""))
        if not hits:
            return []
        at, place, owner = (np.concatenate(part) for part in zip(*hits))
        found = []
        for k in np.unique(owner).tolist():
            mine = owner == k
            t, i, size = at[mine], place[mine] - self.starts[k], self.least[k]
            if len(np.unique((i[:, None] + np.arange(size)).ravel())) < coverage * self.lengths[k]:
                continue  # even all seeds together don't cover enough
            order = np.lexsort((i, t - i))
            t, i = t[order], i[order]
            cut = np.flatnonzero((np.diff(t - i) != 0) | (np.diff(i) != 1)) + 1
            ends = np.append(cut, len(t))
            runs = [Tile(int(i[a]), int(t[a]), int(b - a + size - 1)) for a, b in zip(np.append(0, cut), ends)]
            share = sum(tile.length for tile in tiles(runs, size, self.lengths[k])) / self.lengths[k]
            if share >= coverage:
                found.append((self.names[k], share))
        return found


def indexes(benchmark: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes of bounded size that together hold all items; equal items of one id count once."""
    items = benchmark.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).distinct()
    words = items.agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(r"\w+")), F.lit(0)))).first()[0] or 0
    blocks = -(-int(words) // block_words)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text").collect()
        yield Index([(row.item, row.text) for row in rows], seed)


def found_items(text: Column, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, block_words: int = BLOCK_WORDS) -> Column:
    """For each row's text, the items ``(item_id, coverage)`` it contains to the share ``coverage``, sorted by id.

    Seeds (runs of ``seed`` shared words, found by rolling hashes) are joined with those of the items in the task that reads the text. The
    benchmark is broadcast in indexes of at most about ``block_words`` words, however large it is; each adds a step over the same
    rows, and the texts are not shuffled. The words of a text are read a block at a time.
    """
    kind = f"array<struct<item_id:{benchmark.schema['item_id'].dataType.simpleString()},coverage:double>>"

    def tiled_by(index: Index):
        shared = benchmark.sparkSession.sparkContext.broadcast(index)

        @F.pandas_udf(kind)
        def tiled(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: [{"item_id": i, "coverage": c} for i, c in shared.value.matches(t, coverage)])

        return tiled

    parts = [tiled_by(index)(text) for index in indexes(benchmark, seed, block_words)]
    return F.sort_array(F.concat(*parts)) if parts else F.array().cast(kind)


def report(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``(doc_id, contaminated, coverage, items)`` for each row: the items whose words it repeats, in whatever order of passages.

    Words are runs of letters, digits and underscores, lower-cased. ``coverage`` is the largest share found, zero if none reaches the
    threshold. Null and empty texts are clean, items without words are never found, a null item id is reported as null. Repeated rows get
    equal results, an empty table gives none, an empty benchmark finds nothing. Other columns are not read.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), found_items(text, benchmark, coverage, **options).alias("items"))
    best = F.coalesce(F.array_max(F.transform("items", lambda x: x["coverage"])), F.lit(0.0))
    return rows.select("doc_id", (F.size("items") > 0).alias("contaminated"), best.alias("coverage"), "items")


def keep_clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text_col: str = "text", **options) -> DataFrame:
    """The documents that contain no item of the benchmark, with all their columns."""
    return docs.where(F.size(found_items(F.col(f"`{text_col}`").cast("string"), benchmark, coverage, **options)) == 0)
