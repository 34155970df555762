"""Periodic runs of words in texts, found by string synchronising sets at dyadic scales."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Periods up to this are sought by comparing the text with itself, shifted by each.
SMALL = 16
#: A run is at least so many words long.
SHORTEST = 24
#: Bytes of text whose words are compared at once; a longer text is taken alone.
CHUNK = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mixed(z: np.ndarray) -> np.ndarray:
    """64 bits scrambled (the finaliser of SplitMix64)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _sliding(pick, a: np.ndarray, width: int) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        a = pick(a[:-size], a[size:])
        size *= 2
    rest = width - size
    return pick(a[:-rest], a[rest:]) if rest else a


def _stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of at least ``least`` true values."""
    turns = np.flatnonzero(equal[1:] != equal[:-1]) + 1
    edges = np.concatenate(([0], turns, [len(equal)]))
    first = 0 if len(equal) and equal[0] else 1
    starts, ends = edges[first:-1:2], edges[first + 1 :: 2]
    starts = starts[: len(ends)]
    long = ends - starts >= least
    return starts[long], ends[long]


def synchronising(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places whose hash is the least of some ``window`` consecutive places: one of them in every window, chosen by the text around alone.

    ``hashes`` stand for the factors of one length that start at each place. All of equal least hashes are chosen.
    """
    if len(hashes) < window:
        return np.empty(0, np.int64)
    least = _sliding(np.minimum, hashes, window)
    pad = np.zeros(window - 1, hashes.dtype)
    return np.flatnonzero(_sliding(np.maximum, np.concatenate((pad, least, pad)), window) == hashes)


class _Factors:
    """Comparison of factors of one sequence by a hash of all prefixes."""

    def __init__(self, hashed: np.ndarray):
        n = len(hashed)
        self.powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE, np.uint64))), dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashed * self.powers[:n], dtype=np.uint64)))

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the factors of a size at a and at b (a <= b) hash alike."""
        left, right = self.sums[a + size] - self.sums[a], self.sums[b + size] - self.sums[b]
        return left * self.powers[b - a] == right

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The greatest size, up to ``most``, at which the factors that start at a and b are alike."""
        low, high = np.zeros_like(most), most
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high + 1) // 2, low)
            same = self.equal(a, b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same for factors that end before a and b."""
        low, high = np.zeros_like(most), most
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high + 1) // 2, low)
            same = self.equal(a - middle, b - middle, middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low


def _proposed(hashes: np.ndarray, owner: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods in (2 scale, 4 scale] that places with equal contexts of ``scale`` words propose.

    Places less than half a scale after an equal one lie in a region with so small a period that a smaller scale reports it; only the
    first place of such a region is kept. So any two equal contexts lie more than half a scale apart and a period spans at most eight of them.
    """
    at = synchronising(hashes, max(1, scale // 3))
    keys = hashes[at] ^ _mixed(owner[at].astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    follows = np.concatenate(([False], (keys[1:] == keys[:-1]) & (at[1:] - at[:-1] <= scale // 2)))
    keys, at = keys[~follows], at[~follows]
    places, periods = [], []
    for step in range(1, 9):
        gap = at[step:] - at[:-step]
        fits = (keys[step:] == keys[:-step]) & (gap > 2 * scale) & (gap <= 4 * scale)
        places.append(at[:-step][fits])
        periods.append(gap[fits])
    return np.concatenate(places), np.concatenate(periods)


def _checked(words: np.ndarray, start: int, end: int, period: int, place: int, low: int, high: int) -> tuple[int, int]:
    """The stretch around ``place`` within [low, high) that has the period, compared word by word."""
    def holds(s: int, e: int) -> bool:
        return np.array_equal(words[s : e - period], words[s + period : e])

    if holds(start, end) and (start == low or words[start - 1] != words[start - 1 + period]) and (end == high or words[end] != words[end - period]):
        return start, end
    equal = words[low : high - period] == words[low + period : high]  # hashes of different factors have met
    before, after = np.flatnonzero(~equal[: place - low]), np.flatnonzero(~equal[place - low :])
    return low + (int(before[-1]) + 1 if len(before) else 0), (place + int(after[0]) if len(after) else high - period) + period


def runs(words: np.ndarray, sizes: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Rows ``(text, start, length, period)`` of all runs, ordered by text, start and period.

    ``words`` are the words of some texts as integers, equal if the words are, one text after the other; ``sizes`` are the words of each text.
    A run is a stretch of at least ``max(shortest, 3 * period)`` words whose smallest period is ``period`` and which can't be extended.
    Every scale ``s`` = 8, 16, 32, ... finds the periods in (2s, 4s]: of three periods in a row, one holds a synchronising place whose context recurs
    one period on. Proposals are extended by binary search on hashes and then compared word by word, so nothing false is returned.
    """
    n_texts = len(sizes)
    first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64) if n_texts else np.empty(0, np.int64)
    owner = np.repeat(np.arange(n_texts), sizes + 1)
    x = np.empty(len(owner), np.int64)  # each text is followed by a word that is found nowhere else
    last = first + sizes
    inner = np.ones(len(owner), bool)
    inner[last] = False
    x[inner], x[last] = words, -1 - np.arange(n_texts)
    found: dict[tuple[int, int], int] = {}

    def keep(start: int, end: int, period: int) -> None:
        if end - start >= max(shortest, 3 * period):
            found[start, end] = min(period, found.get((start, end), period))

    for period in range(1, min(SMALL, len(x) - 1) + 1):
        starts, ends = _stretches(x[period:] == x[:-period], max(shortest, 3 * period) - period)
        for s, e in zip(starts.tolist(), ends.tolist()):
            keep(s, e + period, period)

    factors = None
    scale, place = 1, np.arange(len(x))  # place: where the words that are still compared stand in x
    hashes = _mixed(x.astype(np.uint64) + _BASE)
    while 2 * scale <= max(sizes, default=0):
        if scale > 1 and scale >= SMALL // 2:
            wide = sizes >= max(shortest, 3 * (2 * scale + 1))
            stays = wide[owner]
            if not stays.any():
                break
            if stays.mean() < 0.7:  # texts too short for this scale are left out from here on
                x_part = x[place]
                place, owner = place[stays], owner[stays]
                hashes = _window_hashes(_mixed(x_part[stays].astype(np.uint64) + _BASE), scale)
            at, period = _proposed(hashes, owner[: len(hashes)], scale)
            if len(at):
                factors = factors or _Factors(_mixed(x.astype(np.uint64) + _BASE))
                texts = owner[at]
                for s, e, q in _extended(x, factors, place[at], period, first[texts], last[texts], shortest):
                    keep(s, e, q)
        hashes = _doubled(hashes, scale)
        scale *= 2
    rows = sorted((s, q, e - s) for (s, e), q in found.items())
    table = np.array([(0, s, n, q) for s, q, n in rows], np.int64).reshape(-1, 4)
    table[:, 0] = np.searchsorted(first, table[:, 1], "right") - 1
    table[:, 1] -= first[table[:, 0]]
    return table


def _doubled(hashes: np.ndarray, scale: int) -> np.ndarray:
    """Hashes of factors twice as long."""
    return _mixed(hashes[:-scale] * _BASE + hashes[scale:]) if len(hashes) > scale else hashes[:0]


def _window_hashes(hashes: np.ndarray, scale: int) -> np.ndarray:
    size = 1
    while size < scale:
        hashes, size = _doubled(hashes, size), 2 * size
    return hashes


def _extended(x, factors: _Factors, at, period, low, high, shortest: int) -> Iterator[tuple[int, int, int]]:
    """``(start, end, period)`` in x of the widest stretches around the proposals, within [low, high), those long enough, each once."""
    fits = at + period < high
    at, period, low, high = at[fits], period[fits], low[fits], high[fits]
    start = at - factors.backward(at, at + period, at - low)
    end = at + period + factors.forward(at, at + period, high - at - period)
    long = end - start >= np.maximum(shortest, 3 * period)
    rows, which = np.unique(np.stack([start, end, period, low, high], 1)[long], axis=0, return_index=True)
    for (s, e, q, lo, hi), i in zip(rows.tolist(), np.flatnonzero(long)[which].tolist()):
        yield *_checked(x, s, e, q, int(at[i]), lo, hi), q


def _words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and how many each has. Words are what stands between ASCII white space."""
    parts = pc.ascii_split_whitespace(texts.fill_null(""))
    words, parents = parts.flatten(), pc.list_parent_indices(parts)
    there = pc.greater(pc.binary_length(words), 0)
    words, parents = words.filter(there), parents.filter(there).to_numpy(zero_copy_only=False)
    return words, np.bincount(parents, minlength=len(texts)).astype(np.int64)


def _dropped(table: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For every word whether a run holds it after its first period."""
    marks = np.zeros(int(sizes.sum()) + 1, np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    at = offsets[table[:, 0]] + table[:, 1]
    np.add.at(marks, at + table[:, 3], 1)
    np.add.at(marks, at + table[:, 2], -1)
    return np.cumsum(marks)[:-1] > 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _of_chunk(ids: pa.Array, texts: pa.Array, shortest: int) -> pa.RecordBatch:
    words, sizes = _words_of(texts)
    table = runs(words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes, shortest)
    stays = ~_dropped(table, sizes)
    kept = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[stays], minlength=len(sizes))
    offsets = pa.array(np.concatenate(([0], np.cumsum(kept))), pa.int32())
    collapsed = pc.binary_join(pa.ListArray.from_arrays(offsets, words.filter(pa.array(stays))), " ")
    each = np.concatenate(([0], np.cumsum(np.bincount(table[:, 0], minlength=len(sizes)))))
    columns = [pa.array(table[:, k], pa.int64()) for k in (1, 2, 3)]
    listed = pa.ListArray.from_arrays(pa.array(each, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_RUN)))
    return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), listed, collapsed], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` for each row of ``docs``.

    ``runs`` are structs ``(start, length, period)`` in words, ordered by start and period; ``collapsed`` is the text with one copy of each
    repeated period left, its words joined by one space. Null and empty texts have no words, no runs and an empty collapsed text;
    repeated rows are returned as often as they come; a null id stays null; other columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                done = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + CHUNK)))
                part = batch.slice(start, stop - start)
                yield _of_chunk(part.column(0), part.column(1), shortest)
                start = stop

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
