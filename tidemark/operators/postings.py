"""Stored postings: a query reads the buckets of its own words and no text.

A posting is a word of a field of a document with all its positions there. A document's postings are made where its text is read, and those of
one word from the documents of a part travel and are stored as one row of plain numbers, a block. Blocks are stored by bucket, a hash of the word's
English stem, and sorted by stem within, so that a query for words or stems prunes buckets by partition and row groups by
statistics. Words are stemmed when an index is built, each distinct word of a part once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stem import porter_stem
from tidemark.operators import search

#: Words of texts whose postings make one block of each word; a longer text is taken alone.
PART = 1 << 20
#: Words whose stems a task remembers.
REMEMBERED = 1 << 18


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in parts of about ``PART`` words."""
    for batch in batches:
        ends = np.cumsum(sum(pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:]))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (int(ends[start - 1]) if start else 0) + PART)))
            yield batch.slice(start, stop - start)
            start = stop


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word of a part of rows ``(id, words of each field)``: ids and fields of its postings, where each starts in ``pos``, all positions."""
    stem = lru_cache(REMEMBERED)(porter_stem)
    stop_words = pa.array(search.STOP_WORDS)
    for part in _parts(batches):
        words, rows, fields, places = [], [], [], []
        for number, lists in enumerate(part.columns[1:]):
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            words.append(lists.flatten())
            rows.append(np.repeat(np.arange(len(lists)), lengths))
            fields.append(np.full(len(rows[-1]), number, np.int8))
            places.append(np.arange(len(rows[-1])) - np.repeat(np.cumsum(lengths) - lengths, lengths))
        terms = pa.concat_arrays(words).dictionary_encode()
        code, row, field, place = terms.indices.to_numpy(zero_copy_only=False), *map(np.concatenate, (rows, fields, places))
        wanted = ~pc.is_in(terms.dictionary, value_set=stop_words).to_numpy(zero_copy_only=False)
        kept = np.flatnonzero(wanted[code])
        key = (code[kept].astype(np.int64) * part.num_rows + row[kept]) * len(words) + field[kept]
        order = np.argsort(key, kind="stable")  # positions ascend within a field of a row
        kept, key = kept[order], key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))  # a posting's first occurrence
        holder = kept[first]
        begin = np.flatnonzero(np.diff(code[holder], prepend=-1))  # a word's first posting
        offsets = np.append(begin, len(first))
        starts = first - np.repeat(first[begin], np.diff(offsets))
        found = terms.dictionary.take(pa.array(code[holder[begin]])).to_pylist()
        per_posting = [part.column(0).take(pa.array(row[holder])), pa.array(field[holder]), pa.array(starts, pa.int32())]
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values) for values in per_posting]
        lists.append(pa.ListArray.from_arrays(pa.array(np.append(first[begin], len(kept)), pa.int32()), pa.array(place[kept], pa.int32())))
        columns = [pa.array(found, pa.string()), pa.array(map(stem, found), pa.string()), *lists]
        yield pa.RecordBatch.from_arrays(columns, ["term", "stem", "ids", "fields", "starts", "pos"])


@dataclass(frozen=True)
class Index:
    """Where an index is stored, of how many buckets it is, and the type of the documents' ids."""

    spark: SparkSession
    folder: str
    buckets: int = 64
    id_type: str = "bigint"

    def _bucket(self, stem: str) -> int:
        return zlib.crc32(stem.encode()) % self.buckets

    def _block(self) -> str:
        return f"term string, stem string, ids array<{self.id_type}>, fields array<tinyint>, starts array<int>, pos array<int>"

    # --- writing ---

    def extend(self, documents: DataFrame) -> None:
        """Add the postings of documents that the index doesn't hold yet. Null texts have no words; stop words are left out.

        One shuffle deals the blocks by bucket, and a bucket too large for one task goes to several.
        """
        words = documents.select(F.col("id").cast(self.id_type), *[search.tokens(F.col(name)).alias(name) for name in search.FIELD_WEIGHTS])
        bucket = F.pmod(F.crc32(F.col("stem").cast("binary")), F.lit(self.buckets)).cast("int")
        rows = words.mapInArrow(_blocks, self._block()).withColumn("bucket", bucket)
        load = uuid.uuid4().hex
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "stem", "term").write.partitionBy("bucket").parquet(f"{self.folder}/postings/load={load}")
        terms = self._stored().filter(F.col("load") == load).select("term", "stem").distinct()
        known = self.lexicon()
        fresh = terms if known is None else terms.join(known.select("term"), "term", "left_anti")
        fresh.write.mode("append").parquet(f"{self.folder}/lexicon")

    def lexicon(self) -> DataFrame | None:
        """``(term, stem)`` of all words seen, or ``None`` before the first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/lexicon")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema("term string, stem string").parquet(f"{self.folder}/lexicon")

    # --- reading ---

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(f"{self._block()}, load string, bucket int").parquet(f"{self.folder}/postings")

    def postings(self, words: list[str], stemmed: bool) -> DataFrame:
        """The postings of some words or, ``stemmed``, of all words with their stems: ``id, field, term, stem, pos``."""
        wanted = {porter_stem(w) for w in words}
        rows = self._stored()
        rows = rows.filter(F.col("bucket").isin(sorted({self._bucket(s) for s in wanted})) & F.col("stem").isin(sorted(wanted)))
        rows = rows if stemmed else rows.filter(F.col("term").isin(words))
        names = F.array(*map(F.lit, search.FIELD_WEIGHTS))

        def posting(i: Column) -> Column:
            start = F.get("starts", i)
            end = F.coalesce(F.get("starts", i + 1), F.size("pos"))
            return F.struct(F.get("ids", i).alias("id"), F.get(names, F.get("fields", i)).alias("field"), F.slice("pos", start + 1, end - start).alias("pos"))

        each = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), posting)
        return rows.select("term", "stem", F.inline(each)).select("id", "field", "term", "stem", "pos")


def matches(index: Index, query: search.Query, stemmed: bool = True, scope: DataFrame | None = None) -> DataFrame:
    """``id``, ``strict`` and ``lexical_rank`` as :func:`search.lexical_matches` has them, from the postings alone.

    ``scope`` limits the documents to those whose ``id`` it has. The postings of a document are brought together by its id; they are
    those of the query's words only.
    """
    words = list(dict.fromkeys(w for term in query.terms + query.excluded for w in term if w is not None))
    if not query.alternatives:
        return index.spark.createDataFrame([], f"id {index.id_type}, strict boolean, lexical_rank double")
    rows = index.postings(words, stemmed)
    if scope is not None:
        rows = rows.join(scope.select("id"), "id", "left_semi")
    number = {w: i for i, w in enumerate(words)}

    def is_word(word: str) -> Column:
        return F.col("stem") == porter_stem(word) if stemmed else F.col("term") == word

    fields = list(search.FIELD_WEIGHTS)
    places = [
        F.array_sort(F.flatten(F.collect_list(F.when((F.col("field") == name) & is_word(w), F.col("pos"))))).alias(f"p{f}_{i}")
        for f, name in enumerate(fields) for w, i in number.items()
    ]
    found = rows.groupBy("id").agg(*places)

    def count(f: int, term: search.Term) -> Column:
        first, *rest = [(k, F.col(f"p{f}_{number[w]}")) for k, w in enumerate(term) if w is not None]
        if not rest:
            return F.size(first[1])
        return F.size(F.filter(first[1], lambda p: reduce(lambda a, b: a & b, [F.array_contains(other, p + (k - first[0])) for k, other in rest])))

    asked = list(dict.fromkeys(query.terms + query.excluded))
    counts = [F.array(*[count(f, term) for f in range(len(fields))]).alias(f"n{i}") for i, term in enumerate(asked)]
    counted = found.select("id", *counts)
    place = {term: f"n{i}" for i, term in enumerate(asked)}

    def present(term: search.Term) -> Column:
        return F.exists(place[term], lambda n: n > 0)

    strict = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [present(t) for t in group]) for group in query.alternatives])
    for term in query.excluded:
        counted = counted.filter(~present(term))
    candidate = reduce(lambda a, b: a | b, [present(t) for t in query.terms]) if query.can_relax else strict
    rank = reduce(
        lambda a, b: a + b,
        [F.lit(weight) * reduce(lambda a, b: a + b, [F.get(place[t], F.lit(f)) for t in query.terms]) for f, weight in enumerate(search.FIELD_WEIGHTS.values())],
    )
    return counted.filter(candidate).select("id", strict.alias("strict"), rank.cast("double").alias("lexical_rank"))


def lexical_topk(index: Index, query: search.Query, k: int, stemmed: bool = True, scope: DataFrame | None = None) -> DataFrame:
    """Best ``k`` strict matches or, if nothing matches strictly, the best relaxed ones: ``id``, ``lexical_rank`` and ``rank``."""
    return search.best_matches(matches(index, query, stemmed, scope), k)
