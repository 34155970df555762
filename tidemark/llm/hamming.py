"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import durable

BITS = 64


def sign_code(vector: list[float] | None) -> int | None:
    """64 signs of a vector as a signed number: bit i is set if the sum of the coordinates i, i + 64, ... is positive.

    Nulls in the vector count as zero, a null or empty vector has no code.
    """
    if not vector:
        return None
    values = np.array([0.0 if x is None else x for x in vector], np.float64)
    folded = np.pad(values, (0, -len(values) % BITS)).reshape(-1, BITS).sum(0)
    return int(np.packbits(folded > 0, bitorder="little").view("<i8")[0])


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, code)`` of the rows that have an id and a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sign_code(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["vec_id", "code"])

    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))
    return rows.mapInArrow(run, "vec_id long, code long").dropna()


def segments(n_codes: int) -> list[tuple[int, int]]:
    """``(first bit, width)`` of each segment: about log2(n) bits wide, so that a point of a segment's table holds about one code."""
    count = max(2, min(8, round(BITS / max(math.log2(max(n_codes, 2)), 1))))
    edges = [round(BITS * i / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _part(code: Column, segment: tuple[int, int]) -> Column:
    first, width = segment
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1))


def _starts(codes: DataFrame, name: str, parts: list[tuple[int, int]]) -> DataFrame:
    """A row for each segment of each code in column ``name``: ``segment``, its ``width`` and the code's part as ``key``."""
    code = F.col(name)
    row = [F.struct(F.lit(i).alias("segment"), F.lit(s[1]).alias("width"), _part(code, s).alias("key")) for i, s in enumerate(parts)]
    return codes.withColumn("_at", F.explode(F.array(*row))).select("*", "_at.segment", "_at.width", "_at.key").drop("_at")


def _ball(queries: DataFrame, parts: list[tuple[int, int]], radius: int) -> DataFrame:
    """``(query, segment, key)``: the points of each segment's table at most ``radius`` bits from the query's part.

    Each shell is made from the one within it by flipping one higher bit, so no point comes twice.
    """
    shell = _starts(queries.select("query"), "query", parts).withColumn("next", F.lit(0))
    ball = shell
    for _ in range(min(radius, max(width for _, width in parts))):
        bits = F.explode(F.sequence(F.col("next"), F.col("width") - 1)).alias("bit")
        grown = shell.where("next < width").select("query", "segment", "width", "key", bits)
        turned = F.expr("key ^ shiftleft(1L, bit)").alias("key")
        shell = grown.select("query", "segment", "width", turned, (F.col("bit") + 1).alias("next"))
        ball = ball.union(shell)
    return ball.select("query", "segment", "key")


def _found_at(radius: int, queries: DataFrame, index: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """``(query, code, n, distance)`` of the codes that this radius covers and the one before didn't.

    With radius r in each of m segments all codes within m * (r + 1) - 1 bits are met: a code further off may differ in r + 1 bits
    in every segment. A code is met in several tables; the first that has it within the radius reports it.
    """
    x = F.col("query").bitwiseXOR(F.col("code"))
    distance = F.bit_count(x)
    accepted = distance.between(len(parts) * radius, len(parts) * (radius + 1) - 1)
    for i, segment in enumerate(parts[:-1]):
        accepted &= (F.col("segment") <= i) | (F.bit_count(_part(x, segment)) > radius)
    # the planner takes the ball for as small as the queries, so it is told not to broadcast it
    met = _ball(queries, parts, radius).hint("merge").join(index, ["segment", "key"]).where(accepted)
    return met.select("query", "code", "n", distance.alias("distance"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, distance)``: the k nearest others of each query by Hamming distance of the sign codes. Exact.

    Ties go to the smaller id. The search radius in all segments' tables grows by one bit in each round, for those queries only whose k-th
    verified distance isn't covered yet. Equal codes are one entry of the tables, with the k + 1 smallest ids (the query itself may
    be one of them), more of which no answer can hold; equal queries are searched once. Rows without
    id or vector are neither searched nor found, of repeated rows one counts. With fewer than k others, all are returned. Only the number of
    open queries reaches the driver. Other columns are not read.
    """
    known = durable(codes(vectors, id_col, vector_col).distinct(), "codes")
    asked = durable(codes(queries, id_col, vector_col).distinct(), "query-codes")
    by_id = Window.partitionBy("code").orderBy("vec_id")
    members = durable(known.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1), "members")
    nodes = members.groupBy("code").agg(F.count("*").alias("n"))
    nodes = durable(nodes, "distinct-codes")
    parts = segments(nodes.count())
    index = durable(_starts(nodes, "code", parts).select("segment", "key", "code", "n"), "segment-tables")
    still = durable(asked.select(F.col("code").alias("query")).distinct(), "open-queries")
    found, radius = None, 0
    while radius * len(parts) <= BITS and still.limit(1).count():
        met = durable(_found_at(radius, still, index, parts), "met")
        found = met if found is None else found.union(met)
        covered = found.groupBy("query").agg(F.sum("n").alias("n")).where(F.col("n") > k).select("query")
        still = durable(still.join(covered, "query", "left_anti"), "open-queries")
        radius += 1
    if found is None:
        return asked.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).alias("distance"))
    best = Window.partitionBy("query").orderBy("distance", "vec_id")
    listed = found.join(members, "code").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    answers = asked.select(F.col("vec_id").alias("query_id"), F.col("code").alias("query")).join(
        listed.select("query", "vec_id", "distance", "place"), "query"
    )
    answers = answers.where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return answers.select("query_id", rank.alias("rank"), "vec_id", "distance").where(F.col("rank") <= k)
