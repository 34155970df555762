"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import durable

#: Words of a text, as the sizes count them.
WORDS = r"[^\x20\x09-\x0D]+"
#: Rows of a source that one task sorts, on average.
BUCKET_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORDS)).cast("long")


def plain_share(text: Column) -> Column:
    """A document's quality weight, 0.1 to 1: the share of its characters that are neither digits nor symbols."""
    whole = F.greatest(F.octet_length(text), F.lit(1))
    plain = F.octet_length(F.translate(text, "0123456789#$%&*+/<=>@[\\]^_`{|}~", ""))
    return F.greatest(F.coalesce(plain / whole, F.lit(0.0)), F.lit(0.1))


def _source_totals(sized: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """``(source, source_size, weight)``, weights dealt in turn to the sources by code point, null last.

    Sources are ranked in ranges of the sorted order, so their number may grow: a range's rank is the number of sources in
    the ranges before it plus the rank within it.
    """
    totals = durable(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranges = totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id())
    ranges = durable(ranges, "source-ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("_range").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last()))
    turn = (F.col("_start") + within - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    return ranges.join(starts, "_range").select("source", "source_size", weight.alias("weight"))


def targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ceiling: int = 3) -> DataFrame:
    """``(source, source_size, target)``: all sizes shared out by weight, no target above ``ceiling`` times its source's size.

    A target is ``level * weight`` or the ceiling, whichever is less. The level rises until all is shared: each
    round takes out the sources that hit their ceiling and shares the rest anew. Only three sums reach the driver in a round.
    """
    totals = durable(_source_totals(sized, weights), "source-weights")
    total = totals.agg(F.sum("source_size")).first()[0] or 0
    most, level, capped = ceiling * F.col("source_size"), 0.0, -1
    while True:
        full = F.col("weight") * level >= most
        row = totals.agg(
            F.sum(F.when(full, most).otherwise(0)).alias("fixed"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(full).alias("n"),
        ).first()
        if row.n == capped or not row.open:
            break
        level, capped = (total - row.fixed) / row.open, row.n
    target = F.least(F.col("weight") * level, most.cast("double"))
    return totals.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    quality: Column | None = None,
    seed: int = 7,
    bucket_rows: int = BUCKET_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for each document: how many of its words the mix takes.

    A source takes all its documents as often as its target holds its whole size (complete epochs). What remains
    is filled by Efraimidis-Spirakis sampling: a document's key is an exponential variable divided by its ``quality``
    (by default ``plain_share``; null or less than 0.001 counts as 0.001), documents are taken in the order of their keys, and one is taken once more if at least half
    of its words fit into what remains. So a source ends within half a document of its target and none is taken more
    than three times. Keys come from a hash of id and text: reruns agree.

    Prefix sums are made in two steps, over the buckets of a source and within a bucket. Keys are mapped by their own
    distribution to equally likely buckets, whose number follows from the rows of the source, so that no task
    sorts a source. A null text has size zero, a null source is a source of its own, sources of size zero have
    target zero. Ties of keys are broken by id and size; rows alike in both are equal, whatever their order. An empty
    table gives no rows, other columns are not read.
    """
    text = F.col(f"`{text_col}`").cast("string")
    weight = plain_share(text) if quality is None else F.greatest(F.coalesce(quality, F.lit(0.0)), F.lit(1e-3))
    chance = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), text), 11) + 0.5) / float(1 << 53)
    sized = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(text).alias("size"),
        (-F.log(chance) / weight).alias("key"),
        weight.alias("quality"),
    )
    sized = durable(sized, "sizes")
    plan = targets(sized, weights)
    counts = sized.groupBy("source").agg(F.count("*").alias("rows"), F.avg("quality").alias("mean"))
    plan = plan.join(counts, plan["source"].eqNullSafe(counts["source"])).drop(counts["source"])
    # With the mean weight, 1 - exp(-key * mean) is about uniform; any error only makes buckets uneven.
    buckets = F.ceil(F.col("rows") / bucket_rows)
    place = F.least(F.floor((1 - F.exp(-F.col("key") * F.col("mean"))) * buckets), buckets - 1)
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    dealt = (
        sized.join(F.broadcast(plan) if _is_small(plan) else plan, sized["source"].eqNullSafe(plan["source"]))
        .drop(plan["source"])
        .withColumn("bucket", place)
        .withColumn("epochs", share)
        .withColumn("rest", F.col("target") - share * F.col("source_size"))
    )
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("source", "bucket")
        .agg(F.sum("size").alias("words"))
        .select("source", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    )
    starts = starts.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "start")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, placed["source"].eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    once_more = (F.col("start") + F.col("ahead") + F.col("size") / 2 <= F.col("rest")).cast("long")
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", ((F.col("epochs") + once_more) * F.col("size")).cast("long").alias("taken")
    )


def _is_small(plan: DataFrame, bound: int = 10_000) -> bool:
    """Whether a table of sources is proven to have at most ``bound`` rows, by counting no further than that."""
    return plan.limit(bound + 1).count() <= bound
