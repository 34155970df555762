"""Views of the serving table: projections, filters, leaderboards, events and counters."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions import text


def known_sources(requested: Iterable[str] | None, vocabulary: Iterable[str]) -> list[str] | None:
    """Requested sources that exist. ``None`` means "no filter"; an empty list matches nothing."""
    if requested is None:
        return None
    known = set(vocabulary)
    return [s for s in requested if s in known]


def search_filter(
    sources: list[str] | None = None,
    winners_only: bool = False,
    since: date | None = None,
    until: date | None = None,
) -> Column:
    """Conjunction of the given conditions; rows without a date fail either date bound."""
    condition = F.lit(True)
    if sources is not None:
        condition &= F.col("source").isin(sources) if sources else F.lit(False)
    if winners_only:
        condition &= F.col("is_winner")
    if since is not None:
        condition &= F.col("hackathon_date") >= F.lit(since)
    if until is not None:
        condition &= F.col("hackathon_date") <= F.lit(until)
    return condition


def summary(projects: DataFrame) -> DataFrame:
    return projects.select(*model.SUMMARY_COLUMNS)


def detail(projects: DataFrame, project_id: str | Column) -> DataFrame:
    return projects.filter(F.col("id") == project_id).select(*model.DETAIL_COLUMNS)


def leaderboard_order() -> list[Column]:
    """Winners first, then the best placement, then the title; ``id`` makes the order total."""
    return [
        F.col("is_winner").desc(),
        F.col("placement").asc_nulls_last(),
        F.col("title").asc(),
        F.col("id").asc(),
    ]


def leaderboard(projects: DataFrame, source: str, slug: str) -> DataFrame:
    rows = projects.filter((F.col("source") == source) & (F.col("hackathon_slug") == slug))
    return rows.orderBy(*leaderboard_order()).select(*model.SUMMARY_COLUMNS)


def theme_projects(projects: DataFrame, theme: str, limit: int = 60) -> DataFrame:
    rows = projects.filter(F.array_contains("theme_tags", theme))
    return rows.orderBy(*leaderboard_order()).limit(limit).select(*model.SUMMARY_COLUMNS)


def hackathon_counts(hackathons: DataFrame, projects: DataFrame) -> DataFrame:
    """Events with their number of projects; an event without projects counts 0.

    Projects are counted before the join, so the join sees one row per event on either side however
    many projects one event holds.
    """
    counts = projects.groupBy("source", F.col("hackathon_slug").alias("slug")).agg(
        F.count("*").alias("project_count")
    )
    return hackathons.join(counts, ["source", "slug"], "left").withColumn(
        "project_count", F.coalesce("project_count", F.lit(0).cast("long"))
    )


def hackathon_candidates(hackathons: DataFrame, projects: DataFrame, slug: str) -> DataFrame:
    """All events of one slug (a slug may exist on several sources), the fullest first."""
    rows = hackathon_counts(
        hackathons.filter(F.col("slug") == slug), projects.filter(F.col("hackathon_slug") == slug)
    )
    return rows.orderBy(F.desc("project_count"), F.asc("source"))


def hackathon_main(hackathons: DataFrame, projects: DataFrame) -> DataFrame:
    """For every slug: which event is the main one and which are alternatives.

    A slug's group holds at most one row per source.
    """
    order = Window.partitionBy("slug").orderBy(F.desc("project_count"), F.asc("source"))
    ranked = hackathon_counts(hackathons, projects).withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("role", F.when(F.col("rank") == 1, "main").otherwise("alternative"))


def corpus_stats(projects: DataFrame, hackathons: DataFrame) -> DataFrame:
    events = hackathons.agg(F.count("*").alias("n"))
    per_source = projects.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if("is_winner").alias("w")
    )
    return per_source.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("projects"),
        F.coalesce(F.sum("w"), F.lit(0)).alias("winners"),
        F.count("source").alias("sources"),
    ).withColumn("hackathons", events.scalar())


def work_queue(projects: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows still to encode, the first by id if limited. ``limit=0`` asks for no row, ``None`` for all.

    Only a limit needs the order, so an unlimited queue is not sorted.
    """
    queue = projects.filter(F.col("embedding").isNull()).select("id", *model.EMBEDDED_TEXT)
    return queue if limit is None else queue.orderBy("id").limit(limit)


def extraction_batch(
    projects: DataFrame, sources: list[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Rows to send to tag extraction; a limit takes the first by id, and 0 or ``None`` means all."""
    rows = projects.filter(search_filter(sources)).select("id", "source", *model.EMBEDDED_TEXT)
    return rows.orderBy("id").limit(limit) if limit else rows


def with_repository(projects: DataFrame) -> DataFrame:
    return projects.filter(F.col("repo_url").ilike(f"%{text.CODE_HOST}%"))


def only_missing(projects: DataFrame, done: DataFrame) -> DataFrame:
    """Projects that have no row yet in an enrichment table, to resume a pass."""
    return projects.join(done.select(F.col("project_id").alias("id")), "id", "left_anti")


def encode_batches(queue: DataFrame, partitions: int | None = None) -> DataFrame:
    """Texts grouped by length within each task, so that a padded batch wastes little."""
    rows = queue.withColumn("text", text.embed_text(*[F.col(c) for c in model.EMBEDDED_TEXT]))
    if partitions:
        rows = rows.repartition(partitions)
    return rows.withColumn("n_chars", F.length("text")).sortWithinPartitions("n_chars")
