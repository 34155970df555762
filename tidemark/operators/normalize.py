"""Relational dumps of several sources to the one project schema.

Three families of sources differ in how a result is known: a declared position, being listed at all,
or the prizes won. One pass over the projects handles all of them; the dimensions are joined with
their natural sizes, so Spark broadcasts the small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text


def best_prizes(prizes: DataFrame) -> DataFrame:
    """Per project: best place, its track and label, and whether any prize was won.

    The first prize wins ties. Without a placed prize the track is that of the first prize. Both are
    aggregates with map-side combine, so a project with very many prizes is no hot spot.
    ``prizes`` has ``project_id``, ``item_name``, ``prize_name`` and a unique ``ord``.
    """
    place = text.parse_place(F.col("item_name"))
    placed = F.when(F.col("place").isNotNull(), F.struct("place", "ord"))
    best = F.min_by(F.struct("place", "prize_name", "item_name"), placed)
    return (
        prizes.withColumn("place", place)
        .groupBy("project_id")
        .agg(best.alias("best"), F.min_by("prize_name", "ord").alias("first_track"), F.count("*").alias("n_prizes"))
        .select(
            "project_id",
            F.col("best.place").alias("placement"),
            F.coalesce(text.clean(F.col("best.prize_name")), text.clean(F.col("first_track"))).alias("prize_track"),
            text.clean(F.col("best.item_name")).alias("place_label"),
            "n_prizes",
        )
    )


def normalize_projects(
    raw_projects: DataFrame,
    raw_events: DataFrame,
    raw_teams: DataFrame,
    raw_prizes: DataFrame,
    families: dict[str, list[str]],
) -> DataFrame:
    """Unified project rows. Rows without a slug or without a known event are dropped.

    ``families`` lists the sources of each kind: ``position``, ``winners_only`` and ``prizes``.
    """
    events = raw_events.select(
        F.col("id").alias("event_id"), F.col("name").alias("hackathon_name"), F.col("slug").alias("hackathon_slug")
    )
    teams = raw_teams.select(F.col("id").alias("team_id"), F.col("name").alias("team"))
    prizes = best_prizes(raw_prizes).select(F.col("project_id").alias("id"), F.struct("*").alias("prize"))
    rows = (
        raw_projects.filter(F.col("slug") != "")
        .join(events, "event_id")
        .join(teams, "team_id", "left")
        .join(prizes, "id", "left")
    )
    source = F.col("source")
    declared = text.position_outcome(F.coalesce("event_position", F.lit("")))
    url = text.clean(F.col("url"))

    def by_family(position: Column, winners_only: Column, by_prize: Column, other: Column) -> Column:
        return (
            F.when(source.isin(families["position"]), position)
            .when(source.isin(families["winners_only"]), winners_only)
            .when(source.isin(families["prizes"]), by_prize)
            .otherwise(other)
        )

    none = F.lit(None)
    won = F.coalesce("prize.n_prizes", F.lit(0)) > 0
    raw_place = text.clean(F.col("event_position"))
    return rows.select(
        text.project_id(source, F.col("slug")).alias("id"),
        "source",
        F.coalesce("url", F.lit("")).alias("source_url"),
        "hackathon_slug",
        "hackathon_name",
        "title",
        text.clean(F.col("description")).alias("description"),
        text.clean(F.col("short_description")).alias("short_description"),
        by_family(declared.placement, none, F.col("prize.placement"), none).cast("int").alias("placement"),
        by_family(raw_place, raw_place, F.coalesce("prize.place_label", raw_place), raw_place).alias("raw_placement"),
        by_family(declared.is_winner, F.lit(True), won, F.lit(False)).alias("is_winner"),
        by_family(none, none, F.col("prize.prize_track"), none).cast("string").alias("prize_track"),
        by_family(F.col("team"), F.col("team"), none, F.col("team")).cast("string").alias("team_name"),
        by_family(none, none, F.when(text.is_code_host(url), url), none).cast("string").alias("repo_url"),
    )


def raw_tags(raw_project_tech: DataFrame, technologies: DataFrame, project_ids: DataFrame) -> DataFrame:
    """Raw tags per project, each name once, with the slug that comes first. ``project_ids`` maps the raw key to id and source."""
    named = raw_project_tech.join(technologies, "tech_id").join(project_ids, "raw_id")
    first = F.min(F.struct("position", "tech_slug"))
    return named.groupBy("project_id", "source", "tech_name").agg(first["tech_slug"].alias("tech_slug"))
