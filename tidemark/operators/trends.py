"""Theme and trend analytics.

Tags are exploded and counted with a map-side combine, so the shuffle carries one row per tag and
task whatever the skew. Small totals enter as scalar subqueries, not as joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import stats, text

# Report sizes and notes.
TOP_STACKS = 15
LIFT_ROWS = 25
LIFT_MIN_COUNT = 5
BIAS_NOTE = "win rates depend on the number of prizes and on how winners were collected"
AWAITING_DATES = "awaiting_date_backfill"
UNAVAILABLE = "unavailable_in_corpus"


def _in_theme(projects: DataFrame, theme: str | None) -> DataFrame:
    return projects if theme is None else projects.filter(F.array_contains("theme_tags", theme))


def _scalar(frame: DataFrame, *columns: str) -> Column:
    """The single row of ``frame`` as one struct-valued scalar subquery."""
    return frame.select(F.struct(*columns)).scalar()


def theme_counts(projects: DataFrame) -> DataFrame:
    return (
        projects.select(F.explode("theme_tags").alias("slug"), "is_winner")
        .groupBy("slug")
        .agg(F.count("*").alias("project_count"), F.count_if("is_winner").alias("winner_count"))
    )


def theme_index(projects: DataFrame, themes: DataFrame) -> DataFrame:
    """Every theme of the vocabulary with its counts, and whether it has any project."""
    counted = themes.join(theme_counts(projects), "slug", "left").select(
        "slug",
        "label",
        "description",
        F.coalesce("project_count", F.lit(0)).alias("project_count"),
        F.coalesce("winner_count", F.lit(0)).alias("winner_count"),
    )
    return counted.withColumn("has_projects", F.col("project_count") > 0).orderBy(
        F.desc("project_count"), F.asc("label")
    )


def theme_detail(projects: DataFrame, theme: str) -> DataFrame:
    """Volume, winners and win rate of one theme; the rate of an empty theme is NULL."""
    counts = _in_theme(projects, theme).agg(
        F.count("*").alias("project_count"), F.count_if("is_winner").alias("winner_count")
    )
    return counts.select(
        F.lit(theme).alias("slug"),
        "project_count",
        "winner_count",
        F.try_divide("winner_count", "project_count").alias("win_rate"),
        F.lit(BIAS_NOTE).alias("note"),
    )


def theme_top_stacks(projects: DataFrame, theme: str, limit: int = TOP_STACKS) -> DataFrame:
    return (
        _in_theme(projects, theme)
        .select(F.explode("tech_stack").alias("tech"))
        .groupBy("tech")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc("tech"))
        .limit(limit)
    )


def theme_win_rates(projects: DataFrame, themes: DataFrame) -> DataFrame:
    """Win rate per observed tag, labelled from the vocabulary or by the slug itself."""
    return (
        theme_counts(projects)
        .join(themes.select("slug", "label"), "slug", "left")
        .select(
            "slug",
            F.coalesce("label", "slug").alias("label"),
            "project_count",
            "winner_count",
            F.try_divide("winner_count", "project_count").alias("win_rate"),
            F.lit(BIAS_NOTE).alias("note"),
        )
        .orderBy(F.desc("project_count"), F.asc("slug"))
    )


def crowded_low_win(win_rates: DataFrame, min_count: int = 500, limit: int = 5) -> DataFrame:
    """Themes with many projects and few wins."""
    crowded = win_rates.filter((F.col("project_count") >= min_count) & F.col("win_rate").isNotNull())
    return crowded.orderBy(F.asc("win_rate"), F.asc("slug")).limit(limit)


def date_coverage(projects: DataFrame) -> DataFrame:
    """How many rows are dated, and whether temporal analyses can run."""
    counts = projects.agg(F.count("hackathon_date").alias("with_date"), F.count("*").alias("total"))
    status = F.when(F.col("with_date") == 0, AWAITING_DATES).otherwise("available")
    return counts.withColumn("status", status)


def saturation(projects: DataFrame, theme: str | None = None) -> DataFrame:
    """Volume and winners per quarter; undated rows are left out."""
    quarter_start = F.date_trunc("quarter", "hackathon_date").cast("date")
    return (
        _in_theme(projects, theme)
        .filter(F.col("hackathon_date").isNotNull())
        .groupBy(quarter_start.alias("start"))
        .agg(F.count("*").alias("n"), F.count_if("is_winner").alias("winners"))
        .select(text.quarter_label(F.col("start")).alias("quarter"), "n", "winners")
        .orderBy("quarter")
    )


def lifecycle(saturated: DataFrame) -> DataFrame:
    """First, busiest and last quarter; of equally busy quarters the earliest counts.

    Labels sort like the quarters they name.
    """
    busiest = F.min_by("quarter", F.struct(-F.col("n"), F.col("quarter")))
    return saturated.agg(
        F.min("quarter").alias("first_quarter"),
        busiest.alias("peak_quarter"),
        F.max("quarter").alias("last_quarter"),
    )


def stack_contrast(
    projects: DataFrame,
    theme: str | None = None,
    min_count: int = LIFT_MIN_COUNT,
    winners_only: bool = False,
) -> DataFrame:
    """Per tag: rows, winners and others, next to the totals over all rows that have a tag."""
    population = _in_theme(projects, theme).filter(F.size("tech_stack") > 0)
    if winners_only:
        population = population.filter("is_winner")
    counts = [F.count("*").alias("n"), F.count_if("is_winner").alias("winners"), F.count_if(~F.col("is_winner")).alias("others")]
    totals = population.agg(*counts)
    return (
        population.select(F.explode("tech_stack").alias("tech"), "is_winner")
        .groupBy("tech")
        .agg(*counts)
        .filter(F.col("n") >= min_count)
        .withColumn("t", _scalar(totals, "n", "winners", "others"))
        .select(
            "tech", "n", "winners", "others",
            F.col("t.n").alias("total"),
            F.col("t.winners").alias("total_winners"),
            F.col("t.others").alias("total_others"),
        )
    )


def stack_lift(contrast: DataFrame, limit: int = LIFT_ROWS) -> DataFrame:
    """Share among winners over share overall, for the most frequent tags; 0 where undefined."""
    winner_share = F.coalesce(F.try_divide("winners", "total_winners"), F.lit(0.0))
    baseline = F.coalesce(F.try_divide("n", "total"), F.lit(0.0))
    top = contrast.orderBy(F.desc("n"), F.asc("tech")).limit(limit)
    return (
        top.withColumn("winner_share", winner_share)
        .withColumn("baseline_share", baseline)
        .withColumn("lift", F.coalesce(F.try_divide("winner_share", "baseline_share"), F.lit(0.0)))
    )


def stack_ztest(lift: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Winners against others: z, two-sided p and the decision; NULL where it cannot be computed."""
    z = stats.two_proportion_z(
        F.col("winners"), F.col("total_winners"), F.col("others"), F.col("total_others")
    )
    return lift.withColumn("z", z).withColumns(
        {"p_value": stats.two_sided_p("z"), "significant": stats.is_significant(F.col("z"), alpha)}
    )


def team_size_correlation(projects: DataFrame) -> DataFrame:
    """Correlation of team size and placement, or the status that says no source gives sizes."""
    known = projects.agg(
        F.count("team_size").alias("with_size"),
        F.corr("team_size", "placement").alias("correlation"),
    )
    status = F.when(F.col("with_size") == 0, UNAVAILABLE).otherwise("available")
    return known.withColumn("status", status)
