"""Merge of the enrichment passes into the serving table, and grounding of claimed tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import tags, text
from tidemark.functions.tags import Vocabulary


def merge_passes(repo: DataFrame, model: DataFrame) -> DataFrame:
    """One row per project of either pass. Repository tags win unless empty; themes come from the
    model pass only. ``stack_source`` says where the tags came from."""
    r = repo.select("project_id", F.col("tech_stack").alias("repo_tags"))
    m = model.select("project_id", F.col("tech_stack").alias("model_tags"), F.col("theme_tags").alias("themes"))
    nothing = F.array().cast("array<string>")
    from_repo = F.coalesce(F.size("repo_tags") > 0, F.lit(False))
    return r.join(m, "project_id", "full_outer").select(
        "project_id",
        F.when(from_repo, F.col("repo_tags")).otherwise(F.coalesce("model_tags", nothing)).alias("tech_stack"),
        F.when(from_repo, "github")
        .when(F.coalesce(F.size("model_tags") > 0, F.lit(False)), "llm")
        .otherwise("none")
        .alias("stack_source"),
        F.coalesce("themes", nothing).alias("theme_tags"),
        F.col("model_tags").isNotNull().alias("has_model"),
    )


def merge_summary(merged: DataFrame) -> DataFrame:
    """What applying the merge would do, without doing it."""
    with_theme = F.col("has_model") & (F.size("theme_tags") > 0)
    return merged.groupBy("stack_source").agg(
        F.count("*").alias("projects"), F.count_if(with_theme).alias("with_themes")
    )


def apply_merge(projects: DataFrame, merged: DataFrame) -> DataFrame:
    """Projects with the merged tags. A merged row decides even when its list is empty; themes
    change only where the model pass saw the project."""
    m = merged.select(
        F.col("project_id").alias("id"), F.struct("tech_stack", "stack_source", "theme_tags", "has_model").alias("m")
    )
    hit = F.col("m").isNotNull()
    joined = projects.join(m, "id", "left").withColumns(
        {
            "tech_stack": F.when(hit, F.col("m.tech_stack")).otherwise(F.col("tech_stack")),
            "stack_source": F.when(hit, F.col("m.stack_source")).otherwise(F.col("stack_source")),
            "theme_tags": F.when(F.col("m.has_model"), F.col("m.theme_tags")).otherwise(F.col("theme_tags")),
        }
    )
    return joined.withColumn("enriched", hit).drop("m")


def reground(claims: DataFrame, projects: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Claimed tags that the project's own text mentions.

    The text is searched where it is read; the join carries the tags found, never the text.
    """
    whole = text.grounding_text(F.col("title"), F.col("short_description"), F.col("description"))
    found = projects.select(
        F.col("id").alias("project_id"), tags.mentioned_tags(whole, vocabulary).alias("mentioned")
    )
    claimed = claims.filter(F.size("tech_stack") > 0)
    return claimed.join(found, "project_id").select(
        "project_id",
        F.col("tech_stack").alias("claimed"),
        tags.ground_tags(F.col("tech_stack"), F.col("mentioned")).alias("grounded"),
    )


def reground_impact(regrounded: DataFrame) -> DataFrame:
    removed = F.size("claimed") - F.size("grounded")
    return regrounded.agg(
        F.count("*").alias("with_tags"),
        F.count_if(removed > 0).alias("changed"),
        F.coalesce(F.sum(removed), F.lit(0)).alias("removed"),
    )
