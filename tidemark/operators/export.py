"""Guarded public export: declared columns and types, never the text itself."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import model


def check_columns(columns: Iterable[str]) -> None:
    """Refuse a selection that would publish text."""
    if leaked := sorted(model.EXPORT_FORBIDDEN.intersection(columns)):
        raise ValueError(f"columns that must not be published: {', '.join(leaked)}")


def to_declared(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows in the declared schema; a different set or order of columns is an error."""
    if rows.columns != schema.names:
        raise ValueError(f"columns {rows.columns} differ from the declared {schema.names}")
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def export_projects(projects: DataFrame, limit: int | None = None) -> DataFrame:
    check_columns(model.EXPORT_COLUMNS)
    rows = projects.select(
        *model.EXPORT_COLUMNS,
        (F.col("description").isNotNull() | F.col("short_description").isNotNull()).alias("has_description"),
        F.coalesce(F.length("description"), F.length("short_description"), F.lit(0)).alias("description_chars"),
        F.col("embedding").isNotNull().alias("has_embedding"),
    ).orderBy("id")
    return to_declared(rows if limit is None else rows.limit(limit), model.EXPORT_PROJECT)


def export_hackathons(hackathons: DataFrame) -> DataFrame:
    rows = hackathons.select(*model.EXPORT_HACKATHON.names).orderBy("source", "slug")
    return to_declared(rows, model.EXPORT_HACKATHON)


def export_embeddings(projects: DataFrame, exported: DataFrame | None = None) -> DataFrame:
    """Vectors of the exported rows. Pass ``exported`` when that export was limited: a limit of its
    own would pick other ids. A full export needs no such join."""
    rows = projects.filter(F.col("embedding").isNotNull()).select("id", "embedding")
    if exported is not None:
        rows = rows.join(exported.select("id"), "id", "left_semi")
    return to_declared(rows.orderBy("id"), model.EXPORT_EMBEDDING)


def coverage(exported: DataFrame) -> DataFrame:
    """Counts and whole percentages for the dataset card, in one pass."""
    n = F.count("*")

    def percent(condition: Column) -> Column:
        return F.bround(100.0 * F.count_if(condition) / F.greatest(n, F.lit(1)), 0).cast("long")

    return exported.agg(
        n.alias("n_projects"),
        F.count_if("has_embedding").alias("n_embeddings"),
        percent(F.col("hackathon_date").isNotNull()).alias("pct_date"),
        percent(F.size("theme_tags") > 0).alias("pct_theme"),
        percent(F.col("has_embedding")).alias("pct_embedding"),
    )


_CARD = """---
license: cc-by-sa-4.0
configs:
  - config_name: projects
    data_files: projects/*.parquet
  - config_name: hackathons
    data_files: hackathons/*.parquet
  - config_name: embeddings
    data_files: embeddings/*.parquet
---

# Project catalogue, version {version}

{n_projects} projects of {n_hackathons} events. Winners and others are both included; `is_winner`
tells them apart. Descriptions are not republished: follow `source_url`, and use `has_description`
and `description_chars` to judge what is there.

| Measured | Value |
|---|---|
| rows with an event date | {pct_date} % |
| rows with a theme | {pct_theme} % |
| rows with a vector | {n_embeddings} ({pct_embedding} %) |
"""


def write_dataset(
    projects: DataFrame,
    hackathons: DataFrame,
    folder: str,
    version: str,
    limit: int | None = None,
    with_embeddings: bool = True,
) -> str:
    """Write the Parquet tables and return the dataset card. Only counts reach the driver."""
    exported = export_projects(projects, limit)
    exported.write.mode("overwrite").parquet(f"{folder}/projects")
    export_hackathons(hackathons).write.mode("overwrite").parquet(f"{folder}/hackathons")
    if with_embeddings:
        chosen = None if limit is None else exported
        export_embeddings(projects, chosen).write.mode("overwrite").parquet(f"{folder}/embeddings")
    spark = projects.sparkSession
    written = spark.read.parquet(f"{folder}/projects")
    check_columns(written.columns)
    stats = coverage(written).first().asDict()
    if not with_embeddings:
        stats.update(n_embeddings=0, pct_embedding=0)
    stats["n_hackathons"] = spark.read.parquet(f"{folder}/hackathons").count()
    return _CARD.format(version=version, **stats)
