"""Declared schemas, column lists and closed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())


def _field(name: str, kind: T.DataType, required: bool = False) -> T.StructField:
    return T.StructField(name, kind, not required)


PROJECT = T.StructType(
    [
        _field("id", T.StringType(), True),
        _field("source", T.StringType(), True),
        _field("source_url", T.StringType(), True),
        _field("hackathon_slug", T.StringType(), True),
        _field("hackathon_name", T.StringType(), True),
        _field("hackathon_date", T.DateType()),
        _field("theme_tags", STRINGS, True),
        _field("title", T.StringType(), True),
        _field("description", T.StringType()),
        _field("short_description", T.StringType()),
        _field("placement", T.IntegerType()),
        _field("raw_placement", T.StringType()),
        _field("is_winner", T.BooleanType(), True),
        _field("prize_track", T.StringType()),
        _field("tech_stack", STRINGS, True),
        _field("stack_source", T.StringType(), True),
        _field("team_size", T.IntegerType()),
        _field("team_name", T.StringType()),
        _field("repo_url", T.StringType()),
        _field("demo_url", T.StringType()),
        _field("scraped_at", T.TimestampType(), True),
    ]
)

EMBEDDING = T.ArrayType(T.FloatType())
SERVING = T.StructType(PROJECT.fields + [_field("embedding", EMBEDDING)])
STAGING = T.StructType([_field("scrape_run_id", T.LongType(), True)] + PROJECT.fields)

HACKATHON = T.StructType(
    [
        _field("source", T.StringType(), True),
        _field("slug", T.StringType(), True),
        _field("name", T.StringType(), True),
        _field("hackathon_date", T.DateType()),
        _field("url", T.StringType()),
        _field("scraped_at", T.TimestampType(), True),
    ]
)

RUN_EVENT = T.StructType(
    [
        _field("run_id", T.LongType(), True),
        _field("seq", T.LongType(), True),
        _field("source", T.StringType()),
        _field("kind", T.StringType(), True),
        _field("status", T.StringType(), True),
        _field("n_scraped", T.LongType()),
        _field("n_promoted", T.LongType()),
        _field("notes", T.StringType()),
    ]
)

CHECK = T.StructType(
    [
        _field("scrape_run_id", T.LongType(), True),
        _field("source", T.StringType(), True),
        _field("check_name", T.StringType(), True),
        _field("passed", T.BooleanType(), True),
        _field("detail", T.StringType()),
    ]
)

PROJECT_COLUMNS = [f.name for f in PROJECT.fields]

# Columns whose text is encoded into the vector, in the order they are joined.
EMBEDDED_TEXT = ["title", "short_description", "description"]

# Closed enumerations of the data model.
STACK_SOURCES = ["github", "llm", "scraped", "none"]
RUN_STATUSES = ["running", "scraped", "validated", "rejected", "promoted", "failed", "blocked"]
PENDING_STATUSES = ["scraped", "validated"]

# Columns of the read views.
DETAIL_COLUMNS = [
    "id", "source", "source_url", "hackathon_slug", "hackathon_name", "hackathon_date", "title",
    "description", "short_description", "theme_tags", "tech_stack", "stack_source", "is_winner",
    "placement", "raw_placement", "prize_track", "team_size", "team_name", "repo_url", "demo_url",
    "scraped_at",
]
SUMMARY_COLUMNS = [
    "id", "source", "source_url", "title", "placement", "raw_placement", "is_winner", "prize_track",
    "team_name", "tech_stack", "repo_url", "demo_url",
]
NEIGHBOUR_COLUMNS = [
    "id", "source", "source_url", "title", "hackathon_slug", "hackathon_name", "is_winner",
    "placement", "tech_stack",
]
HIT_COLUMNS = [
    "id", "source", "source_url", "title", "description", "short_description", "hackathon_slug",
    "hackathon_name", "is_winner", "placement", "tech_stack", "theme_tags",
]

# Public export: what leaves the catalogue, and what never may.
EXPORT_COLUMNS = [
    "id", "source", "source_url", "hackathon_slug", "hackathon_name", "hackathon_date", "title",
    "theme_tags", "tech_stack", "stack_source", "is_winner", "placement", "raw_placement",
    "prize_track", "team_size", "team_name", "repo_url", "demo_url", "scraped_at",
]
EXPORT_DERIVED = [
    _field("has_description", T.BooleanType()),
    _field("description_chars", T.IntegerType()),
    _field("has_embedding", T.BooleanType()),
]
EXPORT_PROJECT = T.StructType(
    [_field(c, PROJECT[c].dataType) for c in EXPORT_COLUMNS] + EXPORT_DERIVED
)
EXPORT_HACKATHON = T.StructType(
    [_field(f.name, f.dataType) for f in HACKATHON.fields if f.name != "scraped_at"]
)
EXPORT_EMBEDDING = T.StructType([_field("id", T.StringType()), _field("embedding", EMBEDDING)])
EXPORT_FORBIDDEN = {"description", "short_description", "fts"}
