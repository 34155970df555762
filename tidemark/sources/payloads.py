"""Captured JSON payloads to rows, with native JSON readers.

Each input is a table of captured documents (``body`` and whatever identifies it). Payload order is
kept in ``ord``, so that "first" has a meaning after a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text

# The declared shapes of the payloads; other fields are ignored.
SUBMISSION = (
    "struct<title:string,slug:string,shortDescription:string,description:string,eventPosition:string,"
    "event:struct<name:string,slug:string>,team:struct<name:string,slug:string>,"
    "techIn:array<struct<tech:struct<name:string,slug:string>>>,videoLink:string>"
)
EVENT = "struct<title:string,url:string,submission_period_dates:string,winners_announced:boolean>"
EVENT_SITE = r"\Ahttps?://([^.]+)\.devpost\.com"
# The repetition is possessive: it runs as a loop, however long the pushed text is.
SCRIPT_CALL = r'self\.__next_f\.push\(\[1,"((?:[^"\\]|\\.)*+)"\]\)'
SUBMISSION_SITE = "https://lablab.ai/p/"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as ``path`` and ``body``; the shape is decided when they are parsed."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("body")
    )


def submissions(captured: DataFrame, *keys: str) -> DataFrame:
    """One row per submission of ``{"submissions": [...]}`` or of a bare list."""
    wrapped = F.from_json("body", f"struct<submissions:array<{SUBMISSION}>>").submissions
    bare = F.from_json("body", f"array<{SUBMISSION}>")
    rows = F.when(F.ltrim("body").startswith("["), bare).otherwise(wrapped)
    return captured.select(*keys, F.posexplode(rows).alias("ord", "s"))


def submission_projects(rows: DataFrame, source: str, *keys: str) -> DataFrame:
    """Unified rows of the submissions that have a slug."""
    slug = text.clean(F.col("s.slug"))
    event_slug = F.coalesce(text.clean(F.col("s.event.slug")), slug)
    outcome = text.position_outcome(F.coalesce("s.eventPosition", F.lit("")))
    return rows.filter(slug.isNotNull()).select(
        *keys,
        "ord",
        text.project_id(F.lit(source), slug).alias("id"),
        F.lit(source).alias("source"),
        F.concat(F.lit(SUBMISSION_SITE), slug).alias("source_url"),
        event_slug.alias("hackathon_slug"),
        F.coalesce(text.clean(F.col("s.event.name")), event_slug).alias("hackathon_name"),
        F.coalesce(text.clean(F.col("s.title")), slug).alias("title"),
        text.clean(F.col("s.description")).alias("description"),
        text.clean(F.col("s.shortDescription")).alias("short_description"),
        outcome.placement.alias("placement"),
        text.clean(F.col("s.eventPosition")).alias("raw_placement"),
        outcome.is_winner.alias("is_winner"),
        text.clean(F.col("s.team.name")).alias("team_name"),
        text.clean(F.col("s.videoLink")).alias("demo_url"),
    )


def submission_tags(rows: DataFrame, source: str) -> DataFrame:
    """Raw tags of the submissions: project, name and slug."""
    slug = text.clean(F.col("s.slug"))
    tagged = rows.filter(slug.isNotNull()).select(
        text.project_id(F.lit(source), slug).alias("project_id"), F.explode("s.techIn.tech").alias("t")
    )
    return tagged.select(
        "project_id",
        F.lit(source).alias("source"),
        text.clean(F.col("t.name")).alias("tech_name"),
        text.clean(F.col("t.slug")).alias("tech_slug"),
    ).filter(F.col("tech_name").isNotNull())


def submission_events(projects: DataFrame, *order: str) -> DataFrame:
    """The event of each submission, once per slug and with its first spelling of the name."""
    first = F.min_by("hackathon_name", F.struct(*order))
    return projects.groupBy("source", F.col("hackathon_slug").alias("slug")).agg(first.alias("name"))


def event_list(captured: DataFrame, *keys: str) -> DataFrame:
    """Events with announced winners and an address on the site."""
    listed = captured.select(
        *keys, F.inline(F.from_json("body", f"struct<hackathons:array<{EVENT}>>").hackathons)
    )
    slug = text.extract(F.col("url"), EVENT_SITE)
    return listed.filter(F.col("winners_announced") & slug.isNotNull()).select(
        *keys,
        slug.alias("slug"),
        F.coalesce(text.clean(F.col("title")), slug).alias("title"),
        text.parse_date_range(F.col("submission_period_dates")).alias("hackathon_date"),
    )


def event_list_meta(captured: DataFrame, *keys: str) -> DataFrame:
    """``total_count`` and ``per_page`` (0 and 50 when absent) of each list page."""
    meta = F.from_json("body", "struct<meta:struct<total_count:bigint,per_page:bigint>>").meta
    return captured.select(
        *keys,
        F.coalesce(F.nullif(meta.total_count, F.lit(0)), F.lit(0)).alias("total_count"),
        F.coalesce(F.nullif(meta.per_page, F.lit(0)), F.lit(50)).alias("per_page"),
    )


# --- payloads inside script calls ------------------------------------------------------------

_PRIZES = "array<struct<name:string,prize:struct<name:string>>>"
_LISTED = f"array<struct<uuid:string,slug:string,name:string,tagline:string,prizes:{_PRIZES}>>"
_PROJECT = (
    "struct<uuid:string,slug:string,name:string,tagline:string,description:string,sourceCodeUrl:string,"
    f"url:string,event:struct<slug:string,name:string,startTime:string>,prizes:{_PRIZES}>"
)


def script_payloads(body: Column) -> Column:
    """Decoded texts that a page pushes to its scripts."""
    return F.transform(
        F.regexp_extract_all(body, F.lit(SCRIPT_CALL), F.lit(1)), text.unescape_json_text
    )


def _first_with(payloads: Column, marker: str) -> Column:
    """The first payload that contains the marker, from the JSON value after it on."""
    found = F.try_element_at(F.filter(payloads, lambda p: F.contains(p, F.lit(marker))), F.lit(1))
    start = F.instr(found, marker) + len(marker) - 1
    return F.substring(found, start, F.length(found))


def listing_entries(captured: DataFrame, *keys: str) -> DataFrame:
    """All projects of a listing page; ``has_prizes`` tells the awarded ones apart.

    The JSON reader stops at the end of the list, so whatever follows it is ignored.
    """
    pages = captured.select(*keys, script_payloads(F.col("body")).alias("payloads"))
    listed = F.from_json(_first_with(F.col("payloads"), '"projects":['), _LISTED)
    return pages.select(*keys, F.inline(listed)).select(
        *keys,
        "uuid",
        "slug",
        F.coalesce(text.clean(F.col("name")), "slug").alias("name"),
        text.clean(F.col("tagline")).alias("tagline"),
        (F.coalesce(F.size("prizes"), F.lit(0)) > 0).alias("has_prizes"),
    )


#: A text payload: its id, the length in hexadecimal digits, the text.
_TEXT = r"(?s)\A(\w+):T[0-9a-fA-F]+,(.+)\z"


def script_projects(captured: DataFrame, *keys: str) -> DataFrame:
    """The project of a page, its best prize and its description.

    A description that is a reference (``$`` and an id) lives in the text payload of that id.
    """
    pages = captured.select(*keys, script_payloads(F.col("body")).alias("payloads"))
    texts = F.transform(
        F.filter("payloads", lambda p: p.rlike(_TEXT)),
        lambda p: F.struct(F.regexp_extract(p, _TEXT, 1).alias("id"), F.regexp_extract(p, _TEXT, 2).alias("body")),
    )
    parsed = pages.select(
        *keys,
        # ``explode`` keeps the optimiser from parsing again for the filter below.
        F.explode(F.array(F.from_json(_first_with(F.col("payloads"), '"project":{'), _PROJECT))).alias("p"),
        texts.alias("texts"),
    ).filter(F.col("p.uuid").isNotNull() | F.col("p.name").isNotNull())
    ranked = F.transform(
        F.coalesce("p.prizes", F.array().cast(_PRIZES)),
        lambda prize, i: F.struct(
            text.parse_place(prize.getField("name")).alias("place"),
            i.alias("ord"),
            text.clean(prize.getField("prize").getField("name")).alias("track"),
            text.clean(prize.getField("name")).alias("label"),
        ),
    )
    rows = parsed.withColumn("prizes", ranked)
    best = F.array_min(F.filter("prizes", lambda r: r.place.isNotNull()))
    first = F.try_element_at("prizes", F.lit(1))
    inline = text.clean(F.col("p.description"))
    wanted = F.substring_index(inline, "$", -1)
    referred = text.clean(F.get(F.filter("texts", lambda t: t.id == wanted), F.lit(0)).body)
    return rows.withColumns({"best": best, "first": first}).select(
        *keys,
        F.coalesce("p.uuid", F.lit("")).alias("uuid"),
        F.coalesce(text.clean(F.col("p.slug")), "p.uuid", F.lit("")).alias("slug"),
        F.coalesce(text.clean(F.col("p.name")), "p.uuid", F.lit("")).alias("name"),
        text.clean(F.col("p.tagline")).alias("tagline"),
        F.coalesce(text.clean(F.col("p.sourceCodeUrl")), text.clean(F.col("p.url"))).alias("repo_url"),
        F.when(~inline.startswith("$"), inline).otherwise(referred).alias("description"),
        text.clean(F.col("p.event.slug")).alias("event_slug"),
        text.clean(F.col("p.event.name")).alias("event_name"),
        text.parse_iso_date(F.col("p.event.startTime")).alias("event_date"),
        F.col("best.place").alias("placement"),
        (F.size("prizes") > 0).alias("is_winner"),
        F.coalesce("best.track", "first.track", "first.label").alias("prize_track"),
        F.coalesce("best.label", F.when(F.col("best.track").isNull(), F.col("first.label"))).alias("raw_placement"),
    )
