"""Text, URL, date and identity columns.

The regular expressions are constants, so each is compiled once per task and stays inside the
generated code of the stage that uses it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import let

# Patterns and lookup tables that decide results.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
PLACE = r"(?i)(\d+)\s*(?:st|nd|rd|th)\s+place"
URL_WITH_HOST = r"(?i)\Ahttps?://[^/?#]"
URL_SHAPE = r"(?i)\Ahttps?://."
URL_PARTS = r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)"
MONTH_NAMES = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
YEAR = r"(\d{4})"
DAY_BEFORE_YEAR = r"(\d{1,2})(?:st|nd|rd|th)?,?\s+\d{4}"
CODE_HOST = "github.com"
POSITIONS = {
    "WINNERS": (1, True),
    "TOP_2": (2, True),
    "TOP_3": (3, True),
    "FINALISTS": (None, False),
    "OTHER": (None, False),
}


def project_id(source: Column, slug: Column) -> Column:
    """Deterministic identity, so collecting a record again updates it."""
    return F.sha2(F.concat_ws(":", source, slug), 256)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean(c: Column) -> Column:
    """Strip white space of any kind at both ends; nothing left becomes NULL."""
    return blank_to_null(F.btrim(c, F.lit(WHITE_SPACE)))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL where the pattern does not occur."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def parse_place(c: Column) -> Column:
    return extract(c, PLACE).try_cast("int")


def position_outcome(position: Column) -> Column:
    """``struct(placement, is_winner)`` of a declared position; unknown positions do not win."""
    placement, winner = F.lit(None).cast("int"), F.lit(False)
    for name, (rank, won) in POSITIONS.items():
        placement = F.when(position == name, F.lit(rank).cast("int")).otherwise(placement)
        winner = F.when(position == name, F.lit(won)).otherwise(winner)
    return F.struct(placement.alias("placement"), winner.alias("is_winner"))


def excerpt(description: Column, short: Column, max_chars: int) -> Column:
    """``struct(text, truncated)``: the long text if any, cut on a word boundary."""

    def cut(head: Column) -> Column:
        from_end = F.instr(F.reverse(head), " ")
        last_space = F.when(from_end > 0, F.length(head) - from_end).otherwise(-1)
        kept = F.when(last_space > max_chars // 2, F.substring(head, F.lit(1), last_space)).otherwise(head)
        return F.concat(F.rtrim(kept, F.lit(WHITE_SPACE)), F.lit("…"))

    def shorten(whole: Column) -> Column:
        long = F.length(whole) > max_chars
        text = F.when(long, let(F.substring(whole, 1, max_chars), cut)).otherwise(whole)
        return F.struct(text.alias("text"), F.coalesce(long, F.lit(False)).alias("truncated"))

    return let(F.coalesce(clean(description), clean(short)), shorten)


def embed_text(*columns: Column) -> Column:
    """Text to encode: the non-empty parts, a blank line between them."""
    return F.concat_ws("\n\n", *[blank_to_null(c) for c in columns])


def grounding_text(title: Column, short: Column, description: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, short, description)])


def quarter_label(day: Column) -> Column:
    return F.date_format(day, "yyyy'Q'q")


def parse_date_range(c: Column) -> Column:
    """End date of a period written for people: last month named, last day, the year."""
    month = F.try_element_at(F.regexp_extract_all(c, F.lit(MONTH_NAMES), F.lit(1)), F.lit(-1))
    day, year = extract(c, DAY_BEFORE_YEAR), extract(c, YEAR)
    # ``concat`` is NULL as soon as one part is missing.
    spelled = F.concat(month, F.lit(" "), day, F.lit(" "), year)
    return F.to_date(F.try_to_timestamp(spelled, F.lit("MMM d yyyy")))


def parse_iso_date(c: Column) -> Column:
    """Day of an ISO date or date-time; anything after the day is ignored."""
    return extract(c, r"\A(\d{4}-\d{2}-\d{2})").try_cast("date")


def valid_url(c: Column) -> Column:
    """An explicit http(s) scheme and a non-empty host; NULL is not a valid URL."""
    return F.coalesce(c.rlike(URL_WITH_HOST), F.lit(False))


def url_shaped(c: Column) -> Column:
    """The looser rule of the batch gate: scheme and one more character."""
    return c.rlike(URL_SHAPE)


def is_code_host(url: Column) -> Column:
    return url.contains(CODE_HOST)


def parse_repo_url(c: Column) -> Column:
    """``struct(owner, repo)`` of a code-host URL, NULL for any other URL."""
    url = clean(c)
    host = F.lower(F.regexp_extract(url, URL_PARTS, 1))
    parts = F.filter(F.split(F.regexp_extract(url, URL_PARTS, 2), "/"), lambda p: p != "")
    return F.when(
        host.contains(CODE_HOST) & (F.size(parts) >= 2),
        F.struct(
            F.try_element_at(parts, F.lit(1)).alias("owner"),
            F.regexp_replace(F.try_element_at(parts, F.lit(2)), r"\.git\z", "").alias("repo"),
        ),
    )


def unescape_json_text(c: Column) -> Column:
    """Decode the body of a JSON string literal, unicode escapes included."""
    return F.from_json(F.concat(F.lit('{"t":"'), c, F.lit('"}')), "t string").t
