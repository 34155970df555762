import json

import pytest
from pyspark.sql import functions as F

from tidemark.session import work_folder
from tidemark.sources import pages, payloads

GALLERY = """
<div data-software-id="1"><a class="link-to-software" href="https://x.example/software/one?ref=2">
 <h5> One </h5><p class="tagline"> first </p></a><aside class="entry-badge"><img class="winner"> Best of <b>all</b> </aside>
 <div class="members"><img alt="Ann"><img alt="Bo"><img alt="Ann"></div></div>
<div data-software-id="2"><a href="/software/two"><h5></h5></a><aside class="entry-badge">Winner</aside></div>
<div data-software-id="3"><a href="/elsewhere">no entry</a></div>
<div data-software-id="4"><a href="/software/four#x">Four</a></div>
"""
SOFTWARE = """<html><head><meta name="description" content="meta text"></head><body>
<div id="app-details-left"><h2>What</h2><p>it does<br>well</p><script>x()</script></div>
<nav class="app-links"><a href="/local">l</a><a href="https://demo.example/a">d</a><a href="https://github.com/a/b">r</a>
<a href="https://github.com/c/d">r2</a></nav><div id="built-with"><span class="cp-tag">go</span><span class="cp-tag"> </span></div>"""
CHALLENGE = '<title>Just a moment...</title><script>window._cf_chl_opt={}</script>'


def captured(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "page int, body string")


def test_gallery(spark):
    rows = pages.gallery_entries(captured(spark, GALLERY, "", "<p>none"), "page").orderBy("position").collect()
    assert [r.slug for r in rows] == ["one", "two", "four"]
    one, two, four = rows
    assert (one.url, one.title, one.tagline) == ("https://x.example/software/one", "One", "first")
    assert (one.is_winner, one.prize_track, one.team_name) == (True, "Best of all", "Ann, Bo")
    assert (two.title, two.is_winner, two.prize_track) == ("two", True, "Winner")
    assert (four.is_winner, four.prize_track, four.team_name) == (False, None, None)


def test_software_page(spark):
    full, bare = pages.software_details(
        captured(spark, SOFTWARE, '<meta name="description" content=" only meta ">'), "page"
    ).orderBy("page").collect()
    assert full.description == "What it does well"
    assert (full.repo_url, full.demo_url, full.tags) == ("https://github.com/a/b", "https://demo.example/a", ["go"])
    assert (bare.description, bare.repo_url, bare.tags) == ("only meta", None, [])


@pytest.mark.parametrize(
    "status, body, blocked, marker",
    [
        (403, CHALLENGE, True, "just a moment"), (503, CHALLENGE, True, "just a moment"), (403, "no", True, None),
        (200, CHALLENGE, True, "cf_chl_opt"), (200, "just a moment, captcha", False, None), (503, "busy", False, None),
        (404, "challenge-platform", False, None),
    ],
)
def test_block_detection(spark, status, body, blocked, marker):
    frame = spark.createDataFrame([("u", status, body)], "url string, status int, body string")
    row = pages.block_flags(frame).first()
    assert (row.blocked, row.marker) == (blocked, marker)
    expected = {"reason": "blocked", "url": "u", "status": status, "marker": marker} if blocked else None
    assert (json.loads(row.note) if row.note else None) == expected


def test_redaction(spark):
    body = '<meta name="maps-api-key" content="K1"><meta content="secret" name="description"><meta name="x" content="kept">'
    frame = captured(spark, body)
    clean = pages.redact(F.col("body"))
    row = frame.select(clean.alias("c"), pages.redact(clean).alias("twice"), pages.has_residue(F.col("body")).alias("before"),
                       pages.has_residue(clean).alias("after")).first()
    assert "K1" not in row.c and "secret" not in row.c and "kept" in row.c
    assert row.c == row.twice and row.before and not row.after


def script(*texts):
    return "".join(f"<script>self.__next_f.push([1,{json.dumps(t)}])</script>" for t in texts)


def test_script_project(spark):
    record = {
        "uuid": "u1", "slug": "s", "name": "Né", "tagline": 'a "b"\nc', "description": "$28", "sourceCodeUrl": None,
        "url": "https://github.com/a/b", "event": {"slug": "e", "name": "E", "startTime": "2024-05-06T07:00:00Z"},
        "prizes": [{"name": "Pool", "prize": {"name": "P"}}, {"name": "2nd place", "prize": {"name": "T"}}],
    }
    long = "A description that is long enough to live in a text chunk of its own, " * 2
    page = script("1:I[]", '0:["$",{"project":' + json.dumps(record) + ',"other":{}}]', f"28:T8f,{long}")
    unplaced = record | {"description": "inline", "prizes": [{"name": "Pool", "prize": None}]}
    bare = record | {"description": None, "prizes": []}
    pages_ = captured(spark, page, *[script('0:{"project":' + json.dumps(r) + "}") for r in (unplaced, bare)], "<p>")
    full, pool, none = payloads.script_projects(pages_, "page").orderBy("page").collect()
    assert (full.name, full.tagline, full.repo_url, full.description) == ("Né", 'a "b"\nc', record["url"], long.strip())
    assert (full.placement, full.prize_track, full.raw_placement, str(full.event_date)) == (2, "T", "2nd place", "2024-05-06")
    assert (pool.placement, pool.prize_track, pool.raw_placement, pool.is_winner) == (None, "Pool", "Pool", True)
    assert (none.is_winner, none.prize_track, none.description) == (False, None, None)


def test_very_long_script_text(spark):
    listed = [{"uuid": f"u{i}", "slug": f"s{i}", "name": "n" * 500, "prizes": []} for i in range(400)]
    rows = payloads.listing_entries(captured(spark, script('9:{"projects":' + json.dumps(listed) + "}")), "page")
    assert rows.count() == 400


def test_submissions_from_files(spark):
    folder = work_folder(spark, "archive")
    sub = {"slug": "s", "title": " T ", "eventPosition": "TOP_2", "event": {"slug": "e", "name": "E"},
           "techIn": [{"tech": {"name": "Go", "slug": "go"}}, {"tech": None}, None]}
    bodies = [json.dumps({"submissions": [sub, {"slug": ""}]}), json.dumps([sub | {"slug": "t", "event": None}])]
    for i, body in enumerate(bodies):
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(f"{folder}/{i}")
    documents = payloads.read_documents(spark, f"{folder}/*/*.txt")
    rows = payloads.submissions(documents, "path")
    projects = {r.title + r.hackathon_slug: r for r in payloads.submission_projects(rows, "lablab", "path").collect()}
    assert set(projects) == {"Te", "Tt"} and projects["Te"].placement == 2
    assert payloads.submission_tags(rows, "lablab").count() == 2
    events = payloads.submission_events(payloads.submission_projects(rows, "lablab", "path"), "path", "ord")
    assert {(r.slug, r.name) for r in events.collect()} == {("e", "E"), ("t", "t")}


def test_event_list(spark):
    body = json.dumps(
        {"hackathons": [
            {"title": " A ", "url": "https://aa.devpost.com/", "winners_announced": True, "submission_period_dates": "Mar 3, 2025"},
            {"title": "B", "url": "https://bb.devpost.com/", "winners_announced": False},
            {"title": "C", "url": "https://example.org", "winners_announced": True},
            {"title": "", "url": "http://dd.devpost.com", "winners_announced": True}],
         "meta": {"total_count": 4}}
    )
    rows = payloads.event_list(captured(spark, body), "page").orderBy("slug").collect()
    assert [(r.slug, r.title, str(r.hackathon_date)) for r in rows] == [("aa", "A", "2025-03-03"), ("dd", "dd", "None")]
    assert tuple(payloads.event_list_meta(captured(spark, body, "{}"), "page").orderBy("page").collect()[1])[1:] == (0, 50)


def test_unclosed_tags(spark):
    deep = '<div id="app-details-left">' + "<p>part " * 5000 + "</div>"
    nested = '<div id="app-details-left">' + "<div>" * 5000 + "deep"
    gallery = '<div data-software-id="1"><a href="/software/one"><h5>One</h5><p class="tagline">one<p>two</a></div>'
    found = pages.software_details(captured(spark, deep, nested), "page").orderBy("page").collect()
    assert found[0].description.split() == ["part"] * 5000 and found[1].description == "deep"
    assert pages.gallery_entries(captured(spark, gallery), "page").first().tagline == "one"
