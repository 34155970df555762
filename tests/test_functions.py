from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import manifests, stats, tags, text, vectors

VOCABULARY = tags.build_vocabulary(
    {
        "canonical": {"languages": ["Python", "Go", "C++", "Rust"], "web": ["Next.js", "React Native"]},
        "aliases": {"py": "Python", "golang": "Go", "cpp": "C++", "next": "Next.js"},
        "themes": [{"slug": s, "label": s.title(), "description": s} for s in ("health", "music", "energy", "games")],
    },
    theme_bounds=(1, 50),
)


def test_project_id_is_stable_and_depends_on_the_source(one):
    first = one(text.project_id, "a", "slug")
    assert first == one(text.project_id, "a", "slug") != one(text.project_id, "b", "slug")
    assert len(first) == 64


@pytest.mark.parametrize(
    "label, place",
    [
        ("2nd place", 2), ("Best Use of X — 3rd place", 3), ("1ST  Place", 1), ("Pool Prize — Pool Prize", None),
        (None, None), ("", None), ("99999999999th place", None),
    ],
)
def test_parse_place(one, label, place):
    assert one(text.parse_place, label) == place


@pytest.mark.parametrize(
    "position, outcome",
    [
        ("WINNERS", (1, True)), ("TOP_2", (2, True)), ("TOP_3", (3, True)), ("FINALISTS", (None, False)),
        ("OTHER", (None, False)), ("new", (None, False)), (None, (None, False)),
    ],
)
def test_positions(one, position, outcome):
    assert tuple(one(text.position_outcome, position)) == outcome


@pytest.mark.parametrize(
    "raw, cleaned", [("  hi  ", "hi"), ("", None), ("   ", None), (None, None), (" a b \n", "a b")]
)
def test_clean(one, raw, cleaned):
    assert one(text.clean, raw) == cleaned


@pytest.mark.parametrize(
    "spelled, day",
    [
        ("Apr 05 - 06, 2024", date(2024, 4, 6)), ("Jun 16 - Jul 16, 2026", date(2026, 7, 16)),
        ("Mar 3, 2025", date(2025, 3, 3)), ("September 2nd, 2023", date(2023, 9, 2)), ("TBD", None), (None, None),
        ("Feb 30, 2024", None),
    ],
)
def test_date_ranges(one, spelled, day):
    assert one(text.parse_date_range, spelled) == day


@pytest.mark.parametrize(
    "spelled, day",
    [
        ("2026-06-12T00:00:00.000Z", date(2026, 6, 12)), ("2024-11-15", date(2024, 11, 15)), (None, None),
        ("not-a-date", None), ("2024-13-01", None),
    ],
)
def test_iso_dates(one, spelled, day):
    assert one(text.parse_iso_date, spelled) == day


@pytest.mark.parametrize(
    "long, short, n, expected",
    [
        (None, None, 10, (None, False)), ("  ", "", 10, (None, False)), ("short one", None, 20, ("short one", False)),
        ("the long text", "short", 20, ("the long text", False)), (None, "fallback", 20, ("fallback", False)),
        ("one two three four", None, 11, ("one two…", True)), ("abcdefghijklmnop", None, 5, ("abcde…", True)),
        ("ab cdefghijkl", None, 10, ("ab cdefghi…", True)), ("héé wörld ünd mehr", None, 10, ("héé wörld…", True)),
    ],
)
def test_excerpt(spark, long, short, n, expected):
    frame = spark.createDataFrame([(long, short)], "a string, b string")
    assert tuple(frame.select(text.excerpt(F.col("a"), F.col("b"), n).alias("e")).first().e) == expected


@pytest.mark.parametrize(
    "url, valid, shaped",
    [
        ("https://a.b/c", True, True), ("HTTP://a", True, True), ("https:///x", False, True), ("https://", False, False),
        ("ftp://a.b", False, False), ("a.b", False, False), (None, False, None),
    ],
)
def test_urls(one, url, valid, shaped):
    assert one(text.valid_url, url) is valid
    assert one(text.url_shaped, url) is shaped


@pytest.mark.parametrize(
    "url, parts",
    [
        ("https://github.com/ann/tool.git", ("ann", "tool")), (" https://github.com/ann/tool/tree/main?x=1 ", ("ann", "tool")),
        ("https://GitHub.com/ann/tool#readme", ("ann", "tool")), ("https://gitlab.com/ann/tool", None),
        ("https://github.com/ann", None), ("no url", None), (None, None),
    ],
)
def test_repository_urls(one, url, parts):
    found = one(text.parse_repo_url, url)
    assert (tuple(found) if found else None) == parts


def test_embed_text_skips_empty_parts(one):
    assert one(text.embed_text, "t", "", "d") == "t\n\nd"
    assert one(text.embed_text, None, None, None) == ""


# --- tags ---


@pytest.mark.parametrize("raw, tag", [("py", "Python"), (" PYTHON ", "Python"), ("cobol", None), ("", None), ("CPP", "C++")])
def test_normalize_tag(one, raw, tag):
    assert one(lambda c: tags.normalize_tag(c, VOCABULARY), raw) == tag


def test_clean_tags_keeps_first_seen_order(one):
    assert one(lambda c: tags.clean_tags(c, VOCABULARY), ["go", "cobol", "py", "Golang", "Python"]) == ["Go", "Python"]


def test_themes_are_capped_and_deduplicated(one):
    given = ["Music", "nope", "music", "health", "energy", "games"]
    assert one(lambda c: tags.clean_themes(c, VOCABULARY), given) == ["music", "health", "energy"]


@pytest.mark.parametrize(
    "claimed, body, kept",
    [
        (["Python", "Go"], "nothing here", []), (["Python"], "written in PY.", ["Python"]),
        (["Go", "Python", "C++", "Rust", "Next.js", "React Native"], "we use next.js, c++ and React native!", ["C++", "Next.js", "React Native"]),
        (["Go", "Rust"], "google is trustworthy", []), (["C++"], "abc++", []), (["Go"], "Go", ["Go"]), (["Go"], "(go)é", ["Go"]),
    ],
)
def test_grounding(spark, claimed, body, kept):
    frame = spark.createDataFrame([(claimed, body)], "tags array<string>, body string")
    found = tags.mentioned_tags(F.col("body"), VOCABULARY)
    assert frame.select(tags.ground_tags(F.col("tags"), found).alias("v")).first().v == kept


@pytest.mark.parametrize(
    "content, tech, themes",
    [
        ('{"tech_stack": ["py", "cobol"], "theme_tags": ["music", "x", "health", "energy", "games"]}', ["Python"], ["music", "health", "energy"]),
        ("not json", [], []), ('{"tech_stack": "py", "theme_tags": ["music"]}', [], ["music"]), ("{}", [], []),
        ('{"tech_stack": null, "theme_tags": null}', [], []),
    ],
)
def test_model_answers(one, content, tech, themes):
    found = one(lambda c: tags.parse_tag_json(c, VOCABULARY), content)
    assert (found.tech_stack, found.theme_tags) == (tech, themes)


@pytest.mark.parametrize(
    "change, message",
    [
        ({"canonical": {"a": ["X", "X"]}}, "twice"), ({"aliases": {"z": "Zig"}}, "unknown"),
        ({"themes": [{"slug": "s", "label": "", "description": ""}] * 2}, "twice"), ({"themes": []}, "expected"),
    ],
)
def test_vocabulary_is_checked(change, message):
    data = {"canonical": {"a": ["X"]}, "themes": [{"slug": "s", "label": "", "description": ""}]} | change
    with pytest.raises(ValueError, match=message):
        tags.build_vocabulary(data, theme_bounds=(1, 50))


# --- manifests ---


@pytest.mark.parametrize(
    "name, body, expected",
    [
        ("package.json", '{"dependencies": {"react": "1"}, "devDependencies": {"vite": "2"}}', ["react", "vite"]),
        ("package.json", "broken", []),
        ("requirements.txt", "# c\n-r x\nflask>=1\n\n  numpy \ngit+https://x\nhttps://y\n", ["flask", "numpy"]),
        ("pyproject.toml", '[project]\ndependencies = ["httpx>=0.1", "rich"]\n[tool.poetry.dependencies]\npython = "3"\nclick = "*"', ["httpx", "rich", "click"]),
        ("pyproject.toml", "= broken", []),
        ("go.mod", "module m\nrequire (\n\tgithub.com/x/gin v1.9\n\tgolang.org/x/net v0.1 // indirect\n)", ["gin", "net"]),
        ("Cargo.toml", '[dependencies]\nserde = "1"\ntokio = {version = "1"}', ["serde", "tokio"]),
        ("Makefile", "all:", []),
    ],
)
def test_manifests(spark, name, body, expected):
    frame = spark.createDataFrame([(name, body)], "name string, body string")
    found = frame.select(manifests.dependency_names(F.col("name"), F.col("body")).alias("v")).first().v
    assert found == expected


def test_content_with_broken_bytes_is_readable(one):
    assert one(manifests.decode_content, "aGk/\n/w==") == "hi?�"


# --- vectors ---


@pytest.mark.parametrize(
    "payload, expected",
    [
        ("[3, 4]", [0.6, 0.8]), ("[[3.0, 4e0]]", [0.6, 0.8]), ("[1, 0]", [1.0, 0.0]), ("[[1,0],[0,1]]", None),
        ("[1, 2, 3]", None), ("[0, 0]", None), ("oops", None), ("[true, 1]", None), ('["1", 2]', None), ("[]", None),
    ],
)
def test_encoder_payloads(one, payload, expected):
    found = one(lambda c: vectors.parse_vector(c, 2), payload)
    assert (found is None) == (expected is None)
    if expected:
        assert found == pytest.approx(expected)


def test_cosine_distance(spark):
    rows = [([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "a array<float>, b array<float>")
    found = [r.d for r in frame.select(vectors.cosine_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert found[:3] == pytest.approx([1.0, 0.0, 2.0]) and found[3] is None


# --- z-test ---


def _ztest(spark, k1, n1, k2, n2, alpha=0.05):
    frame = spark.createDataFrame([(k1, n1, k2, n2)], "k1 long, n1 long, k2 long, n2 long")
    z = frame.select(stats.two_proportion_z(*map(F.col, frame.columns)).alias("z"))
    return z.select("z", stats.two_sided_p("z").alias("p"), stats.is_significant(F.col("z"), alpha).alias("s")).first()


@pytest.mark.parametrize("counts", [(5, 10, 0, 0), (0, 10, 0, 10), (10, 10, 10, 10)])
def test_degenerate_ztest(spark, counts):
    assert tuple(_ztest(spark, *counts)) == (None, None, None)


def test_ztest(spark):
    equal, apart, mirrored = (_ztest(spark, *c) for c in ((50, 100, 50, 100), (80, 100, 20, 100), (20, 100, 80, 100)))
    assert equal.z == pytest.approx(0) and equal.p == pytest.approx(1) and equal.s is False
    assert apart.s is True and apart.p < 1e-9
    assert mirrored.z == pytest.approx(-apart.z) and mirrored.p == pytest.approx(apart.p)
    border = (60, 100, 46, 100)
    assert 0.01 < _ztest(spark, *border).p < 0.05
    assert _ztest(spark, *border).s is True and _ztest(spark, *border, alpha=0.01).s is False
