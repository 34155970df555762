import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from tidemark.functions.stem import porter_stem
from tidemark.operators import catalog, search
from tidemark.sources import tables

DOCS = [
    (1, "Navigation for blind people", "An app that helps", "Walking in cities with sound", [1.0, 0.0], True),
    (2, "City maps", "Maps of cities", "Cities and more cities, navigation included", [0.9, 0.1], False),
    (3, "Cooking robot", None, "A robot that cooks. Cooking is fun. The robot is blind", [0.0, 1.0], True),
    (4, "Robot arm", "robot", None, None, False),
    (5, "Arm of a robot", "", "a cooking robot with an arm", [0.1, 0.9], False),
]
SCHEMA = "id long, title string, short_description string, description string, embedding array<float>, is_winner boolean"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


def found(docs, typed, **more):
    rows = search.lexical_topk(docs, search.parse_query(typed), 10, **more).orderBy("rank").collect()
    return [r.id for r in rows]


def test_query_text():
    assert search.parse_query('blind "the cooking of robots" or -arm maps').alternatives == [
        [("blind",), ("cooking", None, "robots")],
        [("maps",)],
    ]
    assert search.parse_query('x -"big arm"').excluded == [("big", "arm")]
    assert search.parse_query("the of and").alternatives == []


def test_conjunction_stays_strict_when_it_matches(docs):
    assert found(docs, "cooking robot") == [3, 5]


def test_relaxes_only_when_nothing_matches(docs):
    assert set(found(docs, "helping blind people navigate cities")) == {1, 2, 3}
    assert found(docs, "helping blind people navigate cities")[0] == 1


def test_phrase_alternative_and_exclusion(docs):
    assert found(docs, '"cooking robot"') == [3, 5]
    assert found(docs, '"robot cooking"') == []
    assert set(found(docs, '"arm of robot"')) == set()
    assert found(docs, '"arm of a robot"') == [5]
    assert set(found(docs, "maps or arm")) == {2, 4, 5}
    assert set(found(docs, "robot -cooking")) == {4}
    assert found(docs, "robot -robot") == []
    assert found(docs, "unheardof blind -cities") == []


@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("feed", "feed"), ("plastered", "plaster"),
        ("sing", "sing"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
        ("relational", "relat"), ("navigation", "navig"), ("navigate", "navig"), ("triplicate", "triplic"), ("hopefulness", "hope"),
        ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("controlling", "control"), ("is", "is"),
    ],
)
def test_stems(word, stem):
    assert porter_stem(word) == stem


def test_words_of_the_same_stem_match(docs):
    query = search.parse_query("navigate city")
    forms = search.word_forms(search.lexicon(docs), query)
    assert forms == {"navigate": ["navigate", "navigation"], "city": ["cities", "city"]}
    ranked = search.lexical_topk(docs, query, 10, forms=forms).orderBy("rank").collect()
    assert [r.id for r in ranked] == [2, 1]
    phrase = search.parse_query('"robots that cook"')
    forms = search.word_forms(search.lexicon(docs), phrase)
    for dense in (False, True):
        assert [r.id for r in search.lexical_topk(docs, phrase, 10, dense, forms).collect()] == [3]
    hits = search.hybrid_search(docs, "navigate city", None, terms=search.lexicon(docs)).collect()
    assert [r.id for r in hits] == [2, 1]


@pytest.mark.parametrize("one, many", [("day", "days"), ("key", "keys"), ("way", "ways"), ("toy", "toys"), ("boy", "boys")])
def test_short_stems_find_their_family(spark, one, many):
    words = spark.createDataFrame([(1, f"{one} {many} {one}time", None, None)], "id long, title string, short_description string, description string")
    terms = search.lexicon(words)
    for typed in (one, many):
        assert search.word_forms(terms, search.parse_query(typed)) == {typed: [one, many]}


def test_cover_density_prefers_close_terms(spark):
    rows = [
        (1, "x", None, "alpha one two three four beta", None, False),
        (2, "x", None, "alpha beta", None, False),
        (3, "x", None, "alpha x beta and alpha beta", None, False),
    ]
    close = spark.createDataFrame(rows, SCHEMA)
    ranked = search.lexical_topk(close, search.parse_query("alpha beta"), 10, cover_density=True)
    scores = {r.id: r.lexical_rank for r in ranked.collect()}
    assert scores[2] == pytest.approx(0.2) and scores[1] == pytest.approx(0.2 / 5)
    # spans: alpha x beta; beta and alpha; alpha beta
    assert scores[3] == pytest.approx(0.2 / 2 + 0.2 / 2 + 0.2)


def _covers(words, weights, group):
    """Minimal spans straight from the definition: the shortest end of each start, not containing another."""
    spans = []
    for a, word in enumerate(words):
        if word in group:
            ends = [b for b in range(a, len(words)) if group <= set(words[a : b + 1])][:1]
            spans += [(a, b) for b in ends]
    minimal = [s for s in spans if not any(t[0] > s[0] and t[1] <= s[1] for t in spans)]
    total = 0.0
    for a, b in minimal:
        inside = [weights[i] for i in range(a, b + 1) if words[i] in group]
        total += len(inside) / sum(1 / w for w in inside) / (1 + (b - a) - (len(inside) - 1))
    return total


def test_cover_density_against_brute_force(spark):
    documents = tables.documents(spark, SMALL)
    query = search.parse_query("ndre onti")
    ranked = search.lexical_topk(documents, query, 500, cover_density=True).collect()
    assert ranked
    bodies = {r.id: r for r in documents.collect()}
    for row in ranked:
        words, weights = [], []
        for name, weight in search.FIELD_WEIGHTS.items():
            part = re.findall(r"[^\W_]+", (bodies[row.id][name] or "").lower())
            words += part
            weights += [weight] * len(part)
        assert row.lexical_rank == pytest.approx(_covers(words, weights, {"ndre", "onti"})), row.id


def test_hybrid_search_with_and_without_vector(docs):
    both = search.hybrid_search(docs, "cooking robot", [1.0, 0.0]).collect()
    assert {r.id for r in both} == {1, 2, 3, 5}
    assert both[0].id == 3 and both[0].score == pytest.approx(1 / 61 + 1 / 64)
    lexical = search.hybrid_search(docs, "cooking robot", None).collect()
    assert [r.id for r in lexical] == [3, 5] and lexical[0].score == pytest.approx(1 / 61)


def test_filters_apply_before_relaxing(docs):
    # Among winners "city maps" matches nothing strictly, so any of the words is enough there.
    rows = search.hybrid_search(docs, "cities maps", None, F.col("is_winner")).collect()
    assert [r.id for r in rows] == [1]


def test_similar_items_without_vector_or_item(docs):
    assert [r.id for r in search.similar_items(docs, 1, 2).collect()] == [2, 5]
    assert search.similar_items(docs, 4).collect() == []
    assert search.similar_items(docs, 99).collect() == []


def test_approximate_neighbours_find_most_exact_ones(spark):
    documents = tables.documents(spark, SMALL).select("id", "embedding").cache()
    items = [r.id for r in documents.filter("embedding IS NOT NULL").orderBy(F.xxhash64("id")).limit(20).collect()]
    recalls = [search.approx_recall(documents, item, 20).first() for item in items]
    assert all(r.k == 20 for r in recalls) and sum(r.recall for r in recalls) / len(recalls) >= 0.9


def test_order_and_partitions_do_not_matter(spark):
    documents = tables.documents(spark, SMALL).drop("lang", "source")
    shuffled = documents.repartition(5).orderBy(F.desc("id"))
    a = search.hybrid_search(documents, "thatin orre", search.vector_of(documents, 7)).collect()
    b = search.hybrid_search(shuffled, "thatin orre", search.vector_of(shuffled, 7)).collect()
    assert a == b


@pytest.mark.parametrize(
    "asked, kept", [(None, None), (["a", "nowhere"], ["a"]), (["nowhere"], []), ([], [])]
)
def test_known_sources(asked, kept):
    assert catalog.known_sources(asked, ["a", "b"]) == kept


def test_search_filter(spark):
    rows = [("a", True, date(2024, 1, 1)), ("a", False, None), ("b", True, date(2025, 1, 1))]
    frame = spark.createDataFrame(rows, "source string, is_winner boolean, hackathon_date date")

    def n(**conditions):
        return frame.filter(catalog.search_filter(**conditions)).count()

    assert n() == 3 and n(winners_only=True) == 2 and n(sources=["a"]) == 2 and n(sources=[]) == 0
    assert n(since=date(2024, 6, 1)) == 1 and n(until=date(2024, 6, 1)) == 1
    assert n(sources=["a"], winners_only=True, since=date(2024, 1, 1), until=date(2024, 1, 1)) == 1


def test_limits_of_the_queues(docs):
    # Encoding honours a limit of 0; extraction takes it for "no limit".
    assert catalog.work_queue(docs, 0).count() == 0 and catalog.work_queue(docs).count() == 1
    projects = docs.withColumn("source", F.lit("a"))
    assert catalog.extraction_batch(projects, limit=0).count() == 5
    assert [r.id for r in catalog.extraction_batch(projects, limit=2).collect()] == [1, 2]


def test_hits_are_selected_before_documents_are_joined(spark):
    """Of documents that are joined with other tables only the rows found are shuffled with their text."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        documents = tables.documents(spark, SMALL)
        found = search.hybrid_search(documents, "thatin orre", None, limit=5)
        ids = sorted(r.id for r in found.collect())
        optimized = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(ids) == 5
    reads = [line for line in optimized.splitlines() if "Filter" in line and " IN (" in line]
    assert reads and all("doc_id#" in line or "vec_id#" in line or "label_doc#" in line for line in reads), optimized
