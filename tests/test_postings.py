"""The stored index against the search that reads the texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.stem import porter_stem
from tidemark.operators import postings, search
from tidemark.session import work_folder

WORDS = ["run", "running", "runs", "runner", "connect", "connected", "connection", "the", "of", "sea", "seas", "sky", "cat", "cats"]
SCHEMA = "id long, title string, short_description string, description string"
QUERIES = [
    "running connected", "sea sky cat run", '"sea sky"', '"run the sea" cats', "cat or sky", 'connection -"sea sky"', "running -cats", '"sea of the sky" or runner',
    "the of", "unknown", "unknown sea", "-cat", "",
]


def corpus(spark, seed, n=150):
    rng = random.Random(seed)
    text = lambda most: None if rng.random() < 0.1 else " ".join(rng.choices(WORDS, k=rng.randint(0, most)))
    return spark.createDataFrame([(i, text(4), text(8), text(30)) for i in range(n)], SCHEMA)


@pytest.fixture(scope="module")
def both(spark):
    documents = corpus(spark, 1)
    index = postings.Index(spark, work_folder(spark, "index"), buckets=8)
    index.extend(documents.filter("id < 100"))
    index.extend(documents.filter("id >= 100"))
    return documents, index


@pytest.mark.parametrize("typed", QUERIES)
@pytest.mark.parametrize("stemmed", [False, True])
def test_index_finds_what_the_texts_hold(both, typed, stemmed):
    documents, index = both
    query = search.parse_query(typed)
    forms = None
    if stemmed:
        words = {w for term in query.terms + query.excluded for w in term if w is not None}
        forms = {w: sorted(v for v in WORDS if porter_stem(v) == porter_stem(w)) or [w] for w in words}
    want = search.lexical_topk(documents, query, 200, forms=forms)
    found = postings.lexical_topk(index, query, 200, stemmed)
    shape = lambda frame: [(r.id, round(r.lexical_rank, 6), r["rank"]) for r in frame.orderBy("rank").collect()]
    assert shape(found) == shape(want)


def test_scope_limits_the_documents(both):
    documents, index = both
    query = search.parse_query("sea cat")
    scope = documents.filter("id % 3 = 0")
    want = {r.id: r["rank"] for r in search.lexical_topk(scope, query, 50).collect()}
    assert {r.id: r["rank"] for r in postings.lexical_topk(index, query, 50, False, scope).collect()} == want


def test_a_query_reads_the_buckets_of_its_words(both):
    _, index = both
    plan = postings.matches(index, search.parse_query("sea sky"))._jdf.queryExecution().executedPlan().toString()
    buckets = {index._bucket(porter_stem(w)) for w in ("sea", "sky")}
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan), plan
    files = index.postings(["sea", "sky"], True).select(F.input_file_name().alias("f")).distinct().collect()
    assert {int(r.f.split("bucket=")[1].split("/")[0]) for r in files} <= buckets and plan.count("FileScan") == 1


def test_each_word_is_stemmed_once(both):
    _, index = both
    terms = [r.term for r in index.lexicon().collect()]
    assert sorted(terms) == sorted(set(WORDS) - set(search.STOP_WORDS))


def test_postings_are_made_where_the_text_is_read(spark):
    """One shuffle, of blocks: a row for each word of a part, not for each word of a document."""
    documents = corpus(spark, 2, 60).repartition(1)
    index = postings.Index(spark, work_folder(spark, "index"), buckets=4)
    index.extend(documents)
    blocks = index._stored().collect()
    want = search.postings(documents).groupBy("id", "field", "term").agg(F.sort_array(F.collect_list("pos")).alias("pos")).collect()
    found = index.postings(sorted(set(WORDS)), False).collect()
    assert len(blocks) < len(want) / 2
    assert sorted((r.id, r.field, r.term, r.pos) for r in found) == sorted((r.id, r.field, r.term, r.pos) for r in want)


def test_documents_without_words(spark):
    index = postings.Index(spark, work_folder(spark, "index"))
    index.extend(spark.createDataFrame([(1, None, "the of", "..."), (2, None, None, None)], SCHEMA))
    index.extend(spark.createDataFrame([], SCHEMA))
    assert postings.lexical_topk(index, search.parse_query("sea"), 5).count() == 0 and index.lexicon().count() == 0
