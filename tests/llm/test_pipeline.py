import pytest

import __spark_entry__ as entry
import check_results
import corpus_pipeline
from conftest import SMALL
from tidemark.llm import decontaminate, queries, simhash, toxicity


@pytest.fixture(scope="module")
def steps(spark):
    docs, found = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        found.append((docs, stage(spark, docs, SMALL)))
        docs = spark.createDataFrame(found[-1][1].collect(), found[-1][1].schema)
    return found


def test_columns(steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns


def test_toxic_documents_go(spark, steps):
    before, after = steps[0]
    scored = toxicity.score(before, toxicity.train(before, spark.read.parquet(f"{SMALL}/labels.parquet"))).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in scored if not r.predicted)


def test_lines_go_but_no_rows(steps):
    before, after = steps[1]
    texts = {r.doc_id: r.text for r in before.collect()}
    found = after.collect()
    assert len(found) == len(texts)
    seen = set()
    for r in found:
        mine = [x for x in r.text.split("\n") if x.strip()]
        assert set(mine) <= set(texts[r.doc_id].split("\n"))
        assert seen.isdisjoint(mine)
        seen.update(mine)


def test_one_of_each_group_stays(steps):
    before, after = steps[2]
    classes = simhash.near_duplicates(before).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted({r.component_id for r in classes})


def test_contaminated_documents_go(spark, steps):
    before, after = steps[3]
    index = decontaminate.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if not index.matches(r.text))


def test_mix(steps):
    before, after = steps[4]
    rows = after.collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in before.collect()} and all(0 < r.taken <= 3 * r["size"] for r in rows)


def test_whole_run_is_the_stages(spark, steps):
    assert sorted(corpus_pipeline.run(spark, SMALL).collect()) == sorted(steps[-1][1].collect())


def test_registered():
    assert "pipeline" in entry.queries() and set(queries.ORACLE_SQL) <= set(queries.queries())
    assert sorted(int(name[2:].split("_")[0]) for name in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert check_results.compare(spark, check_results.connect(SMALL), SMALL, name) is None


EXTRA = ("_id", "_row", "_gone", "root", "fp", "key", "least", "size", "score", "line", "pos", "h", "item_id", "y")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder whose documents have nulls in all columns, empty and very long texts, repeated rows and columns with the names used inside."""
    long = "\n".join(f"word{i} some more of line {i}" for i in range(3000))
    texts = [(1, "good words here\nand a line"), (1, "good words here\nand a line"), (2, None), (None, "no id at all"), (None, None), (3, ""), (4, long), (5, " \n "), (6, "ok then")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    rows = [(i, t, None if k % 2 else "en", None if k % 3 else "s", k or None, *(f"{c}{k}" for c in EXTRA)) for k, (i, t) in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0), (6, 1), (3, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(60))), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_bear_odd_rows(spark, odd, name, stage):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    found = stage(spark, docs, odd)
    rows = found.collect()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert found.columns == docs.columns
        kept = {r._row: r for r in docs.collect()}
        assert all(r[c] == kept[r._row][c] for r in rows for c in docs.columns if c != "text")  # rows are what they were
    if name in ("line dedup", "benchmark decontamination"):
        assert len(rows) == docs.count()
    if name == "line dedup":
        assert [r.text for r in rows if r.doc_id == 2] == [None] and {r.text for r in rows if r.doc_id == 3} == {""}
    assert stage(spark, docs.where("false"), odd).collect() == []
