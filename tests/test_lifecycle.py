import pytest
from pyspark.sql import functions as F

from tidemark import model
from tidemark.operators import enrich, export, lifecycle, normalize, trends
from tidemark.session import work_folder
from test_gate import project_rows


@pytest.fixture(scope="module")
def target(spark):
    rows = project_rows(spark, 4, short_description="s")
    return rows.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>"))


def upserted(target, batch):
    return {r.id: r for r in lifecycle.promote_upsert(target, batch).collect()}


@pytest.mark.parametrize("column", model.EMBEDDED_TEXT)
def test_changed_text_drops_the_vector(spark, target, column):
    after = upserted(target, project_rows(spark, 2, **({"short_description": "s"} | {column: "changed"})))
    assert [after[f"a:{i}"].embedding is None for i in range(4)] == [True, True, False, False]
    assert after["a:0"][column] == "changed" and after["a:3"].change == "kept"


def test_unchanged_text_keeps_the_vector_and_inserts_have_none(spark, target):
    batch = project_rows(spark, 3, first=2, short_description="s", placement=None)
    result = lifecycle.promote_upsert(target, batch)
    after = {r.id: r for r in result.collect()}
    assert after["a:2"].embedding == [1.0, 2.0] and after["a:2"].placement is None
    assert after["a:4"].embedding is None and after["a:4"].change == "inserted"
    assert tuple(lifecycle.promote_summary(result).first()) == (3, 1)


def test_upsert_twice_is_upsert_once(spark, target):
    batch = project_rows(spark, 3, first=2, title="x")
    once = lifecycle.promote_upsert(target, batch).drop("change")
    twice = lifecycle.promote_upsert(once, batch).drop("change")
    assert sorted(once.collect()) == sorted(twice.select(*once.columns).collect())


def test_stale_text_is_not_written_back(spark, target):
    empty = target.withColumn("embedding", F.lit(None).cast("array<float>"))
    encoded = target.withColumn("title", F.when(F.col("id") == "a:1", "old").otherwise(F.col("title")))
    rows = {r.id: r for r in lifecycle.embed_writeback(empty, encoded.filter("id <> 'a:3'")).collect()}
    assert [rows[f"a:{i}"].written for i in range(4)] == [True, False, True, False]
    assert rows["a:1"].embedding is None and rows["a:0"].embedding == [1.0, 2.0]


def test_null_texts_compare_as_equal(spark, target):
    bare = target.withColumn("short_description", F.lit(None).cast("string"))
    assert all(r.written for r in lifecycle.embed_writeback(bare, bare).collect())


def test_first_wins(spark):
    rows = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("y", 3, "c")], "id string, seq int, v string")
    assert sorted(lifecycle.first_wins(rows, ["id"], ["seq"]).collect()) == [("x", 1, "a"), ("y", 3, "c")]
    assert tuple(lifecycle.collisions(rows, ["id"]).first()) == (3, 2, 1)


def test_first_wins_with_a_hot_key(spark):
    rows = spark.range(30000).select(
        F.when(F.col("id") < 20000, F.lit(-1)).otherwise(F.col("id")).alias("key"), F.col("id").alias("seq")
    )
    kept = lifecycle.first_wins(rows.repartition(6), ["key"], ["seq"])
    assert kept.count() == 10001 and kept.filter("key = -1").first().seq == 0


def test_replace_rows(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(lifecycle.replace_rows(current, batch, ["k"]).collect()) == [(1, "a"), (2, "B"), (3, "C")]


def test_known_event_dates_survive(spark):
    schema = "source string, slug string, name string, hackathon_date string, url string, scraped_at string"
    known = spark.createDataFrame([("a", "h", "Old", "2024-01-01", "u1", "t0"), ("a", "i", "I", None, "u", "t0")], schema)
    batch = spark.createDataFrame([("a", "h", "New", None, "u2", "t"), ("b", "h", "B", None, "u3", "t")], schema)
    after = sorted(lifecycle.hackathon_upsert(known, batch, F.lit("now")).collect())
    assert [tuple(r) for r in after] == [
        ("a", "h", "New", "2024-01-01", "u1", "now"), ("a", "i", "I", None, "u", "t0"), ("b", "h", "B", None, "u3", "now"),
    ]


def test_merge_prefers_repository_tags_unless_empty(spark):
    repo = spark.createDataFrame([("1", ["Go"]), ("2", []), ("3", [])], "project_id string, tech_stack array<string>")
    model_ = spark.createDataFrame(
        [("1", ["Py"], ["t"]), ("2", ["Py"], []), ("4", [], ["u"])],
        "project_id string, tech_stack array<string>, theme_tags array<string>",
    )
    merged = {r.project_id: r for r in enrich.merge_passes(repo, model_).collect()}
    assert [(merged[i].tech_stack, merged[i].stack_source, merged[i].theme_tags) for i in "1234"] == [
        (["Go"], "github", ["t"]), (["Py"], "llm", []), ([], "none", []), ([], "none", ["u"]),
    ]
    projects = spark.createDataFrame(
        [(i, ["old"], "llm", ["old"]) for i in "135"],
        "id string, tech_stack array<string>, stack_source string, theme_tags array<string>",
    )
    after = {r.id: r for r in enrich.apply_merge(projects, enrich.merge_passes(repo, model_)).collect()}
    # A staged row decides even when it is empty, but themes need the model pass.
    assert (after["3"].tech_stack, after["3"].stack_source, after["3"].theme_tags) == ([], "none", ["old"])
    assert after["5"].tech_stack == ["old"] and after["1"].theme_tags == ["t"]


def test_best_prize(spark):
    rows = [
        (1, "Pool", "P", 0), (1, "2nd place", "B", 1), (1, "1st Place", "A", 2), (1, "1st place", "later", 3),
        (2, "Pool", " Q ", 0), (2, "Other", "R", 1), (3, "1st place", None, 1), (3, "Pool", "first", 0),
    ]
    prizes = spark.createDataFrame(rows, "project_id int, item_name string, prize_name string, ord int")
    best = {r.project_id: r for r in normalize.best_prizes(prizes).collect()}
    assert (best[1].placement, best[1].prize_track, best[1].place_label) == (1, "A", "1st Place")
    assert (best[2].placement, best[2].prize_track, best[2].place_label) == (None, "Q", None)
    assert (best[3].placement, best[3].prize_track) == (1, "first")


# --- export ---


def test_text_is_never_exported(spark, target):
    with pytest.raises(ValueError, match="description"):
        export.check_columns(["id", "description"])
    exported = export.export_projects(target)
    assert exported.columns == model.EXPORT_PROJECT.names
    assert not model.EXPORT_FORBIDDEN & set(exported.columns)
    with pytest.raises(ValueError, match="declared"):
        export.to_declared(exported.drop("title"), model.EXPORT_PROJECT)


def test_limited_export_is_consistent(spark, target):
    partly = target.withColumn("embedding", F.when(F.col("id") != "a:0", F.col("embedding")))
    folder = work_folder(spark, "export")
    card = export.write_dataset(partly, _events(spark), folder, "v1", limit=2)
    ids = {r.id for r in spark.read.parquet(f"{folder}/projects").collect()}
    vectors = {r.id for r in spark.read.parquet(f"{folder}/embeddings").collect()}
    assert ids == {"a:0", "a:1"} and vectors == {"a:1"}
    assert "2 projects of 1 events" in card and "1 (50 %)" in card


def _events(spark):
    row = [("a", "h", "H", None, "u")]
    return spark.createDataFrame(row, "source string, slug string, name string, hackathon_date date, url string")


# --- trends ---


def test_no_dates_and_no_sizes_are_reported(spark):
    bare = project_rows(spark, 3).withColumn("hackathon_date", F.lit(None).cast("date"))
    assert trends.date_coverage(bare).first().status == trends.AWAITING_DATES
    assert trends.saturation(bare).collect() == []
    assert trends.team_size_correlation(bare).first().status == trends.UNAVAILABLE


def test_earliest_of_equal_peaks(spark):
    rows = [("2024Q1", 2, 1), ("2024Q2", 5, 1), ("2024Q3", 5, 1)]
    seasons = spark.createDataFrame(rows, "quarter string, n long, winners long")
    assert tuple(trends.lifecycle(seasons).first()) == ("2024Q1", "2024Q2", "2024Q3")


def test_winners_only_view_has_no_contrast(spark):
    rows = project_rows(spark, 6, tech_stack=["Go"])
    tested = trends.stack_ztest(trends.stack_lift(trends.stack_contrast(rows, winners_only=True))).first()
    assert tested.lift == pytest.approx(1.0) and tested.z is None and tested.significant is None
    assert trends.theme_detail(rows, "none").first().win_rate is None


def test_only_rows_whose_key_repeats_travel_whole(spark):
    rows = spark.createDataFrame(
        [(1, "a", 3), (1, "b", 2), (2, "c", 1), (None, "d", 2), (None, "e", 1), (3, None, None)], "id int, v string, o int"
    )
    found = lifecycle.first_of_few(rows, ["id"], ["o"])
    want = lifecycle.first_wins(rows, ["id"], ["o"])
    assert found.columns == want.columns
    assert sorted(found.collect(), key=str) == sorted(want.collect(), key=str)
    single = lifecycle.first_of_few(rows.filter("id > 1"), ["id"], ["o"])
    assert sorted(r.v or "" for r in single.collect()) == ["", "c"]
    plan = single._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and plan.count("Aggregate") == 1  # that of the repeated rows


def test_import_and_staging_share_one_stored_table(spark):
    from conftest import SMALL
    from tidemark.sources import tables

    kept = tables.stored_projects(spark, SMALL)
    assert kept is tables.stored_projects(spark, SMALL)
    for stored, view in ((tables.staged(kept), tables.staging(spark, SMALL)), (tables.imported(kept, spark, SMALL), tables.serving(spark, SMALL))):
        assert stored.columns == view.columns
        assert "lineitem" not in stored._jdf.queryExecution().optimizedPlan().toString()
        assert stored.select("id", "title", "description").exceptAll(view.select("id", "title", "description")).isEmpty()
        assert stored.count() == view.count()


@pytest.fixture(scope="module")
def stored_sides(spark):
    """A target of 70,000 rows in one file and more in others, and a batch that has every third of them and 10,000 new ones."""
    from tidemark.session import durable

    def rows(ids):
        number = F.col("id")
        frame = project_rows(spark, 1, short_description="s").drop("id").crossJoin(ids)
        return frame.withColumn("title", F.concat(F.lit("t"), number.cast("string"))).withColumn("id", F.concat(F.lit("a:"), number.cast("string")))

    vector = F.when(F.col("placement") == 2, F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>"))
    numbers = [spark.range(0, 70000, 1, 1), spark.range(70000, 80000, 1, 3)]
    target = numbers[0].unionByName(numbers[1])
    some = F.substring("title", 2, 9).cast("long")
    target = rows(target).withColumn("placement", F.when(some % 5 == 0, 2).otherwise(1)).withColumn("embedding", vector)
    batch = rows(spark.range(0, 270000, 3, 2)).withColumn("description", F.when(some % 2 == 0, "new").otherwise(F.col("description")))
    return durable(target, "target"), durable(batch, "batch")


def test_upsert_of_stored_tables_equals_the_join(spark, stored_sides):
    target, batch = stored_sides
    want, found = lifecycle.promote_upsert(target, batch), lifecycle.promote_upsert(target, batch, stored=True)
    assert found.columns == want.columns and found.count() == want.count()
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()
    told = {r.change: (r.n, r.v) for r in found.groupBy("change").agg(F.count("*").alias("n"), F.count("embedding").alias("v")).collect()}
    assert told["kept"][0] + told["updated"][0] == 80000 and told["inserted"] == (63333, 0)
    assert 0 < told["updated"][1] < told["updated"][0] / 5  # of every fifth row with a vector half keep their text


def test_upsert_of_stored_tables_moves_no_row(spark, stored_sides):
    plan = lifecycle.promote_upsert(*stored_sides, stored=True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("empty", ["target", "batch"])
def test_upsert_of_stored_tables_with_an_empty_side(spark, stored_sides, empty):
    from tidemark.session import durable

    target, batch = [durable(side.where("id < 'a:2'").limit(0 if name == empty else 50), name) for name, side in zip(("target", "batch"), stored_sides)]
    want, found = lifecycle.promote_upsert(target, batch), lifecycle.promote_upsert(target, batch, stored=True)
    assert found.count() == 50 and found.exceptAll(want).isEmpty()


def test_only_digests_of_keys_travel(spark, monkeypatch):
    kept, write = [], lifecycle.durable
    monkeypatch.setattr(lifecycle, "durable", lambda frame, *more: kept.append(frame) or write(frame, *more))
    rows = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (2, "b", 1), (None, "c", 1), (None, "c", 1)], "k int, v string, o int")
    lifecycle.first_of_few(rows, ["k", "v"], ["o"])
    assert kept[0].columns == ["_digest_of_keys"] and kept[0].count() == 2
    assert sorted(lifecycle.distinct_of_few(rows).collect(), key=str) == sorted(rows.distinct().collect(), key=str)
    again = lifecycle.known_keys(rows, rows.where("o = 1 AND v < 'c'").unionByName(rows.limit(0)), ["k", "v"])
    assert sorted(map(tuple, again.collect())) == [(1, "a"), (2, "b")]


def test_equal_digests_of_other_keys_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(lifecycle, "_digest", lambda keys: F.length(F.col(keys[-1])))
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5), ("cc", 3)], "id string, o int")
    assert sorted(map(tuple, lifecycle.first_of_few(rows, ["id"], ["o"]).collect())) == [("a", 1), ("b", 5), ("cc", 3)]
    assert lifecycle.distinct_of_few(rows.select("id")).count() == 3
    assert [r.id for r in lifecycle.known_keys(rows.where("id <> 'b'"), rows.where("id <> 'a'"), ["id"]).collect()] == ["cc"]


def test_tags_of_orders_from_one_set_of_parts(spark):
    from tidemark.sources import tables

    folder = work_folder(spark, "orders")
    lines = [(1, 1, 1, "A", 0.0), (1, 1, 2, "R", 0.05), (1, 2, 3, "R", 0.01), (1, 3, 4, None, 0.1), (2, 3, None, "N", None), (3, 9, 1, "A", 0.1)]
    parts = [(1, "B1", "BIG", "x"), (2, "B1", None, "y"), (3, None, "Small", "x")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_discount double").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_name string").write.parquet(f"{folder}/part.parquet")
    tags = tables.order_tags(spark, folder)
    assert {r.tag_orderkey: tuple(r)[1:] for r in tags.collect()} == {
        1: (["B1"], ["big", "small"], ["x", "y"], ["B1"], ["B1"], True, 4),
        2: ([], ["small"], ["x"], [], [], False, None),
    }
    assert tags._jdf.queryExecution().optimizedPlan().toString().count("collect_set") == 1
