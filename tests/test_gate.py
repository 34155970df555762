import copy
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tidemark.config as config
from tidemark import model
from tidemark.operators import quality
from tidemark.session import small_frame, work_folder
from tidemark.sources.storage import Store
from tidemark.streaming import gate

THRESHOLDS = config.load_thresholds()
BASE = {
    "n": 1000, "fill_description": 0.95, "fill_hackathon_date": 0.9, "fill_repo_url": 0.12, "fill_demo_url": 0.3,
    "fill_prize_track": 0.5, "fill_placement": 0.8, "median_desc_len": 300.0, "url_valid_rate": 1.0,
}
METRIC = (
    "struct<n:bigint,fill_description:double,fill_hackathon_date:double,fill_repo_url:double,fill_demo_url:double,"
    "fill_prize_track:double,fill_placement:double,median_desc_len:double,url_valid_rate:double>"
)
OVERLAP = "struct<overlap:bigint,base_total:bigint,cand_total:bigint>"


def checks(spark, candidate=None, moving=BASE, anchor=BASE, overlap=(2, 10, 10), anchor_overlap=(2, 10, 10)):
    row = (
        1, "a", BASE | (candidate or {}), moving, anchor,
        dict(zip(("overlap", "base_total", "cand_total"), overlap)) if overlap else None,
        dict(zip(("overlap", "base_total", "cand_total"), anchor_overlap)) if anchor_overlap else None,
    )
    schema = (
        f"scrape_run_id long, source string, candidate {METRIC}, moving {METRIC}, anchor {METRIC}, "
        f"moving_overlap {OVERLAP}, anchor_overlap {OVERLAP}"
    )
    return quality.compare_metrics(spark.createDataFrame([row], schema), THRESHOLDS).orderBy("position").collect()


def failed(rows):
    return [r.check_name for r in rows if not r.passed]


def note(rows, name):
    return next(r.note for r in rows if r.check_name == name)


def test_nominal_run_has_seventeen_checks(spark):
    rows = checks(spark)
    assert len(rows) == 17 and failed(rows) == []


@pytest.mark.parametrize(
    "change, expected",
    [
        ({"fill_description": 0.40}, ["moving:null_rate.description", "anchor:null_rate.description"]),
        ({"fill_description": 0.75}, ["moving:null_rate.description"]),
        ({"fill_repo_url": 0.05}, ["moving:null_rate.repo_url"]),
        ({"median_desc_len": 150.0}, ["moving:median_desc_len"]),
        ({"fill_placement": 0.60}, ["moving:placement_fill"]),
        ({"url_valid_rate": 0.80}, ["batch:url_valid"]),
        ({"fill_hackathon_date": 1.0, "median_desc_len": 900.0}, []),
    ],
)
def test_only_drops_fail(spark, change, expected):
    assert failed(checks(spark, change)) == expected


def test_events_are_compared_on_the_overlap(spark):
    rows = checks(spark, overlap=(1, 100, 10), anchor_overlap=None)
    assert failed(rows) == ["moving:projects_per_hackathon"]
    assert note(rows, "anchor:projects_per_hackathon") == "no_overlap"


def test_first_time_and_empty_batches(spark):
    rows = checks(spark, moving=None, anchor=None)
    assert [r.check_name for r in rows] == ["moving:bootstrap", "anchor:bootstrap", "batch:url_valid"]
    assert failed(rows) == []
    empty = checks(spark, {"n": 0})
    assert [(r.check_name, r.passed) for r in empty] == [("batch:nonempty", False)]


def test_zero_baseline_passes(spark):
    rows = checks(spark, moving=BASE | {"fill_repo_url": 0.0})
    assert failed(rows) == [] and note(rows, "moving:null_rate.repo_url") == "baseline_zero_pass"


# --- thresholds ---


@pytest.mark.parametrize(
    "path, value",
    [
        (["anchor"], None), (["moving", "null_rate"], {}), (["moving", "null_rate", "repo_url", "mode"], "odd"),
        (["moving", "null_rate", "repo_url"], {"mode": "relative"}), (["moving", "null_rate", "team"], {"mode": "relative", "max_pct": 5}),
        (["moving", "median_desc_len_max_pct"], 0), (["anchor", "placement_fill_max_delta_points"], "x"),
        (["url_valid_min_rate"], 1.5), (["url_valid_min_rate"], 0),
    ],
)
def test_thresholds_are_checked(path, value):
    source = Path(config.__file__).with_name("thresholds.json")
    data = copy.deepcopy(json.loads(source.read_text()))
    block = data
    for key in path[:-1]:
        block = block[key]
    block[path[-1]] = value
    with pytest.raises(ValueError):
        config.parse_thresholds(data)


def test_missing_key_is_an_error():
    with pytest.raises(ValueError, match="missing"):
        config.parse_thresholds({"moving": {}, "anchor": {}})


# --- store, gate and stream ---

FIELDS = {
    "source": "a", "source_url": "https://x/1", "hackathon_slug": "h", "hackathon_name": "H", "theme_tags": [],
    "description": "d" * 30, "is_winner": True, "placement": 1, "prize_track": "main", "tech_stack": [],
    "stack_source": "none", "repo_url": "https://r/1", "demo_url": "https://d/1", "title": "t",
}


def project_rows(spark, n, first=0, schema=model.PROJECT, **changes):
    rows = []
    for i in range(first, first + n):
        values = FIELDS | {"id": f"{changes.get('source', 'a')}:{i}"} | changes
        rows.append(tuple(values.get(c) for c in schema.names))
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    frame = small_frame(spark, rows, nullable)
    return frame.withColumns(
        {"scraped_at": F.lit("2024-05-01").cast("timestamp"), "hackathon_date": F.lit("2024-05-01").cast("date")}
    )


def stage(store, run_id, rows):
    store.stage(rows.withColumn("scrape_run_id", F.lit(run_id).cast("long")))
    source = rows.first().source
    store.log_states([{"run_id": run_id, "seq": 0, "source": source, "kind": "scrape", "status": "scraped"}])


def states(frame):
    return {r.run_id: r.status for r in frame.collect()}


@pytest.fixture
def store(spark):
    return Store(spark, work_folder(spark, "store"))


def test_gate_promotes_good_runs_and_rejects_broken_ones(spark, store):
    first = project_rows(spark, 20).unionByName(project_rows(spark, 5, source="b"))
    gate.import_run(store, first, 1, ["source_url"])
    assert store.serving().count() == 25
    stage(store, 2, project_rows(spark, 20, first=10))
    stage(store, 3, project_rows(spark, 20, description=None))
    stage(store, 4, project_rows(spark, 8, source="b", title="new"))
    assert states(gate.run_gate(store, THRESHOLDS)) == {1: "promoted", 2: "promoted", 3: "rejected", 4: "promoted"}
    serving = store.serving().cache()
    assert serving.groupBy("source").count().orderBy("source").collect() == [("a", 30), ("b", 8)]
    assert serving.filter("source = 'b' AND title = 'new'").count() == 8
    assert serving.filter("description IS NULL").count() == 0
    report = store.checks().filter("scrape_run_id = 3 AND NOT passed").collect()
    assert {r.check_name for r in report} >= {"moving:null_rate.description", "anchor:null_rate.description"}

    # A second call finds nothing to decide, and nothing changes.
    log_size, n_checks = store.events().count(), store.checks().count()
    gate.run_gate(store, THRESHOLDS)
    assert (store.events().count(), store.checks().count()) == (log_size, n_checks)


def test_validated_run_is_taken_up_again(spark, store):
    gate.import_run(store, project_rows(spark, 20), 1, ["source_url"])
    stage(store, 2, project_rows(spark, 20, first=10))
    assert states(gate.run_gate(store, THRESHOLDS, promote=False))[2] == "validated"
    assert store.serving().count() == 20
    n_checks = store.checks().count()
    assert states(gate.run_gate(store, THRESHOLDS))[2] == "promoted"
    assert store.serving().count() == 30 and store.checks().count() == n_checks


def test_stream_takes_each_file_once(spark, store):
    gate.import_run(store, project_rows(spark, 20), 1, ["source_url"])
    incoming, progress = work_folder(spark, "incoming"), work_folder(spark, "progress")

    def arrive(run_id, rows):
        gate.finish_run(store, run_id, "a", rows.select("id").distinct().count())
        rows.withColumn("scrape_run_id", F.lit(run_id).cast("long")).select(*model.STAGING.names).write.mode(
            "append"
        ).parquet(incoming)
        gate.stream_gate(spark, incoming, store, THRESHOLDS, progress).awaitTermination()

    arrive(2, project_rows(spark, 20, first=10).unionByName(project_rows(spark, 20, first=10)))
    assert store.serving().count() == 30
    log_size = store.events().count()
    gate.stream_gate(spark, incoming, store, THRESHOLDS, progress).awaitTermination()
    assert store.events().count() == log_size
    arrive(3, project_rows(spark, 15, description=None))
    assert states(quality.run_status(store.events())) == {1: "promoted", 2: "promoted", 3: "rejected"}
    assert store.serving().count() == 30


def delivery(run_id, rows):
    return rows.withColumn("scrape_run_id", F.lit(run_id).cast("long")).select(*model.STAGING.names)


def test_a_run_in_two_deliveries_is_whole(spark, store):
    gate.import_run(store, project_rows(spark, 20), 1, ["source_url"])
    gate.finish_run(store, 2, "a", 25)
    gate.deliver(store, delivery(2, project_rows(spark, 20, first=10)), 1)
    assert states(gate.run_gate(store, THRESHOLDS))[2] == "scraped"
    for _ in range(2):  # the second delivery repeats ids of the first, and comes twice
        gate.deliver(store, delivery(2, project_rows(spark, 10, first=25)), 2)
    status = {r.run_id: r for r in gate.run_gate(store, THRESHOLDS).collect()}
    assert (status[2].status, status[2].n_scraped, status[2].n_promoted) == ("promoted", 25, 25)
    assert store.staging().filter("scrape_run_id = 2").count() == 25 and store.serving().count() == 35


def test_late_rows_are_refused_where_one_can_see_them(spark, store):
    gate.import_run(store, project_rows(spark, 20), 1, ["source_url"])
    gate.finish_run(store, 2, "a", 20)
    gate.deliver(store, delivery(2, project_rows(spark, 20, first=10)), 1)
    gate.run_gate(store, THRESHOLDS)
    gate.deliver(store, delivery(2, project_rows(spark, 20, first=10)), 1)  # taken before, so nothing new
    assert store.refused().count() == 0
    gate.deliver(store, delivery(2, project_rows(spark, 3, first=90)), 2)
    assert store.refused().count() == 3 and store.staging().filter("scrape_run_id = 2").count() == 20
    assert store.serving().count() == 30


def test_a_repeated_delivery_under_a_new_number_leaves_the_run_waiting(spark, store):
    """A collector's retry brings the same 20 ids again; the missing 10 still count as missing and are promoted when they come."""
    gate.import_run(store, project_rows(spark, 20), 1, ["source_url"])
    gate.finish_run(store, 2, "a", 30)
    for number in (1, 2):
        gate.deliver(store, delivery(2, project_rows(spark, 20, first=10)), number)
    assert states(gate.run_gate(store, THRESHOLDS))[2] == "scraped"
    gate.deliver(store, delivery(2, project_rows(spark, 10, first=30)), 3)
    status = {r.run_id: r for r in gate.run_gate(store, THRESHOLDS).collect()}
    assert (status[2].status, status[2].n_promoted) == ("promoted", 30)
    assert store.refused().count() == 0 and store.serving().count() == 40


def test_equal_ids_with_other_texts_are_picked_alike(spark):
    rows = delivery(2, project_rows(spark, 5)).unionByName(delivery(2, project_rows(spark, 5, description="other")))
    picked = []
    for frame in (rows, rows.orderBy(F.desc("description")).repartition(3)):
        own = Store(spark, work_folder(spark, "store"))
        gate.deliver(own, frame, 1)
        picked.append({r.id: r.description for r in own.staging().collect()})
    assert picked[0] == picked[1] and len(picked[0]) == 5


def events(spark, run_id, *slugs, source="a", name="E", day="2024-05-01"):
    rows = [(source, slug, name, "https://e/" + slug, run_id) for slug in slugs]
    frame = spark.createDataFrame(rows, "source string, slug string, name string, url string, scrape_run_id long")
    return frame.withColumn("hackathon_date", F.lit(day).cast("date"))


def names(store):
    return {(r.source, r.slug): (r.name, str(r.hackathon_date)) for r in store.hackathons().collect()}


def test_events_are_promoted_with_their_projects(spark, store):
    gate.import_run(store, project_rows(spark, 20), 1, ["source_url"], events(spark, 1, "x", "y").drop("scrape_run_id"))
    assert names(store) == {("a", "x"): ("E", "2024-05-01"), ("a", "y"): ("E", "2024-05-01")}
    stage(store, 2, project_rows(spark, 20, first=10))
    store.stage_events(events(spark, 2, "y", "z", name="new", day=None).unionByName(events(spark, 2, "z", name="later")))
    stage(store, 3, project_rows(spark, 20, description=None))
    store.stage_events(events(spark, 3, "x", "w", name="broken"))
    assert states(gate.run_gate(store, THRESHOLDS)) == {1: "promoted", 2: "promoted", 3: "rejected"}
    found = names(store)
    assert set(found) == {("a", s) for s in "xyz"} and found["a", "x"] == ("E", "2024-05-01")
    assert found["a", "y"] == ("new", "2024-05-01")  # a known date is never lost


@pytest.mark.parametrize("broken", ["events", "publish", "log"])
def test_a_promotion_that_breaks_off_shows_nothing_or_all(spark, store, monkeypatch, broken):
    gate.import_run(store, project_rows(spark, 20), 1, ["source_url"], events(spark, 1, "x").drop("scrape_run_id"))
    stage(store, 2, project_rows(spark, 20, first=10))
    store.stage_events(events(spark, 2, "x", "y", name="new"))

    def fails(*args, **kwargs):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        write, log = Store.write_snapshots, Store.log_states
        if broken == "events":
            patch.setattr(Store, "write_snapshots", lambda self, rows, table, *more: fails() if table == "events" else write(self, rows, table, *more))
        elif broken == "publish":
            patch.setattr(Store, "publish", fails)
        else:
            patch.setattr(Store, "log_states", lambda self, told: fails() if told[0]["status"] == "promoted" else log(self, told))
        with pytest.raises(OSError):
            gate.run_gate(store, THRESHOLDS)
    seen = (store.serving().count(), len(names(store)))
    assert seen == ((30, 2) if broken == "log" else (20, 1))
    assert states(gate.run_gate(store, THRESHOLDS))[2] == "promoted"
    assert (store.serving().count(), names(store)["a", "x"][0], len(names(store))) == (30, "new", 2)


def test_raw_tags_are_replaced_whole_and_added_once(spark, store):
    schema = "project_id string, tech_name string, tech_slug string, source string"
    store.replace_raw_tags(spark.createDataFrame([("p", "A", "a", "s1"), ("q", "B", "b", "s2")], schema))
    store.replace_raw_tags(spark.createDataFrame([("p", "C", "c", "s1")], schema))
    assert [tuple(r) for r in store.raw_tags().collect()] == [("p", "C", "c", "s1")]
    for _ in range(2):
        store.add_raw_tags(spark.createDataFrame([("p", "C", "other", "s1"), ("q", "B", "b2", "s2"), ("q", "B", "b1", "s2")], schema))
    assert sorted(tuple(r) for r in store.raw_tags().collect()) == [("p", "C", "c", "s1"), ("q", "B", "b1", "s2")]
    store.replace_raw_tags(spark.createDataFrame([], schema))
    assert store.raw_tags().count() == 0


def test_partitions_are_written_side_by_side(spark, store):
    from tidemark.sources import storage

    name, seen = "spark.sql.maxConcurrentOutputFileWriters", []
    before = spark.conf.get(name)
    rows = delivery(2, project_rows(spark, 5).unionByName(project_rows(spark, 5, source="b")))
    with storage.side_by_side(spark):
        seen.append(spark.conf.get(name))
    store.stage(rows)
    assert seen == ["16"] and spark.conf.get(name) == before
    files = store.staging().inputFiles()
    assert len(files) >= 2 and all(f.endswith(".zstd.parquet") for f in files) and store.staging().count() == 10
    with pytest.raises(ZeroDivisionError), storage.side_by_side(spark):
        1 / 0
    assert spark.conf.get(name) == before
