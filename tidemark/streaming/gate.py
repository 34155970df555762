"""Gate and promote staged runs, as a batch or as a stream of newly staged files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import model
from tidemark.config import Thresholds
from tidemark.operators import lifecycle, quality
from tidemark.sources.storage import Store


def import_run(store: Store, rows: DataFrame, run_id: int, order: list[str], events: DataFrame | None = None, now: Column | None = None) -> None:
    """First load: stage and promote all sources at once, without a baseline to compare with."""
    unique = lifecycle.first_of_few(rows, ["id"], order)
    store.stage(unique.withColumn("scrape_run_id", F.lit(run_id).cast("long")))
    if events is not None:
        store.stage_events(events.withColumn("scrape_run_id", F.lit(run_id).cast("long")))
    store.log_states([{"run_id": run_id, "seq": 0, "kind": "import", "status": "validated"}])
    staged = store.staging().filter(F.col("scrape_run_id") == run_id)
    sources = [row.source for row in staged.select("source").distinct().collect()]
    promote_runs(store, {source: {"run_id": run_id, "kind": "import", "seq": 1} for source in sources}, now)
    total = staged.count()
    store.log_states(
        [{"run_id": run_id, "seq": 2, "kind": "import", "status": "promoted", "n_scraped": total, "n_promoted": total}]
    )


def promote_runs(store: Store, turn: dict[str, dict], now: Column | None = None) -> None:
    """Upsert one staged run per source into the projects and the events; both become visible with one version of the manifest.

    An id contains its source, so a batch never touches the rows of another source, and one job
    serves all of them. ``turn`` maps a source to the next state of its run. Rows promoted are counted as they are written. Until the version is
    published nothing has changed for readers; a run whose promotion broke off is still validated and taken up again.
    """
    run_of_source = {source: state["run_id"] for source, state in turn.items()}
    sources = list(turn)
    chosen = F.lit(False)
    for source, run_id in run_of_source.items():
        chosen |= (F.col("scrape_run_id") == run_id) & (F.col("source") == source)
    batch = store.staging().filter(chosen)
    seen = Observation()
    touched = F.col("change") != "kept"
    counts = [F.count_if(touched & (F.col("source") == source)).alias(f"n{i}") for i, source in enumerate(sources)]
    upserted = lifecycle.promote_upsert(store.serving(sources), batch, stored=True).observe(seen, *counts)
    versions = store.write_snapshots(upserted, "projects", model.SERVING.names, run_of_source)
    events = lifecycle.first_wins(store.staged_events().filter(chosen), ["source", "slug"], ["delivery", "name", "hackathon_date", "url"])
    merged = lifecycle.hackathon_upsert(store.hackathons(sources), events, now if now is not None else F.current_timestamp())
    store.publish(versions + store.write_snapshots(merged, "events", model.HACKATHON.names, run_of_source))
    promoted = seen.get
    store.log_states([{**state, "source": source, "status": "promoted", "n_promoted": promoted[f"n{i}"]} for i, (source, state) in enumerate(turn.items())])


def outcomes(checks: DataFrame, status: DataFrame) -> DataFrame:
    """What the gate does with each run: promoted with its rows, or rejected with the reasons."""
    runs = status.select(F.col("run_id").alias("scrape_run_id"), "n_scraped")
    decided = quality.verdicts(checks).join(runs, "scrape_run_id")
    return decided.select(
        "scrape_run_id",
        "source",
        F.when(F.col("passed"), "promoted").otherwise("rejected").alias("status"),
        F.when(F.col("passed"), F.col("n_scraped")).alias("n_promoted"),
        F.nullif("failed", F.lit("")).alias("notes"),
    )


def run_gate(store: Store, thresholds: Thresholds, promote: bool = True, now: Column | None = None) -> DataFrame:
    """Decide every pending run and promote the accepted ones; returns the state of all runs.

    Runs of different sources do not influence each other and are measured together. Runs of one
    source are decided in order, each against the table as the previous one left it. A run that was
    validated but not promoted is taken up again; a decided run is left alone.
    """
    ready = quality.run_status(store.events()).join(incomplete_runs(store), "run_id", "left_anti")
    waiting = quality.gate_runs(store.staging(), ready)
    while waiting:
        turn = {p.source: p for p in reversed(waiting)}
        waiting = [p for p in waiting if p is not turn[p.source]]
        runs = sorted(turn.values(), key=lambda p: p.run_id)
        checks = quality.quality_checks(store.staging(), store.serving(list(turn)), runs, thresholds)
        store.write_checks(checks)
        stored = store.checks().filter(F.col("scrape_run_id").isin([p.run_id for p in runs]))
        log = store.events().groupBy("run_id").agg(F.max("seq").alias("seq"), F.max("kind").alias("kind"))
        decided = quality.verdicts(stored).join(log, F.col("scrape_run_id") == F.col("run_id")).collect()
        states = [
            {
                "run_id": run.run_id,
                "seq": run.seq + 1,
                "source": run.source,
                "kind": run.kind,
                "status": "validated" if run.passed else "rejected",
                "notes": run.failed or None,
            }
            for run in decided
        ]
        store.log_states(states)
        accepted = {s["source"]: {**s, "seq": s["seq"] + 1} for s in states if s["status"] == "validated"}
        if accepted and promote:
            promote_runs(store, accepted, now)
    return quality.run_status(store.events())


def finish_run(store: Store, run_id: int, source: str, n_scraped: int) -> None:
    """Mark a run as complete once all its ``n_scraped`` different ids were delivered; until they are here the gate lets it wait."""
    state = {"run_id": run_id, "seq": 0, "source": source, "kind": "scrape", "status": "scraped", "n_scraped": n_scraped}
    store.log_states([state])


def deliver(store: Store, batch: DataFrame, delivery: int) -> None:
    """Stage a delivery of one or more runs, each of which may come in several.

    The first row of an id counts, within a delivery and across those of a run; rows alike in time, url and title are ordered by a digest of all
    columns. A delivery that comes again replaces itself, and one that brings known ids only under a new number adds nothing to its run. Rows of a run
    that is decided already are refused, unless this very delivery was taken before.
    """
    runs = [row[0] for row in batch.select("scrape_run_id").distinct().collect()]  # the runs of one delivery
    decided = quality.run_status(store.events()).filter(F.col("status").isin("promoted", "rejected"))
    taken = store.deliveries().filter(F.col("delivery") == delivery).select("scrape_run_id").distinct()
    closed = decided.select(F.col("run_id").alias("scrape_run_id"))
    late = batch.join(closed.join(taken, "scrape_run_id", "left_anti"), "scrape_run_id", "left_semi")
    if not late.isEmpty():
        store.refuse(late, delivery)
    fresh = batch.join(closed, "scrape_run_id", "left_anti")
    whole = F.xxhash64(*[F.to_json(F.struct(c)) for c in sorted(fresh.columns)])
    order = ["scraped_at", "source_url", "title", "_digest"]
    unique = lifecycle.first_of_few(fresh.withColumn("_digest", whole), ["scrape_run_id", "id"], order)
    earlier = store._read("staging", T.StructType([*model.STAGING.fields, T.StructField("delivery", T.LongType())]))
    known = earlier.filter(F.col("scrape_run_id").isin(runs) & (F.col("delivery") != delivery)).select("scrape_run_id", "id")
    again = lifecycle.known_keys(fresh, known, ["scrape_run_id", "id"])  # few: whole rows don't travel for them
    added = unique.join(again, ["scrape_run_id", "id"], "left_anti")
    keys = ["scrape_run_id", "source"]  # a delivery without new ids is on record, too
    new = added.groupBy(*keys).agg(F.count("*").alias("n"))
    brought = fresh.select(*keys).distinct().join(new, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    store.stage(added, delivery, brought)


def incomplete_runs(store: Store) -> DataFrame:
    """``run_id`` of the runs of which rows are still to come: fewer different ids were delivered than their marker tells."""
    told = quality.run_status(store.events()).select("run_id", "n_scraped")
    came = store.deliveries().groupBy(F.col("scrape_run_id").alias("run_id")).agg(F.sum("n").alias("n"))
    return told.join(came, "run_id", "left").filter(F.coalesce("n", F.lit(0)) < F.col("n_scraped")).select("run_id")


def stream_gate(
    spark: SparkSession, incoming: str, store: Store, thresholds: Thresholds, checkpoint: str, files_per_batch: int | None = None
):
    """Take up staged files as they arrive; a run is gated and promoted when it is marked complete and all its rows are here.

    A repeated micro-batch is the same delivery: it rewrites the same staged partitions and finds its runs already decided.
    """
    options = {"maxFilesPerTrigger": str(files_per_batch)} if files_per_batch else {}
    arriving = spark.readStream.schema(model.STAGING).options(**options).parquet(incoming)

    def accept(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        deliver(store, batch, number + 1)
        run_gate(store, thresholds)

    query = arriving.writeStream.foreachBatch(accept).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()


def stream_dedup(spark: SparkSession, incoming: str, output: str, checkpoint: str, delay: str = "7 days"):
    """Keep the first arrival of each id; state older than the delay is dropped."""
    arriving = spark.readStream.schema(model.STAGING).parquet(incoming)
    unique = arriving.withWatermark("scraped_at", delay).dropDuplicatesWithinWatermark(["id"])
    sink = unique.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
    return sink.trigger(availableNow=True).start()
