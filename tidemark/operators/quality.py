"""Quality gate: metrics of staged batches against two baselines, one row per check.

All runs are measured in one grouped pass over the staged rows. Everything after that works on one
row per run and source, or per run, source and event.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import model
from tidemark.config import MEASURED, Limit, Thresholds
from tidemark.functions import text
from tidemark.session import small_frame

URL_COLUMNS = ["source_url", "repo_url", "demo_url"]
RUN_KEYS = ["scrape_run_id", "source"]


def _filled(column: str) -> Column:
    return F.avg(F.col(column).isNotNull().cast("int"))


def quality_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Row count, fill rates, median text length and share of well-formed URLs per group.

    URLs are counted within the row, so the three URL columns need no unnesting. The exact median
    is kept as counts per length, which combine before the shuffle.
    """
    given = [F.col(c).isNotNull().cast("int") for c in URL_COLUMNS]
    formed = [F.coalesce(text.url_shaped(F.col(c)), F.lit(False)).cast("int") for c in URL_COLUMNS]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[_filled(c).alias(f"fill_{c}") for c in MEASURED],
        _filled("placement").alias("fill_placement"),
        F.coalesce(F.percentile(F.length("description"), 0.5), F.lit(0.0)).alias("median_desc_len"),
        F.coalesce(
            F.try_divide(F.sum(sum(formed, F.lit(0))), F.sum(sum(given, F.lit(0)))), F.lit(0.0)
        ).alias("url_valid_rate"),
    )


def projects_per_hackathon(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "hackathon_slug").agg(F.count("*").alias("n"))


def anchor_runs(staging: DataFrame, runs: DataFrame) -> DataFrame:
    """For each source the earliest promoted run that holds rows of it.

    ``runs`` has ``run_id`` and ``status``. The promoted runs prune the staged partitions.
    """
    promoted = runs.filter(F.col("status") == "promoted").select(F.col("run_id").alias("scrape_run_id"))
    held = staging.select(*RUN_KEYS).join(promoted, "scrape_run_id", "left_semi")
    return held.groupBy("source").agg(F.min("scrape_run_id").alias("anchor_run"))


def overlap_drop(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Projects of the events that both sides have, per run and source of the candidate.

    Both inputs hold one row per event. Columns ``overlap``, ``base_total`` and ``cand_total``.
    """
    base = baseline.withColumnRenamed("n", "base_n")
    keys = ["source", "hackathon_slug"]
    return (
        candidate.join(base, keys)
        .groupBy(*RUN_KEYS)
        .agg(
            F.count("*").alias("overlap"),
            F.sum("base_n").alias("base_total"),
            F.sum("n").alias("cand_total"),
        )
    )


_SHAPE = "struct<check_name:string,mode:string,baseline:double,candidate:double,limit:double,overlap:bigint>"


def _metric(side: str, limit: Limit) -> Column:
    column = limit.metric.removeprefix("null_rate.")
    name = {"median_desc_len": "median_desc_len", "placement_fill": "fill_placement"}.get(column, f"fill_{column}")
    return F.col(f"{side}.{name}")


def _comparison(profile: str, limit: Limit) -> Column:
    if limit.mode == "overlap":
        base, cand = F.col(f"{profile}_overlap.base_total"), F.col(f"{profile}_overlap.cand_total")
        overlap = F.coalesce(F.col(f"{profile}_overlap.overlap"), F.lit(0))
    else:
        base, cand = _metric(profile, limit), _metric("candidate", limit)
        overlap = F.lit(None)
    return F.struct(
        F.lit(f"{profile}:{limit.metric}"), F.lit(limit.mode), base, cand, F.lit(limit.limit), overlap
    ).cast(_SHAPE)


def _single(name: str, mode: str, candidate: Column, limit: Column) -> Column:
    return F.struct(
        F.lit(name), F.lit(mode), F.lit(None), candidate, limit, F.lit(None)
    ).cast(_SHAPE)


def compare_metrics(metrics: DataFrame, thresholds: Thresholds) -> DataFrame:
    """Check rows of every run in ``metrics``, which has one row per run with the structs
    ``candidate``, ``moving``, ``anchor`` and the two ``*_overlap``.

    Only drops fail. A missing baseline is a first time and passes; an empty batch fails outright.
    """
    checks = F.array()
    for profile, limits in thresholds.profiles.items():
        first_time = F.coalesce(F.col(f"{profile}.n"), F.lit(0)) == 0
        bootstrap = F.array(_single(f"{profile}:bootstrap", "bootstrap", F.lit(None), F.lit(None)))
        compared = F.array(*[_comparison(profile, limit) for limit in limits])
        checks = F.concat(checks.cast(f"array<{_SHAPE}>"), F.when(first_time, bootstrap).otherwise(compared))
    urls = _single("batch:url_valid", "rate", F.col("candidate.url_valid_rate"), F.lit(thresholds.url_valid_min_rate))
    batch_size = F.coalesce(F.col("candidate.n"), F.lit(0))
    empty = F.array(_single("batch:nonempty", "size", batch_size, F.lit(0.0)))
    rows = metrics.select(
        *RUN_KEYS,
        F.posexplode(F.when(batch_size == 0, empty).otherwise(F.concat(checks, F.array(urls)))).alias("position", "c"),
    ).select(*RUN_KEYS, "position", "c.*")

    mode, base, cand = F.col("mode"), F.col("baseline"), F.col("candidate")
    compares = mode.isin("absolute", "relative", "overlap")
    drop = F.when(mode == "absolute", (base - cand) * 100.0).when(
        compares, F.try_divide(base - cand, base) * 100.0
    )
    note = (
        F.when(mode == "bootstrap", "no_baseline")
        .when(F.col("overlap") == 0, "no_overlap")
        .when(mode.isin("relative", "overlap") & (base == 0), "baseline_zero_pass")
    )
    passed = (
        F.when(note.isNotNull(), True)
        .when(mode == "size", cand > F.col("limit"))
        .when(mode == "rate", cand >= F.col("limit"))
        .otherwise(F.col("drop") <= F.col("limit"))
    )
    return rows.withColumn("drop", drop).withColumns({"passed": passed, "note": note})


def _as_struct(metrics: DataFrame, keys: list[str], name: str) -> DataFrame:
    values = [c for c in metrics.columns if c not in keys]
    return metrics.select(*keys, F.struct(*values).alias(name))


@dataclass(frozen=True)
class GateRun:
    """A run to decide on, and the anchor run of its source if there is one."""

    run_id: int
    source: str
    anchor_run: int | None


_GATE_RUN = T.StructType(
    [
        T.StructField("scrape_run_id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("anchor_run", T.LongType()),
    ]
)


def gate_runs(staging: DataFrame, runs: DataFrame) -> list[GateRun]:
    """The pending runs with their anchors: run bookkeeping, one short row per run."""
    anchors = {r.source: r.anchor_run for r in anchor_runs(staging, runs).collect()}
    pending = pending_runs(runs).select("run_id", "source").collect()
    return [GateRun(r.run_id, r.source, anchors.get(r.source)) for r in sorted(pending)]


def quality_checks(
    staging: DataFrame, serving: DataFrame, pending: list[GateRun], thresholds: Thresholds
) -> DataFrame:
    """All checks of all runs that wait for a decision.

    The moving baseline is the serving table's current rows of the source; the anchor is the
    earliest promoted run of the source, which a slow decline cannot move. Batches and anchors are
    measured together, and the run numbers are literals that prune the staged partitions.
    """
    spark = staging.sparkSession
    runs = small_frame(spark, [(p.run_id, p.source, p.anchor_run) for p in pending], _GATE_RUN)
    numbers = sorted({n for p in pending for n in (p.run_id, p.anchor_run) if n is not None})
    sources = sorted({p.source for p in pending})
    relevant = staging.filter(F.col("scrape_run_id").isin(numbers) & F.col("source").isin(sources))
    current = serving.filter(F.col("source").isin(sources))

    staged = quality_metrics(relevant, RUN_KEYS)
    moving = quality_metrics(current, ["source"])
    staged_events = projects_per_hackathon(relevant, RUN_KEYS)
    batch_events = staged_events.join(runs, RUN_KEYS)
    anchors = runs.select("source", F.col("anchor_run").alias("scrape_run_id")).distinct()
    anchor_events = staged_events.join(anchors, RUN_KEYS).drop("scrape_run_id")
    moving_events = projects_per_hackathon(current, ["source"])

    anchor = _as_struct(staged.withColumnRenamed("scrape_run_id", "anchor_run"), ["anchor_run", "source"], "anchor")
    metrics = (
        runs.join(_as_struct(staged, RUN_KEYS, "candidate"), RUN_KEYS, "left")
        .join(_as_struct(moving, ["source"], "moving"), "source", "left")
        .join(anchor, ["anchor_run", "source"], "left")
        .join(_as_struct(overlap_drop(batch_events, moving_events), RUN_KEYS, "moving_overlap"), RUN_KEYS, "left")
        .join(_as_struct(overlap_drop(batch_events, anchor_events), RUN_KEYS, "anchor_overlap"), RUN_KEYS, "left")
    )
    return compare_metrics(metrics, thresholds)


def verdicts(checks: DataFrame) -> DataFrame:
    """One row per run: the decision and the names of the failed checks."""
    failed = F.collect_list(F.when(~F.col("passed"), F.col("check_name")))
    return checks.groupBy(*RUN_KEYS).agg(
        F.bool_and("passed").alias("passed"),
        F.count("*").alias("n_checks"),
        F.array_join(F.array_sort(failed), ", ").alias("failed"),
    )


def check_log(checks: DataFrame) -> DataFrame:
    """Checks as they are stored, with the numbers as a JSON detail."""
    detail = F.to_json(
        F.struct(
            "mode", "note", "overlap", "limit",
            *[F.bround(c, d).alias(c) for c, d in (("baseline", 4), ("candidate", 4), ("drop", 2))],
        )
    )
    return checks.select(*RUN_KEYS, "check_name", "passed", detail.alias("detail"))


def check_report(checks: DataFrame) -> DataFrame:
    """A markdown report per run; a run has at most a few dozen checks."""

    def shown(c: str) -> Column:
        return F.when(F.col(c).isNull(), "-").otherwise(F.format_string("%.2f", F.bround(c, 2)))

    line = F.concat(
        F.lit("| `"), "check_name", F.lit("` | "), shown("baseline"), F.lit(" | "), shown("candidate"), F.lit(" | "),
        F.coalesce("note", shown("drop")), F.lit(" | "), shown("limit"), F.lit(" | "),
        F.when(F.col("passed"), "pass").otherwise("FAIL"), F.lit(" |"),
    )
    lines = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    table = F.array_join(F.transform(lines, lambda x: x.line), "\n")
    head = F.lit("| check | baseline | batch | drop | limit | |\n|---|---|---|---|---|---|\n")
    title = F.concat(
        F.lit("## run "), F.col("scrape_run_id").cast("string"), F.lit(", source `"), "source", F.lit("`: "),
        F.when(F.col("passed"), "accepted").otherwise("REJECTED, the serving table is unchanged"), F.lit("\n\n"),
    )
    reports = checks.groupBy(*RUN_KEYS).agg(F.bool_and("passed").alias("passed"), table.alias("table"))
    return reports.select(*RUN_KEYS, "passed", F.concat(title, head, "table").alias("report"))


# --- run log ---------------------------------------------------------------------------------


def run_status(events: DataFrame) -> DataFrame:
    """Current state of each run, from the append-only log: its latest entry, and the last known counts."""

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name)

    latest = F.max_by(F.struct("status", "source", "kind"), "seq").alias("s")
    grouped = events.groupBy("run_id").agg(latest, last("n_scraped"), last("n_promoted"))
    return grouped.select("run_id", "s.*", "n_scraped", "n_promoted")


def pending_runs(runs: DataFrame) -> DataFrame:
    """Runs to decide on. A validated run is still pending: its promotion may have been lost.

    A run without a source mixes several and cannot be compared.
    """
    return runs.filter(F.col("status").isin(model.PENDING_STATUSES) & F.col("source").isNotNull())


def latest_validated_run(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status") == "validated").agg(F.max("run_id").alias("run_id"))


# --- constraints -----------------------------------------------------------------------------


def constraint_checks(projects: DataFrame, hackathons: DataFrame, sources: list[str]) -> DataFrame:
    """Violations of the declared rules, one row per rule.

    Projects are reduced to one row per event before they meet the event table.
    """
    rules = projects.agg(
        F.count_if(F.col("placement") < 1).alias("placement_at_least_1"),
        F.count_if(~F.col("source").isin(sources)).alias("source_known"),
        F.count_if(~F.col("stack_source").isin(model.STACK_SOURCES)).alias("stack_source_known"),
        F.count_if(F.col("id").isNull()).alias("id_present"),
    )
    per_event = projects.groupBy("source", F.col("hackathon_slug").alias("slug")).agg(F.count("*").alias("n"))
    orphans = per_event.join(hackathons.select("source", "slug"), ["source", "slug"], "left_anti")
    with_fk = rules.withColumn("event_exists", orphans.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar())
    names = with_fk.columns
    return with_fk.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in names]))
    ).withColumn("passed", F.col("violations") == 0)
