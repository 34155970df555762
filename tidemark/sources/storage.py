"""Parquet layout of runs and published tables.

Staged rows live in one folder per run, source and delivery. Each promotion writes its projects and events to folders of
its own; a version of the manifest, written at once after them, names the folders that are current. So readers see all tables of a
promotion or none, and a lost or repeated attempt leaves nothing but folders that no version names. How many new ids each delivery
brought is on record, so that a run is decided when all of it has come, and what comes after a decision is refused where one can see it.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import model
from tidemark.operators import lifecycle, quality
from tidemark.session import small_frame


RAW_TAG = T.StructType().add("project_id", "string").add("tech_name", "string").add("tech_slug", "string").add("source", "string")
DELIVERY = (
    T.StructType().add("source", "string").add("n", "long").add("scrape_run_id", "long").add("delivery", "long")
)


#: A version of a table, or of one source of it: the folder, below that of the store, that is current from version ``seq`` on.
PUBLISHED = T.StructType().add("seq", "long").add("table", "string").add("source", "string").add("run_id", "long").add("path", "string")
#: Events as collected in a run.
STAGED_EVENT = T.StructType(
    [T.StructField(f.name, f.dataType) for f in model.HACKATHON.fields if f.name != "scraped_at"] + [T.StructField("scrape_run_id", T.LongType())]
)


#: How wide rows are stored. Row groups are small because a task has one open for each of its partitions.
COMPACT = {"compression": "zstd", "parquet.block.size": str(32 << 20)}
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def side_by_side(spark: SparkSession, partitions: int = 16):
    """Tasks write up to so many partitions at once; only a task with more sorts its rows by partition, which spills."""
    before = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, str(partitions))
    try:
        yield
    finally:
        spark.conf.set(_WRITERS, before)


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    folder: str

    def _path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    # --- staging ---

    def _overwrite(self, rows: DataFrame, name: str, *partitions: str) -> None:
        """Write rows, replacing only the partitions that they belong to."""
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        with side_by_side(rows.sparkSession):
            writer.options(**COMPACT).partitionBy(*partitions).parquet(self._path(name))

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        """A table of the store, empty if nothing was written yet."""
        return self.spark.read.schema(schema).parquet(self._path(name)) if self._exists(name) else small_frame(self.spark, [], schema)

    def stage(self, rows: DataFrame, delivery: int = 0, brought: DataFrame | None = None) -> None:
        """Write the staged rows of a delivery, replacing what an earlier attempt of the same delivery left.

        ``brought`` counts what it adds to its runs (``scrape_run_id, source, n``), by default the rows written. Other deliveries of
        the same runs stay.
        """
        number = F.lit(delivery).cast("long").alias("delivery")
        self._overwrite(rows.select(*model.STAGING.names, number), "staging", "scrape_run_id", "source", "delivery")
        if brought is None:
            brought = self.staging(delivery).join(
                rows.select("scrape_run_id").distinct(), "scrape_run_id", "left_semi"
            ).groupBy("scrape_run_id", "source").agg(F.count("*").alias("n"))
        self._overwrite(brought.select("source", "n", "scrape_run_id", number), "deliveries", "scrape_run_id", "delivery")

    def stage_events(self, rows: DataFrame, delivery: int = 0) -> None:
        """Write the events collected in a delivery, replacing what an earlier attempt of it left."""
        number = F.lit(delivery).cast("long").alias("delivery")
        self._overwrite(rows.select(*STAGED_EVENT.names, number), "staged_events", "scrape_run_id", "source", "delivery")

    def staged_events(self) -> DataFrame:
        """Events of all runs, with the delivery that brought them."""
        return self._read("staged_events", T.StructType([*STAGED_EVENT.fields, T.StructField("delivery", T.LongType())]))

    def staging(self, delivery: int | None = None) -> DataFrame:
        # Partition values carry the declared types; the columns inside are read as declared.
        rows = self._read("staging", T.StructType([*model.STAGING.fields, T.StructField("delivery", T.LongType())]))
        return (rows if delivery is None else rows.filter(F.col("delivery") == delivery)).select(*model.STAGING.names)

    def deliveries(self) -> DataFrame:
        return self._read("deliveries", DELIVERY)

    def refuse(self, rows: DataFrame, delivery: int) -> None:
        """Keep rows that came after their run was decided; they are staged nowhere."""
        number = F.lit(delivery).cast("long").alias("delivery")
        self._overwrite(rows.select(*model.STAGING.names, number), "refused", "scrape_run_id", "delivery")

    def refused(self) -> DataFrame:
        return self._read("refused", T.StructType([*model.STAGING.fields, T.StructField("delivery", T.LongType())]))

    # --- raw tags ---

    def replace_raw_tags(self, tags: DataFrame) -> None:
        """Load raw tags in place of all there were, those of sources that are not in the load included."""
        self.publish([("raw_tags", None, None, self._write_version(tags.select(*RAW_TAG.names), "raw_tags"))])

    def add_raw_tags(self, tags: DataFrame) -> None:
        """Add the tags that their project doesn't have yet; of several rows of one the least counts."""
        keys = ["project_id", "tech_name"]
        unique = lifecycle.first_wins(tags.select(*RAW_TAG.names), keys, ["tech_slug", "source"])
        fresh = unique.join(self.raw_tags().select(*keys), keys, "left_anti").select(*RAW_TAG.names)
        added = self._write_version(fresh, "raw_tags")
        self.publish([("raw_tags", None, None, path) for path in [*self.current("raw_tags").get(None, []), added]])

    def raw_tags(self) -> DataFrame:
        return self._published("raw_tags", RAW_TAG)

    # --- run log ---

    def log(self, events: DataFrame) -> None:
        events.select(*[F.col(f.name).cast(f.dataType) for f in model.RUN_EVENT.fields]).write.mode(
            "append"
        ).parquet(self._path("run_events"))

    def events(self) -> DataFrame:
        return self._read("run_events", model.RUN_EVENT)

    def log_states(self, states: list[dict]) -> None:
        """Append run states; keys are the columns of the log, the absent ones are NULL."""
        rows = [tuple(state.get(c) for c in model.RUN_EVENT.names) for state in states]
        self.log(small_frame(self.spark, rows, model.RUN_EVENT))

    # --- published tables ---

    def _write_version(self, rows: DataFrame, table: str) -> str:
        """Write rows to a folder of their own, which no version names yet."""
        name = f"{table}/{uuid.uuid4().hex}"
        rows.write.parquet(self._path(name))
        return name

    def write_snapshots(self, rows: DataFrame, table: str, columns: list[str], run_of_source: dict[str, int]) -> list[tuple]:
        """Write the new rows of some sources, each source to a folder of its own; returns what :meth:`publish` takes."""
        name, number = f"{table}/{uuid.uuid4().hex}", F.lit(None).cast("int")
        for i, source in enumerate(run_of_source):
            number = F.when(F.col("source") == source, F.lit(i)).otherwise(number)
        with side_by_side(rows.sparkSession):
            rows.select(*columns, number.alias("part")).write.options(**COMPACT).partitionBy("part").parquet(self._path(name))
        written = [(table, source, run, f"{name}/part={i}") for i, (source, run) in enumerate(run_of_source.items())]
        return [told for told in written if self._exists(told[3])]

    def publish(self, versions: list[tuple]) -> None:
        """Make folders ``(table, source, run_id, path)`` current, all at once: one file, that of one task, is committed."""
        seq = (self.versions().agg(F.max("seq")).first()[0] or 0) + 1
        rows = small_frame(self.spark, [(seq, *version) for version in versions], PUBLISHED)
        rows.coalesce(1).write.mode("append").parquet(self._path("versions"))

    def versions(self) -> DataFrame:
        return self._read("versions", PUBLISHED)

    def current(self, table: str) -> dict[str | None, list[str]]:
        """The current folders of a table by source; one small row per folder reaches the driver."""
        told = self.versions().filter(F.col("table") == table)
        last = told.groupBy("source").agg(F.max("seq").alias("seq"))
        found: dict[str | None, list[str]] = {}
        for row in told.alias("t").join(last.alias("l"), (F.col("t.seq") == F.col("l.seq")) & F.col("t.source").eqNullSafe(F.col("l.source"))).select("t.*").collect():
            found.setdefault(row.source, []).append(row.path)
        return found

    def _published(self, table: str, schema: T.StructType, sources: list[str] | None = None) -> DataFrame:
        """The current rows of a table: nothing but the current folders is listed or read."""
        chosen = [path for source, paths in self.current(table).items() if sources is None or source in sources for path in paths]
        if not chosen:
            return small_frame(self.spark, [], schema)
        return self.spark.read.schema(schema).parquet(*map(self._path, sorted(chosen)))

    def serving(self, sources: list[str] | None = None) -> DataFrame:
        """The serving table of all or some sources."""
        return self._published("projects", model.SERVING, sources).select(*model.SERVING.names)

    def hackathons(self, sources: list[str] | None = None) -> DataFrame:
        """The promoted events of all or some sources."""
        return self._published("events", model.HACKATHON, sources)

    # --- checks ---

    def write_checks(self, checks: DataFrame) -> None:
        """Store the checks of the runs at hand, replacing those of an earlier attempt."""
        (
            quality.check_log(checks)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("scrape_run_id")
            .parquet(self._path("contract_checks"))
        )

    def checks(self) -> DataFrame:
        return self.spark.read.schema(model.CHECK).parquet(self._path("contract_checks"))
