"""Session defaults shared by the tests, the bench and local runs.

A cluster supplies its own session: nothing in the package needs more than the settings below,
and the library reads the folder for durable intermediate data from ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Set for test tables of one file with one row group, which Spark can't split: the tables that need much work per row
#: are dealt over so many tasks. Unset on a cluster, where tables have many files and nothing is dealt anew.
READ_PARTITIONS = "spark.tidemark.read.partitions"


def local_session(cores: int | str = "*", app: str = "tidemark") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config(READ_PARTITIONS, "8" if cores == "*" else str(cores))
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for data that must outlive an executor.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Where it is unset, a session in one
    process gets a temporary folder of its own and any other session an error, because executors
    on other machines would not see such a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(frame: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """The frame written as a table in the shared folder and read back: lineage ends here, and a lost executor costs nothing."""
    folder = work_folder(frame.sparkSession, name)
    frame.write.parquet(folder, compression=codec)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def small_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A few rows known to the driver, as a local relation whose size the planner knows."""
    table = pa.Table.from_pylist([dict(zip(schema.names, row)) for row in rows], to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


def dealt(frame: DataFrame) -> DataFrame:
    """The rows of a table over as many tasks as ``READ_PARTITIONS`` names; the table as it is where that is unset."""
    partitions = frame.sparkSession.conf.get(READ_PARTITIONS, None)
    return frame.repartition(int(partitions)) if partitions else frame
