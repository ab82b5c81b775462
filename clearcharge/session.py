"""Session defaults, the shared work folder, and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a broadcast side may hold. Beyond it the join shuffles and AQE splits skewed keys.
BROADCAST_ROWS = 200_000
# The same for a list of keys of one short column: at most some 100 MB in a task.
BROADCAST_KEYS = 1_000_000
# Shuffle files go when their job ends; else they stay until the driver happens to collect its garbage, and a query of
# many jobs fills the disk with all of them.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "clearcharge") -> SparkSession:
    # Python-side query contexts cost more than building the plans they annotate.
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(TIDY, "true")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):  # one process does all the work; the default heap is 1 GB
            builder = builder.config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster (`spark.checkpoint.dir`). Without one, a temporary folder on a
    local master, where driver and executor are one process; on a cluster that is an error, since
    machines would not see each other's files."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        configured = tempfile.mkdtemp(prefix="clearcharge-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def new_work_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{work_folder(spark)}/clearcharge/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write once, read many: cuts lineage and survives lost executors. `codec`: how a large table is packed, if other
    than the session packs."""
    return written(df, new_work_path(df.sparkSession, name), codec)


def written(df: DataFrame, path: str, codec: str | None = None) -> DataFrame:
    """`materialise` at a path the caller knows, for tables that are removed once nothing reads them."""
    df.write.mode("overwrite").parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes work tables that were read for the last time."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when a count proves the side small; otherwise the join shuffles.

    Give it a materialised or cheaply countable frame: the count stops one row past the limit."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
