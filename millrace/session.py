"""Session defaults, size checks and lineage cutting shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows one task may hold in a sorted window or a numpy block. A group above it is split.
TASK_ROWS = 1_000_000
# Rows of a side that may be broadcast; checked by a bounded count before every hint.
BROADCAST_ROWS = 200_000


def build_session(app: str = "millrace", cores: str = "*", shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A local session with the settings the operators expect; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    # A local master has one machine: one folder per session, remembered as its checkpoint folder.
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, stem: str) -> str:
    """A fresh path below the shared folder for a table the job writes and reads back."""
    import uuid

    return f"{work_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a table that `new_path` named, once nothing reads it any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and fixes one evaluation of `df`."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(work_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *keys, rows_per_task: int = 10_000) -> DataFrame:
    """A checkpoint for many passes of heavy per-row work, split so that every core has a part."""
    rows = cut_lineage(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= cores:
        return rows
    parts = min(cores, -(-rows.count() // rows_per_task))
    return cut_lineage(rows.repartition(parts, *keys)) if parts > rows.rdd.getNumPartitions() else rows


class Shared:
    """A broadcast value that may hold classes of this package; loaded once per task."""

    def __init__(self, spark: SparkSession, value):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = None

    def __getstate__(self):
        return {"_sent": self._sent, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = cloudpickle.loads(self._sent.value)
        return self._value

    def unpersist(self) -> None:
        self._sent.unpersist()


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when `df` has at most `max_rows` rows; stops counting just above the limit."""
    return df.limit(max_rows + 1).count() <= max_rows


def largest_group(df: DataFrame, keys) -> int:
    """Row count of the biggest group of `keys` (of the whole frame when there are none)."""
    keys = list(keys)
    if not keys:
        return df.count()
    top = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return int(top or 0)


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys) -> DataFrame:
    """Repartition by key when the input has fewer splits than there are cores to use.

    Meant for few, small files ahead of heavy per-row work; a large table is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def as_list(cols) -> list:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)
