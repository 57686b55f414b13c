"""Session set-up, table access and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "granary", cores: str = "*", **conf: str) -> SparkSession:
    """A session with the settings the library is tested under (UTC, AQE on)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *, spread: bool = False) -> DataFrame:
    """One of the shipped parquet tables.

    ``spread`` is for work that costs far more than a shuffle of its input: a table with fewer
    splits than there are cores (one row group, say) is dealt to all of them. Tables of many splits are read as they are.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    Only a local session (tests) that has none gets a temporary folder; on a cluster a missing
    setting is an error, because executors do not share a machine-local folder.
    """
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        held = java.get() if java.isDefined() else None
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        held = f"file://{tempfile.mkdtemp(prefix='granary-')}"
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/granary/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def stamp(spark: SparkSession, path: str) -> tuple[int, ...]:
    """What changes when a table is rewritten or grows: the time of its file or folder, its bytes, and how many files it has."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = fs.getContentSummary(at)
    return fs.getFileStatus(at).getModificationTime(), held.getLength(), held.getFileCount()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage with replicated files instead of executor-local blocks, so a lost
    executor costs a re-read and not a recomputation of everything before it.
    """
    return _written(df, scratch(df.sparkSession, label))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The intermediate tables of one computation, deleted one by one when nothing reads them any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``materialize`` under a name; a table kept under that name before stays until ``drop``."""
        path = scratch(self.spark, f"{self.label}-{name}")
        self.paths.setdefault(name, []).append(path)
        return _written(df, path)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names, of all names without any."""
        for n in names or list(self.paths):
            for path in self.paths.pop(n, []):
                remove(self.spark, path)

    def drop_older(self, name: str) -> None:
        """Delete all but the newest table of a name."""
        *old, last = self.paths[name]
        self.paths[name] = [last]
        for path in old:
            remove(self.spark, path)
