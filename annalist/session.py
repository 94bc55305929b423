"""Session settings, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 100_000

#: Bytes in memory for one in a file, as Spark is told to reckon: keys in order pack to a fiftieth and less,
#: and by its files alone a table of millions of rows would be gathered on the driver to be broadcast.
UNPACKED = {"spark.sql.sources.fileCompressionFactor": "20"}


def local_session(cores: str = "8", app: str = "annalist") -> SparkSession:
    """Session for one machine; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config(map=UNPACKED)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_LOCAL: dict[str, str] = {}


def stage_folder(spark: SparkSession) -> str:
    """A new path in the shared folder; only a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        root = _LOCAL[app]
    return f"{root.rstrip('/')}/stage-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from the files.

    Used after order-dependent or iterated stages, so that a lost executor re-reads files
    instead of replaying every earlier round, and later reads take only the columns they need.
    """
    path = stage_folder(df.sparkSession)
    plain = df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"})
    plain.write.parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path)


def release(*stages: DataFrame) -> None:
    """Remove the files of cut frames that nothing reads any more."""
    for df in stages:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles() if "/stage-" in f}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``rows`` rows; stops counting one row later."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when a count proves it small; otherwise never, however small its files are."""
    return F.broadcast(df) if fits(df, rows) else df.hint("merge")


def reckon_unpacked(spark: SparkSession) -> SparkSession:
    """Let a session that was started elsewhere guess tables at their size in memory, unless it has a factor of its own."""
    for key, value in UNPACKED.items():
        if float(spark.conf.get(key)) == 1.0:
            spark.conf.set(key, value)
    return spark


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Scans over this size, in bytes, are never spread: their own splits are enough.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a small scan of few files over all cores; any other scan stays as it is.

    Only for frames that are plain reads: their size and splits are known without running anything.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the Python workers of a session that was started elsewhere."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / package.name
        spark.sparkContext.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
        _SHIPPED.add(app)
    return spark
