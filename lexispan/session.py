"""Session helpers: the folder shared by all executors, and cutting lineage by a table written there."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app: str = "lexispan", *, cores: str = "*", shuffle_partitions: int = 8, driver_memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where that is unset (tests, one machine) a temporary one is made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="lexispan-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_LOCK = threading.Lock()
_WRITING: dict[str, int] = {}
_TABLES: dict[str, list[str]] = {}


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows once, as Parquet in the shared folder, and reads them from there: lineage ends, and the loss of an executor costs nothing.

    The table stays until `drop_cut`, `release` or the end of the driver's process.
    """
    spark = df.sparkSession
    application = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/lexispan-{uuid.uuid4().hex}"
    with _LOCK:  # writes at the same time share the setting; the last one to end takes it back
        _TABLES.setdefault(application, []).append(path)
        _WRITING[application] = _WRITING.get(application, 0) + 1
        if _WRITING[application] == 1:
            _BEFORE[application] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")  # the shuffles of this write aren't needed once the table is there
    try:
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    finally:
        with _LOCK:
            _WRITING[application] -= 1
            if not _WRITING[application]:
                before = _BEFORE.pop(application)
                spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_BEFORE: dict[str, str | None] = {}


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_cut(df: DataFrame) -> None:
    """Deletes what cut() wrote for this frame; for loops that no longer need an earlier round."""
    known = _TABLES.get(df.sparkSession.sparkContext.applicationId, [])
    for name in df.inputFiles():
        parent = name.rsplit("/", 1)[0]
        for path in known:
            if parent.rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]:
                known.remove(path)
                _delete(df.sparkSession, path)
                return


def release(spark: SparkSession) -> None:
    """Deletes all that cut() wrote for this application; frames that read from there can't be used any more."""
    for path in _TABLES.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone; then the folder is its owner's to clear
            release(spark)


def spread(df: DataFrame) -> DataFrame:
    """Rows that are read in fewer pieces than there are cores, dealt over all cores, for work that is heavy for each row; larger inputs, also single large files, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt by columns into as many partitions as a shuffle has, and at least one for each core: a count that is asked for isn't reduced for small tables, where each row is heavy."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *columns)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers of all executors, once for each application; they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lexispan-code-")) / "lexispan_code.zip"  # on the driver only; Spark serves it from there
    with zipfile.ZipFile(archive, "w") as into:
        for file in sorted(root.rglob("*.py")):
            into.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
