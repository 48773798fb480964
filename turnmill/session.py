"""Sessions, and this package on the executors."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()
_folders: dict[str, str] = {}

#: Rows of one Arrow batch to a Python worker; with Spark's default of 10,000 a run of long texts would fill a worker.
BATCH_ROWS = 500
ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that the Parquet reader decodes at once; with Spark's default of 4,096 a column of texts takes tens of MB in one array.
READER = "spark.sql.parquet.columnarReaderBatchSize"
READER_ROWS = 128
#: Bytes of one Arrow batch to a Python worker; a longer row is a batch by itself.
BATCH_BYTES = 4 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Marks the sessions that adopt() makes.
OWN = "spark.turnmill.own"


def get_spark(name: str = "turnmill", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with this engine's settings; on a cluster, spark-submit's settings take the place of master and memory."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TURNMILL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, unless PYTHONPATH leads them to it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped or str(ROOT) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    folder = tempfile.mkdtemp(prefix="turnmill-")  # of the driver, which serves the file to executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    to = Path(folder) / "turnmill.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted((ROOT / "turnmill").rglob("*")):
            if p.suffix in (".py", ".txt"):
                z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


def adopt(df: DataFrame) -> DataFrame:
    """df in a copy of its session with this package's batch sizes, so that what a Python worker holds at a time grows neither with the rows nor with their length: the caller's session keeps its own. Sizes that the caller has lowered hold."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(OWN, None):
        return df
    own = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set(OWN, "true")
    for key, default, ours in ((ARROW, 10_000, BATCH_ROWS), (READER, 4096, READER_ROWS), (ARROW_BYTES, BATCH_BYTES, BATCH_BYTES)):
        if not (at := own.conf.get(key)).isdigit() or int(at) >= default:
            own.conf.set(key, str(ours))
    made = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().analyzed())
    return DataFrame(made, own)


def release() -> None:
    """Give a Python worker's free memory back: workers stay alive between batches and tasks, several to an executor, and would keep their peaks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share (spark.checkpoint.dir). Where it is unset a local session, as in tests, gets a temporary one; a cluster gets an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if spark.sparkContext.applicationId not in _folders:
            _folders[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="turnmill-")
            atexit.register(shutil.rmtree, _folders[spark.sparkContext.applicationId], ignore_errors=True)
        at = _folders[spark.sparkContext.applicationId]
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the application's own folder in the shared one."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table: computed once, and it survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
