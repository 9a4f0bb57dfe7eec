"""Session defaults and the one place that decides where checkpoints go."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_MARKED: set[str] = set()
_SHIPPED: set[str] = set()


def local_session(cores: int | str = 8, app: str = "swathline", **conf: str) -> SparkSession:
    """Session for tests and benchmarks on one machine; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture per column expression
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that a driver can run from any folder."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="swathline-ship-")  # of the driver, which serves the file while it lives
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = Path(folder) / "swathline.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a folder of our own only where it is unset (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if configured is None and current.isDefined():
        configured = current.get()
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="swathline-ckpt-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def _own_folder(spark: SparkSession) -> str:
    """This session's part of the shared folder; it goes when the session's JVM ends."""
    folder = f"{shared_folder(spark)}/swathline/{spark.sparkContext.applicationId}"
    if folder not in _MARKED:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _MARKED.add(folder)
    return folder


def own_path(spark: SparkSession) -> str:
    """A new path in this session's part of the shared folder."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written as parquet to the shared folder, in a folder per value of ``by``, and read back.

    The copy survives lost executors, later steps prune its columns, and, unlike after ``checkpoint()``, the optimizer
    starts afresh: a checkpointed plan keeps its inferred constraints, which double with every round of a loop.
    """
    path = own_path(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
