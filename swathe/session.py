"""Session helpers: defaults for stand-alone use, and shipping this package to the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()
_written: dict[str, list[str]] = {}


#: Rows of an Arrow batch: texts are long, and a worker holds a batch and what it makes of it.
BATCH_ROWS = 1000


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application, and keep Arrow
    batches small where the session has Spark's default."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="swathe-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)


def local_session(cpus: int = 8, memory: str = "8g", name: str = "swathe") -> SparkSession:
    """A local session with the settings that tests and the bench share."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is missing (tests, a single machine) a local folder is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder's path in the shared folder, which ``drop_written`` deletes."""
    path = f"{shared_dir(spark)}/swathe-{tag}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs the files' readers nothing but a re-read.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    # The files replace the plan, so its shuffle files go when they are written, not when the driver
    # happens to collect garbage.
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Delete what this application has written into the shared folder; results that still read
    those files must be stored before. Returns the number of folders."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    return len(paths)
