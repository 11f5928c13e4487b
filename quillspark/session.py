"""Session settings, and tables written to cut a plan's lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, name: str = "quillspark", **conf: str) -> SparkSession:
    """A session with UTC, AQE and skew joins on. ``conf`` overrides the defaults."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    spark = builder.config(map=DEFAULTS | conf).getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that they needn't find it on a path of their own."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="quillspark-package-")) / "quillspark.zip"  # read by the driver only, which serves it
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(Path(root.name) / f.relative_to(root)))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def prepare(spark: SparkSession) -> None:
    """What every query needs. Dates and formatted times follow the session zone, so it is UTC."""
    ship_package(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it; a local one only where it is unset and Spark runs in one process."""
    ship_package(spark)
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    path = spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    spark.sparkContext.setCheckpointDir(path)
    delete_at_exit(spark, path)
    return path


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Removes a folder when the driver ends."""
    def delete() -> None:
        with contextlib.suppress(Exception):
            jvm, sc = spark._jvm, spark.sparkContext
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)

    atexit.register(delete)


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back.

    What was written survives the loss of any executor, is not computed again by later uses, and gives the
    planner real sizes. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files behind a table that ``written`` returned, once nothing reads them any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        with contextlib.suppress(Exception):
            target = spark._jvm.org.apache.hadoop.fs.Path(name)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
