"""Spark session helper and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "docloom", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution and UTC; on a cluster the submitted configuration wins."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("DOCLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the Python workers, once a session, so that they need no copy of their own."""
    context, root = spark.sparkContext, Path(__file__).parent
    if getattr(context, "_docloom_shipped", False) or not root.is_dir():  # not a folder: it came as a zip itself
        return
    made = Path(tempfile.mkdtemp(prefix="docloom-")) / "docloom.zip"
    with zipfile.ZipFile(made, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(str(made))
    context._docloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent and the session runs in one process is a temporary folder made;
    on a cluster without the setting this raises, for a machine's own folder would not be shared.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="docloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str = "stage", tidy: bool = False) -> DataFrame:
    """Write ``df`` as a parquet table into the shared folder and read it back, which cuts the lineage.

    A lost executor costs nothing that is already written. The table is deleted when the driver's JVM ends, or by ``discard``.
    tidy: the shuffle files of the write are deleted as soon as it is done, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, None)
    if tidy:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table of ``materialise`` that nothing reads any more."""
    spark = table.sparkSession
    for path in {x.rpartition("/")[0] for x in table.inputFiles()}:
        if path.rpartition("/")[2].startswith("docloom-"):
            hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
