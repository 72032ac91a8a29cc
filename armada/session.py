"""Session helpers: local sessions for tests and the bench, and the shared
checkpoint folder taken from the session."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "armada") -> SparkSession:
    """A local session configured the way the tests and the bench use it."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ARMADA_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``armada`` importable in Python workers (``--py-files`` style):
    zip the package once per SparkContext and ``addPyFile`` it."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="armada-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder (``spark.checkpoint.dir``).

    A folder is only chosen here for a ``local[...]`` master, as in tests; on
    a cluster driver and executors share no local folder, so a session
    without the setting is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set: with master {master} it must name a folder "
                             "that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="armada-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def work_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder, scoped by application id."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/armada/{spark.sparkContext.applicationId}/{name}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder that no other call uses: lazy results of two calls never
    read or overwrite each other's intermediates."""
    return work_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate that nothing reads any more."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    read it back: later passes (several consumers, retries) read the written
    rows instead of recomputing the lineage."""
    spark = df.sparkSession
    path = fresh_dir(spark, f"materialized/{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
