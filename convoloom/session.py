"""Session settings, table access and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "convoloom", **conf) -> SparkSession:
    """A session with UTC times and adaptive execution; conf overrides by key (dots as double underscores)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: What the path of an archive begins with that is read out of a backup.
SNAPSHOTS = "snapshots:"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        folder = Path(tempfile.mkdtemp(prefix="convoloom-ship-"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = Path(__file__).resolve().parent
        with zipfile.ZipFile(folder / "convoloom.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(folder / "convoloom.zip"))
        _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of an archive, or of a folder of snapshots if sf_dir begins with SNAPSHOTS."""
    ship(spark)
    if sf_dir.startswith(SNAPSHOTS):
        return spark.read.parquet(f"{sf_dir.removeprefix(SNAPSHOTS)}/{name}/data")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, only where that is unset and Spark runs in this one process, a temporary one. On a cluster without the setting it refuses: executors would write to disks of their own."""
    there = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="convoloom-")
        atexit.register(shutil.rmtree, there, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
        there = spark.sparkContext.getCheckpointDir()
    return there.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder; it goes when the process ends, where the file system lets it."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).deleteOnExit(p)
    return path


def settle(df: DataFrame, what: str) -> DataFrame:
    """df written once to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
