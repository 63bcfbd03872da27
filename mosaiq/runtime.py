"""Session and storage helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "mosaiq", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE, Arrow); conf wins over them."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # a checkpoint goes when nothing refers to it
        "spark.ui.enabled": "false",
    }
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    spark = b.config(map=base | conf).getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in all Python workers, wherever they run; once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_mosaiq_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="mosaiq-"), "mosaiq_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in sorted(os.walk(root)):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)  # served to executors by the driver
    sc._mosaiq_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder: the session's spark.checkpoint.dir, or a temporary one where that is unset and all runs here.

    On a cluster it must be set, as a folder of this machine isn't shared.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            found = tempfile.mkdtemp(prefix="mosaiq-checkpoint-")
            atexit.register(shutil.rmtree, found, True)
        sc.setCheckpointDir(found)
    return found


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """df written to the shared checkpoint folder and read back, so lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file on any storage that Spark can reach; None if it isn't there."""
    at, files = _path(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes the file beside its place and renames it, so that readers see the old text or the new one whole."""
    at, files = _path(spark, path)
    fresh, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = files.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(fresh, at, options)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, on storage that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
