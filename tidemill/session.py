"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, Arrow, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemill")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, a private one of a local session only.

    Executors on other machines can't see a private folder, so a cluster session without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
    own = os.path.join(tempfile.gettempdir(), f"tidemill-{os.getpid()}")
    os.makedirs(own, exist_ok=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/tidemill/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a frame below the shared folder and read it back: a stage boundary that survives executor loss."""
    path = fresh_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, path: str):
    """Hadoop's view of a path: its file context and the path itself, so any file system that Spark writes to will do."""
    fs = spark._jvm.org.apache.hadoop.fs
    at = fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    return (fs.FileContext.getFileContext(at.toUri(), conf) if at.toUri().getScheme() else fs.FileContext.getFileContext(conf)), at


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small text at ``path`` in one step: readers see the old text or the new one, whenever a run breaks off."""
    files, at = _files(spark, path)
    fresh = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    gateway, jvm = spark.sparkContext._gateway, spark._jvm
    kinds = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    parents = gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 1)
    parents[0] = jvm.org.apache.hadoop.fs.Options.CreateOpts.createParent()
    out = files.create(fresh, kinds, parents)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fresh, at, how)


def published(spark: SparkSession, path: str) -> str | None:
    """The text last put at ``path``, or None."""
    files, at = _files(spark, path)
    if not files.util().exists(at):
        return None
    return spark._jvm.org.apache.commons.io.IOUtils.toString(files.open(at), "UTF-8")


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate results."""
    for path in paths:
        files, at = _files(spark, path)
        files.delete(at, True)
