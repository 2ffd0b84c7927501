"""Tables that are replaced as a whole: a new version is written beside the current one, then a manifest names it."""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import drop_path

MANIFEST = "_current"  # readers of Parquet folders pass over names that begin so


def _path(spark: SparkSession, path: str) -> JavaObject:
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str) -> JavaObject:
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, target: str) -> str | None:
    """The folder that the manifest names, or None before anything was published."""
    manifest = _path(spark, f"{target}/{MANIFEST}")
    store = _store(spark, target)
    if not store.exists(manifest):
        return None
    stream = store.open(manifest)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def _name_current(spark: SparkSession, target: str, version: str) -> None:
    """Switch the manifest: written aside, then moved over the old one in one step of the store."""
    store, aside = _store(spark, target), f"{target}/{MANIFEST}-{version}"
    stream = store.create(_path(spark, aside), True)
    try:
        stream.writeUTF(version)
    finally:
        stream.close()
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, target).toUri(), settings)
    files.rename(_path(spark, aside), _path(spark, f"{target}/{MANIFEST}"), how)


def publish(frame: DataFrame, target: str) -> None:
    """Make `frame` the content of the table at `target`.

    Until all of it is written, and if that fails, the table stays as it was.
    The version before stays for readers that have begun with it, and goes with the
    next publication, as does what a failed one has left. A table has one writer at a time.
    """
    spark, version = frame.sparkSession, f"version-{uuid.uuid4().hex}"
    before = current_version(spark, target)
    frame.write.parquet(f"{target}/{version}")
    _name_current(spark, target, version)
    store = _store(spark, target)
    for status in store.listStatus(_path(spark, target)):
        name = status.getPath().getName()
        if name.startswith("version-") and name not in (version, before):
            drop_path(spark, f"{target}/{name}")


def published(spark: SparkSession, target: str) -> DataFrame:
    """The table at `target` as it was published last."""
    version = current_version(spark, target)
    if version is None:
        raise FileNotFoundError(f"nothing has been published at {target}")
    return spark.read.parquet(f"{target}/{version}")
