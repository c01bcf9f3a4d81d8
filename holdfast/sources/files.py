"""The few file-system calls needed beside Spark's readers and writers, on any Hadoop path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, system = _path(spark, path)
    return system.exists(target)


def remove_folder(spark: SparkSession, path: str) -> None:
    target, system = _path(spark, path)
    system.delete(target, True)


def list_names(spark: SparkSession, folder: str) -> list[str]:
    target, system = _path(spark, folder)
    if not system.exists(target):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(target))


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file; fails when it exists already."""
    target, system = _path(spark, path)
    stream = system.create(target, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and rename it over the old one in one step."""
    target, system = _path(spark, path)
    jvm = spark.sparkContext._jvm
    aside, _ = _path(spark, f"{path}.new")
    stream = system.create(aside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        target.toUri() if target.toUri().getScheme() else system.getUri(),
        spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(aside, target, options)


def read_text(spark: SparkSession, path: str) -> str:
    target, system = _path(spark, path)
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()
