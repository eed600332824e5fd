"""Files in the shared folder: written and read by tasks and the driver through the file system that the path names."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import SparkSession


def _at(path: str) -> tuple[fs.FileSystem, str]:
    # "file:/x" and "/x" name the same local file; other schemes go to their own file system.
    local = re.match(r"(?:file:)?(/.*)", path)
    if local:
        return fs.LocalFileSystem(), re.sub("^/+", "/", local[1])
    return fs.FileSystem.from_uri(path)


def open_output(path: str):
    """A stream to a new file; folders are made."""
    system, name = _at(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    return system.open_output_stream(name, compression=None)


def open_input(path: str):
    """A seekable file."""
    system, name = _at(path)
    return system.open_input_file(name)


def write_bytes(spark: SparkSession, path: str, data: bytes, overwrite: bool = True) -> None:
    """Write a small file from the driver through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, overwrite)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
