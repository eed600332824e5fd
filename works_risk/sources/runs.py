"""Runs of a job that are published whole.

A run writes its tables into a folder of its own, which nobody reads until the run commits: one small numbered file that names
the folder and its tables. A run that breaks off leaves no commit, so readers go on with the run before it. Two runs that
finish at once take different numbers, because a commit file is never overwritten.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from works_risk.sources.files import write_bytes

_COMMITS = "commits"


def begin(out: str) -> str:
    """A folder for the tables of a new run."""
    return f"{out}/runs/{uuid.uuid4().hex}"


def _commits(spark: SparkSession, out: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/{_COMMITS}/*.json")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted((status.getPath().getName() for status in found), reverse=True)


def commit(spark: SparkSession, out: str, run: str, tables: list[str]) -> None:
    """Make ``run`` the newest run of ``out``."""
    names = _commits(spark, out)
    number = int(names[0].partition(".")[0]) + 1 if names else 0
    text = json.dumps({"run": run, "tables": sorted(tables)}).encode()
    for number in range(number, number + 1000):
        try:
            write_bytes(spark, f"{out}/{_COMMITS}/{number:012d}.json", text, overwrite=False)
            return
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
                raise
    raise RuntimeError(f"no free commit number in {out}")


def newest(spark: SparkSession, out: str, tables: tuple[str, ...] = ()) -> str | None:
    """The folder of the newest committed run that has ``tables``, or None. A commit file that was cut off does not count."""
    for name in _commits(spark, out):
        text = spark.read.text(f"{out}/{_COMMITS}/{name}", wholetext=True).first()
        try:
            held = json.loads(text["value"]) if text else {}
        except ValueError:
            continue
        if set(tables) <= set(held.get("tables", ())) and "run" in held:
            return held["run"]
    return None
