"""Numbered commits of a folder: files that appear whole, once each, in order. What a commit names is what readers see."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer committed that number first."""


def _file(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)


def commits(spark: SparkSession, folder: str) -> list[dict]:
    """All commits, the first first."""
    if not exists(spark, f"{folder}/commits"):
        return []
    rows = spark.read.option("pathGlobFilter", "*.json").text(f"{folder}/commits", wholetext=True).select("value", F.col("_metadata.file_name").alias("name")).collect()
    return [json.loads(r["value"]) for r in sorted(rows, key=lambda r: r["name"])]


def commit(spark: SparkSession, folder: str, number: int, what: dict) -> None:
    """Makes what the commit of that number, unless it has one.

    The file is written aside and renamed. A rename onto a file that is there fails on a distributed file system; elsewhere
    the check before it leaves a gap in which two writers could meet.
    """
    fs, to = _file(spark, f"{folder}/commits/{number:012d}.json")
    _, aside = _file(spark, f"{folder}/commits/_{uuid.uuid4().hex}")
    fs.mkdirs(to.getParent())
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(what).encode()))
    out.close()
    if fs.exists(to) or not fs.rename(aside, to):
        fs.delete(aside, False)
        raise Conflict(f"{folder}: commit {number} is another writer's")
