"""Small file-system helpers that work on any store Spark can reach."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-folders of a folder; empty when it does not exist."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def stamp(spark: SparkSession, path: str) -> dict:
    """Path, total size and latest change of a folder's files."""
    fs, p = _fs(spark, path)
    latest = 0
    files = fs.listFiles(p, True)
    while files.hasNext():
        latest = max(latest, int(files.next().getModificationTime()))
    return {
        "path": str(fs.makeQualified(p).toString()),
        "size": int(fs.getContentSummary(p).getLength()),
        "mtime": latest,
    }


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """One JSON document as a one-file text table."""
    row = spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The document, or None when it is absent or unreadable."""
    try:
        row = spark.read.text(path).first()
        return json.loads(row["value"]) if row else None
    except (AnalysisException, ValueError):
        return None
