"""Session defaults and the few cluster settings the library reads."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

# Only settings that help every plan here; sizes (shuffle partitions, memory) are
# left to the cluster that runs the job.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "spotweave", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, str(value))
    return ship(builder.getOrCreate())


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application, so that the Python
    workers find it wherever they run."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        package = Path(__file__).resolve().parent
        # The driver serves this file for as long as the application runs.
        folder = tempfile.mkdtemp(prefix="spotweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = f"{folder}/spotweave.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(archive)
    return spark


# About 50 bytes a row: what a broadcast side may take in every executor.
BROADCAST_ROWS = 4_000_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast when ``df`` (a cached or small table) is counted to be under the
    limit; beyond it the join stays a shuffle join that AQE can split."""
    return F.broadcast(df) if df.count() <= limit else df


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partitions ``df`` for a step whose work is far larger than its bytes.

    AQE merges partitions by size, which would leave such a step to a few tasks; an
    explicit number of partitions is kept. A group-by on the same columns reuses it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to and read back from the shared folder the cluster names.

    One job, unlike a checkpoint, which computes its input twice, and as safe: the
    files outlive any executor. ``spark.checkpoint.dir`` is used when the session has
    it. Only a session on one machine that names none (a test) gets a temporary folder.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/spotweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a session on one machine may have a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = _local_folder()
    return folder


@lru_cache(maxsize=1)
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="spotweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
