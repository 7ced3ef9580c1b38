"""Session helpers: table access, shared scratch tables that cut lineage, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows a side may hold before `small_or_shuffled` refuses to broadcast it.
BROADCAST_ROWS = 200_000
_OWN: list[str] = []
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, so that it need not be installed on the executors."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="factloom-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{folder}/factloom", "zip", os.path.dirname(package), os.path.basename(package)))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one of the project's Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the session names none (tests, local mode) a local folder is made and removed at exit.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="factloom-"))
        atexit.register(shutil.rmtree, _OWN[0][len("file://"):], ignore_errors=True)
    return _OWN[0]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, executors may be lost."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, rows: int | None = None, limit: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast if it is counted and found within ``limit`` rows (BROADCAST_ROWS), else leave it to a shuffle join.

    ``df`` should be a materialised table, so that the count reads footers only.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= (BROADCAST_ROWS if limit is None else limit) else df.hint("shuffle_hash")


def cores() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
