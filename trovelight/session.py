"""Session helpers: a tuned session for local runs, table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Shuffle files of a query go when it ends; by default they stay until the driver collects its garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "trovelight", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TROVE_DRIVER_MEMORY", "12g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session (tests, a laptop) may leave that setting out: it gets a temporary folder,
    removed at its end. On a cluster a folder of one machine would hold data that the others can't
    read, so there a missing setting is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="trovelight-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return named or context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> str:
    """The URI of a new folder in the shared one, with ``df`` as Parquet."""
    root = shared_dir(df.sparkSession)
    folder = f"{root if '://' in root or root.startswith('file:') else 'file://' + root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return it read back.

    A lost executor then costs no recomputation of the loop behind it.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written to a folder as compressed Parquet and read back; a checkpoint isn't compressed."""
    compact(df, folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def compact(df: DataFrame, folder: str) -> None:
    """Write Parquet with zstd, and with dictionaries large enough for a file's digests."""
    df.write.options(**{"compression": "zstd", "parquet.dictionary.page.size": str(16 << 20)}).parquet(folder)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files are removed as soon as it ends, so that a chain of jobs needs the disk of its largest."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)
