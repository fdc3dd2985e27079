"""Session helpers shared by all operators: worker import path and reliable checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


#: What lets Python workers, which live on between stages, reuse memory within a task and give it back behind one.
FRUGAL = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(16 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}
#: Bytes of an Arrow batch sent to a Python worker, where the session doesn't set its own; Spark's default is eight times as much.
BATCH_BYTES = 8 << 20


def share_path(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver imported it, send them batches of bounded bytes and have them free memory.

    On a cluster the package is installed on every node and the path changes nothing.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    for name, value in FRUGAL.items():
        env.setdefault(name, value)
    if ROOT not in path.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{path}" if path else ROOT


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function for mapInArrow, which gives a worker's freed memory back to the system at a task's end."""

    def trimmed(batches: Iterator) -> Iterator:
        import ctypes
        import gc

        yield from run(batches)
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return trimmed


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, which the session names; only a local session gets one under /tmp if it names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or f"/tmp/checkpoints/{uuid.uuid4().hex}")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, *by: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared checkpoint folder, for results that are read more than once or in part.

    ``by`` names columns by whose values the files are laid out; they come last in what is read.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
