"""Tables in the folder that all machines share, to cut lineages in a way that outlives executors."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a local master, as in tests, and elsewhere an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='factweave-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Rows of a table that may be sent whole to all machines.
SENT = 50_000


def settle(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back. Joins with it go by its rows: a small table is broadcast, a larger one never is.

    Spark itself goes by the bytes of files, which tell little of the memory that their rows take: what repeats is written once.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    return made.hint("broadcast" if made.count() <= SENT else "merge")


def settle_all(**frames: DataFrame) -> dict[str, DataFrame]:
    """settle() of several tables that don't depend on each other, by name; their jobs run side by side."""
    with ThreadPoolExecutor(4) as pool:
        return dict(zip(frames, pool.map(settle, frames.values(), frames), strict=True))
