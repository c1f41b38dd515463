"""Helpers shared by the text operators: shared scratch tables, checked broadcasts, ASCII text rules."""

from __future__ import annotations

import ctypes
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: Rows and bytes (arrays and texts by their length) that a broadcast side may have at most; beyond that the join is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20

#: The white space of the text contracts: space and TAB to CR.
SPACES = " \t\n\x0b\x0c\r"

#: Arrow types by Spark's names.
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}

#: Texts that a worker has as Python objects at once, and the bytes of text that it works on in Arrow at once (one text at least).
CHUNK, PART = 256, 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share (spark.checkpoint.dir). Where it is unset, a temporary one on a local master, as in tests; elsewhere an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='factweave-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: a cut of the lineage that outlives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(df: DataFrame) -> Column:
    """About how many bytes a row has."""
    wide = [F.length(f.name) if isinstance(f.dataType, (StringType, BinaryType)) else F.size(f.name) * 8 for f in df.schema if isinstance(f.dataType, (StringType, BinaryType, ArrayType))]
    return reduce(lambda a, b: a + b, [F.coalesce(w, F.lit(0)) for w in wide], F.lit(16 + 8 * len(df.columns)))


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and bytes; else as it is, for a shuffled join."""
    held = df.select(_width(df).alias("bytes")).limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
    return F.broadcast(df) if held["n"] <= rows and (held["bytes"] or 0) <= size else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean_worker() -> None:
    """Lets this worker give back what Arrow frees; Arrow's own pool would keep it for the life of the process."""
    pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Returns what this worker has freed to the machine; workers stay for later tasks, and the allocator would keep it."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def parts_of(batch: pa.RecordBatch, size: int = PART) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with text that hold about size bytes of it, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def chunks_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most CHUNK rows and about PART bytes of text."""
    for part in parts_of(batch):
        for at in range(0, part.num_rows, CHUNK):
            yield part.slice(at, CHUNK)


def texts_of(part: pa.RecordBatch) -> pa.Array:
    """The texts of a part, null as empty."""
    return pc.fill_null(part.column("text").cast(pa.string()), "")


def per_part(docs: DataFrame, setup: Callable[[], Callable[[pa.Array], list[pa.Array]]], **columns: str) -> DataFrame:
    """As per_text(), for functions that take the texts of some rows as an Arrow array and return Arrow arrays, one for each column."""
    names, kinds = list(columns), [ARROW[kind] for kind in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        of = setup()
        for batch in batches:
            for part in parts_of(batch):
                made = [a.cast(k) for a, k in zip(of(texts_of(part)), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], ["doc_id", *names])
        give_back()

    schema = ", ".join(["doc_id long", *(f"{n} {k}" for n, k in columns.items())])
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)


def per_text(docs: DataFrame, setup: Callable[[], Callable[[list[str]], list[tuple]]], **columns: str) -> DataFrame:
    """doc_id and, from each row's whole text (null: empty), the columns that a function makes for each of some texts.

    setup runs once in a task and returns that function; columns are Spark type names (of ARROW) by column name.
    Rows are judged one by one in Arrow batches: repeated rows repeat, a null doc_id stays null, other columns are left out.
    """
    names, kinds = list(columns), [ARROW[kind] for kind in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        of = setup()
        for batch in batches:
            for part in chunks_of(batch):
                made = of([text or "" for text in part.column("text").to_pylist()])
                cells = zip(*made, strict=True) if made else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cells, kinds, strict=True))], ["doc_id", *names])
        give_back()

    schema = ", ".join(["doc_id long", *(f"{n} {k}" for n, k in columns.items())])
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)


def keep_texts(docs: DataFrame, setup: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of docs, all columns unchanged, for whose whole text (null: empty) a function says so; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        of = setup()
        for batch in batches:
            for part in chunks_of(batch):
                yield part.filter(pa.array(of([text or "" for text in part.column("text").to_pylist()]), pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't in gone; a null doc_id stays."""
    return docs.join(small_enough(gone.select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)
