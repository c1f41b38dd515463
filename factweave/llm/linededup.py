"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

Documents come in batches of descending doc_id. A run has one row for each line key of a batch (128 bits of hash, the
number of documents that hold it, the largest doc_id among them), bucketed and sorted by the hash and kept in the shared
folder. A new batch is merge-anti-joined with the runs: keys that the runs already know from enough documents have their
verdict and their last holder, so only the others make the batch's own run. When a level has FANOUT runs they are
compacted into one run of the next level. All runs have the same buckets, so merges and compactions shuffle nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import SPACES, ascii_lower, scratch_path, settle, small_enough

FANOUT, BATCHES = 2, 3
KEY = ["key_a", "key_b"]


def lines_of(text: Column) -> Column:
    """The text cut at line feeds; null and empty are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("key_a"), F.xxhash64(F.lit(7), key).alias("key_b")]


class LineRuns:
    """The levels of runs of one store."""

    def __init__(self, spark: SparkSession, enough: int):
        self.spark, self.enough = spark, enough
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", scratch_path(self.spark, "run")).saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        def both(left: DataFrame, right: DataFrame) -> DataFrame:
            other = right.withColumnsRenamed({"n_docs": "n", "last_doc": "last"}).hint("merge")
            docs, last = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0)), F.greatest("last_doc", "last")
            return left.join(other, KEY, "full").select(*KEY, docs.alias("n_docs"), last.alias("last_doc"))

        return reduce(both, [self.spark.table(n) for n in names])

    def absorb(self, batch: DataFrame) -> None:
        """Adds a batch's keys (KEY, n_docs, last_doc; one row for each key). Batches come with descending doc_id."""
        for run in [n for level in self.levels for n in level]:
            settled = self.spark.table(run).where(F.col("n_docs") >= self.enough)
            batch = batch.join(settled.hint("merge"), KEY, "left_anti")
        self.levels[0].append(self._write(batch))
        for level, names in enumerate(self.levels):
            if len(names) >= FANOUT:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(self._merged(names)))
                self.levels[level] = []
                for name in names:
                    self.spark.sql(f"DROP TABLE {name}")

    def repeated(self) -> DataFrame:
        """The keys that enough documents hold, with the largest doc_id that does."""
        return self._merged([n for level in self.levels for n in level]).where(F.col("n_docs") >= self.enough)

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE {name}")
        self.levels = [[]]


def keys_of(docs: DataFrame, shortest: int) -> DataFrame:
    """The rows of a run for docs: each row of docs counts once for a key, however often it repeats the line."""
    keys = F.array_distinct(F.transform(lines_of(F.col("text")), line_key))
    rows = docs.select("doc_id", F.explode(keys).alias("key")).where(F.length("key") >= shortest)
    return rows.groupBy(*hashes(F.col("key"))).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def repeated_lines(docs: DataFrame, shortest: int, enough: int, batches: int = BATCHES) -> DataFrame:
    """KEY, last_doc of each key of at least shortest code points that at least enough rows of docs hold."""
    bounds = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(b) for b in bounds}, reverse=True)
    store = LineRuns(docs.sparkSession, enough)
    doc_id = F.col("doc_id")
    for high, low in zip([None, *cuts], [*cuts, None], strict=True):
        inside = F.lit(True) if high is None else doc_id < high
        inside = (inside if high is None else inside | doc_id.isNull()) if low is None else inside & (doc_id >= low)
        store.absorb(keys_of(docs.where(inside), shortest))
    found = settle(store.repeated().select(*KEY, "last_doc"), "repeated")
    store.close()
    return found


def dedup_lines(docs: DataFrame, shortest: int = 20, enough: int = 3) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped added (these names replace columns of the same name).

    Keys are lines stripped of ASCII white space with A-Z lower-cased. Keys of at least shortest code points that at least
    enough documents hold lose all their lines except in the largest doc_id that holds them; other lines stay, in order.
    Null and empty texts are one empty line. Each row counts as a document: rows that repeat a doc_id are several, and all
    of them keep the line if theirs is the largest. A null doc_id is below all others; keys that only such rows hold stay.
    An empty table gives an empty result. Keys are compared by 128 bits of hash.
    """
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = small_enough(repeated_lines(plain, shortest, enough).withColumnRenamed("last_doc", "_last"))
    cells = plain.select("doc_id", F.xxhash64("text").alias("__ld_text"), F.posexplode(lines_of(F.col("text"))).alias("_at", "_line"))
    key = line_key(F.col("_line"))
    cells = cells.select("doc_id", "__ld_text", "_at", key.alias("_key")).where(F.length("_key") >= shortest).select("doc_id", "__ld_text", "_at", *hashes(F.col("_key")))
    older = F.col("_last").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") < F.col("_last")))
    gone = cells.join(found, KEY).where(older).groupBy(F.col("doc_id").alias("__ld_doc"), "__ld_text").agg(F.collect_set("_at").alias("__ld_gone"))
    same = docs["doc_id"].cast("long").eqNullSafe(gone["__ld_doc"]) & (F.xxhash64(docs["text"]) == gone["__ld_text"])
    joined = docs.join(gone, same, "left")
    lines, dropped = lines_of(F.col("text")), F.coalesce(F.size("__ld_gone"), F.lit(0))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__ld_gone")
    kept = F.when(F.col("__ld_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))
    return joined.withColumns({"kept_text": kept, "n_lines": F.size(lines).cast("long"), "n_dropped": dropped.cast("long")}).drop("__ld_doc", "__ld_text", "__ld_gone")


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of dedup_lines()."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
