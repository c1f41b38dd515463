"""A statement store as a Spark data source: a file for each property, sorted by entity, read by property and entity.

    register(spark)
    spark.read.format("statements").load(path).where("property = 'P17' AND entity = 'C7'")

Equality of property picks the folders, equality of entity the row groups of a file. The folder must be one that all machines reach.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from factweave.sources.scratch import shared_dir

SCHEMA = "stmt_id long, entity string, property string, value string, value_type string, rank string, start_q string, end_q string"
_NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StatementSource)


def store(statements: DataFrame) -> str:
    """Writes statements for StatementSource; returns the folder."""
    path = f"{shared_dir(statements.sparkSession)}/store-{uuid.uuid4().hex}"
    laid = statements.select(*_NAMES).withColumn("at", statements["property"]).repartition("at", "entity").sortWithinPartitions("at", "entity")
    laid.write.partitionBy("at").parquet(path)
    return path


@dataclass
class File(InputPartition):
    path: str


class StatementReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names, self.wanted = path, schema.names, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if isinstance(one, EqualTo) and one.attribute in (("property",), ("entity",)) and self.wanted.get(one.attribute[0], one.value) == one.value:
                self.wanted[one.attribute[0]] = one.value
            else:
                yield one

    def partitions(self) -> list[File]:
        files, base = pyarrow.fs.FileSystem.from_uri(self.path)
        folder = f"{base}/at={self.wanted['property']}" if "property" in self.wanted else base
        found = files.get_file_info(pyarrow.fs.FileSelector(folder, recursive=True, allow_not_found=True))
        return [File(info.path) for info in found if info.is_file and info.base_name.endswith(".parquet")]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no file at all
            return
        files, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        test = None
        for name, value in self.wanted.items():
            one = pyarrow.dataset.field(name) == value
            test = one if test is None else test & one
        yield from pyarrow.dataset.dataset(partition.path, filesystem=files).to_batches(columns=self.names, filter=test)


class StatementSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "statements"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return StatementReader(self.options["path"], schema)
