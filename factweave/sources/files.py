"""JSON lines, seeds and partitioned tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factweave.sources.scratch import shared_dir


def json_round_trip(rows: DataFrame, name: str) -> DataFrame:
    """rows written as JSON lines and read with their schema; nulls are left out of lines and come back as nulls."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def seeds(rows: DataFrame) -> DataFrame:
    """Seed rows are pinned; those without a predicate aren't taken."""
    return rows.where("predicate IS NOT NULL").withColumn("pinned", F.lit(True))


def replace_partitions(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A table partitioned by key, written with rows and then with new in place of the partitions that new has."""
    path = f"{shared_dir(rows.sparkSession)}/table-{uuid.uuid4().hex}"
    rows.repartition(key).write.partitionBy(key).parquet(path)
    new.repartition(key).write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def migrated(path_rows: DataFrame, schema: StructType, defaults: dict[str, object]) -> DataFrame:
    """Rows of an older layout as schema has them: columns that they lack are filled with defaults (null without one), others keep their values."""
    held = set(path_rows.columns)
    return path_rows.select(*[(F.col(f.name) if f.name in held else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema])


def old_layout(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """rows as an earlier version stored them, with these columns only: written to the shared folder and read by the files' own schema."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.select(*columns).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def by_property(statements: DataFrame) -> str:
    """Statements as JSON lines in a folder for each property; returns the path."""
    path = f"{shared_dir(statements.sparkSession)}/statements-{uuid.uuid4().hex}"
    statements.repartition("property").write.partitionBy("property").json(path)
    return path


def scan_property(spark: SparkSession, path: str, schema: str, property_: str) -> DataFrame:
    """The statements of one property from by_property(); only its folder is read."""
    return spark.read.schema(schema).json(path).where(F.col("property") == property_)
