"""External databases over JDBC, and what is common to every external source."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom import types as hub
from tabloom.operators.mapping import canonicalize
from tabloom.plans.scoped_sql import check_read_only


@dataclass(frozen=True)
class Connection:
    """How to reach a database.  ``options`` go to the JDBC reader as they are (user, driver, fetchsize ...)."""

    url: str
    options: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Split:
    """How a table is read in parallel: a numeric, date or timestamp column cut into ranges."""

    column: str
    lower: str
    upper: str
    partitions: int


def jdbc_table(spark: SparkSession, connection: Connection, table: str, split: Split | None = None) -> DataFrame:
    """A table of the database.  Filters, columns and limits of later operators are pushed to it by Spark."""
    reader = spark.read.format("jdbc").options(**connection.options).option("url", connection.url)
    reader = reader.option("dbtable", table)
    if split is not None:
        reader = (
            reader.option("partitionColumn", split.column)
            .option("lowerBound", split.lower)
            .option("upperBound", split.upper)
            .option("numPartitions", split.partitions)
        )
    return reader.load()


def jdbc_query(spark: SparkSession, connection: Connection, query: str, prepare: str | None = None) -> DataFrame:
    """The result of one SELECT run by the database; ``prepare`` is a WITH clause that has to stand before it."""
    check_read_only(spark, f"{prepare} {query}" if prepare else query)
    reader = spark.read.format("jdbc").options(**connection.options).option("url", connection.url)
    reader = reader.option("query", query)
    return (reader.option("prepareQuery", prepare) if prepare else reader).load()


def canonical_type(type_name: Column) -> Column:
    """Canonical type of a database type name, for a listing that is data itself."""
    plain = F.trim(F.lower(F.substring_index(type_name, "(", 1)))
    pairs = [F.lit(x) for canonical, names in hub.SOURCE_TYPE_NAMES.items() for n in names for x in (n, canonical)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), plain), F.lit(hub.TEXT))


def jdbc_listing(spark: SparkSession, connection: Connection) -> DataFrame:
    """Schemas, tables and columns of a database with their canonical types."""
    columns = jdbc_table(spark, connection, "information_schema.columns")
    return columns.select(
        F.col("table_schema").alias("source_schema"),
        F.col("table_name").alias("source_table"),
        F.col("ordinal_position").cast("bigint").alias("ordinal"),
        "column_name",
        canonical_type(F.col("data_type")).alias("sql_type"),
    )


def live_view(df: DataFrame, name: str) -> DataFrame:
    """Register a source as a view that is read anew by each query."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def newer_than(df: DataFrame, column: str, watermark) -> DataFrame:
    """Rows beyond the high-water mark; all of them when there is none yet.  The filter reaches the source."""
    return df if watermark is None else df.where(F.col(column) > F.lit(watermark).cast(df.schema[column].dataType))


def next_watermark(pulled: DataFrame, column: str, watermark=None) -> DataFrame:
    """The mark to store after a pull: the maximum pulled, or the old one when nothing was."""
    kind = pulled.schema[column].dataType
    return pulled.agg(F.coalesce(F.max(column), F.lit(watermark).cast(kind)).alias("watermark"))


def extract(df: DataFrame) -> DataFrame:
    """Rows of a source as the hub stores them."""
    return canonicalize(df)
