"""The closed set of column types a hub table may have, and how other types collapse into it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

BIGINT = "BIGINT"
DECIMAL = "DECIMAL(18,4)"
DATE = "DATE"
DATETIME = "DATETIME2"
TIME = "TIME"
TEXT = "NVARCHAR(MAX)"

SPARK_TYPES: dict[str, T.DataType] = {
    BIGINT: T.LongType(),
    DECIMAL: T.DecimalType(18, 4),
    DATE: T.DateType(),
    DATETIME: T.TimestampNTZType(),
    TIME: T.StringType(),  # held as HH:mm:ss text, Spark's own time type is off by default
    TEXT: T.StringType(),
}

# Source type names and the canonical type each one becomes; every other name is text.
SOURCE_TYPE_NAMES: dict[str, tuple[str, ...]] = {
    BIGINT: ("int2", "int4", "int8", "tinyint", "smallint", "int", "integer", "bigint"),
    DECIMAL: ("numeric", "decimal", "float4", "float8", "float", "real", "double precision", "money", "smallmoney"),
    DATE: ("date",),
    DATETIME: (
        "timestamp", "timestamptz", "timestamp without time zone", "timestamp with time zone",
        "datetime", "datetime2", "smalldatetime", "datetimeoffset",
    ),
    TIME: ("time", "timetz", "time without time zone", "time with time zone"),
}
_BY_NAME = {name: canonical for canonical, names in SOURCE_TYPE_NAMES.items() for name in names}

ROW_HASH = "row_hash"


@dataclass(frozen=True)
class ColumnSpec:
    """One column of a load: its header in the file, its name and type in the table."""

    original_name: str
    sql_name: str
    sql_type: str
    nullable: bool = True


def header_of(field: T.StructField) -> str:
    """The header a column had in its file; its own name if it did not come from one."""
    return field.metadata.get("original_name", field.name)


def canonical_from_name(type_name: str) -> str:
    """Canonical type of a database type name such as ``int4`` or ``numeric(10,2)``."""
    return _BY_NAME.get(type_name.lower().split("(")[0].strip(), TEXT)


def canonical_from_spark(data_type: T.DataType) -> str:
    """Canonical type of a Spark type; whatever has no counterpart is text."""
    if isinstance(data_type, T.IntegralType):
        return BIGINT
    if isinstance(data_type, (T.DecimalType, T.FractionalType)):
        return DECIMAL
    if isinstance(data_type, T.DateType):
        return DATE
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if data_type.typeName().startswith("time("):
        return TIME
    return TEXT


def spark_schema(mapping: list[ColumnSpec]) -> T.StructType:
    """Schema of the table a mapping produces; the header text is kept as field metadata."""
    return T.StructType(
        [
            T.StructField(c.sql_name, SPARK_TYPES[c.sql_type], True, {"original_name": c.original_name})
            for c in mapping
        ]
    )
