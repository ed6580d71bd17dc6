"""Synthetic rows for load tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Categories and first day of the series.
CATEGORIES = ("Vendas", "Marketing", "TI", "RH", "Financeiro")
FIRST_DAY, DAYS = "2023-01-01", 730


def benchmark_rows(spark: SparkSession, rows: int) -> DataFrame:
    """Numbered rows with a category, an amount, a day and a description."""
    n = F.col("id")
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (n % len(CATEGORIES) + 1).cast("int"))
    return spark.range(rows).select(
        n,
        category.alias("categoria"),
        ((n * 7919 % 100000) / 100).cast("decimal(18,4)").alias("valor"),
        F.date_add(F.lit(FIRST_DAY).cast("date"), (n % DAYS).cast("int")).alias("data_ref"),
        F.concat(F.lit("Descrição do item "), n.cast("string")).alias("descricao"),
    )
