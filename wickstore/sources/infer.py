"""Column types of open-schema JSON records, over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# The scalar types a record column can have.
TYPES = {
    "BOOLEAN": BooleanType(),
    "BIGINT": LongType(),
    "DOUBLE": DoubleType(),
    "STRING": StringType(),
}
MAX_COLUMNS = 10_000


def infer_types(records: DataFrame, json: str) -> DataFrame:
    """``(column, type)`` of every top-level key in the JSON text column.

    Whole numbers and fractions together are DOUBLE, any other mix and every nested value is
    STRING, and a key that is always null is STRING. Only one small row per key and task is
    shuffled.
    """
    spark = records.sparkSession
    parsed = records.select(F.parse_json(json).alias("_record"))
    entries = parsed.lateralJoin(spark.tvf.variant_explode(F.col("_record").outer()))
    typed = entries.select(
        F.col("key").alias("column"), F.schema_of_variant("value").alias("_kind")
    )
    kind = F.col("_kind")
    fraction = kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    known = kind.isin("BOOLEAN", "BIGINT", "VOID") | fraction
    seen = (
        typed.filter(F.col("column").isNotNull())
        .groupBy("column")
        .agg(
            F.bool_or(kind == "BOOLEAN").alias("_bool"),
            F.bool_or(kind == "BIGINT").alias("_whole"),
            F.bool_or(fraction).alias("_fraction"),
            F.bool_or(~known).alias("_other"),
        )
    )
    number = F.col("_whole") | F.col("_fraction")
    return seen.select(
        "column",
        F.when(F.col("_other") | (F.col("_bool") & number), F.lit("STRING"))
        .when(F.col("_bool"), F.lit("BOOLEAN"))
        .when(F.col("_fraction"), F.lit("DOUBLE"))
        .when(F.col("_whole"), F.lit("BIGINT"))
        .otherwise(F.lit("STRING"))
        .alias("type"),
    )


def to_struct(types: DataFrame) -> StructType:
    """The inferred columns as a schema; one row per column reaches the driver."""
    rows = types.limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns")
    rows = sorted(rows, key=lambda row: row["column"])
    if not rows:
        raise ValueError("no columns to infer")
    return StructType([StructField(row["column"], TYPES[row["type"]]) for row in rows])


def typed_records(records: DataFrame, json: str) -> DataFrame:
    """The JSON records as typed columns, with the types inferred from all of them."""
    schema = to_struct(infer_types(records, json))
    return records.select(F.from_json(json, schema).alias("_record")).select("_record.*")
