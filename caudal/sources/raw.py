"""Raw text sources. Columns stay strings: silver re-establishes the types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal.schemas import as_text

CORRUPT = "_corrupt"


def with_corrupt(schema: T.StructType) -> T.StructType:
    return as_text(schema).add(CORRUPT, T.StringType(), True)


# For batch and stream alike. A header in another order than the schema is an error:
# columns are never taken by position from a file that names them otherwise.
OPTIONS: dict[str, dict] = {
    "csv": {
        "header": True,
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
        "escape": '"',
        "enforceSchema": False,
    },
    "json": {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
}


def read_text(spark: SparkSession, path: str, schema: T.StructType, kind: str = "csv") -> DataFrame:
    """Headered CSV or JSON lines as text; a malformed line is kept whole in ``_corrupt``."""
    return spark.read.schema(with_corrupt(schema)).options(**OPTIONS[kind]).format(kind).load(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read_text(spark, path, schema, "csv")


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read_text(spark, path, schema, "json")


def write_csv(df: DataFrame, path: str) -> None:
    """Headered CSV, one file per task."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_fields(column: str, schema: T.StructType) -> list:
    """Typed fields of a JSON text column; a text that is no JSON gives nulls."""
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    return [parsed[name].alias(name) for name in schema.names]
