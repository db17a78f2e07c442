"""Table schemas: column type text to Spark types, catalogs from JSON, JDBC or a log's own table maps."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = {"tinyint": (T.ByteType(), T.ShortType()), "smallint": (T.ShortType(), T.IntegerType()), "mediumint": (T.IntegerType(), T.IntegerType()), "int": (T.IntegerType(), T.LongType()), "integer": (T.IntegerType(), T.LongType()), "bigint": (T.LongType(), T.DecimalType(20, 0))}
_PLAIN = {"float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(), "datetime": T.TimestampNTZType(), "timestamp": T.TimestampType(), "time": T.StringType(), "year": T.IntegerType(), "bit": T.LongType(), "json": T.StringType(), "enum": T.StringType(), "set": T.StringType()}
_STRINGS = {"char", "varchar", "tinytext", "text", "mediumtext", "longtext"}
_BYTES = {"binary", "varbinary", "tinyblob", "blob", "mediumblob", "longblob", "geometry", "point"}


def spark_type(column_type: str) -> T.DataType:
    """The Spark type for a column type text such as ``int(11) unsigned`` or ``decimal(14,4)``."""
    text = column_type.strip().lower()
    name = re.match(r"[a-z]+", text)
    if not name:
        raise ValueError(f"no column type: {column_type}")
    kind, unsigned = name[0], "unsigned" in text
    if kind in _INTEGERS:
        return _INTEGERS[kind][unsigned]
    if kind in _PLAIN:
        return _PLAIN[kind]
    if kind in _STRINGS:
        return T.StringType()
    if kind in _BYTES:
        return T.BinaryType()
    if kind in ("decimal", "numeric"):
        digits = re.search(r"\((\d+)(?:\s*,\s*(\d+))?\)", text)
        precision, scale = (int(digits[1]), int(digits[2] or 0)) if digits else (10, 0)
        return T.DecimalType(precision, scale) if precision <= 38 else T.StringType()
    raise ValueError(f"column type {column_type} is not supported")


def table_schemas(columns: DataFrame) -> dict[str, tuple[T.StructType, list[str]]]:
    """Schema and primary key by "db.table", of catalog rows.

    ``columns``: (table_schema, table_name, column_name, column_type, ordinal_position, column_key),
    as the information schema has them. A composite key keeps all its columns, in order.
    """
    out: dict[str, tuple[T.StructType, list[str]]] = {}
    for r in columns.orderBy("table_schema", "table_name", "ordinal_position").collect():  # a catalog
        fields, keys = out.setdefault(f"{r['table_schema']}.{r['table_name']}", (T.StructType(), []))
        fields.add(r["column_name"], spark_type(r["column_type"]), True)
        if r["column_key"] == "PRI":
            keys.append(r["column_name"])
    return out


def from_jdbc(spark: SparkSession, options: dict[str, str], db: str) -> DataFrame:
    """Catalog rows of one database through JDBC; the filter reaches the server."""
    return spark.read.format("jdbc").options(**options).option("dbtable", "information_schema.columns").load().where(F.col("table_schema") == db)


def typed(changes: DataFrame, table: str, schema: T.StructType | str, keys: list[str], image: str = "after") -> DataFrame:
    """The changes of one table ("db.table") with its columns typed: the JSON image is parsed by the table's schema."""
    db, name = table.split(".", 1)
    rows = changes.where((F.col("db") == db) & (F.col("tbl") == name))
    row = F.from_json(F.coalesce(F.col(image), F.col("before")), schema)
    return rows.withColumn("row", row).withColumn("pk", F.to_json(F.struct(*[F.col(f"row.{k}") for k in keys])) if keys else F.col("pk"))
