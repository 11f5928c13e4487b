"""A bounded, read-only SQL surface over tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_READS = re.compile(r"^\s*(?:with|select|describe|show|values|table)\b", re.I)
_WRITES = re.compile(r"\b(?:insert|update|delete|merge|create|alter|drop|truncate|replace|refresh|cache|uncache|set|reset|add|load|msck|grant|revoke)\b", re.I)


def check_read_only(sql: str) -> str:
    """The statement without comments, or an error if it isn't one single read."""
    plain = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().rstrip(";")
    bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", "''", plain)
    if ";" in bare or not _READS.match(plain) or _WRITES.search(bare):
        raise ValueError("only a single reading statement is allowed")
    return plain


def run_sql(spark: SparkSession, tables: dict[str, DataFrame], sql: str, limit: int = 200) -> DataFrame:
    """Rows of a reading statement over the given tables, at most ``limit``; the limit is the feature."""
    statement = check_read_only(sql)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement).limit(limit)


def describe(df: DataFrame) -> DataFrame:
    """``column, type, nullable``."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, type string, nullable boolean")


def profile(df: DataFrame) -> DataFrame:
    """``column, rows, nulls, approx_distinct`` in one pass."""
    one = df.agg(F.count("*").alias("_rows"), *[x for c in df.columns for x in (F.count_if(F.col(c).isNull()).alias(f"{c}|n"), F.approx_count_distinct(F.col(c).cast("string")).alias(f"{c}|d"))])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"`{c}|n`").alias("nulls"), F.col(f"`{c}|d`").alias("approx_distinct")) for c in df.columns])
    return one.select(F.inline(cells))


def find(df: DataFrame, column: str, pattern: str, limit: int = 200) -> DataFrame:
    return df.where(F.col(column).rlike(pattern)).limit(limit)
