"""Reading the tables of a data folder, and their declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.session import prepare
from quillspark.sinks.tables import exists, live_paths


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_prefix(spark: SparkSession, root: str, name: str, required: bool = False, layers: bool = False) -> DataFrame:
    """Base and shards of table ``name`` below ``root`` (S1-S6), in its declared schema; missing columns are null.

    A missing optional table is an empty one of the declared schema. Day partitions prune by their year, month and day.
    With ``layers``, ``_layer`` tells the order of reading: 0 for a base, then shards in the order of their names, so that
    of equal rows the first or last one read can be told.
    """
    prepare(spark)
    schema = schemas.TABLES[name]
    loose = [p for p in (f"{root}/{name.replace('/', '--')}.parquet", f"{root}/{name}.parquet") if exists(spark, p)]
    folder = f"{root}/{name}"
    parts = live_paths(spark, folder) if exists(spark, folder) else []
    paths = [*dict.fromkeys(loose), *(parts or ([folder] if exists(spark, folder) else []))]
    if not paths:
        if required:
            raise FileNotFoundError(f"{root} has no {name}")
        out = spark.createDataFrame([], schema)
        return out.withColumn("_layer", F.lit(0)) if layers else out
    out = None
    for i, path in enumerate(paths):
        df = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(path)
        part = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]).withColumn("_layer", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out if layers else out.drop("_layer")


def load_tables(spark: SparkSession, root: str, required: tuple[str, ...] = ("observations",)) -> dict[str, DataFrame]:
    """All declared tables below ``root``."""
    return {name: read_prefix(spark, root, name, name in required) for name in schemas.TABLES}


def register(tables: dict[str, DataFrame]) -> None:
    """Tables as views for SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def load_index(spark: SparkSession, path: str, dim: int = 384, documents: int | None = None) -> DataFrame:
    """A published index; an error if it hasn't as many documents as its metadata say, or a vector has another size."""
    df = spark.read.parquet(path)
    if documents is not None and (n := df.count()) != documents:
        raise ValueError(f"{n} documents instead of {documents}")
    return df.withColumn("vector", F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector hasn't {dim} numbers"))))


def load_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A published JSON mart (S15); with a schema, it isn't read twice to find one."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def latest_day(cube: DataFrame) -> DataFrame:
    """``day``: the last one of a trend mart; null of an empty one."""
    return cube.agg(F.max("day").alias("day"))


def catalog_counts(spark: SparkSession, names: list[str]) -> DataFrame:
    """``name, rows`` of catalog tables; an error names those that don't exist."""
    unknown = [n for n in names if not spark.catalog.tableExists(n)]
    if unknown:
        raise ValueError("unknown tables: " + ", ".join(sorted(unknown)))
    out = None
    for n in names:
        one = spark.table(n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def read_day(spark: SparkSession, path: str, name: str, day: str) -> DataFrame:
    """One day of a table stored by day partitions, read by partition filters only; empty if there is none."""
    prepare(spark)
    schema = schemas.TABLES[name]
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.parquet(path)
    return df.where((F.col("year").cast("int") == int(day[:4])) & (F.col("month").cast("int") == int(day[5:7])) & (F.col("day").cast("string") == day)).select(*schema.names)
