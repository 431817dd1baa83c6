"""Sources and sinks.

Scratch and table locations live under the session's shared checkpoint
folder (``spark.checkpoint.dir``) unless a path is given, never in a
machine-local temp folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.session import checkpoint_dir

VERSIONS = "_versions"


def scratch_path(spark: SparkSession, name: str = "scratch") -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/eventide-{name}-{uuid.uuid4().hex}"


def _nan_to_null(df: DataFrame) -> DataFrame:
    sel = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            sel.append(F.when(F.isnan(F.col(f.name)), None).otherwise(F.col(f.name)).alias(f.name))
        else:
            sel.append(F.col(f.name))
    return df.select(*sel)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Header CSV; inferred types unless a schema is given; NaN becomes NULL."""
    r = spark.read.option("header", True).option("nanValue", "NaN").option("mode", "PERMISSIVE")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return _nan_to_null(r.csv(path))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              lines: bool | None = None) -> DataFrame:
    """A JSON array of records (multi-line) or JSON lines."""
    multi = not lines if lines is not None else not path.endswith((".jsonl", ".ndjson"))
    r = spark.read.option("multiLine", multi)
    if schema is not None:
        r = r.schema(schema)
    return _nan_to_null(r.json(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S03"""
    return spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str, query: str, properties: Mapping[str, str] | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None) -> DataFrame:
    """A SQL query over JDBC; with a partition column the read is split into ranges."""
    r = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("dbtable", f"({query}) AS q").option("partitionColumn", partition_column)
             .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", num_partitions))
    else:
        r = r.option("query", query)
    return r.load()


def read_landed(spark: SparkSession, directory: str, fmt: str = "csv",
                schema: T.StructType | str | None = None) -> DataFrame:
    """Files landed from an API/URL source, read with S01/S02 (batch)."""
    if fmt == "csv":
        return read_csv(spark, directory, schema)
    if fmt in ("json", "jsonl"):
        return read_json(spark, directory, schema, lines=(fmt == "jsonl"))
    return read_parquet(spark, directory)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """CSV with header and no index, JSON records, or parquet."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def write_version(df: DataFrame, root: str, name: str, version: str, steps: Sequence[str] = ()) -> dict:
    """Data under root/name/version=v plus one lineage row in root/_versions."""
    loc = f"{root.rstrip('/')}/{name}/version={version}"
    df.write.mode("overwrite").parquet(loc)
    spark = df.sparkSession
    rows = spark.read.parquet(loc).count()
    meta = spark.createDataFrame(
        [(name, version, loc, json.dumps(list(steps)), int(rows))],
        "name string, version string, location string, steps string, rows long",
    ).withColumn("created_at", F.current_timestamp())
    meta.write.mode("append").parquet(f"{root.rstrip('/')}/{VERSIONS}")
    return {"name": name, "version": version, "location": loc, "rows": rows}


def list_versions(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Versions newest first (created_at desc, version desc)."""
    v = spark.read.parquet(f"{root.rstrip('/')}/{VERSIONS}").where(F.col("name") == name)
    w = Window.orderBy(F.col("created_at").desc(), F.col("version").desc())  # versions table is tiny
    return v.withColumn("rank", F.row_number().over(w))


def read_version(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    """A given version, or the latest."""
    v = list_versions(spark, root, name)
    row = (v.where(F.col("version") == version) if version else v.where(F.col("rank") == 1)).first()
    if row is None:
        raise ValueError(f"no version {version or 'latest'} of {name}")
    return spark.read.parquet(row["location"])


def export_report(tables: Mapping[str, DataFrame], root: str, fmt: str = "json") -> dict:
    """Write each report table as csv or json records."""
    out = {}
    for name, df in tables.items():
        out[name] = write_table(df, f"{root.rstrip('/')}/{name}", fmt)
    return out


def file_stats(df: DataFrame) -> dict:
    """Rows, columns and bytes of the files behind a DataFrame."""
    files = df.inputFiles()
    # Spark lists the files (in a job of its own where there are many); no content is read
    total = df.sparkSession.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] if files else 0
    return {"rows": df.count(), "columns": len(df.columns), "bytes": int(total or 0)}
