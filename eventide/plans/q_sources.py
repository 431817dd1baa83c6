"""Registered queries: sources and sinks round trips (S-rows).

Each writes the reorder fixture to a fresh folder under the shared checkpoint
folder and reads it back; the oracle is the fixture itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.plans import fixtures as fx
from eventide.plans.registry import register
from eventide.sources import io
from eventide.streaming.landing import ingest_landed, read_ingested

R = fx.with_ctes(fx.REORDER_SQL)
SCHEMA = "id long, cluster long, seg string, price double, prio string, t double, e int, cause int"
ALL = R + "SELECT id, cluster, seg, round(price, 6) AS price, prio, t, e, cause FROM reorder"


def _out(df):
    return df.select("id", "cluster", "seg", F.round("price", 6).alias("price"), "prio", "t", "e", "cause")


@register("csv_roundtrip", ALL)
def csv_roundtrip(spark, sf_dir):
    path = io.scratch_path(spark, "csv")
    io.write_table(fx.reorder(spark, sf_dir), path, "csv")
    return _out(io.read_csv(spark, path, SCHEMA))


@register("json_roundtrip", ALL)
def json_roundtrip(spark, sf_dir):
    path = io.scratch_path(spark, "json")
    io.write_table(fx.reorder(spark, sf_dir), path, "json")
    return _out(io.read_json(spark, path, SCHEMA, lines=True))


@register("parquet_roundtrip", ALL)
def parquet_roundtrip(spark, sf_dir):
    path = io.scratch_path(spark, "parquet")
    io.write_table(fx.reorder(spark, sf_dir), path, "parquet")
    return _out(io.read_parquet(spark, path))


@register("version_roundtrip", R + """
SELECT id, cluster, seg, round(price, 6) AS price, prio, t, e, cause FROM reorder
UNION ALL SELECT id, cluster, seg, round(price, 6), prio, t, e, cause FROM reorder WHERE seg <> 'BUILDING'""")
def version_roundtrip(spark, sf_dir):
    root = io.scratch_path(spark, "versions")
    df = fx.reorder(spark, sf_dir)
    io.write_version(df, root, "reorder", "v1", ["fixture"])
    io.write_version(df.where("seg <> 'BUILDING'"), root, "reorder", "v2", ["fixture", "filter seg"])
    return _out(io.read_version(spark, root, "reorder", "v1")).unionByName(_out(io.read_version(spark, root, "reorder")))


@register("file_stats", "SELECT count(*) AS rows, 6 AS columns FROM orders")
def file_stats_q(spark, sf_dir):
    from eventide.sources.tables import table
    s = io.file_stats(table(spark, sf_dir, "orders"))
    if s["bytes"] <= 0:
        raise ValueError("the table's files have no bytes")
    return spark.range(1).select(F.lit(s["rows"]).cast("long").alias("rows"), F.lit(s["columns"]).alias("columns"))


@register("landed_files", ALL)
def landed_files_q(spark, sf_dir):
    landing = io.scratch_path(spark, "landing")
    table_dir = io.scratch_path(spark, "landed-table")
    df = fx.reorder(spark, sf_dir)
    # two drops of files arrive in the landing folder; each ingest run takes only new files
    io.write_table(df.where("seg < 'F'"), f"{landing}/drop1", "csv")
    ingest_landed(spark, f"{landing}/*", table_dir, SCHEMA, "csv")
    io.write_table(df.where("seg >= 'F'"), f"{landing}/drop2", "csv")
    ingest_landed(spark, f"{landing}/*", table_dir, SCHEMA, "csv")
    return _out(read_ingested(spark, table_dir))
