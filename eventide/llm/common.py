"""Helpers shared by the operators: tables, scratch tables in the shared folder, free names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.session import checkpoint_dir
from eventide.sources.tables import table  # noqa: F401  (re-exported for the queries)

#: Largest table, in rows, that an operator broadcasts after counting it.  The rows are a few
#: numbers each, so this bounds a broadcast to some tens of MB; larger tables are shuffled.
BROADCAST_ROWS = 500_000


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under the folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage like a checkpoint (a lost executor loses nothing), but compressed, with column
    pruning and with a known size for the planner.
    """
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made and nobody reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, n_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast if its counted rows are within ``BROADCAST_ROWS``."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use (Spark compares names without case)."""
    used = {c.lower() for c in df.columns}
    name, k = base, 0
    while name.lower() in used:
        k += 1
        name = f"{base}_{k}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch, column: str = "text", most_bytes: int = 2_000_000):
    """Runs of rows of an Arrow batch whose ``column`` holds about ``most_bytes`` (at least one row), so
    that only their strings are Python objects at a time."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        before = int(ends[a - 1]) if a else 0
        z = max(a + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(a, z - a)
        a = z
    pa.default_memory_pool().release_unused()  # workers live on; what a batch took goes back


def texts(column) -> list[str]:
    """The strings of an Arrow column; null is empty, bytes that are not UTF-8 are replaced."""
    try:
        return ["" if t is None else t for t in column.to_pylist()]
    except UnicodeDecodeError:
        import pyarrow as pa
        return ["" if t is None else t.decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application; call it once no result that reads them is needed."""
    root = scratch_path(spark, "x").rpartition("/")[0]
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
