"""Profiling, role detection and validation of a table (P-rows).

Every statistic over all columns is one ``agg`` (a single scan); the wide
result row is unpivoted with ``stack`` into one row per column.  Distinct counts and medians of
``column_stats`` come from one pass of value counts (column, value) with a map-side
combine (``value_counts``).  Medians and
percentiles are exact at every size (``operators/quantiles``); sketches
(HyperLogLog++, ``percentile_approx``) are used only where the caller asks
for them with ``exact=False``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.operators.quantiles import column_quantiles, counts_quantiles

# Name fragments used to guess column roles.
TEMPORAL_WORDS = ("time", "date", "year", "month", "day")
TTE_WORDS = ("time", "duration", "survival")
EVENT_WORDS = ("event", "status", "indicator", "death", "recurrence")
DETECT_TIME_WORDS = ("time", "duration", "survival", "follow", "recurrence", "days", "months", "years")
DETECT_EVENT_WORDS = ("event", "status", "indicator", "death", "recurrence", "censored", "observed")
CATEGORICAL_RATIO = 0.2
HIGH_CARDINALITY_RATIO = 0.5


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.NumericType, T.BooleanType))


def is_temporal_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def _has(name: str, words) -> bool:
    low = name.lower()
    return any(w in low for w in words)


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def value_counts(df: DataFrame) -> DataFrame:
    """(_col, _value, _text, _n): each non-null value of each column (by its number) and how often it occurs.

    Numbers are in ``_value``; a type that doubles do not hold exactly has its text in ``_text`` as well."""
    values = []
    for i, f in enumerate(df.schema.fields):
        c, t = F.col(_q(f.name)), f.dataType
        number = F.nanvl(c.cast("double"), F.lit(float("nan"))) + 0.0 if is_numeric_type(t) else F.lit(None).cast("double")
        if isinstance(t, (T.LongType, T.DecimalType)) or isinstance(t, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            text = c.cast("string")
        elif is_numeric_type(t):
            text = F.lit(None).cast("string")
        elif isinstance(t, T.BinaryType):
            text = F.hex(c)
        else:
            text = F.to_json(F.struct(c.alias("v"))) if isinstance(t, (T.ArrayType, T.StructType, T.MapType)) else c.cast("string")
        values.append(F.when(c.isNotNull(), F.struct(F.lit(i).alias("c"), number.alias("v"), text.alias("s"))))
    x = df.select(F.explode(F.filter(F.array(*values), lambda v: v.isNotNull())).alias("x"))
    return x.groupBy(F.col("x.c").alias("_col"), F.col("x.v").alias("_value"), F.col("x.s").alias("_text")).agg(F.count(F.lit(1)).alias("_n"))


def _distinct_and_medians(df: DataFrame, numeric: Sequence[str]) -> tuple[dict, dict]:
    """Exact distinct counts of all columns and medians of the numeric ones, from one pass of value counts."""
    names = df.columns
    counts = value_counts(df).persist()
    found = {r["_col"]: r["n"] for r in counts.groupBy("_col").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a column
    row = None
    if numeric:
        at = [names.index(c) for c in numeric]
        place = F.element_at(F.create_map(*[F.lit(v) for pair in zip(at, range(len(at)), strict=True) for v in pair]), F.col("_col"))
        numbers = counts.where(F.col("_col").isin(at)).groupBy(place.alias("_col"), "_value").agg(F.sum("_n").alias("_n"))
        row = counts_quantiles(numbers, len(at), [0.5]).first()
    counts.unpersist()
    medians = {c: row[f"q{i}_0"] if row else None for i, c in enumerate(numeric)}
    return {c: found.get(i, 0) for i, c in enumerate(names)}, medians


def column_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column with type flags, missing, distinct, min/max/mean/median.

    ``exact=False`` asks for sketches of the distinct counts and medians."""
    fields = df.schema.fields
    numeric = [f.name for f in fields if is_numeric_type(f.dataType)]
    distinct, medians = _distinct_and_medians(df, numeric) if exact and fields else ({}, {})
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        c = F.col(_q(f.name))
        aggs.append(F.count(c).alias(f"nn_{i}"))
        aggs.append((F.lit(distinct[f.name]) if exact else F.approx_count_distinct(c)).alias(f"nd_{i}"))
        if is_numeric_type(f.dataType):
            x = c.cast("double")
            aggs += [F.min(x).alias(f"mn_{i}"), F.max(x).alias(f"mx_{i}"), F.avg(x).alias(f"av_{i}"),
                     (F.lit(medians[f.name]).cast("double") if exact
                      else F.percentile_approx(x, 0.5, 10000).cast("double")).alias(f"md_{i}")]
    wide = df.agg(*aggs)
    rows_expr = []
    for i, f in enumerate(fields):
        num = is_numeric_type(f.dataType)
        nm = f.name.replace("'", "\\'")
        stat = (f"mn_{i}, mx_{i}, av_{i}, md_{i}" if num else
                "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)")
        rows_expr.append(
            f"'{nm}', '{f.dataType.simpleString()}', {str(num).lower()}, "
            f"{str(is_temporal_type(f.dataType) or _has(f.name, TEMPORAL_WORDS)).lower()}, "
            f"{str(num and _has(f.name, TTE_WORDS)).lower()}, "
            f"{str(num and _has(f.name, EVENT_WORDS)).lower()}, "
            f"_rows - nn_{i}, nd_{i}, {stat}")
    stack = f"stack({len(fields)}, " + ", ".join(rows_expr) + ") AS (column_name, dtype, is_numeric, " \
        "is_temporal, is_time_to_event, is_event_indicator, missing, n_distinct, min, max, mean, median)"
    out = wide.selectExpr("_rows", stack)
    cat = (~F.col("is_numeric")) & (F.try_divide(F.col("n_distinct"), F.col("_rows")) < CATEGORICAL_RATIO)
    return out.select("column_name", "dtype", "is_numeric", F.coalesce(cat, F.lit(False)).alias(
        "is_categorical"), "is_temporal", "is_time_to_event", "is_event_indicator",
        F.col("missing").cast("long").alias("missing"), F.col("n_distinct").cast("long").alias("n_distinct"),
        "min", "max", "mean", "median", F.col("_rows").alias("n_rows"))


def role_candidates(stats: DataFrame) -> DataFrame:
    """(role, column_name) for time and event candidates."""
    t = stats.where("is_time_to_event").select(F.lit("time").alias("role"), "column_name")
    e = stats.where("is_event_indicator").select(F.lit("event").alias("role"), "column_name")
    return t.unionByName(e)


def detect_survival_columns(df: DataFrame) -> dict:
    """Guess (time column, event column) with one aggregate over numeric columns.

    time: numeric and the name has a time word.  event: numeric with values in
    {0,1} or {0,1,2} and an event word in its name; fallback: any numeric
    column with 2-3 distinct values.  The first candidate in column order wins.
    """
    num = [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]
    if not num:
        return {"time": None, "event": None}
    aggs = []
    for i, c in enumerate(num):
        x = F.col(_q(c)).cast("double")
        aggs += [F.bool_and(x.isNull() | x.isin(0.0, 1.0)).alias(f"b01_{i}"),
                 F.bool_and(x.isNull() | x.isin(0.0, 1.0, 2.0)).alias(f"b012_{i}"),
                 F.count_distinct(x).alias(f"nd_{i}")]
    row = df.agg(*aggs).first().asDict()
    time_col = next((c for c in num if _has(c, DETECT_TIME_WORDS)), None)
    ev = [c for i, c in enumerate(num)
          if (row[f"b01_{i}"] or row[f"b012_{i}"]) and _has(c, DETECT_EVENT_WORDS)]
    if not ev:
        ev = [c for i, c in enumerate(num) if 2 <= (row[f"nd_{i}"] or 0) <= 3 and c != time_col]
    return {"time": time_col, "event": ev[0] if ev else None}


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram; the last bin is closed on the right."""
    x = F.col(_q(col)).cast("double")
    mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_lower double, bin_upper double, count long")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.when(x >= F.lit(hi), bins - 1).otherwise(F.floor((x - F.lit(lo)) / F.lit(width))).cast("int")
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = grid.join(counts, "bin", "left")
    return out.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lower"),
                      (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_upper"),
                      F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def shape_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Skewness and kurtosis (population moments) and 1.5 IQR outlier count per column."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(_q(c)).cast("double")
        aggs += [F.skewness(x).alias(f"sk_{i}"), F.kurtosis(x).alias(f"ku_{i}")]
    q = df.agg(*aggs).first().asDict()
    for i, (q1, q3) in enumerate(column_quantiles(df, cols, [0.25, 0.75]).values()):
        q |= {f"q1_{i}": q1, f"q3_{i}": q3}
    out_aggs = []
    for i, c in enumerate(cols):
        x = F.col(_q(c)).cast("double")
        lo = q[f"q1_{i}"] - 1.5 * (q[f"q3_{i}"] - q[f"q1_{i}"]) if q[f"q1_{i}"] is not None else 0.0
        hi = q[f"q3_{i}"] + 1.5 * (q[f"q3_{i}"] - q[f"q1_{i}"]) if q[f"q1_{i}"] is not None else 0.0
        out_aggs.append(F.count(F.when((x < lo) | (x > hi), 1)).alias(f"oc_{i}"))
    oc = df.agg(*out_aggs).first().asDict()
    spark = df.sparkSession
    rows = [(c, q[f"sk_{i}"], q[f"ku_{i}"], int(oc[f"oc_{i}"])) for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "column_name string, skewness double, kurtosis double, "
                                       "outlier_count long")


def top_values(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """The k most frequent values (ties by value) with counts."""
    return (df.groupBy(F.col(_q(col)).alias("value")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("value").asc_nulls_last()).limit(k))


def dataset_summary(stats: DataFrame) -> DataFrame:
    """Rows, columns, numeric/categorical counts, missing cells and percent."""
    return stats.agg(
        F.max("n_rows").alias("total_rows"),
        F.count(F.lit(1)).alias("total_columns"),
        F.count(F.when(F.col("is_numeric"), 1)).alias("numeric_columns"),
        F.count(F.when(F.col("is_categorical"), 1)).alias("categorical_columns"),
        F.count(F.when(F.col("missing") > 0, 1)).alias("columns_with_missing"),
        F.sum("missing").alias("missing_cells"),
        F.round(100.0 * F.sum("missing") / (F.max("n_rows") * F.count(F.lit(1))), 6).alias("missing_percent"))


def column_groups(stats: DataFrame) -> DataFrame:
    """(group, column_name) for categorical/numerical/temporal/missing/high-cardinality."""
    hc = (~F.col("is_numeric")) & (F.col("n_distinct") / F.col("n_rows") > HIGH_CARDINALITY_RATIO)
    parts = [("categorical", F.col("is_categorical")), ("numerical", F.col("is_numeric")),
             ("temporal", F.col("is_temporal")), ("missing", F.col("missing") > 0),
             ("high_cardinality", hc)]
    out = None
    for name, cond in parts:
        p = stats.where(cond).select(F.lit(name).alias("group"), "column_name")
        out = p if out is None else out.unionByName(p)
    return out


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation for every pair (a, b), a <= b, in one aggregate."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    aggs = [F.corr(F.col(_q(a)).cast("double"), F.col(_q(b)).cast("double")).alias(f"r_{k}")
            for k, (a, b) in enumerate(pairs)]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{a}', '{b}', r_{k}" for k, (a, b) in enumerate(pairs))
    return wide.selectExpr(f"stack({len(pairs)}, {stack}) AS (col_a, col_b, r)")


def preview(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """P10: the first n rows by key (top-k, no full sort)."""
    return df.orderBy(F.col(_q(key))).limit(n)


def event_distribution(df: DataFrame, event: str = "e") -> DataFrame:
    """Count and share per event code."""
    c = df.groupBy(F.col(_q(event)).alias("event")).agg(F.count(F.lit(1)).alias("count"))
    total = df.count()
    return c.withColumn("share", F.col("count") / F.lit(float(total)))


def population_summary(df: DataFrame, time: str = "t", event: str = "e",
                       group: str | None = None, numeric: Sequence[str] = ()) -> DataFrame:
    """N, events, median follow-up, group ratio, numeric min/max/median."""
    medians = column_quantiles(df, [time, *numeric], [0.5])
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("long")).alias("events"),
            F.lit(medians[time][0]).cast("double").alias("median_followup")]
    if group:
        aggs.append(F.avg(F.col(group).cast("double")).alias("group_ratio"))
    for c in numeric:
        x = F.col(_q(c)).cast("double")
        aggs += [F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"), F.lit(medians[c][0]).cast("double").alias(f"{c}_median")]
    return df.agg(*aggs)


def _nan_safe(v):
    return v is not None and not (isinstance(v, float) and math.isnan(v))
