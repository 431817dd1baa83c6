"""Data validation: issue tables (P11) and the survival-table check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.operators.profile import _q, is_numeric_type


class SurvivalDataError(ValueError):
    pass


def validate(df: DataFrame, time: str | None = None, event: str | None = None,
             outlier_z: float = 3.0, key: str | None = None, sample_size: int = 5) -> DataFrame:
    """One row per issue: (issue_type, column_name, severity, affected_rows, description).

    Rules: missing values (warning; error on time/event), non-positive time,
    event outside {0, 1}, numeric outliers beyond ``outlier_z`` standard
    deviations (info).  Two aggregates over the table.
    """
    fields = df.schema.fields
    num = [f.name for f in fields if is_numeric_type(f.dataType)]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(fields):
        aggs.append(F.count(F.when(F.col(_q(f.name)).isNull(), 1)).alias(f"miss_{i}"))
    for i, c in enumerate(num):
        aggs += [F.avg(F.col(_q(c)).cast("double")).alias(f"mu_{i}"),
                 F.stddev_samp(F.col(_q(c)).cast("double")).alias(f"sd_{i}")]
    if time:
        aggs.append(F.count(F.when(F.col(_q(time)) <= 0, 1)).alias("bad_time"))
    if event:
        aggs.append(F.count(F.when(~F.col(_q(event)).cast("double").isin(0.0, 1.0), 1)).alias("bad_event"))
    row = df.agg(*aggs).first().asDict()
    out_aggs = []
    for i, c in enumerate(num):
        mu, sd = row[f"mu_{i}"], row[f"sd_{i}"]
        if sd and sd > 0:
            out_aggs.append(F.count(F.when(F.abs((F.col(_q(c)) - mu) / sd) > outlier_z, 1)).alias(f"o_{i}"))
    orow = df.agg(*out_aggs).first().asDict() if out_aggs else {}
    issues = []
    for i, f in enumerate(fields):
        m = row[f"miss_{i}"]
        if m:
            sev = "error" if f.name in (time, event) else "warning"
            issues.append(("missing_values", f.name, sev, int(m),
                           f"{m} missing values in {f.name}", "impute or drop rows"))
    if time and row.get("bad_time"):
        issues.append(("incorrect_format", time, "error", int(row["bad_time"]),
                       "time must be positive", "drop or correct rows"))
    if event and row.get("bad_event"):
        issues.append(("incorrect_format", event, "error", int(row["bad_event"]),
                       "event must be 0 or 1", "encode the event column"))
    for i, c in enumerate(num):
        o = orow.get(f"o_{i}")
        if o:
            issues.append(("outliers", c, "info", int(o), f"{o} values beyond {outlier_z} sd",
                           "check or winsorize"))
    out = df.sparkSession.createDataFrame(
        issues, "issue_type string, column_name string, severity string, affected_rows long, "
                "description string, suggestion string")
    if key is None or not issues:
        return out
    # capped sample of offending keys per issue: top-k per group by window rank (distributed)
    conds = []
    for it, col, *_ in issues:
        c = F.col(_q(col))
        if it == "missing_values":
            cond = c.isNull()
        elif it == "incorrect_format" and col == time:
            cond = c <= 0
        elif it == "incorrect_format":
            cond = ~c.cast("double").isin(0.0, 1.0)
        else:
            i = num.index(col)
            cond = F.abs((c - row[f"mu_{i}"]) / row[f"sd_{i}"]) > outlier_z
        conds.append(F.when(cond, F.struct(F.lit(it).alias("issue_type"), F.lit(col).alias("column_name"))))
    bad = df.select(F.col(_q(key)).alias("_key"), F.explode(F.filter(F.array(*conds), lambda x: x.isNotNull()))
                    .alias("_i")).select("_key", "_i.issue_type", "_i.column_name")
    w = Window.partitionBy("issue_type", "column_name").orderBy("_key")
    sample = (bad.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample_size)
              .groupBy("issue_type", "column_name")
              .agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", F.col("_key").cast("string").alias("k")))),
                               lambda x: x["k"]).alias("sample_keys")))
    return out.join(sample, ["issue_type", "column_name"], "left")


def survival_violations(df: DataFrame, time: str = "t", event: str = "e") -> dict:
    """Counts of rows breaking the survival-table rules (one aggregate)."""
    for c in (time, event):
        if c not in df.columns:
            raise SurvivalDataError(f"missing column {c!r}")
    t = F.col(_q(time)).cast("double")
    e = F.col(_q(event)).cast("double")
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(t.isNull() | F.isnan(t), 1)).alias("null_time"),
        F.count(F.when(e.isNull(), 1)).alias("null_event"),
        F.count(F.when(t <= 0, 1)).alias("nonpositive_time"),
        F.count(F.when(t == float("inf"), 1)).alias("infinite_time"),
        F.count(F.when(~e.isin(0.0, 1.0), 1)).alias("bad_event"),
    ).first().asDict()
    return row


def validate_survival(df: DataFrame, time: str = "t", event: str = "e") -> DataFrame:
    """Raise with the counts when the table is not a valid survival table."""
    v = survival_violations(df, time, event)
    bad = {k: v[k] for k in v if k != "rows" and v[k]}
    if bad:
        raise SurvivalDataError(f"invalid survival table: {bad}")
    return df


def check_columns(df: DataFrame, cols: Sequence[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise SurvivalDataError(f"missing columns: {missing}")
