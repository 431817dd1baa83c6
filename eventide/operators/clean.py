"""Cleaning and encoding.

Each fitted stage is one aggregate whose result (a handful of constants per
column, or a bounded level list) is applied as a projection.  Fitted values
are returned as plain dicts so they can be stored and reused at predict time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.exprs import event_from_string
from eventide.operators.profile import _q, is_numeric_type
from eventide.operators.quantiles import column_quantiles

MAX_ONE_HOT_LEVELS = 20


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if not is_numeric_type(f.dataType) and f.name not in exclude
            and f.dataType.simpleString() == "string"]


def fit_impute_numeric(df: DataFrame, method: str = "mean", cols: Sequence[str] | None = None) -> dict:
    cols = list(cols) if cols is not None else numeric_columns(df)
    if method == "zero":
        return {c: 0.0 for c in cols}
    if method == "median":
        medians = column_quantiles(df, cols, [0.5]) if cols else {}
        return {c: v[0] for c, v in medians.items() if v[0] is not None}
    if method != "mean":
        raise KeyError(method)
    row = df.agg(*[F.avg(F.col(_q(c)).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"v{i}"] for i, c in enumerate(cols) if row[f"v{i}"] is not None}


def fit_mode(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent non-null value per column, ties to the smallest; all-null -> ''.

    One grouped count per column, reduced by ``max_by`` over a (count, -value)
    ordering — no window over the whole column.
    """
    out = {}
    for c in cols:
        counts = (df.where(F.col(_q(c)).isNotNull()).groupBy(F.col(_q(c)).alias("v"))
                  .agg(F.count(F.lit(1)).alias("n")))
        top = counts.orderBy(F.col("n").desc(), F.col("v").asc()).limit(1).collect()
        out[c] = top[0]["v"] if top else ""
    return out


def impute(df: DataFrame, method: str = "mean", cols: Sequence[str] | None = None) -> DataFrame:
    """mean|median|zero for numeric columns, mode|empty_string for strings."""
    if method in ("mean", "median", "zero"):
        vals = fit_impute_numeric(df, method, cols)
        return apply_fill(df, vals)
    scols = list(cols) if cols is not None else string_columns(df)
    vals = fit_mode(df, scols) if method == "mode" else {c: "" for c in scols}
    return apply_fill(df, vals)


def apply_fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    sel = []
    for c in df.columns:
        if c in values and values[c] is not None:
            dt = df.schema[c].dataType
            sel.append(F.coalesce(F.col(_q(c)), F.lit(values[c]).cast(dt)).alias(c))
        else:
            sel.append(F.col(_q(c)))
    return df.select(*sel)


def normalize(df: DataFrame, method: str = "min_max", exclude: Sequence[str] = (),
              cols: Sequence[str] | None = None) -> DataFrame:
    """X03 min_max (only when max > min) / X04 z_score (sample std, only when std > 0)."""
    cols = list(cols) if cols is not None else numeric_columns(df, exclude)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(_q(c)).cast("double")
        if method == "min_max":
            aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
        else:
            aggs += [F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"b{i}")]
    row = df.agg(*aggs).first() if aggs else None
    sel = []
    for c in df.columns:
        if c in cols:
            i = cols.index(c)
            a, b = row[f"a{i}"], row[f"b{i}"]
            x = F.col(_q(c)).cast("double")
            if method == "min_max" and a is not None and b is not None and b > a:
                sel.append(((x - F.lit(a)) / F.lit(b - a)).alias(c))
                continue
            if method == "z_score" and b is not None and b > 0:
                sel.append(((x - F.lit(a)) / F.lit(b)).alias(c))
                continue
        sel.append(F.col(_q(c)))
    return df.select(*sel)


def levels(df: DataFrame, col: str, max_levels: int | None = None) -> list | None:
    """Sorted distinct non-null values; None if more than ``max_levels``."""
    q = df.select(F.col(_q(col)).alias("v")).where(F.col("v").isNotNull()).distinct()
    if max_levels is not None:
        q = q.limit(max_levels + 1)
    vals = sorted(r["v"] for r in q.collect())
    if max_levels is not None and len(vals) > max_levels:
        return None
    return vals


def one_hot(df: DataFrame, cols: Sequence[str] | None = None,
            max_levels: int = MAX_ONE_HOT_LEVELS - 1) -> DataFrame:
    """String columns with fewer than 20 levels become {col}_{value} 0/1 columns."""
    cols = list(cols) if cols is not None else string_columns(df)
    enc = {}
    for c in cols:
        lv = levels(df, c, max_levels)
        if lv is not None:
            enc[c] = lv
    sel = []
    for c in df.columns:
        if c in enc:
            sel += [F.when(F.col(_q(c)) == F.lit(v), 1).otherwise(0).alias(f"{c}_{v}") for v in enc[c]]
        else:
            sel.append(F.col(_q(c)))
    return df.select(*sel)


def label_encode(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """code = position of the value in its sorted distinct levels; null = -1.

    Codes come from a dense rank over the distinct values (a small table per
    column) joined back, so the level list never has to fit the driver.
    """
    from eventide.operators.split import sorted_dense_rank
    cols = list(cols) if cols is not None else string_columns(df)
    out = df
    for c in cols:
        distinct = df.select(F.col(_q(c)).alias("_lv")).where(F.col("_lv").isNotNull()).distinct()
        codes = sorted_dense_rank(distinct, "_lv").withColumn("_code", F.col("rank") - 1).drop("rank")
        out = (out.join(codes, out[c] == codes["_lv"], "left")
               .withColumn(c, F.coalesce(F.col("_code"), F.lit(-1)).cast("int")).drop("_lv", "_code"))
    return out


def fit_cleaner(df: DataFrame, cols: Sequence[str]) -> dict:
    """Medians for numeric, modes for string covariates."""
    num = [c for c in cols if is_numeric_type(df.schema[c].dataType)]
    st = [c for c in cols if c not in num]
    vals = fit_impute_numeric(df, "median", num) if num else {}
    vals.update(fit_mode(df, st))
    return vals


MAX_ENCODER_LEVELS = 1000


def fit_encoder(df: DataFrame, cols: Sequence[str], max_levels: int = MAX_ENCODER_LEVELS) -> dict:
    """Sorted levels per string covariate (first level is the dropped reference).

    Each level becomes a column, so the level list is bounded (checked)."""
    out = {}
    for c in cols:
        if is_numeric_type(df.schema[c].dataType):
            continue
        lv = levels(df, c, max_levels)
        if lv is None:
            raise ValueError(f"{c!r} has more than {max_levels} levels; use label_encode instead")
        out[c] = lv
    return out


def apply_encoder(df: DataFrame, encoder: Mapping[str, list]) -> DataFrame:
    """One-hot with the first level dropped; unseen levels encode as all zeros."""
    sel = []
    for c in df.columns:
        if c in encoder:
            sel += [F.when(F.col(_q(c)) == F.lit(v), 1.0).otherwise(0.0).alias(f"{c}_{v}")
                    for v in encoder[c][1:]]
        else:
            sel.append(F.col(_q(c)))
    return df.select(*sel)


def encode_event(df: DataFrame, event: str, out: str | None = None) -> DataFrame:
    """Strings via the fixed map; two numeric values map min->0, max->1; else error."""
    out = out or event
    dt = df.schema[event].dataType
    if not is_numeric_type(dt):
        enc = event_from_string(F.col(_q(event)))
        bad = df.where(F.col(_q(event)).isNotNull() & enc.isNull()).limit(1).count()
        if bad:
            raise ValueError(f"cannot encode event column {event!r}")
        return df.withColumn(out, enc.cast("int"))
    r = df.agg(F.min(event).alias("lo"), F.max(event).alias("hi")).first()
    if r["lo"] is None:
        return df.withColumn(out, F.col(_q(event)).cast("int"))
    if not df.where(F.col(_q(event)).isNotNull() & ~F.col(_q(event)).isin(r["lo"], r["hi"])).isEmpty():
        raise ValueError(f"event column {event!r} has more than two values")
    return df.withColumn(out, (F.col(_q(event)) == F.lit(r["hi"])).cast("int")
                         if r["hi"] != r["lo"] else F.col(_q(event)).cast("int"))


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict:
    """Mean and population std per column."""
    row = df.agg(*[x for i, c in enumerate(cols) for x in
                   (F.avg(F.col(_q(c))).alias(f"m{i}"), F.stddev_pop(F.col(_q(c))).alias(f"s{i}"))]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def apply_scaler(df: DataFrame, scaler: Mapping[str, tuple]) -> DataFrame:
    sel = []
    for c in df.columns:
        if c in scaler:
            m, s = scaler[c]
            s = s if s else 1.0
            sel.append(((F.col(_q(c)) - F.lit(m)) / F.lit(s)).alias(c))
        else:
            sel.append(F.col(_q(c)))
    return df.select(*sel)


def clean(df: DataFrame, config: Mapping[str, object], time: str | None = None,
          event: str | None = None) -> DataFrame:
    """Impute -> normalize -> encode -> drop, as configured.

    config keys: ``impute_numeric`` (mean|median|zero), ``impute_categorical``
    (mode|empty_string), ``normalize`` (min_max|z_score), ``encode``
    (one_hot|label), ``drop`` (list).
    """
    from eventide.operators.relational import drop_columns
    out = df
    if config.get("impute_numeric"):
        out = impute(out, str(config["impute_numeric"]))
    if config.get("impute_categorical"):
        out = impute(out, str(config["impute_categorical"]))
    if config.get("normalize"):
        out = normalize(out, str(config["normalize"]), exclude=[c for c in (time, event) if c] +
                        list(config.get("keep", [])))
    if config.get("encode") == "one_hot":
        out = one_hot(out)
    elif config.get("encode") == "label":
        out = label_encode(out)
    if config.get("drop"):
        out = drop_columns(out, list(config["drop"]))
    return out


def prepare(df: DataFrame, time: str, event: str, covariates: Sequence[str],
            keep: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    """Encode event -> impute covariates -> one-hot (drop first) -> validate.

    Returns the model-ready table (keep columns, covariates..., time, event)
    and the fitted state (cleaner values, encoder levels, feature names).
    """
    from eventide.operators.validate import validate_survival
    d = encode_event(df, event)
    cleaner = fit_cleaner(d, covariates)
    d = apply_fill(d, cleaner)
    encoder = fit_encoder(d, covariates)
    d = apply_encoder(d.select(*keep, *covariates, time, event), encoder)
    feats = [c for c in d.columns if c not in (*keep, time, event)]
    d = d.select(*keep, *[F.col(_q(c)).cast("double").alias(c) for c in feats],
                 F.col(_q(time)).cast("double").alias(time), F.col(_q(event)).cast("int").alias(event))
    validate_survival(d, time, event)
    return d, {"cleaner": cleaner, "encoder": encoder, "features": feats}
