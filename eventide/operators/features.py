"""Feature engineering (X11-X14, X16) and time discretisation.

All features are projections; whole-table summaries (X12) come from one
aggregate whose single row of constants is added as literals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators.clean import numeric_columns
from eventide.operators.profile import _q
from eventide.operators.quantiles import column_quantiles, exact_quantiles

# Limits that callers may pass to get a bounded feature set; no limit is the default.
MAX_PAIRWISE = 20
MAX_SERIES_COLS = 10
MAX_INTERACTION_COLS = 10
MAX_POLY_COLS = 5


def pairwise_features(df: DataFrame, cols: Sequence[str] | None = None, exclude: Sequence[str] = (),
                      max_features: int | None = None) -> DataFrame:
    """X11: ft_{a}_plus_{b}, ft_{a}_times_{b}, ft_{a}_div_{b} (a < b alphabetically)."""
    cols = sorted(cols if cols is not None else numeric_columns(df, exclude))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    ops = [("plus", lambda a, b: a + b), ("times", lambda a, b: a * b),
           ("div", lambda a, b: F.try_divide(a, b))]
    new = []
    for name, fn in ops:
        for a, b in pairs:
            if max_features is not None and len(new) >= max_features:
                break
            x, y = F.col(_q(a)).cast("double"), F.col(_q(b)).cast("double")
            new.append(fn(x, y).alias(f"ft_{a}_{name}_{b}"))
    return df.select("*", *new)


def series_features(df: DataFrame, cols: Sequence[str] | None = None, exclude: Sequence[str] = (),
                    by: str | None = None, max_cols: int | None = None) -> DataFrame:
    """Per column sum, median, mean, length, std, var, rms, max, abs max, min (population),
    repeated on every row (``by`` gives per-entity summaries through a join)."""
    cols = list(cols if cols is not None else numeric_columns(df, exclude))[:max_cols]
    if not cols:
        return df
    aggs, names = [], []
    for c in cols:
        x = F.col(_q(c)).cast("double")
        names += [f"ts_{c}_{s}" for s in ("sum", "median", "mean", "length", "std", "var", "rms", "max", "abs_max", "min")]
        aggs += [F.sum(x).alias(f"ts_{c}_sum"),
                 F.avg(x).alias(f"ts_{c}_mean"), F.count(x).alias(f"ts_{c}_length"),
                 F.stddev_pop(x).alias(f"ts_{c}_std"), F.var_pop(x).alias(f"ts_{c}_var"),
                 F.sqrt(F.avg(x * x)).alias(f"ts_{c}_rms"), F.max(x).alias(f"ts_{c}_max"),
                 F.max(F.abs(x)).alias(f"ts_{c}_abs_max"), F.min(x).alias(f"ts_{c}_min")]
    if by:
        medians = exact_quantiles(df, cols, [0.5], by=by)
        stats = df.groupBy(by).agg(*aggs).join(medians, by, "left")
        stats = stats.withColumnsRenamed({f"q{i}_0": f"ts_{c}_median" for i, c in enumerate(cols)})
        return df.join(stats.select(by, *[_q(n) for n in names]), on=by, how="left")
    row = df.agg(*aggs).first().asDict()  # one row of constants
    row |= {f"ts_{c}_median": v[0] for c, v in column_quantiles(df, cols, [0.5]).items()}
    return df.select("*", *[F.lit(row[k]).alias(k) for k in names])


def interaction_features(df: DataFrame, exclude: Sequence[str] = (), max_cols: int | None = None) -> DataFrame:
    """interaction_{a}_x_{b} over the numeric columns (or the first ``max_cols``)."""
    cols = numeric_columns(df, exclude)[:max_cols]
    new = [(F.col(_q(a)).cast("double") * F.col(_q(b)).cast("double")).alias(f"interaction_{a}_x_{b}")
           for i, a in enumerate(cols) for b in cols[i + 1:]]
    return df.select("*", *new)


def polynomial_features(df: DataFrame, exclude: Sequence[str] = (), max_cols: int | None = None) -> DataFrame:
    """{c}_squared for the numeric columns (or the first ``max_cols``)."""
    cols = numeric_columns(df, exclude)[:max_cols]
    return df.select("*", *[(F.col(_q(c)).cast("double") * F.col(_q(c)).cast("double"))
                            .alias(f"{c}_squared") for c in cols])


def engineer(df: DataFrame, config: Mapping[str, bool], exclude: Sequence[str] = (), limits: Mapping[str, int] | None = None) -> DataFrame:
    """Pairwise -> series -> interactions -> polynomial, each when enabled.

    ``limits`` bounds a step by its name, e.g. ``{"pairwise": MAX_PAIRWISE}``."""
    limits = limits or {}
    base = numeric_columns(df, exclude)
    out = df
    if config.get("pairwise"):
        out = pairwise_features(out, base, max_features=limits.get("pairwise"))
    if config.get("series"):
        out = series_features(out, base, max_cols=limits.get("series"))
    if config.get("interactions"):
        out = interaction_features(out, exclude=[c for c in out.columns if c not in base], max_cols=limits.get("interactions"))
    if config.get("polynomial"):
        out = polynomial_features(out, exclude=[c for c in out.columns if c not in base], max_cols=limits.get("polynomial"))
    return out


def time_bins(df: DataFrame, time: str = "t", n: int = 10) -> tuple[DataFrame, list[float]]:
    """Equal-width edges max*j/n; per-row interval index in 1..n."""
    tmax = df.agg(F.max(F.col(time).cast("double"))).first()[0] or 1.0
    width = tmax / n
    b = F.least(F.greatest(F.ceil(F.col(time) / F.lit(width)), F.lit(1)), F.lit(n)).cast("int")
    return df.withColumn("interval", b), [tmax * j / n for j in range(n + 1)]


def person_period(df: DataFrame, time: str = "t", event: str = "e", n: int = 10) -> DataFrame:
    """One row per subject and interval lived; y = 1 only in the interval of the event."""
    binned, _ = time_bins(df, time, n)
    out = binned.withColumn("period", F.explode(F.sequence(F.lit(1), F.col("interval"))))
    y = ((F.col("period") == F.col("interval")) & (F.col(event) == 1)).cast("int")
    return out.withColumn("y", y)
