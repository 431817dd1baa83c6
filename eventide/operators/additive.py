"""Aalen's additive hazards model.

dB(t) = (X_R' X_R + lambda I)^-1 X_R' dN(t) at each event time, X_R the
design (with intercept) of the risk set.  X_R' X_R is a reverse running sum
of per-time sums of x x' (p(p+1)/2 columns, ``scan.cumulative``); the small
per-time solves run with numpy in ``mapInPandas`` over the time table; B(t)
is a running sum of dB.

With a smoothing penalty s the step at t is drawn toward the step before it,
    dB(t) = (X_R' X_R + (lambda + s) I)^-1 (X_R' dN(t) + s dB(t-)),
an affine map of dB(t-).  Affine maps compose, so the steps are a prefix scan: time is cut into
buckets, each bucket composes its maps into one p x p matrix and a vector, the composed maps give every
bucket's starting step, and the buckets then run on their own (``smoothed_steps``).

Medians are the first event time with S(t) <= 0.5, though H(t) = x' B(t) may rise and fall: a bucket's
least and largest B bound H inside it, a row looks only into buckets that can cross, first to last, and exactly there
(``first_crossing``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.plans.scan import cumulative


@dataclass
class AdditiveModel:
    features: list[str]
    coef_penalizer: float
    cumulative_coef: DataFrame = field(repr=False, default=None)  # time, B_intercept, B_<feature>...

    def names(self):
        return ["intercept"] + self.features

    def predict_cumulative_hazard(self, df: DataFrame, times: Sequence[float], keep=()) -> DataFrame:
        aggs = [F.max_by(F.struct(*[F.col(f"`B_{n}`") for n in self.names()]),
                         F.when(F.col("time") <= float(t), F.col("time"))).alias(f"b{i}")
                for i, t in enumerate(times)]
        row = self.cumulative_coef.agg(*aggs).first()
        vals = []
        for i, t in enumerate(times):
            b = row[f"b{i}"]
            vals.append([0.0] * len(self.names()) if b is None else [float(v) for v in b])
        grid = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("time"),
                                            *[F.lit(v).alias(f"c{j}") for j, v in enumerate(bv)])
                                   for t, bv in zip(times, vals)])).alias("g")
        x = df.select(*keep, *self.features, grid)
        h = F.col("g.c0")
        for j, f in enumerate(self.features, start=1):
            h = h + F.col(f).cast("double") * F.col(f"g.c{j}")
        return x.select(*keep, F.col("g.time").alias("time"), h.alias("cumulative_hazard"),
                        F.exp(-h).alias("survival"))

    def importance(self, spark) -> DataFrame:
        """mean |dB| over event times per feature."""
        c = self.cumulative_coef
        row = c.agg(*[F.avg(F.abs(F.col(f"`dB_{f}`"))).alias(f"i{j}") for j, f in enumerate(self.features)]).first()
        return spark.createDataFrame([(f, float(row[f"i{j}"] or 0.0)) for j, f in enumerate(self.features)],
                                     "feature string, importance double")

    def summary(self, spark) -> DataFrame:
        c = self.cumulative_coef
        parts = []
        for n in self.names():
            parts += [F.avg(F.col(f"`dB_{n}`")).alias(f"{n}_mean"), F.stddev_samp(F.col(f"`dB_{n}`")).alias(f"{n}_std")]
        return c.agg(*parts)


#: Event times of one bucket of the smoothing scan and of the search for a first crossing.
STEP_BUCKET = 50_000
CROSSING_BUCKET = 2048
#: Rows that search one bucket in one task.
CROSSING_ROWS = 200_000


def _time_buckets(table: DataFrame, rows_each: int) -> tuple[DataFrame, int]:
    """``table`` with ``_bucket``: consecutive ranges of time of about ``rows_each`` rows; and how many there are."""
    from eventide.operators.lookup import _buckets, _with_bucket
    splits = _buckets(table, "time", max(1, -(-table.count() // rows_each)))
    return _with_bucket(table, "time", splits), max(1, len(splits) - 1)


def smoothed_steps(table: DataFrame, names: Sequence[str], ridge: float, smoothing: float, rows_each: int = STEP_BUCKET) -> DataFrame:
    """(time, dB_<name>...) from rows (time, M<a>_<b>, v<a>) of event times; see the module text."""
    p = len(names)
    dealt, _ = _time_buckets(table, rows_each)
    dealt = dealt.persist(StorageLevel.MEMORY_AND_DISK)

    def maps(pdf):
        pdf = pdf.sort_values("time")
        m = np.zeros((len(pdf), p, p))
        for a in range(p):
            for b in range(a, p):
                m[:, a, b] = m[:, b, a] = pdf[f"M{a}_{b}"].to_numpy()
        v = np.stack([pdf[f"v{a}"].to_numpy() for a in range(p)], axis=1)
        inverse = np.linalg.inv(m + (ridge + smoothing) * np.eye(p))
        return pdf, smoothing * inverse, np.einsum("tij,tj->ti", inverse, v)

    def compose(key, pdf):
        _, matrix, shift = maps(pdf)
        whole, add = np.eye(p), np.zeros(p)
        for a, b in zip(matrix, shift):
            whole, add = a @ whole, a @ add + b
        return pd.DataFrame({"_bucket": [key[0]], "m": [whole.ravel()], "v": [add]})
    starts, step = {}, np.zeros(p)
    composed = dealt.groupBy("_bucket").applyInPandas(compose, "_bucket int, m array<double>, v array<double>").orderBy("_bucket").collect()
    for r in composed:  # one p x p matrix a bucket of STEP_BUCKET event times
        starts[r["_bucket"]] = step
        step = np.array(r["m"]).reshape(p, p) @ step + np.array(r["v"])

    def run(key, pdf):
        pdf, matrix, shift = maps(pdf)
        out, step = np.empty((len(pdf), p)), starts[key[0]]
        for i, (a, b) in enumerate(zip(matrix, shift)):
            out[i] = step = a @ step + b
        return pd.DataFrame({"time": pdf["time"].to_numpy(), **{f"dB_{n}": out[:, j] for j, n in enumerate(names)}})
    return dealt.groupBy("_bucket").applyInPandas(run, "time double, " + ", ".join(f"`dB_{n}` double" for n in names))


def first_crossing(rows: DataFrame, keep: Sequence[str], values: Sequence, curves: DataFrame, curve_cols: Sequence[str], level: float,
                   rows_each: int = CROSSING_BUCKET) -> DataFrame:
    """keep..., crossing: the first time at which sum of values[j] * curve_cols[j](time) reaches ``level``, null if never.

    ``values`` are columns of ``rows``, one for each of ``curve_cols``; ``curves`` has one row per ``time``.
    """
    import pyarrow as pa

    from eventide.session import cut_lineage
    cols = list(curve_cols)
    table, _ = _time_buckets(curves.select("time", F.array(*[F.col(f"`{c}`") for c in cols]).alias("c")), rows_each)
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    bounds = table.groupBy("_bucket").agg(*[g(F.col("c")[j]).alias(f"{n}{j}") for j in range(len(cols))
                                                                             for g, n in ((F.min, "low"), (F.max, "high"))]).orderBy("_bucket").collect()
    names = np.array([r["_bucket"] for r in bounds])  # one row a bucket of CROSSING_BUCKET event times
    low, high = (np.array([[r[f"{n}{j}"] for j in range(len(cols))] for r in bounds]).reshape(len(bounds), len(cols)) for n in ("low", "high"))
    kind = rows.select(F.struct(*keep).alias("k")).schema["k"].dataType.simpleString()
    pending = rows.select(F.struct(*keep).alias("_key"), F.array(*[F.coalesce(v.cast("double"), F.lit(float("nan"))) for v in values]).alias("x"), F.lit(-1).alias("_bucket"))
    schema = f"_key {kind}, x array<double>, _bucket int, crossing double"

    def matrix(column):
        return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cols))

    def advance(batches):  # to the next bucket in which a row can cross; -2: none
        for b in batches:
            x, at = matrix(pa.chunked_array([b.column("x")])), b.column("_bucket").to_numpy()
            nxt = np.full(len(at), -2)
            for a in range(0, len(at), 4096):
                part = x[a:a + 4096]
                upper = np.maximum(part, 0) @ high.T + np.minimum(part, 0) @ low.T
                can = (upper >= level - 1e-9 * (1 + np.abs(upper))) & (names[None, :] > at[a:a + 4096, None])
                nxt[a:a + 4096] = np.where(can.any(axis=1), names[can.argmax(axis=1)], -2) if len(names) else -2
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("x"), pa.array(nxt.astype(np.int32))], names=["_key", "x", "_bucket"])

    def look(left, right):  # exactly, in one bucket
        right = right.sort_by("time")
        times, c = right.column("time").to_numpy(), matrix(right.column("c"))
        x = matrix(left.column("x")) if left.num_rows else np.empty((0, len(cols)))
        found = np.full(len(x), np.nan)
        for a in range(0, len(x), 1024):
            hit = x[a:a + 1024] @ c.T >= level
            found[a:a + 1024] = np.where(hit.any(axis=1), times[hit.argmax(axis=1)], np.nan) if len(times) else np.nan
        return left.select(["_key", "x", "_bucket"]).append_column("crossing", pa.array(found, from_pandas=True))
    done = []
    while True:
        pending = cut_lineage(pending.mapInArrow(advance, f"_key {kind}, x array<double>, _bucket int"))
        done.append(pending.where("_bucket = -2").select("_key", F.lit(None).cast("double").alias("crossing")))
        pending = pending.where("_bucket >= 0")
        n = pending.count()
        if not n:
            break
        pieces = -(-n // CROSSING_ROWS)
        dealt = pending.withColumn("_piece", F.pmod(F.xxhash64("x", "_key"), F.lit(pieces)).cast("int"))
        copies = table.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))).withColumn("_piece", F.col("_piece").cast("int"))
        seen = cut_lineage(dealt.groupBy("_bucket", "_piece").cogroup(copies.groupBy("_bucket", "_piece")).applyInArrow(look, schema))
        done.append(seen.where("crossing IS NOT NULL").select("_key", "crossing"))
        pending = seen.where("crossing IS NULL").select("_key", "x", "_bucket")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("_key.*", "crossing")


def aalen_additive_fit(df: DataFrame, time: str, event: str, features: Sequence[str],
                       coef_penalizer: float = 0.5, smoothing_penalizer: float = 0.0) -> AdditiveModel:
    feats = list(features)
    p = len(feats) + 1
    xs = [F.lit(1.0)] + [F.col(f).cast("double") for f in feats]
    e = F.col(event).cast("double")
    aggs = [F.sum(e).alias("d")]
    for a in range(p):
        for b in range(a, p):
            aggs.append(F.sum(xs[a] * xs[b]).alias(f"m{a}_{b}"))
    aggs += [F.sum(e * xs[a]).alias(f"v{a}") for a in range(p)]
    tt = df.groupBy(F.col(time).cast("double").alias("time")).agg(*aggs)
    mcols = [f"m{a}_{b}" for a in range(p) for b in range(a, p)]
    tt = cumulative(tt, "time", [], sums={f"M{c[1:]}": c for c in mcols}, descending=True)
    ev = tt.where(F.col("d") > 0)
    lam = coef_penalizer
    names = ["intercept"] + feats

    def solve(it):
        for pdf in it:
            M = np.zeros((len(pdf), p, p))
            for a in range(p):
                for b in range(a, p):
                    M[:, a, b] = M[:, b, a] = pdf[f"M{a}_{b}"].to_numpy()
            M += lam * np.eye(p)[None]
            v = np.stack([pdf[f"v{a}"].to_numpy() for a in range(p)], axis=1)
            dB = np.linalg.solve(M, v[:, :, None])[:, :, 0]
            out = {"time": pdf["time"].to_numpy()}
            for j, nme in enumerate(names):
                out[f"dB_{nme}"] = dB[:, j]
            yield pd.DataFrame(out)

    schema = "time double, " + ", ".join(f"`dB_{n}` double" for n in names)
    table = ev.select("time", *[f"M{a}_{b}" for a in range(p) for b in range(a, p)], *[f"v{a}" for a in range(p)])
    db = smoothed_steps(table, names, lam, smoothing_penalizer) if smoothing_penalizer else table.mapInPandas(solve, schema)
    cum = cumulative(db, "time", [], sums={f"B_{n}": f"`dB_{n}`" for n in names})
    cum = cum.persist(StorageLevel.MEMORY_AND_DISK)
    return AdditiveModel(feats, coef_penalizer, cum)


def additive_risk(model: AdditiveModel, df: DataFrame, keep=(), never: float | None = None) -> DataFrame:
    """risk = cumulative hazard at the last event time; median_time = first event time with S <= 0.5, else ``never``
    (by default the last event time)."""
    keep = list(keep)
    c = model.cumulative_coef
    last = c.agg(F.max("time")).first()[0]
    if last is None:
        return df.select(*keep, F.lit(0.0).alias("risk"), F.lit(never).cast("double").alias("median_time"))
    risk = model.predict_cumulative_hazard(df, [float(last)], keep).select(*keep, F.col("cumulative_hazard").alias("risk"))
    x = df.select(*keep, *[f for f in model.features if f not in keep])
    cross = first_crossing(x, keep, [F.lit(1.0)] + [F.col(f) for f in model.features], c, [f"B_{n}" for n in model.names()], math.log(2.0))
    # one row of each key: repeated keys have equal answers only if their features agree, as before
    risk = risk.groupBy(*keep).agg(F.max("risk").alias("risk"))
    cross = cross.groupBy(*keep).agg(F.min("crossing").alias("crossing"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keep]
    on = same[0] if same else F.lit(True)
    for more in same[1:]:
        on = on & more
    return risk.alias("l").join(cross.alias("r"), on).select(
        *[f"l.{k}" for k in keep], "risk", F.coalesce("crossing", F.lit(float(last) if never is None else never)).alias("median_time"))
