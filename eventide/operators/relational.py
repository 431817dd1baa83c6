"""Filters, search, sort, paging, joins and set operations (R/J/U-rows).

Plain DataFrame expressions so Catalyst pushes predicates and projections to
the scan; paging uses ``orderBy().offset().limit()`` (top-k, no full sort
materialized); joins against bounded tables are broadcast only behind a row
count check.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 1_000_000


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows (checked)."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def filter_by(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Equality / IN per field, ANDed; unknown fields are ignored."""
    conds = []
    for k, v in filters.items():
        if k not in df.columns:
            continue
        if isinstance(v, (list, tuple, set)):
            conds.append(F.col(_q(k)).isin(list(v)))
        else:
            conds.append(F.col(_q(k)) == F.lit(v))
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def search(df: DataFrame, term: str, cols: Sequence[str]) -> DataFrame:
    """Case-insensitive substring match on any of ``cols``."""
    t = term.lower()
    conds = [F.coalesce(F.lower(F.col(_q(c)).cast("string")).contains(t), F.lit(False)) for c in cols]
    return df.where(reduce(lambda a, b: a | b, conds))


def search_any(df: DataFrame, term: str) -> DataFrame:
    """Like ``search`` over every column cast to string; nulls never match."""
    return search(df, term, df.columns)


def sort_by(df: DataFrame, col: str, direction: str = "asc", key: str | None = None) -> DataFrame:
    """Typed sort with an optional unique key as tie-break."""
    c = F.col(_q(col))
    o = [c.desc_nulls_last() if direction.lower().startswith("desc") else c.asc_nulls_last()]
    if key and key != col:
        o.append(F.col(_q(key)).asc())
    return df.orderBy(*o)


def page(df: DataFrame, page_no: int, limit: int, order: Sequence[str]) -> tuple[DataFrame, dict]:
    """One page of rows (1-based) plus total and total pages."""
    total = df.count()
    rows = df.orderBy(*[F.col(_q(c)) for c in order]).offset((page_no - 1) * limit).limit(limit)
    return rows, {"total": total, "page": page_no, "limit": limit,
                  "total_pages": math.ceil(total / limit) if limit else 0}


def range_filter(df: DataFrame, date_col: str | None = None, date_range=None,
                 cat_col: str | None = None, categories=None, num_col: str | None = None,
                 min_value=None, max_value=None, sort: str | None = None,
                 descending: bool = False) -> DataFrame:
    """Date range, category set and numeric bounds, then optional sort."""
    out = df
    if date_col and date_range:
        lo, hi = date_range
        if lo is not None:
            out = out.where(F.col(_q(date_col)) >= F.lit(lo).cast("timestamp"))
        if hi is not None:
            out = out.where(F.col(_q(date_col)) <= F.lit(hi).cast("timestamp"))
    if cat_col and categories:
        out = out.where(F.col(_q(cat_col)).isin(list(categories)))
    if num_col and min_value is not None:
        out = out.where(F.col(_q(num_col)) >= min_value)
    if num_col and max_value is not None:
        out = out.where(F.col(_q(num_col)) <= max_value)
    if sort:
        out = out.orderBy(F.col(_q(sort)).desc() if descending else F.col(_q(sort)).asc())
    return out


def status_counts(df: DataFrame, status: str) -> DataFrame:
    """Rows per status."""
    return df.groupBy(F.col(_q(status)).alias("status")).agg(F.count(F.lit(1)).alias("count"))


def recent(df: DataFrame, ts: str, n: int = 5, key: str | None = None) -> DataFrame:
    """The n newest rows (top-k, ties broken by key descending)."""
    o = [F.col(_q(ts)).desc()] + ([F.col(_q(key)).desc()] if key else [])
    return df.orderBy(*o).limit(n)


def accessible(df: DataFrame, acl: DataFrame, user, key: str, owner: str, public: str,
               acl_user: str, acl_key: str, right: str | None = None) -> DataFrame:
    """Rows the user owns, that are public, or whose key the ACL grants.

    The user's grants are reduced to distinct keys first; they join with a
    left join because the grant is ORed with the owner/public predicates.
    """
    grants = acl.where(F.col(_q(acl_user)) == F.lit(user))
    if right:
        grants = grants.where(F.col(_q(right)))
    keys = grants.select(F.col(_q(acl_key)).alias(key)).distinct().withColumn("_granted", F.lit(True))
    j = df.join(maybe_broadcast(keys), on=key, how="left")
    cond = (F.col(_q(owner)) == F.lit(user)) | F.coalesce(F.col(_q(public)), F.lit(False)) | \
        F.col("_granted").isNotNull()
    return j.where(cond).drop("_granted")


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns; names not in the table are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def project_roles(df: DataFrame, time: str, event: str, features: Sequence[str] | None = None,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Select features + time + event (default features: all other columns)."""
    missing = [c for c in [time, event, *(features or [])] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    feats = list(features) if features is not None else \
        [c for c in df.columns if c not in (time, event) and c not in keep]
    return df.select(*[_q(c) for c in [*keep, *feats, time, event]])


def lookup_name(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
                label: str, alias: str | None = None) -> DataFrame:
    """Inner equi-join adding a label from a dimension table."""
    d = dim.select(F.col(_q(dim_key)).alias("_dk"), F.col(_q(label)).alias(alias or label))
    return fact.join(d, F.col(_q(fact_key)) == F.col("_dk"), "inner").drop("_dk")


def split_by_ids(df: DataFrame, id_col: str, train_ids: DataFrame,
                 test_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is in each id list (left-semi joins)."""
    tr = df.join(train_ids.select(F.col(train_ids.columns[0]).alias(id_col)), id_col, "left_semi")
    te = df.join(test_ids.select(F.col(test_ids.columns[0]).alias(id_col)), id_col, "left_semi")
    return tr, te


def attach_features(df: DataFrame, features: DataFrame, id_col: str) -> DataFrame:
    """Align a feature table to rows by key (never by position)."""
    return df.join(features, on=id_col, how="inner")


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """U01"""
    return a.unionByName(b, allowMissingColumns=True)


def time_grid_union(*tables: DataFrame, time: str = "time") -> DataFrame:
    """Distinct times over several curves."""
    out = None
    for t in tables:
        s = t.select(F.col(_q(time)).cast("double").alias("time"))
        out = s if out is None else out.union(s)
    return out.distinct()


def distinct_transitions(df: DataFrame, state: str = "state", next_state: str = "next_state") -> DataFrame:
    """Edges (from_state, to_state) observed in the data."""
    return (df.where(F.col(_q(next_state)).isNotNull())
            .select(F.col(_q(state)).alias("from_state"), F.col(_q(next_state)).alias("to_state"))
            .distinct())


def distinct_states(df: DataFrame, state: str = "state", next_state: str = "next_state") -> DataFrame:
    """nodes = states appearing as origin or destination."""
    a = df.select(F.col(_q(state)).alias("state"))
    b = df.where(F.col(_q(next_state)).isNotNull()).select(F.col(_q(next_state)).alias("state"))
    return a.union(b).distinct()
