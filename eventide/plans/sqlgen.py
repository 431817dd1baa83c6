"""DuckDB SQL text for the oracle side of the registered queries.

Written independently of the Spark code path: plain windows and aggregates
over the fixture CTEs.
"""

from __future__ import annotations

from eventide.functions.stats import Z95

Z = repr(Z95)


def risk_sql(src: str, strata: list[str], time: str = "t", event: str = "e") -> str:
    """CTE bodies g (grouped) and r (with n_at_risk) over ``src``."""
    s = ", ".join(strata)
    sp = f"PARTITION BY {s}" if strata else ""
    sc = f"{s}, " if strata else ""
    return f"""
g AS (SELECT {sc}CAST({time} AS DOUBLE) AS time, CAST(sum({event}) AS BIGINT) AS n_event,
             CAST(count(*) - sum({event}) AS BIGINT) AS n_censored, count(*) AS leave
      FROM {src} GROUP BY {sc}CAST({time} AS DOUBLE)),
r AS (SELECT *, CAST(sum(leave) OVER ({sp} ORDER BY time DESC
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_at_risk FROM g)"""


def km_sql(src: str, strata: list[str], time: str = "t", event: str = "e") -> str:
    """CTE bodies g, r, c, km (curve with time-0 row, unrounded)."""
    s = ", ".join(strata)
    sp = f"PARTITION BY {s}" if strata else ""
    sc = f"{s}, " if strata else ""
    grp = f"GROUP BY {s}" if strata else ""
    return risk_sql(src, strata, time, event) + f""",
c AS (SELECT *, product(1.0 - CAST(n_event AS DOUBLE) / n_at_risk) OVER w AS survival,
             sum(CASE WHEN n_at_risk = n_event THEN NULL
                      ELSE CAST(n_event AS DOUBLE) / (CAST(n_at_risk AS DOUBLE) * (n_at_risk - n_event))
                 END) OVER w AS gw
      FROM r WINDOW w AS ({sp} ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
km0 AS (SELECT {sc}time, n_at_risk, n_event, n_censored, survival, gw FROM c
        UNION ALL
        SELECT {sc}0.0, count(*), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 1.0, 0.0 FROM {src} {grp}),
km AS (SELECT *,
   CASE WHEN survival >= 1 THEN 1.0 WHEN survival <= 0 THEN 0.0
        ELSE exp(ln(survival) * exp({Z} * sqrt(gw) / (-ln(survival)))) END AS ci_lower,
   CASE WHEN survival >= 1 THEN 1.0 WHEN survival <= 0 THEN 0.0
        ELSE exp(ln(survival) * exp(-{Z} * sqrt(gw) / (-ln(survival)))) END AS ci_upper
   FROM km0)"""
