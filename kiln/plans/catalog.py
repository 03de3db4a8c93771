"""Registered queries (Spark) and their DuckDB oracle SQL.

Every query reads the driver tables under ``sf_dir`` whole (dirty inputs are derived by
value-changing expressions, never by dropping rows) and returns a DataFrame whose column
names and types match the oracle SQL. Computed floating values are rounded to 6 decimals
in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# Shared SQL fragments (DuckDB) mirroring kiln.plans.tables.
SQL_DIRTY_EVENTS = """
SELECT event_id, ts, user_id,
       CASE WHEN event_id % 11 = 0 THEN '   '
            WHEN event_id % 5 = 0 THEN concat('  ', event_type, ' ')
            ELSE event_type END AS event_type,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value
FROM events
"""

# Python str.strip / ^\\s*$ in DuckDB regex syntax
SQL_STRIP = "regexp_replace({c}, '^[\\s\\x0b\\x0c\\x1c\\x1d\\x1e\\x1f\\x85\\xa0]+|[\\s\\x0b\\x0c\\x1c\\x1d\\x1e\\x1f\\x85\\xa0]+$', '', 'g')"


def sql_strip(c: str) -> str:
    return SQL_STRIP.format(c=c)


def sql_iqr_chain(src: str, cols: list[str], prefix: str, k: float = 2.5) -> tuple[str, str]:
    """CTEs applying the sequential IQR filter; returns (ctes, last_name)."""
    parts = []
    cur = src
    for i, c in enumerate(cols):
        b = f"{prefix}_b{i}"
        f = f"{prefix}_f{i}"
        parts.append(f"{b} AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, "
                     f"count({c}) AS n FROM {cur})")
        parts.append(f"{f} AS (SELECT {cur}.* FROM {cur}, {b} WHERE {b}.n <= 1 OR "
                     f"({c} >= q1 - {k}::DOUBLE * (q3 - q1) AND {c} <= q3 + {k}::DOUBLE * (q3 - q1)))")
        cur = f
    return ",\n".join(parts), cur


def sql_clean_events() -> str:
    """CTE chain: dirty events -> trim -> blank -> vacio -> mean fill -> IQR; final CTE 'ce'."""
    iqr, last = sql_iqr_chain("cf", ["event_id", "user_id", "value"], "ci")
    return f"""
de AS ({SQL_DIRTY_EVENTS}),
ct AS (SELECT event_id, ts, user_id, {sql_strip('event_type')} AS event_type, value FROM de),
cb AS (SELECT event_id, ts, user_id,
              coalesce(CASE WHEN regexp_matches(event_type, '^\\s*$') THEN NULL ELSE event_type END, 'vacio')
                AS event_type, value FROM ct),
cf AS (SELECT event_id, ts, user_id, event_type,
              coalesce(value, (SELECT avg(value) FROM cb)) AS value FROM cb),
{iqr},
ce AS (SELECT * FROM {last})"""


# ----------------------------------------------------------------------------- flagship
FLAGSHIP_SQL = f"""
WITH {sql_clean_events()},
d AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS total FROM ce GROUP BY 1, 2),
k AS (SELECT event_type, min(day) AS d0, max(day) AS d1 FROM d GROUP BY 1),
g AS (SELECT event_type, CAST(unnest(generate_series(CAST(d0 AS TIMESTAMP), CAST(d1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM k),
r AS (SELECT g.event_type, g.day, d.total FROM g LEFT JOIN d ON g.event_type = d.event_type AND g.day = d.day),
l AS (SELECT *, lag(total, 1) OVER w AS total_lag_1, lag(total, 2) OVER w AS total_lag_2,
             lag(total, 3) OVER w AS total_lag_3
      FROM r WINDOW w AS (PARTITION BY event_type ORDER BY day)),
e AS (SELECT * FROM l WHERE total IS NOT NULL AND total_lag_1 IS NOT NULL AND total_lag_2 IS NOT NULL
                            AND total_lag_3 IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS rid,
             count(*) OVER (PARTITION BY event_type) AS n FROM e),
p AS (SELECT *, CASE WHEN rid < floor(n * 0.7::DOUBLE) THEN 'train'
                     WHEN rid < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val'
                     ELSE 'test' END AS split,
             total - total_lag_1 AS err FROM s)
SELECT event_type, split, CAST(count(*) AS BIGINT) AS n,
       round(avg(err * err), 6) AS mse, round(sqrt(avg(err * err)), 6) AS rmse,
       round(avg(abs(err)), 6) AS mae,
       round(avg(CASE WHEN abs(total) > 1e-10 THEN abs(err / total) END) * 100, 6) AS mape
FROM p GROUP BY 1, 2
"""


@register("flagship_daily_naive_forecast", FLAGSHIP_SQL)
def q_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kiln.plans.flagship import naive_forecast_eval

    return naive_forecast_eval(spark, sf_dir)
