"""ANSI-SQL building blocks for the DuckDB oracle strings.

These restate, independently, what the DataFrame operators compute, so the
driver can check each registered query against a second engine.  DuckDB traps
handled here: integer division is ``//``, ``CAST(double AS INT)`` rounds (use
``trunc``), ``isodow`` is Monday = 1, ``count`` of a filter is BIGINT.
"""

from __future__ import annotations

from rostercast.sources.driver_tables import daily_ops_sql


def daily_cte(series_col: str | None = None) -> str:
    return f"daily AS ({daily_ops_sql(series_col)})"


def easter_ctes(src: str, date_col: str = "date") -> str:
    """CTEs ending in ``easter(y, easter)`` for the years present in ``src``."""
    return f"""yrs AS (SELECT DISTINCT CAST(year({date_col}) AS INTEGER) AS y FROM {src}),
e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM yrs),
e2 AS (SELECT y, a, b, c, b // 4 AS d, b % 4 AS e, (b + 8) // 25 AS f FROM e1),
e3 AS (SELECT y, a, b, c, d, e, (b - f + 1) // 3 AS g FROM e2),
e4 AS (SELECT y, a, c, e, (19 * a + b - d - g + 15) % 30 AS h FROM e3),
e5 AS (SELECT y, a, h, (32 + 2 * e + 2 * (c // 4) - h - (c % 4)) % 7 AS l FROM e4),
e6 AS (SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n FROM e5),
easter AS (SELECT y, make_date(y, CAST(n // 31 AS INTEGER), CAST(n % 31 + 1 AS INTEGER)) AS easter FROM e6)"""


def holiday_expr(d: str = "t.date", easter: str = "e.easter") -> str:
    nov23 = f"make_date(CAST(year({d}) AS INTEGER), 11, 23)"
    back = f"((isodow({nov23}) - 1 - 2 + 7) % 7)"
    repentance = f"({nov23} - CAST(CASE WHEN {back} = 0 THEN 7 ELSE {back} END AS INTEGER))"
    return f"""CAST(CASE WHEN year({d}) >= 1990 AND (
      (month({d}) = 1 AND day({d}) = 1) OR (month({d}) = 5 AND day({d}) = 1)
      OR (month({d}) = 10 AND day({d}) = 3) OR (month({d}) = 12 AND day({d}) IN (25, 26))
      OR date_diff('day', {easter}, {d}) IN (-2, 1, 39, 50)
      OR {d} = DATE '2017-10-31'
      OR (year({d}) <= 1994 AND {d} = {repentance})) THEN 1 ELSE 0 END AS INTEGER)"""


def calendar_cols(d: str = "t.date") -> str:
    return f"""CAST(isodow({d}) - 1 AS INTEGER) AS day_of_week,
  CAST(weekofyear({d}) AS INTEGER) AS week,
  CAST(month({d}) AS INTEGER) AS month,
  CAST((month({d}) % 12) // 3 + 1 AS INTEGER) AS season,
  CAST(year({d}) AS INTEGER) AS year"""


def week_of_month_expr(d: str = "t.date") -> str:
    return f"CAST((day({d}) + isodow(CAST(date_trunc('month', {d}) AS DATE)) - 1 - 1) // 7 + 1 AS INTEGER)"


def modeling_ctes(series_col: str | None = None) -> str:
    """``daily`` + ``modeling`` (the prepared table) as CTE text (no WITH)."""
    key = "t.series, " if series_col else ""
    return f"""{daily_cte(series_col)},
{easter_ctes('daily')},
modeling AS (
SELECT {key}t.date, t.n_sick, t.calls, t.n_duty, t.sby_need, t.dafted,
  t.sby_need / NULLIF(t.n_sby, 0) * 100 AS activation_rate,
  {calendar_cols('t.date')},
  {holiday_expr('t.date', 'e.easter')} AS holiday
FROM daily t JOIN easter e ON e.y = year(t.date))"""
