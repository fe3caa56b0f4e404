"""Registration helpers and the shared views of the comparison SQL.

Doubles are rounded by the same arithmetic on both sides, since the two engines
add in different orders.  The small surplus over one half decides exact ties
upwards whatever the last bits are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 4

VIEWS = {
    "oc": """SELECT * FROM orders JOIN customer ON o_custkey = c_custkey""",
    "rev": """SELECT CAST(o_orderdate AS DATE) AS ds, l_extendedprice * (1 - l_discount) AS y,
        c_mktsegment AS platform, o_orderpriority AS affiliate, n_name AS campaign, p_brand AS ad,
        CAST(o_custkey AS VARCHAR) AS profile_id
      FROM lineitem JOIN oc ON l_orderkey = o_orderkey
      JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey""",
    "ord": """SELECT CAST(o_orderdate AS DATE) AS ds, o_totalprice AS y, c_mktsegment AS platform,
        CAST(o_custkey AS VARCHAR) AS profile_id, o_orderkey AS purchase_id FROM oc""",
    "leads": """SELECT CAST(o_orderdate AS DATE) AS ds, c_mktsegment AS platform, CAST(count(*) AS DOUBLE) AS leads
      FROM oc GROUP BY 1, 2""",
    "cost": """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS ds, c_mktsegment AS platform,
        sum(l_quantity * p_retailprice * 0.01::DOUBLE) AS cost
      FROM lineitem JOIN oc ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "co_orders": """SELECT CAST(date_trunc('month', f.first_day) AS DATE) AS lead_month,
        CAST(date_trunc('month', o_orderdate) AS DATE) AS transaction_month, o_totalprice AS revenue,
        c_mktsegment AS platform
      FROM oc JOIN (SELECT o_custkey AS k, min(o_orderdate) AS first_day FROM orders GROUP BY 1) f ON o_custkey = f.k""",
    "evd0": """SELECT CAST(ts AS DATE) AS ds, sum(value) FILTER (event_type = 'purchase') AS y,
        CAST(count(*) FILTER (event_type = 'signup') AS DOUBLE) AS leads,
        CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS clicks,
        CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS visits,
        count(*) FILTER (event_type = 'error') AS errors
      FROM events GROUP BY 1""",
    "evd": """SELECT ds, y, leads, clicks, visits,
        CAST(errors > (SELECT quantile_cont(errors, 0.5) FROM evd0) AS INTEGER) AS outage_flag FROM evd0""",
    "d": """SELECT platform AS series_id, ds, sum(y) AS y FROM rev GROUP BY 1, 2""",
    "dirty": """SELECT strftime(o_orderdate, '%-m/%-d/%Y') AS "Revenue Date",
        CASE WHEN o_orderkey % 11 = 0 THEN ' n/a '
             WHEN o_orderkey % 13 = 0 THEN '(' || format('{:,.2f}', o_totalprice) || ')'
             WHEN o_orderkey % 3 = 0 THEN '$' || format('{:,.2f}', o_totalprice)
             ELSE format('{:,.2f}', o_totalprice) END AS "Revenue",
        CASE WHEN o_orderkey % 17 = 0 THEN 'NULL' WHEN o_orderkey % 5 = 0 THEN '  ' || c_mktsegment || ' '
             ELSE c_mktsegment END AS "Platform",
        o_orderpriority AS "Campaign" FROM oc""",
    # leads per day and platform beside the month's cost spread over its days, joined to the
    # transactions and shared evenly among the rows of a key
    "cost_day": """SELECT CAST(g.day AS DATE) AS ds, platform, cost / datediff('day', ds, last_day(ds) + 1) AS cost
      FROM cost, LATERAL (SELECT unnest(generate_series(cost.ds, last_day(cost.ds), INTERVAL 1 DAY)) AS day) g""",
    "keyed": """SELECT r.ds, r.platform, count(*) AS n FROM rev r GROUP BY 1, 2""",
    "day_n": """SELECT ds, sum(n) AS n FROM keyed GROUP BY 1""",
    "cost_all": """SELECT ds, sum(cost) AS cost FROM cost_day GROUP BY 1""",
    "model": """SELECT r.*, l.leads / k.n AS leads, coalesce(b.cost / k.n, a.cost / dn.n) AS cost,
        CASE WHEN b.cost IS NOT NULL THEN r.platform ELSE 'company_total' END AS cost_bucket
      FROM rev r JOIN keyed k ON r.ds = k.ds AND r.platform = k.platform JOIN day_n dn ON r.ds = dn.ds
      LEFT JOIN leads l ON r.ds = l.ds AND r.platform = l.platform
      LEFT JOIN cost_day b ON r.ds = b.ds AND r.platform = b.platform
      LEFT JOIN cost_all a ON r.ds = a.ds""",
    # daily per platform with leads and cost, and the company's day
    "dm": """SELECT platform AS series_id, ds, sum(y) AS y, sum(leads) AS leads, coalesce(sum(cost), 0) AS cost
      FROM model GROUP BY 1, 2""",
    "dc": """SELECT ds, sum(y) AS y, sum(leads) AS leads, sum(cost) AS cost FROM dm GROUP BY 1""",
}

_DEPENDS = {
    "rev": ["oc"], "ord": ["oc"], "leads": ["oc"], "cost": ["oc"], "co_orders": ["oc"], "evd": ["evd0"],
    "d": ["rev"], "dirty": ["oc"], "cost_day": ["cost"], "keyed": ["rev"], "day_n": ["keyed"],
    "cost_all": ["cost_day"], "model": ["rev", "keyed", "day_n", "leads", "cost_day", "cost_all"],
    "dm": ["model"], "dc": ["dm"],
}


def view(name: str, sql: str, depends: str = "") -> None:
    """Add a shared view for the comparison SQL."""
    VIEWS[name] = sql
    _DEPENDS[name] = depends.split()


def with_views(names: str, body: str) -> str:
    """``WITH`` clause over the named views and what they need, then the body."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in _DEPENDS.get(name, []):
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for n in names.split():
        add(n)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    stripped = body.strip()
    if stripped[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{stripped[15:]}"
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{stripped}"


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    scale = float(10**digits)

    def floor(c):
        # ``F.floor`` gives a long, which ends at 9.2e18; this stays a double of any size
        return c - F.pmod(c, F.lit(1.0))

    return df.select(
        *[
            (floor(F.col(f"`{f.name}`").cast("double") * scale + 0.501) / scale).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


class Registry:
    """Collects queries; ``sql`` is checked by the driver, a missing one means a rows-only check."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, views: str = "", sql: str | None = None, rnd: str = "", digits: int = DIGITS):
        """Register the decorated query; ``rnd`` names the double columns of ``sql``."""

        def wrap(fn):
            self.queries[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)
            if sql is not None:
                body = with_views(views, sql)
                if rnd:
                    cols = ", ".join(f"floor(CAST({c} AS DOUBLE) * 1e{digits} + 0.501::DOUBLE) / 1e{digits} AS {c}" for c in rnd.split())
                    body = f"SELECT * REPLACE ({cols}) FROM (\n{body}\n)"
                self.oracles[name] = body
            return fn

        return wrap
