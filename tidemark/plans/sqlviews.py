"""DuckDB twins of the metric views in :mod:`tidemark.sources.testdata`.

``with_views('net_long', body=...)`` prefixes a query with the CTEs it needs
(dependencies are added in order).
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "gauge_long": ((), """
SELECT 'host-' || CAST(user_id AS VARCHAR) AS entity, 'app_' || event_type AS tbl,
       'value' AS metric, ts, value, event_id AS seq
FROM events"""),
    "counter_run": ((), """
SELECT 'host-' || CAST(user_id AS VARCHAR) AS entity, 'app_counter' AS tbl, ts, event_id AS seq,
       CAST(SUM(CAST(round(value * 100) AS BIGINT)) OVER (
            PARTITION BY user_id ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total
FROM events"""),
    "counter_long": (("counter_run",), """
SELECT entity, tbl, 'requests' AS metric, ts, CAST(total AS DOUBLE) AS value, seq FROM counter_run
UNION ALL
SELECT entity, tbl, 'requests_wrap' AS metric, ts, CAST(((total % 50000) + 50000) % 50000 AS DOUBLE) AS value, seq
FROM counter_run"""),
    "net": ((), """
SELECT 'server-' || CAST(l_suppkey AS VARCHAR) AS entity, 'net_' || l_returnflag AS tbl, l_shipdate AS ts,
       (floor(SUM(l_extendedprice) * 100 + 0.5) / 100) AS bytes_sent, SUM(l_quantity) AS bytes_recv,
       CAST(COUNT(*) AS DOUBLE) AS cmd_get,
       CAST(COUNT(*) FILTER (WHERE l_discount > 0.045) AS DOUBLE) AS get_hits
FROM lineitem GROUP BY l_suppkey, l_returnflag, l_shipdate"""),
    "net_long": (("net",), """
SELECT entity, tbl, 'bytes_sent' AS metric, ts, bytes_sent AS value FROM net
UNION ALL SELECT entity, tbl, 'bytes_recv', ts, bytes_recv FROM net
UNION ALL SELECT entity, tbl, 'cmd_get', ts, cmd_get FROM net
UNION ALL SELECT entity, tbl, 'get_hits', ts, get_hits FROM net"""),
    "catalog": ((), """
SELECT * FROM (VALUES
  ('app', 'value', 'GAUGE', 86400, NULL::DOUBLE, NULL::DOUBLE),
  ('app', 'requests', 'DERIVE', 86400, 0.0::DOUBLE, NULL::DOUBLE),
  ('app', 'requests_wrap', 'DERIVE', 86400, 0.0::DOUBLE, NULL::DOUBLE),
  ('net', 'bytes_sent', 'DERIVE', 86400, 0.0::DOUBLE, NULL::DOUBLE),
  ('net', 'bytes_recv', 'DERIVE', 86400, 0.0::DOUBLE, NULL::DOUBLE),
  ('net', 'cmd_get', 'DERIVE', 86400, 0.0::DOUBLE, NULL::DOUBLE),
  ('net', 'get_hits', 'DERIVE', 86400, 0.0::DOUBLE, NULL::DOUBLE)
) AS t(plugin, metric, kind, heartbeat_s, min_v, max_v)"""),
}


def register(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    VIEWS[name] = (deps, sql)


def with_views(*names: str, body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    body = body.strip()
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order)
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def rnd(expr: str, digits: int = 4) -> str:
    """SQL twin of :func:`tidemark.plans.common.rnd` (same IEEE steps)."""
    m = 10 ** digits
    return f"(floor(({expr}) * {m} + 0.5) / {m})"
