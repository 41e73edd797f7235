"""DuckDB SQL of the native queries, put together from common table expressions."""

from __future__ import annotations

WEEK = """week AS (
  SELECT 'all' AS uid, CAST(date_trunc('week', o_orderdate) AS DATE) AS t, r_name AS asset, round(sum(o_totalprice), 2) AS x
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 2, 3)"""
PRIORITY = WEEK.replace("week AS (", "panel AS (", 1).replace("'all' AS uid", "o_orderpriority AS uid").replace("GROUP BY 2, 3", "GROUP BY 1, 2, 3")
MONTH_NATION = """panel AS (
  SELECT 'all' AS uid, CAST(date_trunc('month', o_orderdate) AS DATE) AS t, n_name AS asset, round(sum(o_totalprice), 2) AS x
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 2, 3)"""
CLEAN = """grid AS (
  SELECT uid, t, asset, x FROM (SELECT DISTINCT uid, t FROM panel) JOIN (SELECT DISTINCT uid, asset FROM panel) USING (uid) LEFT JOIN panel USING (uid, t, asset)
), filled AS (
  SELECT uid, t, asset, last_value(x IGNORE NULLS) OVER (PARTITION BY uid, asset ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS x FROM grid
), whole AS (
  SELECT uid, t, asset, x FROM (SELECT *, count(x) OVER (PARTITION BY uid, t) AS have, count(*) OVER (PARTITION BY uid, t) AS want FROM filled) WHERE have = want)"""
RETURNS = """rets AS (
  SELECT uid, t, asset, round(ln(x / before), 10) AS r FROM (SELECT *, lag(x) OVER (PARTITION BY uid, asset ORDER BY t) AS before FROM whole) WHERE before IS NOT NULL)"""
CORR = "CASE WHEN isfinite({c}) THEN greatest(least({c}, 1.0::DOUBLE), -1.0::DOUBLE) ELSE 0.0::DOUBLE END"
EDGES = f"""pairs AS (
  SELECT l.uid, l.t, l.asset AS a, m.asset AS b, l.r AS ra, m.r AS rb FROM rets l JOIN rets m ON l.uid = m.uid AND l.t = m.t AND l.asset < m.asset
), edges AS (
  SELECT uid, t, a, b, round({CORR.format(c="c")}, 9) AS c FROM (
    SELECT uid, t, a, b, corr(ra, rb) OVER w AS c, count(*) OVER w AS n FROM pairs WINDOW w AS (PARTITION BY uid, a, b ORDER BY t ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)) WHERE n = 22)"""
SHRUNK = """shrunk AS (SELECT uid, t, a, b, round(0.95::DOUBLE * c, 9) AS c FROM edges
), dist AS (SELECT *, round(sqrt(greatest(2 * (1 - c), 0.0::DOUBLE)), 9) AS d FROM shrunk)"""
GRAPH = """sides AS (SELECT {k}, a AS i, b AS j, d FROM dist UNION ALL SELECT {k}, b, a, d FROM dist
), near AS (
  SELECT {k}, i, j FROM (SELECT *, row_number() OVER (PARTITION BY {k}, i ORDER BY d, j) AS r, count(*) OVER (PARTITION BY {k}, i) + 1 AS n FROM sides)
  WHERE r <= greatest(1, least(5, greatest(2, (n - 1) // 2)))
), graph AS (SELECT DISTINCT {k}, least(i, j) AS u, greatest(i, j) AS v FROM near
), around AS (SELECT {k}, u AS i, v AS j FROM graph UNION ALL SELECT {k}, v, u FROM graph
), degree AS (SELECT {k}, i, count(*) AS n FROM around GROUP BY ALL
), shared AS (SELECT {kg}, g.u, g.v, count(*) AS n FROM graph g JOIN around p ON {kp} AND p.i = g.u JOIN around q ON {kq} AND q.i = g.v AND q.j = p.j GROUP BY ALL
), curved AS (
  SELECT {kg}, g.u, g.v, CAST(4 - p.n - q.n + 3 * coalesce(s.n, 0) AS DOUBLE) AS curvature FROM graph g JOIN degree p ON {kp} AND p.i = g.u JOIN degree q ON {kq} AND q.i = g.v
  LEFT JOIN shared s ON {ks} AND s.u = g.u AND s.v = g.v
), rigid AS (SELECT {k}, round(median(curvature), 9) AS curvature FROM curved GROUP BY ALL)"""


def graph(*keys: str) -> str:
    join = lambda x: " AND ".join(f"{x}.{k} = g.{k}" for k in keys)
    return GRAPH.format(k=", ".join(keys), kg=", ".join(f"g.{k}" for k in keys), kp=join("p"), kq=join("q"), ks=join("s"))


VOL = """vols AS (
  SELECT uid, t, round(avg(s), 9) AS vol FROM (SELECT uid, t, stddev_pop(r) OVER w AS s, count(*) OVER w AS n FROM rets WINDOW w AS (PARTITION BY uid, asset ORDER BY t ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)) WHERE n = 22 GROUP BY uid, t)"""
STATE = """means AS (SELECT uid, t, round(avg(c), 9) AS mean_corr FROM shrunk GROUP BY uid, t
), state0 AS (
  SELECT uid, t, mean_corr, curvature, round(1 / (abs(curvature) + 0.05::DOUBLE), 9) AS eta, vol FROM means JOIN rigid USING (uid, t) JOIN vols USING (uid, t)
), state1 AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY t) AS rn, count(*) OVER (PARTITION BY uid) AS n FROM state0)"""
CALM = "rn <= floor(n * 0.4::DOUBLE)"
OH = f"""ref AS (SELECT uid, greatest(quantile_cont(eta, 0.05), 1e-12) AS eta_ref FROM state1 WHERE {CALM} GROUP BY uid
), idx AS (SELECT s.*, eta_ref, eta_ref / (eta + 1e-12) AS lam FROM state1 s JOIN ref USING (uid)
), lim AS (SELECT uid, greatest(quantile_cont(lam, 0.99) * 1.02::DOUBLE, 1e-12) AS lambda_c FROM idx WHERE {CALM} GROUP BY uid
), ohs AS (SELECT i.*, lambda_c, round(lam / lambda_c, 9) AS oh FROM idx i JOIN lim USING (uid)
), pre AS (SELECT uid, round(quantile_cont(oh, 0.968), 9) AS oh_pre FROM ohs WHERE {CALM} GROUP BY uid
), driven AS MATERIALIZED (SELECT o.*, oh_pre, greatest(round(oh - (oh_pre + 0.08::DOUBLE), 9), 0.0::DOUBLE) AS drive FROM ohs o JOIN pre USING (uid))"""
PHI = f"""memory(uid, rn, phi) AS (
  SELECT uid, CAST(1 AS BIGINT), greatest(drive, 1e-6::DOUBLE) FROM driven WHERE rn = 1
  UNION ALL SELECT m.uid, m.rn + 1, greatest(0.97::DOUBLE * m.phi + d.drive, 1e-6::DOUBLE) FROM memory m JOIN driven d ON d.uid = m.uid AND d.rn = m.rn + 1
), remembered AS MATERIALIZED (SELECT d.*, round(m.phi, 9) AS phi FROM driven d JOIN memory m USING (uid, rn)
), limits AS (
  SELECT uid, round(quantile_cont(phi, 0.99), 9) AS phi_c, round(quantile_cont(oh, 0.75), 9) AS o75, round(quantile_cont(oh, 0.95), 9) AS o95,
         round(quantile_cont(phi, 0.75), 9) AS p75, round(quantile_cont(phi, 0.95), 9) AS p95 FROM remembered WHERE {CALM} GROUP BY uid
), state AS MATERIALIZED (
  SELECT r.*, phi_c, CASE WHEN oh >= o95 OR phi >= 2 * p95 THEN 'rigid' WHEN oh >= o75 OR phi >= p75 THEN 'shift' ELSE 'flow' END AS regime FROM remembered r JOIN limits USING (uid))"""
REVENUE = """series AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY t) AS rn, count(*) OVER (PARTITION BY uid) AS n FROM (
    SELECT 'revenue' AS uid, CAST(l_shipdate AS DATE) AS t, round(sum(l_extendedprice * (1 - l_discount)), 4) AS x FROM lineitem GROUP BY 2))"""
EVENTS = """panel AS (SELECT 'events' AS uid, date_trunc('hour', ts) AS t, event_type AS asset, round(avg(value), 6) AS x FROM events GROUP BY 2, 3)"""


def sql(*parts: str, recursive: bool = False) -> str:
    """``WITH`` the parts but the last, which is the query."""
    if len(parts) == 1:
        return parts[0]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts[:-1]) + "\n" + parts[-1]


WEEK_PANEL = WEEK.replace("week AS (", "panel AS (", 1)
#: From orders to weekly returns of one universe, and of all priorities.
ONE, ALL = (WEEK_PANEL, CLEAN, RETURNS), (PRIORITY, CLEAN, RETURNS)
WINDOWS = (*ALL, EDGES, SHRUNK, graph("uid", "t"), VOL, STATE, OH)
FULL = (*WINDOWS, PHI)
RUNS = """marked AS (SELECT *, sum(CASE WHEN flag IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY t) AS island
  FROM (SELECT *, lag(flag) OVER (PARTITION BY uid ORDER BY t) AS before FROM flagged)
), runs AS (SELECT uid, island, flag, min(t) AS "start", max(t) AS "end", count(*) AS length FROM marked GROUP BY uid, island, flag)"""


def lag_sql(source: str, x: str, most: int = 20) -> str:
    """``lagged(uid, lag)``: the smallest lag at which a series ``uid, rn, x`` and itself moved on do not go together."""
    moved = ", ".join(f"lag(x, {k}) OVER w AS l{k}" for k in range(1, most))
    fits = ", ".join(
        f"CASE WHEN floor(count(x) / 2) > {k} AND covar_pop(x, l{k}) <= 0 AND stddev_pop(CASE WHEN l{k} IS NOT NULL THEN x END) > 0 AND stddev_pop(l{k}) > 0 THEN {k} END" for k in range(1, most)
    )
    return f"""moved AS (SELECT uid, x, {moved} FROM (SELECT uid, rn, {x} AS x FROM {source}) WINDOW w AS (PARTITION BY uid ORDER BY rn)
), lagged AS (SELECT uid, CAST(coalesce(least({fits}), least(greatest(floor(count(x) / 4), 1), {most})) AS INTEGER) AS lag FROM moved GROUP BY uid)"""


def recurrence_sql(source: str, x: str, window: int = 60) -> str:
    """``recurred(uid, t, rr, det, lam, tt, theta, geometry)`` of a numbered series ``uid, t, rn, n, x``."""
    z = lambda c, w: f"{w}::DOUBLE * CASE WHEN k_{c} > 5 THEN greatest(coalesce(({c} - m_{c}) / greatest(s_{c}, 0.01::DOUBLE), 0.0::DOUBLE), 0.0::DOUBLE) ELSE 0.0::DOUBLE END"
    quiet = ", ".join(f"count({c}) FILTER ({CALM}) OVER u AS k_{c}, avg({c}) FILTER ({CALM}) OVER u AS m_{c}, stddev_pop({c}) FILTER ({CALM}) OVER u AS s_{c}" for c in ("det", "lam", "tt"))
    return f"""{lag_sql(source, x)}
, asked AS (SELECT s.uid, s.rn AS e, lag FROM {source} s JOIN lagged USING (uid) WHERE s.rn > {window}
), points AS (
  SELECT w.uid, w.e, a.rn - w.e + {window} AS i, a.{x} AS x0, b.{x} AS x1, c.{x} AS x2 FROM asked w
  JOIN {source} a ON a.uid = w.uid AND a.rn BETWEEN w.e - {window} AND w.e - 1
  JOIN {source} b ON b.uid = w.uid AND b.rn = a.rn + lag AND b.rn < w.e JOIN {source} c ON c.uid = w.uid AND c.rn = a.rn + 2 * lag AND c.rn < w.e
), sizes AS (SELECT uid, e, count(*) AS m FROM points GROUP BY uid, e HAVING count(*) >= 10
), apart AS (
  SELECT p.uid, p.e, p.i, q.i AS j, sqrt((p.x0 - q.x0) * (p.x0 - q.x0) + (p.x1 - q.x1) * (p.x1 - q.x1) + (p.x2 - q.x2) * (p.x2 - q.x2)) AS d
  FROM points p JOIN points q ON p.uid = q.uid AND p.e = q.e AND p.i < q.i
), limit_of AS (SELECT uid, e, greatest(quantile_cont(d, 0.1), 1e-12) AS eps FROM apart GROUP BY uid, e
), close AS MATERIALIZED (SELECT uid, e, i, j FROM apart JOIN limit_of USING (uid, e) WHERE d <= eps
), diagonals AS (
  SELECT uid, e, sum(k) AS k FROM (SELECT uid, e, count(*) AS k FROM (SELECT uid, e, j - i AS o, i - row_number() OVER (PARTITION BY uid, e, j - i ORDER BY i) AS g FROM close) GROUP BY uid, e, o, g) WHERE k >= 2 GROUP BY uid, e
), cells AS (SELECT uid, e, i, j FROM close UNION ALL SELECT uid, e, j, i FROM close UNION ALL SELECT uid, e, i, i FROM points
), walls AS (
  SELECT uid, e, sum(k) AS k, avg(k) AS tt FROM (SELECT uid, e, count(*) AS k FROM (SELECT uid, e, j, i - row_number() OVER (PARTITION BY uid, e, j ORDER BY i) AS g FROM cells) GROUP BY uid, e, j, g) WHERE k >= 2 GROUP BY uid, e
), totals AS (SELECT uid, e, m, m + 2 * coalesce(c, 0) AS total FROM sizes LEFT JOIN (SELECT uid, e, count(*) AS c FROM close GROUP BY uid, e) USING (uid, e)
), rates AS (
  SELECT uid, e AS rn, total / CAST(m * m AS DOUBLE) AS rr, (m + 2 * coalesce(d.k, 0)) / CAST(total AS DOUBLE) AS det, coalesce(w.k, 0) / CAST(total AS DOUBLE) AS lam, coalesce(w.tt, 0.0::DOUBLE) AS tt
  FROM totals LEFT JOIN diagonals d USING (uid, e) LEFT JOIN walls w USING (uid, e)
), placed_rates AS (SELECT s.uid, s.t, s.rn, s.n, r.rr, r.det, r.lam, r.tt FROM {source} s LEFT JOIN rates r ON r.uid = s.uid AND r.rn = s.rn
), scored_rates AS (SELECT *, {quiet} FROM placed_rates WINDOW u AS (PARTITION BY uid)
), strengths AS (
  SELECT *, coalesce(k_det > 5 AND s_det < 0.005::DOUBLE, false) OR coalesce(k_lam > 5 AND s_lam < 0.005::DOUBLE, false) AS flat, least({z('det', 0.4)} + {z('lam', 0.35)} + {z('tt', 0.25)}, 5.0::DOUBLE) AS raw FROM scored_rates
), recurred AS MATERIALIZED (
  SELECT uid, t, rn, n, rr, det, lam, tt, CASE WHEN n < 60 OR flat THEN 0.0::DOUBLE ELSE round(raw, 9) END AS theta, CASE WHEN n < 60 THEN 'NOT_APPLIED' WHEN flat THEN 'SATURATED' ELSE 'HIGH' END AS geometry FROM strengths)"""


def knee_sql(source: str, x: str, name: str = "knees") -> str:
    """``{name}(uid, knee)``: the values above their mean, sorted, at their greatest curvature (zero with ten or fewer)."""
    return f"""above AS (SELECT uid, t, x FROM (SELECT uid, t, {x} AS x, avg({x}) OVER (PARTITION BY uid) AS m FROM {source}) WHERE x > m
), sorted AS (SELECT uid, x, row_number() OVER (PARTITION BY uid ORDER BY x, t) AS i, count(*) OVER (PARTITION BY uid) AS m FROM above
), d1s AS (SELECT *, 1.0::DOUBLE / (m - 1) AS h, CASE WHEN lag(x) OVER w IS NULL THEN (lead(x) OVER w - x) / (1.0::DOUBLE / (m - 1)) WHEN lead(x) OVER w IS NULL THEN (x - lag(x) OVER w) / (1.0::DOUBLE / (m - 1)) ELSE (lead(x) OVER w - lag(x) OVER w) / (2 * (1.0::DOUBLE / (m - 1))) END AS d1 FROM sorted WHERE m > 10 WINDOW w AS (PARTITION BY uid ORDER BY i)
), d2s AS (SELECT *, CASE WHEN lag(d1) OVER w IS NULL THEN (lead(d1) OVER w - d1) / h WHEN lead(d1) OVER w IS NULL THEN (d1 - lag(d1) OVER w) / h ELSE (lead(d1) OVER w - lag(d1) OVER w) / (2 * h) END AS d2 FROM d1s WINDOW w AS (PARTITION BY uid ORDER BY i)
), ks AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY round(abs(d2) / pow(1 + d1 * d1, 1.5::DOUBLE), 12) DESC, i) AS r FROM d2s
), {name} AS (SELECT s.uid, coalesce(max(round(k.x, 6)), 0.0::DOUBLE) AS knee FROM (SELECT DISTINCT uid FROM {source}) s LEFT JOIN ks k ON k.uid = s.uid AND r = 1 GROUP BY s.uid)"""
