"""DuckDB SQL for the registered queries: common table expressions that are chained, and small templates."""

from __future__ import annotations


def q(x: str, places: int = 6) -> str:
    """Rounding by a floor, as functions.expressions.quantise."""
    return f"(floor(({x}) * 1e{places} + 0.5) / 1e{places})"


def roll(aggregate: str, x: str, n: int, least: int | None = None, order: str = "PARTITION BY ticker ORDER BY date") -> str:
    frame = f"OVER ({order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) {frame} >= {n if least is None else least} THEN {aggregate}({x}) {frame} END)"


def back(x: str, n: int = 1) -> str:
    return f"(lag({x}, {n}) OVER (PARTITION BY ticker ORDER BY date))"


def corr(x: str, y: str) -> str:
    """Of complete pairs, as an aggregate."""
    return f"(covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0))"


def zscore(x: str, null_spread: bool = True) -> str:
    spread = f"stddev_samp({x}) OVER (PARTITION BY date)"
    return f"(({x} - avg({x}) OVER (PARTITION BY date)) / ({f'nullif({spread}, 0)' if null_spread else spread} + 1e-12))"


PANEL = """panel AS (
  SELECT r_name AS ticker, CAST(l_shipdate AS DATE) AS date,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / nullif(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 0) AS price,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""

OHLCV = """ohlcv AS (
  SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY ALL)"""

GRID = """cal AS (
  SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM panel) WHERE isodow(d) < 6
), grid AS (
  SELECT t.ticker, c.date, p.price, p.volume FROM (SELECT DISTINCT ticker FROM panel) t CROSS JOIN cal c LEFT JOIN panel p ON p.ticker = t.ticker AND p.date = c.date)"""


def fill(limit: int = 5) -> str:
    held = lambda x: f"last_value({x} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {limit} PRECEDING AND CURRENT ROW)"
    ahead = lambda x: f"coalesce({x}, lead({x}) OVER (PARTITION BY ticker ORDER BY date))"
    return f"""ffilled AS (SELECT ticker, date, {held("price")} AS price, {held("volume")} AS volume FROM grid
), filled AS (SELECT ticker, date, {ahead("price")} AS price, {ahead("volume")} AS volume FROM ffilled)"""


def winsor(source: str, z: float) -> str:
    return f"""(SELECT ticker, date, CASE WHEN price IS NOT NULL THEN greatest(m - {z} * s, least(m + {z} * s, price)) END AS price
  FROM (SELECT *, avg(price) OVER (PARTITION BY ticker) AS m, stddev_samp(price) OVER (PARTITION BY ticker) AS s FROM {source}))"""


PREP = f"""{PANEL}, {GRID}, {fill()}, cov AS (
  SELECT ticker, avg(CASE WHEN price IS NULL THEN 0 ELSE 1 END) AS pc, avg(CASE WHEN volume IS NULL THEN 0 ELSE 1 END) AS vc FROM filled GROUP BY ticker
), covered AS (SELECT f.* FROM filled f JOIN cov USING (ticker) WHERE pc >= 0.8
), prices AS {winsor("covered", 6.0)}, vols AS (SELECT f.ticker, f.date, f.volume FROM filled f JOIN cov USING (ticker) WHERE vc >= 0.8
), prep AS (
  SELECT p.ticker, p.date, p.price, v.volume, ln(p.price) - lag(ln(p.price)) OVER (PARTITION BY p.ticker ORDER BY p.date) AS ret
  FROM prices p LEFT JOIN vols v USING (ticker, date))"""


def gravity(mass_window: int = 20, dist_window: int = 60, min_periods: int = 30, lookback: int = 20, cap: float | None = None, tag: str = "") -> str:
    """From prep to sig{tag}, by way of corr, dist, mass, mom, force and net."""
    over = f"OVER (PARTITION BY i, j ORDER BY date ROWS BETWEEN {dist_window - 1} PRECEDING AND CURRENT ROW)"
    force = "a.mass * b.mass / (d.dist * d.dist + 1e-6)"
    force = f"least(greatest({force}, 0), {cap})" if cap is not None else force
    return f"""pairs{tag} AS (
  SELECT a.date, a.ticker AS i, b.ticker AS j, CASE WHEN b.ret IS NOT NULL THEN a.ret END AS x, CASE WHEN a.ret IS NOT NULL THEN b.ret END AS y
  FROM prep a JOIN prep b ON a.date = b.date AND a.ticker < b.ticker
), corr{tag} AS (
  SELECT date, i, j, covar_samp(x, y) {over} / nullif(stddev_samp(x) {over} * stddev_samp(y) {over}, 0) AS corr,
         row_number() OVER (PARTITION BY i, j ORDER BY date) AS rn FROM pairs{tag}
), dist{tag} AS (
  SELECT date, i, j, corr, CASE WHEN corr IS NULL THEN 0 ELSE sqrt(2 * (1 - greatest(-1 + 1e-6, least(1 - 1e-6, corr)))) END AS dist
  FROM corr{tag} WHERE rn >= {min_periods}
), mass{tag} AS (
  SELECT date, ticker, greatest(coalesce({roll("avg", "(price * volume)", mass_window, max(2, mass_window // 3))}, 1e-8), 1e-8) AS mass FROM prep
), force{tag} AS (
  SELECT d.date, d.i, d.j, d.dist, {force} AS force
  FROM dist{tag} d JOIN mass{tag} a ON a.date = d.date AND a.ticker = d.i JOIN mass{tag} b ON b.date = d.date AND b.ticker = d.j
), mom{tag} AS (
  SELECT date, ticker, {zscore("raw")} AS mom FROM (SELECT date, ticker, ln(price) - {back("ln(price)", lookback)} AS raw FROM prep)
), net{tag} AS (
  SELECT e.date, e.ticker, sum(force * sign(coalesce(mom, 0))) AS net
  FROM (SELECT date, i AS ticker, j AS other, force FROM force{tag} UNION ALL SELECT date, j, i, force FROM force{tag}) e
  LEFT JOIN mom{tag} m ON m.date = e.date AND m.ticker = e.other GROUP BY e.date, e.ticker
), sig{tag} AS (
  SELECT date, ticker, {zscore("net")} AS signal FROM (SELECT p.date, p.ticker, n.net FROM prep p LEFT JOIN net{tag} n ON n.date = p.date AND n.ticker = p.ticker))"""


def forward(horizons: list[int]) -> str:
    parts = [f"SELECT date, ticker, {k} AS horizon, {q(f'lead(price, {k}) OVER (PARTITION BY ticker ORDER BY date) / price - 1')} AS fwd FROM prep" for k in horizons]
    return f"fwds AS ({' UNION ALL '.join(parts)})"


def ic(tag: str = "", sign: int = 1, method: str = "spearman", out: str = "ics") -> str:
    rank = lambda x: f"(rank() OVER (PARTITION BY date, horizon ORDER BY {x}) + (count(*) OVER (PARTITION BY date, horizon, {x}) - 1) / 2.0)::DOUBLE"
    x, y = (rank("signal"), rank("fwd")) if method == "spearman" else ("signal", "fwd")
    return f"""{out} AS (
  SELECT date, horizon, {corr("x", "y")} AS ic FROM (SELECT date, horizon, {x} AS x, {y} AS y
    FROM (SELECT s.date, f.horizon, {q(f"{sign} * signal")} AS signal, fwd FROM sig{tag} s JOIN fwds f ON f.date = s.date AND f.ticker = s.ticker WHERE signal IS NOT NULL AND fwd IS NOT NULL))
  GROUP BY date, horizon HAVING count(*) >= 3 AND ic IS NOT NULL)"""
