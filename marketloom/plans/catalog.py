"""The registered queries: name, DataFrame plan and the SQL that gives the same rows. Outputs are quantised, as engines sum floats in different orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.expressions import average_rank, by_date, last_known, log_of, quantise, zscore
from marketloom.operators import clean, dashboard, explore, features, gravity
from marketloom.operators.prepare import Prepared, prepare_price_data
from marketloom.plans import oracle as o
from marketloom.plans.oracle import q
from marketloom.sources import panels, sinks
from marketloom.sources.scratch import materialise, scratch_path

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}

HORIZONS = [1, 5, 10, 20, 40, 60, 120, 240, 360, 480, 720]
SWEEP_HORIZONS = HORIZONS[:6]
MAIN = gravity.GravityParams(mass_window=60, dist_window=60, momentum_lookback=240)
CONFIGS = [
    gravity.GravityParams(mass_window=20, dist_window=30, momentum_lookback=120),
    gravity.GravityParams(mass_window=30, dist_window=60, momentum_lookback=20),
    gravity.GravityParams(mass_window=60, dist_window=120, momentum_lookback=240),
    gravity.GravityParams(mass_window=10, dist_window=20, momentum_lookback=60),
]
FORCE_CAP = 1e10
#: The last days of the driver's orders lie before this one.
AS_OF = "1998-08-02"


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def put(plan: Plan) -> Plan:
        QUERIES[name] = plan
        if sql is not None:
            ORACLE[name] = sql
        return plan

    return put


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: quantise(c) for c in columns})


def grid(spark: SparkSession, sf: str) -> DataFrame:
    # The calendar and the tickers come from the panel too: it is written first, so that the lines it sums up are read once.
    return panels.dense_grid(materialise(panels.region_panel(spark, sf), "region"))


def prepared(spark: SparkSession, sf: str) -> Prepared:
    # The panel is an aggregate: a date of a ticker is there once, so there is nothing to validate.
    return prepare_price_data(materialise(panels.region_panel(spark, sf), "region"), validate=False)


def prep_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Price, volume and return of every ticker and day. It is read by several branches of a plan, so it is written once: a panel is
    small next to the lines that it sums up."""
    return materialise(prepared(spark, sf).panel, "panel")


def signals(spark: SparkSession, sf: str, params: gravity.GravityParams = gravity.GravityParams()) -> DataFrame:
    panel = prep_panel(spark, sf)
    return gravity.gravity_signals(panel, params, panel.select("date", "ticker", "ret"))


def horizon_ics(spark: SparkSession, sf: str, horizons: list[int], method: str = "spearman") -> DataFrame:
    """IC of the flagship's inverted signals by date and horizon."""
    panel = prep_panel(spark, sf)
    found = gravity.gravity_signals(panel, MAIN, panel.select("date", "ticker", "ret")).withColumn("signal", quantise(-1 * F.col("signal")))
    return gravity.information_coefficient(found, rounded(features.forward_returns(panel, horizons), "fwd"), method)


WITH_PANEL, WITH_OHLCV, WITH_GRID, WITH_PREP = f"WITH {o.PANEL} ", f"WITH {o.OHLCV} ", f"WITH {o.PANEL}, {o.GRID} ", f"WITH {o.PREP} "
WITH_FILLED = f"WITH {o.PANEL}, {o.GRID}, {o.fill()} "
WITH_DEFAULT = f"WITH {o.PREP}, {o.gravity()} "
WITH_MAIN = f"WITH {o.PREP}, {o.gravity(60, 60, 30, 240)} "


def with_ics(horizons: list[int], method: str = "spearman") -> str:
    return f"WITH {o.PREP}, {o.gravity(60, 60, 30, 240)}, {o.forward(horizons)}, {o.ic(sign=-1, method=method)} "


# Sources, calendar, cleaning


@query("panel_prices", WITH_PANEL + f"SELECT date, ticker, {q('price')} AS price, volume FROM panel")
def panel_prices(spark, sf):
    return rounded(panels.region_panel(spark, sf), "price")


@query("panel_ohlcv", WITH_OHLCV + "SELECT * FROM ohlcv")
def panel_ohlcv(spark, sf):
    return panels.order_panel(spark, sf)


@query("fetch_prices", WITH_OHLCV + "SELECT date, ticker, close AS price, volume FROM ohlcv WHERE ticker IN ('1-URGENT', '2-HIGH') AND date >= DATE '1995-01-01' AND date < DATE '1996-01-01'")
def fetch_prices(spark, sf):
    return panels.fetch_prices(panels.order_panel(spark, sf), ["1-URGENT", "2-HIGH"], "1995-01-01", "1996-01-01", guard=False)


@query("calendar_business", WITH_GRID + "SELECT date FROM cal")
def calendar_business(spark, sf):
    return panels.calendar(panels.region_panel(spark, sf))


@query("period_filter", WITH_OHLCV + f"SELECT date, ticker, close FROM ohlcv WHERE date BETWEEN DATE '{AS_OF}' - 180 AND DATE '{AS_OF}'")
def period_filter(spark, sf):
    return panels.period_filter(panels.order_panel(spark, sf), "6mo", AS_OF).select("date", "ticker", "close")


@query("dedupe_keep_first", "SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS ticker, min(o_orderkey) AS o_orderkey, min_by(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1, 2")
def dedupe_keep_first(spark, sf):
    rows = panels.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("ticker"), "o_orderkey", F.col("o_totalprice").alias("price"))
    return clean.keep_first(rows, "o_orderkey")


@query(
    "validate_report",
    """WITH t AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS ticker, o_orderkey FROM orders),
    b AS (SELECT date < lag(date) OVER (PARTITION BY ticker ORDER BY o_orderkey) AS back FROM t)
    SELECT count(*) AS n_rows, count(*) - count(DISTINCT (ticker, date)) AS n_duplicates, (SELECT count(*) FROM b WHERE back) AS n_backward FROM t""",
)
def validate_report(spark, sf):
    rows = panels.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("ticker"), "o_orderkey")
    return clean.validation_report(rows, "o_orderkey")


@query("positivity", WITH_OHLCV + "SELECT bool_and(coalesce(open > 0, false)) AS open_positive, bool_and(coalesce(close > 0, false)) AS close_positive FROM ohlcv")
def positivity(spark, sf):
    return clean.positivity(panels.order_panel(spark, sf), ["open", "close"])


@query("align_left_calendar", WITH_GRID + f"SELECT date, ticker, {q('price')} AS price, volume FROM grid")
def align_left_calendar(spark, sf):
    return rounded(grid(spark, sf), "price")


@query("ffill_limit", WITH_FILLED + f"SELECT date, ticker, {q('price')} AS price FROM ffilled")
def ffill_limit(spark, sf):
    return rounded(clean.fill_gaps(grid(spark, sf).select("date", "ticker", "price"), "price", 5, 0), "price")


@query("bfill_limit", f"WITH {o.PANEL}, {o.GRID}, {o.fill(1)} SELECT date, ticker, {q('price')} AS price FROM filled")
def bfill_limit(spark, sf):
    return rounded(clean.fill_gaps(grid(spark, sf).select("date", "ticker", "price"), "price", 1, 1), "price")


@query("ffill_unlimited", WITH_GRID + f"SELECT date, ticker, {q('last_value(price IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)')} AS price FROM grid")
def ffill_unlimited(spark, sf):
    return grid(spark, sf).select("date", "ticker", quantise(last_known("price")).alias("price"))


@query("coverage_ratio", WITH_GRID + f"SELECT ticker, {q('avg(CASE WHEN price IS NULL THEN 0 ELSE 1 END)')} AS coverage FROM grid GROUP BY ticker")
def coverage_ratio(spark, sf):
    return rounded(clean.coverage(grid(spark, sf), "price"), "coverage")


LEAST = 0.985
COVERED = f"SELECT ticker FROM grid GROUP BY ticker HAVING avg(CASE WHEN price IS NULL THEN 0 ELSE 1 END) >= {LEAST}"


@query("coverage_filter", WITH_GRID + f"SELECT date, ticker, {q('price')} AS price FROM grid WHERE ticker IN ({COVERED})")
def coverage_filter(spark, sf):
    return rounded(clean.keep_covered(grid(spark, sf).select("date", "ticker", "price"), "price", LEAST), "price")


@query("dropped_tickers", WITH_GRID + f"SELECT DISTINCT ticker FROM grid WHERE ticker NOT IN ({COVERED})")
def dropped_tickers(spark, sf):
    return clean.dropped_tickers(grid(spark, sf), "price", LEAST)


@query("align_and_fill", WITH_PREP + f"SELECT date, ticker, {q('price')} AS price FROM covered")
def align_and_fill(spark, sf):
    return rounded(clean.align_and_fill(materialise(panels.region_panel(spark, sf), "region")), "price")


@query("winsorize", WITH_PANEL + f"SELECT date, ticker, {q('price')} AS price FROM {o.winsor('panel', 1.5)}")
def winsorize(spark, sf):
    return rounded(clean.winsorise(panels.region_panel(spark, sf).select("date", "ticker", "price"), "price", 1.5), "price")


@query("prepare_prices", WITH_PREP + f"SELECT date, ticker, {q('price')} AS price, volume, {q('ret')} AS ret FROM prep")
def prepare_prices(spark, sf):
    return rounded(prepared(spark, sf).panel, "price", "ret")


# Returns, features, indicators


@query("returns_simple", f"WITH {o.PANEL}, {o.GRID}, h AS (SELECT ticker, date, last_value(price IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS p FROM grid) SELECT date, ticker, {q('p / nullif(' + o.back('p') + ', 0) - 1')} AS ret FROM h")
def returns_simple(spark, sf):
    return rounded(features.returns(grid(spark, sf), "simple"), "ret")


@query("returns_log", WITH_GRID + f"SELECT date, ticker, {q('ln(price) - ' + o.back('ln(price)'))} AS ret FROM grid")
def returns_log(spark, sf):
    return rounded(features.returns(grid(spark, sf), "log"), "ret")


@query("forward_returns", WITH_PREP + f", {o.forward(HORIZONS)} SELECT date, ticker, horizon, fwd FROM fwds")
def forward_returns(spark, sf):
    return rounded(features.forward_returns(prepared(spark, sf).prices, HORIZONS), "fwd")


FEATURES = {f"{name}_{w}": sql for w in (5, 20, 60) for name, sql in (("sma", o.roll("avg", "price", w, w // 2)), ("momentum", f"(price / nullif({o.back('price', w)}, 0) - 1)"), ("volatility", o.roll("stddev_samp", "ret", w, w // 2)))}


def _feature(kind: str) -> None:
    names = [f"{kind}_{w}" for w in (5, 20, 60)]

    @query(f"feat_{kind}", WITH_PREP + f"SELECT date, ticker, {', '.join(f'{q(FEATURES[n])} AS {n}' for n in names)} FROM prep")
    def plan(spark, sf):
        return rounded(prepared(spark, sf).features.select("date", "ticker", *names), *names)


for _kind in ("sma", "momentum", "volatility"):
    _feature(_kind)


@query("features_all", WITH_PREP + f"SELECT date, ticker, {', '.join(f'{q(sql)} AS {n}' for n, sql in sorted(FEATURES.items()))} FROM prep")
def features_all(spark, sf):
    return rounded(prepared(spark, sf).features, *FEATURES)


@query("rolling_mean_std", WITH_PREP + f"SELECT date, ticker, {q('price')} AS price, " + ", ".join(f"{q(o.roll(f, 'price', w, w // 2))} AS {n}_{w}" for w in (20, 60) for n, f in (("mean", "avg"), ("std", "stddev_samp"))) + " FROM prep")
def rolling_mean_std(spark, sf):
    return rounded(features.rolling_stats(prepared(spark, sf).prices, "price", guard=False), "price", "mean_20", "std_20", "mean_60", "std_60")


@query("ind_sma", WITH_OHLCV + f"SELECT date, ticker, {', '.join(f'{q(o.roll("avg", "close", w))} AS SMA_{w}' for w in (5, 10, 20, 50))} FROM ohlcv")
def ind_sma(spark, sf):
    names = [f"SMA_{w}" for w in (5, 10, 20, 50)]
    return rounded(features.moving_averages(panels.order_panel(spark, sf)).select("date", "ticker", *names), *names)


@query(
    "ind_rsi",
    WITH_OHLCV
    + f""", d AS (SELECT ticker, date, close - {o.back("close")} AS delta FROM ohlcv),
    g AS (SELECT ticker, date, CASE WHEN delta > 0 THEN delta ELSE 0 END AS gain, CASE WHEN delta < 0 THEN -delta ELSE 0 END AS loss FROM d),
    a AS (SELECT ticker, date, {o.roll("avg", "gain", 14)} AS up, {o.roll("avg", "loss", 14)} AS down FROM g)
    SELECT date, ticker, {q("CASE WHEN down = 0 THEN CASE WHEN up > 0 THEN 100.0 END ELSE 100 - 100 / (1 + up / down) END")} AS rsi FROM a""",
)
def ind_rsi(spark, sf):
    return rounded(features.rsi(panels.order_panel(spark, sf)).select("date", "ticker", "rsi"), "rsi")


MID, STD = o.roll("avg", "close", 20), o.roll("stddev_samp", "close", 20)


@query("ind_bollinger", WITH_OHLCV + f"SELECT date, ticker, {q(MID)} AS middle, {q(f'{MID} + 2 * {STD}')} AS upper, {q(f'{MID} - 2 * {STD}')} AS lower FROM ohlcv")
def ind_bollinger(spark, sf):
    return rounded(features.bollinger(panels.order_panel(spark, sf)).select("date", "ticker", "middle", "upper", "lower"), "middle", "upper", "lower")


@query("volume_colour", WITH_OHLCV + "SELECT date, ticker, volume, CASE WHEN close < open THEN 'red' ELSE 'green' END AS colour FROM ohlcv")
def volume_colour(spark, sf):
    return features.volume_colours(panels.order_panel(spark, sf))


SUMMARY = WITH_OHLCV + f""", few AS (SELECT * FROM ohlcv WHERE true), r AS (SELECT *, close / nullif({o.back("close")}, 0) - 1 AS ret FROM few),
    s AS (SELECT ticker, max_by(close, date) AS current_price, min_by(close, date) AS first_price, max(high) AS high, min(low) AS low, avg(volume) AS avg_volume,
      stddev_samp(ret) * 100 AS volatility FROM r GROUP BY ticker),
    t AS (SELECT *, current_price - first_price AS price_change, (current_price - first_price) / nullif(first_price, 0) * 100 AS price_change_pct FROM s) """
STATS = ["current_price", "price_change", "price_change_pct", "high", "low", "avg_volume", "volatility"]


@query("summary_stats", SUMMARY + f"SELECT ticker, {', '.join(f'{q(c)} AS {c}' for c in STATS)} FROM t")
def summary_stats(spark, sf):
    return rounded(features.summary_stats(panels.order_panel(spark, sf)).select("ticker", *STATS), *STATS)


TEXTS = {"current_price": "$%.2f", "price_change": "$%.2f", "price_change_pct": "%.2f%%", "high": "$%.2f", "low": "$%.2f", "avg_volume": "%.0f", "volatility": "%.2f%%"}


@query("summary_strings", SUMMARY + f"SELECT ticker, {', '.join(f"printf('{form}', {c}) AS {c}_text" for c, form in TEXTS.items())} FROM t")
def summary_strings(spark, sf):
    return features.summary_stats(panels.order_panel(spark, sf)).select("ticker", *(f"{c}_text" for c in TEXTS))


@query("normalised_price", WITH_PREP + f"SELECT date, ticker, {q('price / nullif(first_value(price IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0)')} AS normalised FROM prep")
def normalised_price(spark, sf):
    return rounded(features.normalised(prepared(spark, sf).prices, guard=False), "normalised")


# Exploration

POINTS = {f"p{round(100 * p):02d}": p for p in explore.PERCENTILES}


def describe_sql(column: str) -> str:
    points = ", ".join(f"{q(f'quantile_cont({column}, {p})')} AS {n}" for n, p in POINTS.items())
    return f"SELECT ticker, CAST(count({column}) AS DOUBLE) AS count, {q(f'avg({column})')} AS mean, {q(f'stddev_samp({column})')} AS std, {q(f'min({column})')} AS min, {points}, {q(f'max({column})')} AS max, count({column}) AS non_null, CASE WHEN count(DISTINCT {column}) <= 5000 THEN count(DISTINCT {column}) END AS n_unique FROM"


@query("describe", WITH_GRID + f"{describe_sql('price')} grid GROUP BY ticker")
def describe(spark, sf):
    return rounded(explore.describe(grid(spark, sf), "price", guard=False), "mean", "std", "min", *POINTS, "max")


@query("describe_many", "WITH t AS (SELECT o_orderpriority AS ticker, o_totalprice AS v FROM orders) " + describe_sql("v") + " t GROUP BY ticker")
def describe_many(spark, sf):
    rows = panels.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("ticker"), F.col("o_totalprice").alias("v"))
    return rounded(explore.describe(rows, "v", guard=False), "mean", "std", "min", *POINTS, "max")


@query("missingness", WITH_GRID + f"SELECT ticker, count(*) FILTER (price IS NULL) AS na_count, {q('100.0 * (count(*) FILTER (price IS NULL)) / count(*)')} AS na_pct, min(date) FILTER (price IS NULL) AS first_na, max(date) FILTER (price IS NULL) AS last_na FROM grid GROUP BY ticker")
def missingness(spark, sf):
    return rounded(explore.missingness(grid(spark, sf), "price", guard=False), "na_pct")


@query("null_counts", WITH_GRID + "SELECT count(*) FILTER (date IS NULL) AS date_nulls, count(*) FILTER (ticker IS NULL) AS ticker_nulls, count(*) FILTER (price IS NULL) AS price_nulls, count(*) FILTER (volume IS NULL) AS volume_nulls FROM grid")
def null_counts(spark, sf):
    return explore.null_counts(grid(spark, sf))


RET_PAIRS = WITH_PREP + ", pr AS (SELECT a.ticker AS i, b.ticker AS j, a.ret AS x, b.ret AS y FROM prep a JOIN prep b ON a.date = b.date AND a.ticker < b.ticker WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL) "


@query("corr_pearson", RET_PAIRS + f"SELECT i, j, {q(o.corr('x', 'y'))} AS corr FROM pr GROUP BY i, j")
def corr_pearson(spark, sf):
    return rounded(explore.correlation_pairs(prep_panel(spark, sf), "ret", guard=False), "corr")


def _pair_rank(x: str) -> str:
    return f"(rank() OVER (PARTITION BY i, j ORDER BY {x}) + (count(*) OVER (PARTITION BY i, j, {x}) - 1) / 2.0)::DOUBLE"


QUANTISED_RET_PAIRS = RET_PAIRS + f", pq AS (SELECT i, j, {q('x')} AS x, {q('y')} AS y FROM pr) "


@query("corr_spearman", QUANTISED_RET_PAIRS + f"SELECT i, j, {q(o.corr('x', 'y'))} AS corr FROM (SELECT i, j, {_pair_rank('x')} AS x, {_pair_rank('y')} AS y FROM pq) GROUP BY i, j")
def corr_spearman(spark, sf):
    return rounded(explore.correlation_pairs(rounded(prep_panel(spark, sf), "ret"), "ret", "spearman", guard=False), "corr")


@query(
    "corr_kendall",
    QUANTISED_RET_PAIRS
    + f""", n AS (SELECT *, row_number() OVER (PARTITION BY i, j) AS rn FROM pq),
    s AS (SELECT a.i, a.j, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS score, count(*) AS pairs, count(*) FILTER (a.x = b.x) AS same_x, count(*) FILTER (a.y = b.y) AS same_y
      FROM n a JOIN n b ON a.i = b.i AND a.j = b.j AND a.rn < b.rn GROUP BY a.i, a.j)
    SELECT i, j, {q("score / nullif(sqrt(pairs - same_x) * sqrt(pairs - same_y), 0)")} AS corr FROM s""",
)
def corr_kendall(spark, sf):
    return rounded(explore.correlation_pairs(rounded(prep_panel(spark, sf), "ret"), "ret", "kendall", guard=False), "corr")


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("corr_matrix", RET_PAIRS + f", c AS (SELECT i, j, {o.corr('x', 'y')} AS corr FROM pr GROUP BY i, j), e AS (SELECT i, j, corr FROM c UNION ALL SELECT j, i, corr FROM c UNION ALL SELECT DISTINCT ticker, ticker, 1.0 FROM prep) SELECT i AS ticker, " + ", ".join(f"{q(f'max(corr) FILTER (j = {t!r})')} AS {t.replace(' ', '_')}" for t in REGIONS) + " FROM e GROUP BY i")
def corr_matrix(spark, sf):
    found = rounded(explore.correlation_matrix(prep_panel(spark, sf), "ret", REGIONS, guard=False), *REGIONS)
    return found.withColumnsRenamed({t: t.replace(" ", "_") for t in REGIONS})


@query(
    "hist_returns",
    WITH_PREP
    + f""", v AS (SELECT ticker, {q("ret")} AS v FROM prep WHERE ret IS NOT NULL), b AS (SELECT ticker, min(v) AS a, (max(v) - min(v)) / 50.0 AS w FROM v GROUP BY ticker),
    p AS (SELECT ticker, least(49, coalesce(floor((v - a) / nullif(w, 0)), 0))::INTEGER AS bin, a, w FROM v JOIN b USING (ticker))
    SELECT ticker, bin, {q("a + bin * w")} AS low, {q("a + (bin + 1) * w")} AS high, count(*) AS n FROM p GROUP BY ticker, bin, a, w""",
)
def hist_returns(spark, sf):
    return rounded(explore.histogram(rounded(prepared(spark, sf).returns, "ret"), "ret", guard=False), "low", "high")


@query(
    "kde_returns",
    WITH_PREP
    + f""", s AS (SELECT ticker, count(*)::DOUBLE AS n, stddev_samp(ret) * pow(count(*), -0.2) AS h, min(ret) AS a, max(ret) AS z FROM prep WHERE ret IS NOT NULL GROUP BY ticker HAVING stddev_samp(ret) > 0),
    g AS (SELECT ticker, n, h, k::INTEGER AS point, a - 3 * h + (z - a + 6 * h) * k / 99.0 AS x FROM s, range(100) t(k))
    SELECT ticker, point, {q("x")} AS x, {q("sum(exp(-pow((x - ret) / h, 2) / 2)) / (n * h * sqrt(2 * pi()))")} AS density FROM g JOIN prep USING (ticker) WHERE ret IS NOT NULL GROUP BY ticker, point, x, n, h""",
)
def kde_returns(spark, sf):
    return rounded(explore.density(prepared(spark, sf).returns, "ret", guard=False), "x", "density")


@query(
    "box_stats",
    WITH_PREP
    + f""", v AS (SELECT ticker, {q("ret")} AS v FROM prep WHERE ret IS NOT NULL),
    b AS (SELECT ticker, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY ticker),
    w AS (SELECT v.*, q1, m, q3, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM v JOIN b USING (ticker))
    SELECT ticker, {q("q1")} AS q1, {q("m")} AS median, {q("q3")} AS q3, min(v) FILTER (inside) AS whisker_low, max(v) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS n_outliers FROM w GROUP BY ticker, q1, m, q3""",
)
def box_stats(spark, sf):
    return rounded(explore.box_stats(rounded(prepared(spark, sf).returns, "ret"), "ret", guard=False), "q1", "median", "q3")


FIRST_15 = ", f AS (SELECT * FROM prep WHERE ticker IN (SELECT DISTINCT ticker FROM prep ORDER BY ticker LIMIT 15)) "


def _quick_summary(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    found = prepared(spark, sf)
    return explore.quick_summary(found.prices, found.returns, guard=False)


@query("quick_summary", WITH_PREP + FIRST_15 + describe_sql("ret") + " f GROUP BY ticker")
def quick_summary(spark, sf):
    return rounded(_quick_summary(spark, sf)["describe"], "mean", "std", "min", *POINTS, "max")


@query("quick_summary_missingness", WITH_PREP + FIRST_15 + f"SELECT ticker, count(*) FILTER (ret IS NULL) AS na_count, {q('100.0 * (count(*) FILTER (ret IS NULL)) / count(*)')} AS na_pct, min(date) FILTER (ret IS NULL) AS first_na, max(date) FILTER (ret IS NULL) AS last_na FROM f GROUP BY ticker")
def quick_summary_missingness(spark, sf):
    return rounded(_quick_summary(spark, sf)["missingness"], "na_pct")


@query("quick_summary_corr", WITH_PREP + FIRST_15 + f", pr AS (SELECT a.ticker AS i, b.ticker AS j, a.ret AS x, b.ret AS y FROM f a JOIN f b ON a.date = b.date AND a.ticker < b.ticker WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL) SELECT i, j, {q(o.corr('x', 'y'))} AS corr FROM pr GROUP BY i, j")
def quick_summary_corr(spark, sf):
    return rounded(_quick_summary(spark, sf)["corr"], "corr")


# Gravity


@query("mass_dollar_volume", WITH_DEFAULT + f"SELECT date, ticker, {q('ln(mass)')} AS ln_mass FROM mass")
def mass_dollar_volume(spark, sf):
    return gravity.masses(prep_panel(spark, sf)).select("date", "ticker", quantise(log_of("mass")).alias("ln_mass"))


@query("mass_market_cap", WITH_GRID + f"SELECT date, ticker, {q('greatest(coalesce(price * 1000, 1e-8), 1e-8)')} AS mass FROM grid")
def mass_market_cap(spark, sf):
    caps = grid(spark, sf).withColumn("market_cap", F.col("price") * 1000)
    return rounded(gravity.masses(caps, "market_cap"), "mass")


@query(
    "asof_mass",
    WITH_GRID + ", k AS (SELECT date, ticker FROM cal CROSS JOIN (SELECT DISTINCT ticker FROM panel)) SELECT k.date, k.ticker, coalesce(p.volume, 0) AS mass FROM k ASOF LEFT JOIN panel p ON k.ticker = p.ticker AND k.date >= p.date",
)
def asof_mass(spark, sf):
    panel = panels.region_panel(spark, sf)
    return gravity.mass_as_of(panel.select("date", "ticker", F.col("volume").alias("mass")), panels.calendar(panel))


@query("momentum_z", WITH_DEFAULT + f"SELECT date, ticker, {q('mom')} AS mom FROM mom")
def momentum_z(spark, sf):
    return rounded(gravity.momentum(prepared(spark, sf).prices), "mom")


@query("zscore_cross_section", WITH_PREP + f"SELECT date, ticker, {q(o.zscore('price'))} AS z FROM prep")
def zscore_cross_section(spark, sf):
    return prepared(spark, sf).prices.select("date", "ticker", quantise(zscore("price")).alias("z"))


@query("pair_corr_rolling", WITH_DEFAULT + f"SELECT date, i, j, {q('corr')} AS corr FROM dist")
def pair_corr_rolling(spark, sf):
    return rounded(gravity.rolling_correlations(prep_panel(spark, sf)), "corr")


@query("pair_distance", WITH_DEFAULT + f"SELECT date, i, j, {q('dist')} AS dist FROM dist")
def pair_distance(spark, sf):
    return rounded(gravity.distances(gravity.rolling_correlations(prep_panel(spark, sf))).select("date", "i", "j", "dist"), "dist")


def pair_forces(spark: SparkSession, sf: str, cap: float | None = None) -> DataFrame:
    panel = prep_panel(spark, sf)
    return forces_of(panel, cap)


def forces_of(panel: DataFrame, cap: float | None = None) -> DataFrame:
    dist = gravity.distances(gravity.rolling_correlations(panel.select("date", "ticker", "ret")))
    return gravity.forces(dist, gravity.masses(panel), cap=cap)


@query("pair_force", WITH_DEFAULT + f"SELECT date, i, j, {q('ln(force)')} AS ln_force FROM force")
def pair_force(spark, sf):
    return pair_forces(spark, sf).select("date", "i", "j", quantise(log_of("force")).alias("ln_force"))


@query("pair_force_capped", f"WITH {o.PREP}, {o.gravity(cap=FORCE_CAP)} SELECT date, i, j, {q('ln(force)')} AS ln_force FROM force")
def pair_force_capped(spark, sf):
    return pair_forces(spark, sf, FORCE_CAP).select("date", "i", "j", quantise(log_of("force")).alias("ln_force"))


@query(
    "pair_force_missing_mass",
    WITH_DEFAULT
    + f""", few AS (SELECT date, ticker, CASE WHEN volume >= avg(volume) OVER (PARTITION BY date) THEN price * volume END AS mass FROM prep),
    own AS (SELECT date, ticker, coalesce(mass, median(mass) OVER (PARTITION BY date)) AS mass FROM few)
    SELECT d.date, d.i, d.j, {q("ln(a.mass * b.mass / (d.dist * d.dist + 1e-6))")} AS ln_force FROM dist d JOIN own a ON a.date = d.date AND a.ticker = d.i JOIN own b ON b.date = d.date AND b.ticker = d.j""",
)
def pair_force_missing_mass(spark, sf):
    """Masses are unknown where a ticker trades less than the mean of its date: they become the median of the known ones."""
    panel = prep_panel(spark, sf)
    dist = gravity.distances(gravity.rolling_correlations(panel.select("date", "ticker", "ret")))
    known = F.when(F.col("volume") >= F.avg("volume").over(by_date()), F.col("price") * F.col("volume"))
    force = gravity.forces(dist, panel.select("date", "ticker", known.alias("mass")))
    return force.select("date", "i", "j", quantise(log_of("force")).alias("ln_force"))


@query("net_force", WITH_DEFAULT + f"SELECT date, ticker, {q('sign(net) * ln(1 + abs(net))')} AS net FROM net")
def net_force(spark, sf):
    panel = prep_panel(spark, sf)
    net = gravity.net_forces(forces_of(panel), gravity.momentum(panel))
    return net.select("date", "ticker", quantise(F.signum("net") * F.log(1 + F.abs("net"))).alias("net"))


@query("net_force_normalised", WITH_DEFAULT + f"SELECT date, ticker, {q(o.zscore('net', False))} AS net FROM net")
def net_force_normalised(spark, sf):
    panel = prep_panel(spark, sf)
    return rounded(gravity.net_forces(forces_of(panel), gravity.momentum(panel), True), "net")


@query("gravity_signals", WITH_DEFAULT + f"SELECT date, ticker, {q('signal')} AS signal FROM sig")
def gravity_signals(spark, sf):
    return rounded(signals(spark, sf), "signal")


@query("signal_stats", WITH_MAIN + f""", t AS (SELECT ticker, avg(signal) AS m, stddev_samp(signal) AS s, min(signal) AS a, max(signal) AS z, skewness(signal) AS k FROM sig GROUP BY ticker)
    SELECT {q("avg(m)")} AS mean, {q("avg(s)")} AS std, {q("min(a)")} AS min, {q("max(z)")} AS max, {q("avg(k)")} AS skewness FROM t""")
def signal_stats(spark, sf):
    return rounded(explore.panel_stats(signals(spark, sf, MAIN), "signal"), "mean", "std", "min", "max", "skewness")


@query("avg_rank", WITH_OHLCV + "SELECT date, ticker, volume, (rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0)::DOUBLE AS volume_rank FROM ohlcv")
def avg_rank(spark, sf):
    return panels.order_panel(spark, sf).select("date", "ticker", "volume", average_rank("volume", "date").alias("volume_rank"))


@query("ic_spearman", with_ics([5]) + f"SELECT date, {q('ic')} AS ic FROM ics")
def ic_spearman(spark, sf):
    return rounded(horizon_ics(spark, sf, [5]).drop("horizon"), "ic")


@query("ic_pearson", with_ics([5], "pearson") + f"SELECT date, {q('ic')} AS ic FROM ics")
def ic_pearson(spark, sf):
    return rounded(horizon_ics(spark, sf, [5], "pearson").drop("horizon"), "ic")


BY_HORIZON = with_ics(HORIZONS) + ", m AS (SELECT DISTINCT f.horizon, (SELECT avg(ic) FROM ics i WHERE i.horizon = f.horizon) AS mean_ic FROM fwds f) "


@query("ic_by_horizon", BY_HORIZON + f"SELECT horizon, {q('mean_ic')} AS mean_ic FROM m")
def ic_by_horizon(spark, sf):
    """Mean IC by horizon. On the driver's tables it shows how prices revert, not that the signal predicts."""
    return rounded(gravity.mean_ic(horizon_ics(spark, sf, HORIZONS), HORIZONS).select("horizon", "mean_ic"), "mean_ic")


@query("best_horizon", BY_HORIZON + f"SELECT horizon, {q('mean_ic')} AS mean_ic FROM m WHERE mean_ic IS NOT NULL ORDER BY abs(mean_ic) DESC, horizon LIMIT 1")
def best_horizon(spark, sf):
    return rounded(gravity.best_of(gravity.mean_ic(horizon_ics(spark, sf, HORIZONS), HORIZONS), "mean_ic", "pos").select("horizon", "mean_ic"), "mean_ic")


@query("ic_rolling_30", with_ics([5]) + f"SELECT date, {q('ic')} AS ic, {q(o.roll('avg', 'ic', 30, 30, 'ORDER BY date'))} AS ic_rolling FROM ics")
def ic_rolling_30(spark, sf):
    return rounded(gravity.rolling_ic(horizon_ics(spark, sf, [5]).drop("horizon")), "ic", "ic_rolling")


def sweep_sql() -> str:
    parts = [f"{o.gravity(c.mass_window, c.dist_window, c.dist_min_periods, c.momentum_lookback, tag=str(k))}, {o.ic(tag=str(k), out=f'ics{k}')}" for k, c in enumerate(CONFIGS)]
    stacked = " UNION ALL ".join(f"SELECT {k} AS config, horizon, avg(ic) AS mean_ic FROM ics{k} GROUP BY horizon" for k in range(len(CONFIGS)))
    return f"WITH {o.PREP}, {o.forward(SWEEP_HORIZONS)}, {', '.join(parts)}, sweep AS ({stacked}), every AS (SELECT c::INTEGER AS config, h AS horizon FROM range({len(CONFIGS)}) t(c), unnest({SWEEP_HORIZONS}) u(h)), m AS (SELECT * FROM every LEFT JOIN sweep USING (config, horizon)) "


def sweep(spark: SparkSession, sf: str) -> DataFrame:
    panel = prep_panel(spark, sf)
    return gravity.config_sweep(panel, CONFIGS, SWEEP_HORIZONS, places=6)


@query("config_sweep", sweep_sql() + f"SELECT config, horizon, {q('mean_ic')} AS mean_ic FROM m")
def config_sweep(spark, sf):
    return rounded(sweep(spark, sf).select("config", "horizon", "mean_ic"), "mean_ic")


@query("best_config", sweep_sql() + f"SELECT config, horizon, {q('mean_ic')} AS mean_ic FROM m WHERE mean_ic IS NOT NULL ORDER BY abs(mean_ic) DESC, config, horizon LIMIT 1")
def best_config(spark, sf):
    return rounded(gravity.best_of(sweep(spark, sf), "mean_ic", "config", "pos").select("config", "horizon", "mean_ic"), "mean_ic")


# JSON payloads and files


OHLCV_COLUMNS = ["open", "high", "low", "close", "volume"]
STORE_LISTS = ", ".join(f"""'"{c}":[' || string_agg(coalesce({c}::VARCHAR, 'null'), ',' ORDER BY date) || ']'""" for c in OHLCV_COLUMNS).replace(", '\"", " || ',' || '\"")


@query("json_store_encode", WITH_OHLCV + f"""SELECT ticker, '{{"index":[' || string_agg('"' || strftime(date, '%Y-%m-%d') || '"', ',' ORDER BY date) || '],"data":{{' || {STORE_LISTS} || '}}}}' AS store FROM ohlcv GROUP BY ticker""")
def json_store_encode(spark, sf):
    return sinks.encode_column_store(panels.order_panel(spark, sf), OHLCV_COLUMNS)


@query("json_store_decode", WITH_OHLCV + "SELECT date, ticker, open, high, low, close, volume FROM ohlcv")
def json_store_decode(spark, sf):
    return sinks.decode_column_store(sinks.encode_column_store(panels.order_panel(spark, sf), OHLCV_COLUMNS), OHLCV_COLUMNS)


@query("chart_specs")
def chart_specs(spark, sf):
    return dashboard.chart_specs(panels.order_panel(spark, sf), "1-urgent", "1y", AS_OF)


def _traces() -> str:
    sma = [f"SELECT date, 'technical' AS chart, 'SMA_{w}' AS trace, {o.roll('avg', 'close', w)} AS value FROM few" for w in (5, 10, 20, 50)]
    bands = [f"SELECT date, 'technical', '{name}', {x} FROM few" for name, x in (("middle", MID), ("upper", f"{MID} + 2 * {STD}"), ("lower", f"{MID} - 2 * {STD}"), ("close", "close"))]
    candles = [f"SELECT date, 'candlestick', '{c}', {c} FROM few" for c in ("open", "high", "low", "close")]
    return " UNION ALL ".join([*sma, *bands, *candles, "SELECT date, 'volume', 'volume', volume FROM few", "SELECT date, 'rsi', 'rsi', CASE WHEN down = 0 THEN CASE WHEN up > 0 THEN 100.0 END ELSE 100 - 100 / (1 + up / down) END FROM a"])


@query(
    "chart_traces",
    WITH_OHLCV
    + f""", few AS (SELECT * FROM ohlcv WHERE ticker = '1-URGENT' AND date BETWEEN DATE '{AS_OF}' - 365 AND DATE '{AS_OF}'),
    d AS (SELECT ticker, date, close - {o.back("close")} AS delta FROM few),
    g AS (SELECT ticker, date, CASE WHEN delta > 0 THEN delta ELSE 0 END AS gain, CASE WHEN delta < 0 THEN -delta ELSE 0 END AS loss FROM d),
    a AS (SELECT ticker, date, {o.roll("avg", "gain", 14)} AS up, {o.roll("avg", "loss", 14)} AS down FROM g)
    SELECT chart, trace, date, {q("value")} AS value FROM ({_traces()})""",
)
def chart_traces(spark, sf):
    """What the chart specifications hold, read back from their JSON: a row a trace and date."""
    specs = dashboard.chart_specs(panels.order_panel(spark, sf), "1-urgent", "1y", AS_OF)
    names = list(dict.fromkeys(c for columns in dashboard.CHART_COLUMNS.values() for c in columns if c != "colour"))
    read = specs.select("chart", F.from_json("spec", "x array<string>, " + ", ".join(f"{c} array<double>" for c in names)).alias("s"))
    traces = F.explode(F.array(*(F.struct(F.lit(c).alias("trace"), F.col(f"s.{c}").alias("values")) for c in names))).alias("t")
    rows = read.select("chart", "s.x", traces).where("t.values is not null")
    points = rows.select("chart", "t.trace", F.explode(F.arrays_zip(F.col("x").alias("x"), F.col("t.values").alias("value"))).alias("p"))
    return points.select("chart", "trace", F.to_date("p.x").alias("date"), quantise(F.col("p.value")).alias("value"))


CARDS = SUMMARY.replace("WHERE true", f"WHERE ticker = '1-URGENT' AND date BETWEEN DATE '{AS_OF}' - 365 AND DATE '{AS_OF}'")


@query("summary_cards", CARDS + f"SELECT ticker, {', '.join(f'{q(c)} AS {c}' for c in STATS)}, CASE WHEN price_change < 0 THEN 'red' ELSE 'green' END AS change_colour FROM t")
def summary_cards(spark, sf):
    return rounded(dashboard.summary_cards(panels.order_panel(spark, sf), "1-urgent", "1y", AS_OF).select("ticker", *STATS, "change_colour"), *STATS)


@query("roundtrip_parquet", WITH_OHLCV + "SELECT date, ticker, close, volume FROM ohlcv")
def roundtrip_parquet(spark, sf):
    path = sinks.save_processed(panels.order_panel(spark, sf), scratch_path(spark, "parquet"), save_csv=False)[0]
    return panels.read_ohlcv(spark, path).select("date", "ticker", "close", "volume")


@query("roundtrip_csv", WITH_OHLCV + "SELECT date, ticker, close, volume FROM ohlcv")
def roundtrip_csv(spark, sf):
    path = sinks.save_processed(panels.order_panel(spark, sf), scratch_path(spark, "csv"), save_parquet=False)[0]
    return panels.read_ohlcv(spark, path, "csv").select("date", "ticker", "close", "volume")


@query("roundtrip_two_header_csv", WITH_OHLCV + "SELECT date, ticker, open, high, low, close, volume FROM ohlcv WHERE ticker = '1-URGENT'")
def roundtrip_two_header_csv(spark, sf):
    rows = panels.order_panel(spark, sf).where("ticker = '1-URGENT'")
    text = rows.select(F.col("date").cast("string").alias("Date"), *(F.col(c).cast("string").alias(c.title()) for c in OHLCV_COLUMNS))
    names = spark.createDataFrame([(None, *["1-URGENT"] * len(OHLCV_COLUMNS))], text.schema)
    path = scratch_path(spark, "two_header")
    names.unionByName(text).coalesce(1).write.option("header", True).csv(path)  # one ticker's days: the format is one small file
    return panels.read_two_header_csv(spark, path)


from marketloom.plans import advanced  # noqa: E402, F401  it registers its queries here
