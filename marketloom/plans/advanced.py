"""Registered queries of scans over time blocks, walk-forward validation and direction models."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions.expressions import by_ticker, divide, lagged_change, quantise
from marketloom.operators import blocks, clean, features, models, ranges, scan, validate
from marketloom.plans import catalog as c
from marketloom.plans import oracle as o
from marketloom.plans.catalog import query
from marketloom.plans.oracle import q
from marketloom.sources import connector, panels
from marketloom.sources.scratch import materialise, scratch_path
from marketloom.streaming import features as stream

# Exponential means: the recurrence, row after row.

EMA = f"""WITH RECURSIVE {o.OHLCV}, k AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM ohlcv
), e(ticker, rn, date, fast, slow, signal) AS (
  SELECT ticker, rn, date, close, close, 0.0::DOUBLE FROM k WHERE rn = 1
  UNION ALL
  SELECT ticker, rn, date, fast, slow, signal + (fast - slow - signal) / 5 FROM (
    SELECT k.ticker, k.rn, k.date, fast + 2 * (close - fast) / 13 AS fast, slow + 2 * (close - slow) / 27 AS slow, signal FROM e JOIN k ON k.ticker = e.ticker AND k.rn = e.rn + 1)
) """
#: Means of prices in the hundred thousands, whose last digits depend on the order of additions.
PLACES = 3


@query("ind_ema", EMA + f"SELECT date, ticker, {q('fast', PLACES)} AS EMA_12, {q('slow', PLACES)} AS EMA_26 FROM e")
def ind_ema(spark, sf):
    found = scan.ema(panels.order_panel(spark, sf).select("date", "ticker", "close"), "close", [12, 26])
    return found.select("date", "ticker", *(quantise(n, PLACES).alias(n) for n in ("EMA_12", "EMA_26")))


@query("ind_macd", EMA + f"SELECT date, ticker, {q('fast - slow', PLACES)} AS macd, {q('signal', PLACES)} AS macd_signal, {q('fast - slow - signal', PLACES)} AS macd_hist FROM e")
def ind_macd(spark, sf):
    found = scan.macd(panels.order_panel(spark, sf).select("date", "ticker", "close"))
    return found.select("date", "ticker", *(quantise(n, PLACES).alias(n) for n in ("macd", "macd_signal", "macd_hist")))


# Carried values and falls, by blocks.


@query("ffill_blocks", c.ORACLE["ffill_limit"])
def ffill_blocks(spark, sf):
    return c.rounded(scan.fill_forward(c.grid(spark, sf).select("date", "ticker", "price"), "price", 5), "price")


@query("returns_blocks", c.ORACLE["returns_simple"])
def returns_blocks(spark, sf):
    return c.rounded(scan.simple_returns(c.grid(spark, sf).select("date", "ticker", "price")).select("date", "ticker", "ret"), "ret")


PEAKS = c.WITH_GRID + ", g AS (SELECT date, ticker, price, max(price) OVER w AS peak, price / max(price) OVER w - 1 AS fall FROM grid WINDOW w AS (PARTITION BY ticker ORDER BY date)) "


@query("drawdowns", PEAKS + f"SELECT date, ticker, {q('peak')} AS peak, {q('fall')} AS drawdown, {q('min(fall) OVER (PARTITION BY ticker ORDER BY date)')} AS max_drawdown FROM g")
def drawdowns(spark, sf):
    found = scan.drawdowns(c.grid(spark, sf).select("date", "ticker", "price"))
    return c.rounded(found.drop("price"), "peak", "drawdown", "max_drawdown")


@query(
    "risk_stats",
    f"WITH {o.PANEL}, r AS (SELECT ticker, price / max(price) OVER (PARTITION BY ticker ORDER BY date) - 1 AS fall, ln(price) - {o.back('ln(price)')} AS ret FROM panel WHERE price > 0) "
    f"SELECT ticker, {q('min(fall)')} AS max_drawdown, {q('avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252)')} AS sharpe FROM r GROUP BY ticker",
)
def risk_stats(spark, sf):
    return c.rounded(scan.risk_stats(panels.region_panel(spark, sf)), "max_drawdown", "sharpe")


# Rolling windows by stretches of a ticker.


@query("rsi_stretches", c.ORACLE["ind_rsi"])
def rsi_stretches(spark, sf):
    bars = panels.order_panel(spark, sf).select("date", "ticker", "close")
    return c.rounded(ranges.in_stretches(bars, 14, lambda rows, over: features.rsi(rows, 14, over), 256).select("date", "ticker", "rsi"), "rsi")


@query("features_stretches", c.ORACLE["features_all"])
def features_stretches(spark, sf):
    panel = c.prepared(spark, sf).panel.select("date", "ticker", "price", "ret")
    return c.rounded(ranges.in_stretches(panel, 60, lambda rows, over: features.technical_features(rows, over=over), 512), *c.FEATURES)


# Walk-forward validation: the next row's return by the last five rows' momentum.

PLAN = validate.WalkForward()
MOMENTUM = f"""{o.PREP}, r AS (
  SELECT date, ticker, price / nullif({o.back("price", 5)}, 0) - 1 AS x, lead(price) OVER (PARTITION BY ticker ORDER BY date) / nullif(price, 0) - 1 AS y FROM prep
), span AS (SELECT min(date) AS a, max(date) AS z FROM r), ks AS (SELECT a, unnest(range((z - a + 1 - {PLAN.train_days}) // {PLAN.test_days})) AS k FROM span
), f AS (
  SELECT k::INTEGER AS fold, a AS train_start, (a + ({PLAN.train_days - PLAN.purge_days} + k * {PLAN.test_days})::INTEGER) AS train_end,
         (a + ({PLAN.train_days} + k * {PLAN.test_days})::INTEGER) AS test_start, (a + ({PLAN.train_days + PLAN.test_days} + k * {PLAN.test_days})::INTEGER) AS test_end FROM ks
)"""


def momentum_rows(spark, sf):
    """Features and target of every date and ticker, written once: folds, fit and test all read them."""
    panel = c.prepared(spark, sf).panel
    fwd = divide(F.lead("price", 1).over(by_ticker()), F.col("price")) - 1
    return materialise(panel.select("date", "ticker", lagged_change("price", 5).alias("x"), fwd.alias("y")), "momentum")


@query("walk_forward_folds", f"WITH {MOMENTUM} SELECT f.*, count(*) FILTER (date >= train_start AND date < train_end) AS n_train, count(*) FILTER (date >= test_start AND date < test_end) AS n_test FROM f, r GROUP BY ALL")
def walk_forward_folds(spark, sf):
    rows = momentum_rows(spark, sf)
    return validate.fold_counts(rows, validate.folds(rows, PLAN))


@query(
    "walk_forward_metrics",
    f"""WITH {MOMENTUM}, fit AS (SELECT fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM f JOIN r ON date >= train_start AND date < train_end GROUP BY fold
    ), p AS (SELECT fold, y, a + b * x AS p FROM f JOIN r ON date >= test_start AND date < test_end JOIN fit USING (fold) WHERE x IS NOT NULL AND y IS NOT NULL
    ), m AS (SELECT fold, count(*) AS n, count(*) FILTER ((y > 0) = (p > 0)) AS hit, count(*) FILTER (y > 0 AND p > 0) AS tp, count(*) FILTER (p > 0) AS said, count(*) FILTER (y > 0) AS is_so,
      sqrt(avg((p - y) * (p - y))) AS rmse, avg(abs(p - y)) AS mae FROM p GROUP BY fold)
    SELECT fold, n, {q("hit / n")} AS accuracy, {q("tp / nullif(said, 0)")} AS precision, {q("tp / nullif(is_so, 0)")} AS recall, {q("2 * tp / nullif(said + is_so, 0)")} AS f1, {q("rmse")} AS rmse, {q("mae")} AS mae FROM m""",
)
def walk_forward_metrics(spark, sf):
    found = validate.walk_forward(momentum_rows(spark, sf), ["x"], "y", PLAN)
    return c.rounded(found, "accuracy", "precision", "recall", "f1", "rmse", "mae")


@query("direction_models")
def direction_models(spark, sf):
    """Held-out metrics of logistic regression, random forest and boosted trees in every fold. Prices of the driver's tables revert, so they beat a coin."""
    rows = materialise(models.direction_rows(c.prepared(spark, sf).panel), "direction")
    return models.direction_models(rows, models.feature_names(), PLAN)


# Bars from a store of files by ticker and year, and features of a stream of them.


@query("connector_bars", c.WITH_OHLCV + "SELECT date, ticker, open, high, low, close, volume FROM ohlcv WHERE ticker IN ('1-URGENT', '4-NOT SPECIFIED') AND date >= DATE '1995-07-01' AND date < DATE '1997-02-01'")
def connector_bars(spark, sf):
    folder = scratch_path(spark, "bars")
    connector.write_store(panels.order_panel(spark, sf), folder)
    return connector.read_store(spark, folder, ["1-URGENT", "4-NOT SPECIFIED"], "1995-07-01", "1997-02-01")


STREAMED = {"ret": "ret", **c.FEATURES, "EMA_12": "fast", "EMA_26": "slow"}
LEVELS = ("EMA_12", "EMA_26")


@query(
    "stream_features",
    EMA
    + f""", prep AS (SELECT ticker, date, close AS price, ln(close) - {o.back("ln(close)")} AS ret FROM ohlcv)
    SELECT date, ticker, {", ".join(f"{q(sql, PLACES if n in LEVELS else 6)} AS {n}" for n, sql in STREAMED.items())} FROM prep JOIN e USING (ticker, date)""",
)
def stream_features(spark, sf):
    """The streaming query over all bars, which arrive in three parts; it starts anew, from its checkpoint, for each."""
    bars = panels.order_panel(spark, sf).select(F.col("date").cast("timestamp").alias("ts"), "ticker", F.col("close").alias("price"))
    found = stream.replay(materialise(bars, "bars"))
    return found.select(F.to_date("ts").alias("date"), "ticker", *(quantise(n, PLACES if n in LEVELS else 6).alias(n) for n in STREAMED))


# Sums by blocks and bins.


@query("corr_blocked", c.ORACLE["corr_pearson"])
def corr_blocked(spark, sf):
    return c.rounded(blocks.blocked_correlations(c.prep_panel(spark, sf), "ret"), "corr")


@query(
    "kde_binned",
    c.WITH_PREP
    + f""", s AS (SELECT ticker, count(*)::DOUBLE AS n, stddev_samp(ret) * pow(count(*), -0.2) AS h, min(ret) AS a, max(ret) AS z FROM prep WHERE ret IS NOT NULL GROUP BY ticker HAVING stddev_samp(ret) > 0),
    p AS (SELECT ticker, least((ret - a) / ((z - a) / 2048), 2048.0) AS pos FROM prep JOIN s USING (ticker) WHERE ret IS NOT NULL),
    w AS (SELECT ticker, node, sum(w) AS w FROM (SELECT ticker, floor(pos) AS node, 1 - (pos - floor(pos)) AS w FROM p UNION ALL SELECT ticker, floor(pos) + 1, pos - floor(pos) FROM p) WHERE w > 0 GROUP BY ticker, node),
    g AS (SELECT ticker, n, h, a, (z - a) / 2048 AS cell, k::INTEGER AS point, a - 3 * h + (z - a + 6 * h) * k / 99.0 AS x FROM s, range(100) t(k))
    SELECT ticker, point, {q("x")} AS x, {q("sum(w * exp(-pow((x - a - node * cell) / h, 2) / 2)) / (n * h * sqrt(2 * pi()))")} AS density FROM g JOIN w USING (ticker) GROUP BY ticker, point, x, n, h""",
)
def kde_binned(spark, sf):
    return c.rounded(blocks.binned_density(c.prepared(spark, sf).returns, "ret"), "x", "density")


VERDICTS = """WITH given AS (
  SELECT 'orders' AS name, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS ticker, o_orderkey AS place FROM orders
  UNION ALL SELECT 'ordered', CAST(o_orderdate AS DATE), o_orderpriority, row_number() OVER (ORDER BY o_orderdate, o_orderkey) FROM orders
  UNION ALL SELECT 'days', CAST(o_orderdate AS DATE), o_orderpriority, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) FROM orders GROUP BY ALL
), steps AS (SELECT *, date < lag(date) OVER (PARTITION BY name, ticker ORDER BY place) AS back FROM given),
counts AS (SELECT name, count(*) AS n, count_if(back) AS n_back, count(*) - count(DISTINCT (ticker, date)) AS n_twice FROM steps GROUP BY name)
SELECT r.name, CASE WHEN n IS NULL THEN 'Price panel is empty.' WHEN n_back > 0 THEN 'Dates must be sorted ascending (monotonic increasing).'
  WHEN n_twice > 0 THEN 'Panel contains duplicate timestamps.' ELSE 'ok' END AS verdict
FROM (VALUES ('orders'), ('ordered'), ('days'), ('none')) r(name) LEFT JOIN counts USING (name)"""


@query("validate_verdicts", VERDICTS)
def validate_verdicts(spark, sf):
    """What the validation of prices says of orders by key, of orders by date, of days on which orders were made, and of no orders."""
    rows = panels.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("ticker"), F.col("o_orderkey").cast("long").alias("at"))
    day = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long")
    days = rows.select("date", "ticker").distinct().withColumn("at", day)
    cases = {"orders": rows, "ordered": rows.withColumn("at", day), "days": days, "none": rows.where(F.lit(False))}
    said = []
    for name, case in cases.items():
        try:
            clean.validate_prices(case, "at")
            said.append((name, "ok"))
        except ValueError as e:
            said.append((name, str(e)))
    return spark.createDataFrame(said, "name string, verdict string")
