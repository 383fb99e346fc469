"""Correlations by blocks of dates and tickers, and densities by bins: sums of bounded size in place of a row for each pair or point of each value."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days and tickers of a block.
DATE_BLOCK, TICKER_BLOCK = 256, 64
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _gram(table: pa.Table) -> pa.Table:
    """(i, j, sums) of every two tickers i < j of two ticker blocks over one block of dates: products of matrices and of their masks."""
    tickers, column = table.column("ticker").combine_chunks().dictionary_encode(), table.column("date").combine_chunks().dictionary_encode()
    names = np.array(tickers.dictionary.to_pylist(), dtype=object)
    own = np.zeros(len(names), dtype=np.int64)
    own[tickers.indices.to_numpy()] = table.column("block").to_numpy()
    x = np.full((len(column.dictionary), len(names)), np.nan)
    x[column.indices.to_numpy(), tickers.indices.to_numpy()] = table.column("x").to_numpy()
    known = ~np.isnan(x)
    mask, value = known.astype(np.float64), np.where(known, x, 0.0)
    p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
    a, b = np.flatnonzero(own == p), np.flatnonzero(own == q)
    ma, mb, va, vb = mask[:, a], mask[:, b], value[:, a], value[:, b]
    sums = dict(zip(SUMS, (ma.T @ mb, va.T @ mb, ma.T @ vb, (va**2).T @ mb, ma.T @ vb**2, va.T @ vb), strict=True))
    first, other = np.meshgrid(names[a], names[b], indexing="ij")
    met = (sums["n"] > 0) & (first != other)
    if p == q:
        met &= first < other
    swap = (first > other)[met]
    out = {k: s[met] for k, s in sums.items()}
    for one, two in (("sx", "sy"), ("sxx", "syy")):
        out[one], out[two] = np.where(swap, out[two], out[one]), np.where(swap, out[one], out[two])
    i, j = np.where(swap, other[met], first[met]), np.where(swap, first[met], other[met])
    return pa.table({"i": pa.array(i, pa.string()), "j": pa.array(j, pa.string()), **{k: pa.array(v, pa.float64()) for k, v in out.items()}})


def blocked_correlations(panel: DataFrame, column: str, date_block: int = DATE_BLOCK, ticker_block: int = TICKER_BLOCK) -> DataFrame:
    """(i, j, corr) for i < j over the dates that both have: Pearson's, NULL for constants and fewer than two dates.

    A task multiplies two blocks of ticker_block tickers over date_block days; what is shuffled after it is a row for each pair and block of dates, not for each pair
    and date. Values are centred by their ticker's mean first. Of rows of one ticker and date one counts.
    """
    rows = panel.select("date", "ticker", F.col(column).cast("double").alias("x")).where("x is not null and ticker is not null and date is not null")
    means = rows.groupBy("ticker").agg(F.avg("x").alias("mean"))
    n_blocks = max(1, -(-means.count() // ticker_block))
    centred = rows.join(means, "ticker").select("date", "ticker", (F.col("x") - F.col("mean")).alias("x"), F.pmod(F.xxhash64("ticker"), F.lit(n_blocks)).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    dealt = centred.withColumns({"days": F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / date_block).cast("int"), "other": other})
    dealt = dealt.select("days", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "date", "ticker", "block", "x")
    schema = "i string, j string, " + ", ".join(f"{s} double" for s in SUMS)
    sums = dealt.groupBy("days", "p", "q").applyInArrow(_gram, schema).groupBy("i", "j").agg(*(F.sum(s).alias(s) for s in SUMS))
    n, spread = F.col("n"), lambda s, ss: n * F.col(ss) - F.col(s) * F.col(s)
    constant = (spread("sx", "sxx") <= 1e-12 * n * F.col("sxx")) | (spread("sy", "syy") <= 1e-12 * n * F.col("syy"))
    corr = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.sqrt(spread("sx", "sxx")) * F.sqrt(spread("sy", "syy")), F.lit(0.0))
    return sums.select("i", "j", F.when((n > 1) & ~constant, corr).alias("corr"))


def binned_density(panel: DataFrame, column: str, points: int = 100, bins: int = 2048) -> DataFrame:
    """(ticker, point, x, density): Gaussian kernel density by Scott's rule at so many points, three bandwidths beyond the values; no rows without spread.

    A value is dealt to the two nodes of a grid of `bins` cells around it, by its distance to them; the kernel is summed over nodes. That costs a pass over the values and
    bins * points terms a ticker, and differs from the sum over all values by a share of the cell's width squared.
    """
    known = panel.where(F.col(column).isNotNull()).select("ticker", F.col(column).alias("v"))
    stats = known.groupBy("ticker").agg(F.count(F.lit(1)).cast("double").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("a"), F.max("v").alias("z")).where("sd > 0")
    stats = stats.withColumn("h", F.col("sd") * F.pow("n", F.lit(-0.2))).withColumn("cell", (F.col("z") - F.col("a")) / bins)
    at = known.join(stats, "ticker").withColumn("pos", F.least((F.col("v") - F.col("a")) / F.col("cell"), F.lit(float(bins))))
    low, share = F.floor("pos"), F.col("pos") - F.floor("pos")
    dealt = at.select("ticker", F.explode(F.array(F.struct(low.alias("node"), (1.0 - share).alias("w")), F.struct((low + 1).alias("node"), share.alias("w")))).alias("d")).where("d.w > 0")
    nodes = dealt.groupBy("ticker", "d.node").agg(F.sum("d.w").alias("w"))
    grid = nodes.join(stats, "ticker").withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("x", F.col("a") - 3 * F.col("h") + (F.col("z") - F.col("a") + 6 * F.col("h")) * F.col("point") / F.lit(float(points - 1)))
    kernel = F.col("w") * F.exp(-F.pow((F.col("x") - F.col("a") - F.col("node") * F.col("cell")) / F.col("h"), F.lit(2.0)) / 2.0)
    sums = grid.groupBy("ticker", "point", "x", "n", "h").agg(F.sum(kernel).alias("s"))
    return sums.select("ticker", "point", "x", (F.col("s") / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))
