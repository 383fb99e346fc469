"""Kendall's tau-b of many pairs of tickers, with a pair's dates spread over buckets of values.

Two dates of a pair are in different buckets of both tickers, in one bucket of the first, or in one of the second only. The first are counted from a table of
BUCKETS * BUCKETS counts a pair, by built-in sums; the others by merging inside a bucket. A bucket has about a BUCKETS-th of a pair's dates, more
only where they share a value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.expressions import divide

BUCKETS = 16
FOUND = "i string, j string, first boolean, n long, against long, ties long, both long"


def disorder(values: np.ndarray) -> int:
    """Pairs of places whose values fall, by merging halves."""

    def merged(part: np.ndarray) -> tuple[int, np.ndarray]:
        if len(part) < 2:
            return 0, part
        (a, low), (b, high) = merged(part[: len(part) // 2]), merged(part[len(part) // 2 :])
        return a + b + int((len(low) - np.searchsorted(low, high, side="right")).sum()), np.sort(part)

    return merged(values)[0]


def tied(*keys: np.ndarray) -> int:
    """Pairs of places that are equal in all keys."""
    counts = np.unique(np.stack(keys), axis=1, return_counts=True)[1].astype(np.int64)
    return int((counts * (counts - 1) // 2).sum())


def _bucket_counts(table: pa.Table) -> pa.Table:
    """Of one bucket: pairs that fall in y as they rise in x; pairs with equal x (of a bucket of y: equal y), and with both equal."""
    first = table.column("first")[0].as_py()
    x, y = (table.column(c).to_numpy() for c in ("x", "y"))
    against = disorder(y[np.lexsort((y, x))])
    row = {"i": table.column("i")[0].as_py(), "j": table.column("j")[0].as_py(), "first": first, "n": len(x), "against": against, "ties": tied(x) if first else tied(y), "both": tied(x, y) if first else 0}
    return pa.Table.from_pylist([row], pa.schema([("i", pa.string()), ("j", pa.string()), ("first", pa.bool_()), *((c, pa.int64()) for c in ("n", "against", "ties", "both"))]))


def with_buckets(panel: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """(date, ticker, v, bucket): a value's bucket among its ticker's values, cut at approximate quantiles; equal values are in one bucket."""
    rows = panel.select("date", "ticker", F.col(column).cast("double").alias("v")).where("v is not null")
    cuts = rows.groupBy("ticker").agg(F.percentile_approx("v", F.array(*(F.lit(k / buckets) for k in range(1, buckets))), F.lit(1000)).alias("cuts"))
    return rows.join(cuts, "ticker").select("date", "ticker", "v", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("bucket"))


def kendall_pairs(panel: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """(i, j, corr) for i < j over the dates that both have: tau-b; NULL where one is constant."""
    rows = with_buckets(panel, column, buckets)
    side = lambda k, v, b: rows.select("date", F.col("ticker").alias(k), F.col("v").alias(v), F.col("bucket").alias(b))
    pairs = side("i", "x", "bx").join(side("j", "y", "by"), "date").where("i < j")
    # Dates of different buckets of both: for each bucket of x, those with a lower one and a higher y.
    counts = [F.count_if(F.col("by") == k).alias(f"c{k}") for k in range(buckets)]
    table = pairs.groupBy("i", "j", "bx").agg(*counts)
    lower = Window.partitionBy("i", "j").orderBy("bx").rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumns({f"p{k}": F.coalesce(F.sum(f"c{k}").over(lower), F.lit(0)) for k in range(buckets)})
    higher = [sum((F.col(f"p{m}") for m in range(k + 1, buckets)), F.lit(0)) for k in range(buckets)]
    cross = table.groupBy("i", "j").agg(F.sum(sum((F.col(f"c{k}") * higher[k] for k in range(buckets)), F.lit(0))).alias("across"))
    # The rest: inside each bucket of x by x; inside each bucket of y by the bucket of x, as one bucket's dates are in order of y.
    halves = F.array(
        F.struct(F.lit(True).alias("first"), F.col("bx").alias("bucket"), F.col("x").alias("x")), F.struct(F.lit(False).alias("first"), F.col("by").alias("bucket"), F.col("bx").cast("double").alias("x"))
    )
    dealt = pairs.select("i", "j", "y", F.inline(halves))
    found = dealt.groupBy("i", "j", "first", "bucket").applyInArrow(_bucket_counts, FOUND)
    of = lambda c, first: F.coalesce(F.sum(F.when(F.col("first") == first, F.col(c))), F.lit(0))
    sums = found.groupBy("i", "j").agg(of("n", True).alias("n"), F.sum("against").alias("against"), of("ties", True).alias("same_x"), of("ties", False).alias("same_y"), of("both", True).alias("same"))
    every = F.col("n") * (F.col("n") - 1) / 2
    score = every - F.col("same_x") - F.col("same_y") + F.col("same") - 2.0 * (F.col("against") + F.col("across"))
    spread = F.sqrt(every - F.col("same_x")) * F.sqrt(every - F.col("same_y"))
    return sums.join(cross, ["i", "j"]).select("i", "j", divide(score, F.nullif(spread, F.lit(0.0))).alias("corr"))
