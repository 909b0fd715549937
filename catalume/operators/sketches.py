"""A16 at scale: run durations as mergeable quantile sketches per day and class, kept as a table.

Sketches of a day are made once; any later question over days or classes merges them, so its
cost follows the number of sketches and not of runs. The exact percentile stays beside it in
``logs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a sketch; ranks are off by about 1.33 % at 200, with 99 % confidence, and by less the larger it is.
K = 400


def sketches(runs: DataFrame, *keys: str, value: str = "seconds", k: int = K) -> DataFrame:
    """``(keys, sketch, n)`` of the values that aren't null; groups without any have no row."""
    known = runs.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"), F.count("*").alias("n"))


def merged(table: DataFrame, *keys: str, k: int = K) -> DataFrame:
    """Sketches of coarser keys out of those of finer ones."""
    return table.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))


def quantiles(table: DataFrame, *ranks: float) -> DataFrame:
    """``q<percent>`` columns beside each sketch's keys and count."""
    columns = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(r))).alias(f"q{round(100 * r)}") for r in ranks]
    return table.select(*[c for c in table.columns if c != "sketch"], *columns)
