"""Intervals for medians without gathering a group's rows."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Draws that a task holds at a time.
DRAWS = 4_000_000


def _medians(values: np.ndarray, counts: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """The median of each Poisson resample: a value that n rows have gets a weight of Poisson(n), the sum of n draws of Poisson(1)."""
    rng = np.random.default_rng(seed)
    step = max(1, DRAWS // len(values))
    out = []
    for k in range(0, replicates, step):
        total = np.cumsum(rng.poisson(counts, (min(step, replicates - k), len(values))), axis=1)
        n = total[:, -1]
        low, high = ((total > half[:, None]).argmax(1) for half in ((n - 1) // 2, n // 2))
        out.append(((values[low] + values[high]) / 2)[n > 0])
    return np.concatenate(out)


def bootstrap_median(df: DataFrame, group: str, value: str, replicates: int = 2000, least: int = 10, seed: int = 42) -> DataFrame:
    """``group, median, n, low, high``: the median of each group of ``least`` rows or more, with a 95 % interval from Poisson resamples.

    Rows are first counted by value, so a group goes to its task as its distinct values (days of age), whatever its rows.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("_value")).agg(F.count("*").alias("_count"))

    def interval(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_value")
        n = int(g._count.sum())
        values, counts = g._value.to_numpy(), g._count.to_numpy()
        total = np.cumsum(counts)
        plain = (values[np.searchsorted(total, (n - 1) // 2, "right")] + values[np.searchsorted(total, n // 2, "right")]) / 2
        drawn = _medians(values, counts, replicates, seed + zlib.crc32(str(g[group].iloc[0]).encode()))
        return pd.DataFrame({group: [g[group].iloc[0]], "median": [plain], "n": [n], "low": [np.quantile(drawn, 0.025)], "high": [np.quantile(drawn, 0.975)]})

    kind = df.schema[group].dataType.simpleString()
    return counted.groupBy(group).applyInPandas(interval, f"{group} {kind}, median double, n long, low double, high double").where(F.col("n") >= least)
