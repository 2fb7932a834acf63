"""Window features as array expressions, and a registry of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def variance(x: Column) -> Column:
    """Of the population, around the mean."""
    return F.aggregate(x, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s")), _welford, lambda a: a["s"] / a["n"])


def _welford(a: Column, v: Column) -> Column:
    n = a["n"] + 1
    m = a["m"] + (v - a["m"]) / n
    return F.struct(n.alias("n"), m.alias("m"), (a["s"] + (v - a["m"]) * (v - m)).alias("s"))


def rms(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x))


def peak_to_peak(x: Column) -> Column:
    return F.array_max(x) - F.array_min(x)


def covariance(x: Column, y: Column) -> Column:
    """Of the sample, by shifted sums."""
    start = F.struct(*(F.lit(0.0).alias(n) for n in ("n", "x", "y", "c")))

    def step(a, p):
        n = a["n"] + 1
        mx, my = a["x"] + (p["x"] - a["x"]) / n, a["y"] + (p["y"] - a["y"]) / n
        return F.struct(n.alias("n"), mx.alias("x"), my.alias("y"), (a["c"] + (p["x"] - a["x"]) * (p["y"] - my)).alias("c"))

    return F.aggregate(F.zip_with(x, y, lambda a, b: F.struct(a.alias("x"), b.alias("y"))), start, step, lambda a: F.when(a["n"] > 1, a["c"] / (a["n"] - 1)))


REGISTRY = {"mean": mean, "variance": variance, "rms": rms, "peak_to_peak": peak_to_peak, "min": F.array_min, "max": F.array_max}
