"""Filtering of recordings sensor by sensor, and the tachometer's steps as expressions over ordered samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.dsp import apart
from tideline.functions.labels import SENSORS


def decimated(x: Column, factor: int) -> Column:
    """Samples 0, f, 2f and so on."""
    return x if factor <= 1 else F.filter(x, lambda v, i: i % factor == 0)


#: Bytes of signals that are stacked at most.
STACKED = 64 << 20


def applied(fn: Callable, series: list[np.ndarray]) -> list[np.ndarray | Exception]:
    """fn of each series. A callable with the attribute `many` takes matrices: series of one length go through it together."""
    out: list = [None] * len(series)
    by_length: dict[int, list[int]] = {}
    for i, x in enumerate(series):
        by_length.setdefault(len(x), []).append(i)
    for n, own in by_length.items():
        most = max(1, STACKED // max(8, 8 * n)) if getattr(fn, "many", False) else 1
        for at in range(0, len(own), most):
            some = own[at : at + most]
            x = np.stack([series[i] for i in some])
            try:
                y = np.atleast_2d(np.asarray(fn(x if most > 1 else x[0]), float))
                if y.shape != x.shape:
                    raise ValueError("a filter must keep the number of samples")
            except Exception as e:  # of one signal: the caller decides
                y = [e] * len(some)
            for i, v in zip(some, y):
                out[i] = v
    return out


def filter_recordings(recordings: DataFrame, filter_map: dict[str, Callable], downsample_factor: int = 1, fs: float = 50_000, sensors=SENSORS, errors: bool = False) -> DataFrame:
    """Each mapped sensor through its callable (1-D to 1-D of the same length, or with the attribute `many` rows to rows), then
    decimated; others only decimated. fs is the new rate. A null signal stays null. errors: a column `error` tells what
    failed in a recording, of which the signal is then null; without it a failure raises.

    All sensors of all recordings of an Arrow batch that share a callable and a length are filtered together."""
    if missing := [s for s in filter_map if s not in sensors]:
        raise KeyError(f"no such sensors: {missing}")
    mapped = [s for s in filter_map if s in recordings.columns]
    names = [f"_f{i}" for i in range(len(mapped))]
    keep = recordings.columns
    kinds = {f.name: f.dataType.simpleString() for f in recordings.schema.fields}
    schema = ", ".join([*(f"`{c}` {'array<double>' if c in mapped else kinds[c]}" for c in keep), "_error string"])

    def run(batches):
        for b in batches:
            cols, bad = dict(zip(b.schema.names, b.columns)), [None] * len(b)
            for fn in {id(filter_map[s]): filter_map[s] for s in mapped}.values():
                own = [s for s in mapped if filter_map[s] is fn]
                where = [(s, i) for s in own for i in range(len(b)) if cols[s][i].is_valid]
                made = applied(fn, [np.asarray(cols[s][i].values.to_numpy(zero_copy_only=False), float) for s, i in where])
                found: dict = {s: [None] * len(b) for s in own}
                for (s, i), y in zip(where, made):
                    if isinstance(y, Exception):
                        if not errors:
                            raise y
                        bad[i] = bad[i] or f"{s}: {type(y).__name__}: {y}"
                    else:
                        found[s][i] = y[:: max(1, downsample_factor)]
                cols |= {s: pa.array(v, pa.list_(pa.float64())) for s, v in found.items()}
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(bad, pa.string())], [*cols, "_error"])

    rows = recordings.mapInArrow(run, schema) if names else recordings.withColumn("_error", F.lit(None).cast("string"))
    rest = {s: decimated(F.col(s), downsample_factor) for s in sensors if s in keep and s not in mapped}
    factor = max(1, downsample_factor)
    rows = rows.withColumns(rest | {"n_samples": F.ceil(F.col("n_samples") / factor).cast("int"), "fs": F.lit(fs / factor)})
    return rows.withColumnRenamed("_error", "error") if errors else rows.drop("_error")


def filter_store(spark, source: str, target: str, filter_map: dict[str, Callable], downsample_factor: int = 1, fs: float = 50_000, sensors=SENSORS) -> DataFrame:
    """Filters the store at source into one at target, with its settings under target/_attributes, and returns file_path and error of
    the recordings that failed, which target lacks. Settings: the old and new rate, the factor, and each sensor's filter."""
    from tideline.sources import recordings as store

    rows = filter_recordings(store.read_store(spark, source), filter_map, downsample_factor, fs, sensors, errors=True)
    staged = f"{target}/_staged"
    rows.write.mode("overwrite").parquet(staged)  # each signal is filtered once
    done = spark.read.parquet(staged)
    store.write_store(done.where("error is null").drop("error"), f"{target}/recordings")
    described = {s: type(f).__name__ if not callable(getattr(f, "__name__", None)) else f.__name__ for s, f in filter_map.items()}
    said = [("source_fs", str(fs)), ("fs", str(fs / max(1, downsample_factor))), ("downsample_factor", str(downsample_factor)), *((f"filter.{s}", v) for s, v in described.items())]
    spark.createDataFrame(said, "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{target}/_attributes")
    failed = done.where("error is not null").select("file_path", "error")
    failed.write.mode("overwrite").parquet(f"{target}/_errors")
    return spark.read.schema(failed.schema).parquet(f"{target}/_errors")


# ---- long form: file, i (sample number), x


def robust_scaled(samples: DataFrame) -> DataFrame:
    """x between its file's percentiles 1 and 99 (interpolated); a constant file is only shifted."""
    p = samples.groupBy("file").agg(F.percentile("x", F.lit(0.01)).alias("low"), F.percentile("x", F.lit(0.99)).alias("high"))
    scale = F.col("high") - F.col("low")
    flat = scale <= 1e-9 * F.greatest(F.abs("low"), F.abs("high"))
    return samples.join(p, "file").select("file", "i", F.when(flat, F.col("x") - F.col("low")).otherwise((F.col("x") - F.col("low")) / scale).alias("x"))


def rising_edges(samples: DataFrame, threshold: float = 0.7) -> DataFrame:
    """file and i where x comes to the threshold from below."""
    before = F.lag("x").over(Window.partitionBy("file").orderBy("i"))
    return samples.withColumn("before", before).where((F.col("before") < threshold) & (F.col("x") >= threshold) & (F.col("x") > F.col("before"))).select("file", "i")


def close_edges_removed(edges: DataFrame, ratio: float = 0.7) -> DataFrame:
    """Backwards from the last edge, those at least ratio of the median gap before the one kept last. One pass over each file's edges."""

    def run(t: pa.Table) -> pa.Table:
        kept = apart(np.sort(t["i"].to_numpy()), ratio)
        return pa.table({"file": pa.chunked_array([t["file"].combine_chunks()]).slice(0, len(kept)), "i": pa.array(kept.astype(np.int32))})

    return edges.select("file", F.col("i").cast("int").alias("i")).groupBy("file").applyInArrow(run, f"file {dict(edges.dtypes)['file']}, i int")


def instant_rpm(samples: DataFrame, edges: DataFrame, fs: float = 50_000, pulses_per_rev: int = 1) -> DataFrame:
    """rpm of each sample, from the edges around it; before the first edge that of the first interval, after the last that of the last. Fewer than two edges: 0."""
    own = Window.partitionBy("file").orderBy("i")
    e = edges.select("file", F.col("i").cast("int").alias("i"), (F.lead("i").over(own) - F.col("i")).alias("gap"))
    speed = e.withColumn("rpm", F.lit(60.0) * (F.lit(float(fs)) / F.greatest(F.lit(1), "gap")) / pulses_per_rev)
    rows = samples.select("file", "i").join(speed.select("file", "i", "rpm"), ["file", "i"], "left")
    rows = rows.withColumn("last", F.last("rpm", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first("rpm", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("file", "i", F.coalesce("last", first, F.lit(0.0)).alias("rpm"))
