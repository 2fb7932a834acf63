"""Batches for learning frameworks, features of windows, and the feature store."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.features import REGISTRY
from tideline.functions.labels import member, mixed

META = ["fold", "file_idx", "win_idx", "flat_idx", "label", "severity", "rpm"]


def encoded(rows: DataFrame, class_to_idx: dict[str, int]) -> DataFrame:
    """Adds y; a label without a number raises when it is read."""
    table = F.create_map(*(F.lit(v) for kv in class_to_idx.items() for v in kv))
    return rows.withColumn("y", F.coalesce(F.try_element_at(table, "label"), F.raise_error(F.concat(F.lit("no class number for "), "label"))).cast("long"))


#: Rows of a range that are numbered together, about.
RANGE_ROWS = 100_000


def batches(rows: DataFrame, batch_size: int = 32, shuffle: bool = False, seed: int = 42, epoch: int = 0, n_rows: int | None = None) -> DataFrame:
    """Adds batch and slot; the last batch may be smaller. Shuffled by a mix of flat_idx that epoch and seed change, else in order of flat_idx.

    Rows are numbered by ranges of the order, whose bounds are quantiles: ranges are of nearly equal size, their number
    follows that of the rows (counted unless given), and only the counts of ranges meet in one task."""
    key = mixed(F.col("flat_idx"), seed + 1009 * epoch) if shuffle else F.col("flat_idx")
    rows = rows.withColumn("_k", key.cast("long"))
    ranges = -(-(rows.count() if n_rows is None else n_rows) // RANGE_ROWS)
    bounds = sorted(set(rows.approxQuantile("_k", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    rows = rows.withColumn("_r", _range(F.col("_k"), bounds))
    before = rows.groupBy("_r").agg(F.count("*").alias("_n")).select("_r", (F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")).alias("_b"))
    at = F.row_number().over(Window.partitionBy("_r").orderBy("_k", "flat_idx")) - 1 + F.col("_b")
    return rows.join(F.broadcast(before), "_r").withColumn("_at", at).withColumns({"batch": F.floor(F.col("_at") / batch_size).cast("long"), "slot": (F.col("_at") % batch_size).cast("int")}).drop("_k", "_r", "_b", "_at")


def _range(key: Column, bounds: list[float]) -> Column:
    """How many bounds are at most key, by halving."""
    if not bounds:
        return F.lit(0)

    def halved(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < bounds[mid], halved(low, mid)).otherwise(halved(mid + 1, high))

    return halved(0, len(bounds))


def within(rows: DataFrame, valid_folds: Sequence[int] | None = None, valid_files: Sequence[int] | None = None) -> DataFrame:
    """The rows of the folds and files listed; None: of all."""
    if valid_folds is not None:
        rows = rows.where(F.col("fold").isin([int(v) for v in valid_folds]))
    return rows if valid_files is None else rows.where(F.col("file_idx").isin([int(v) for v in valid_files]))


def arrow_batches(rows: DataFrame, columns: Sequence[str], batch_size: int, shuffle: bool, seed: int, epoch: int) -> Iterator[pa.Table]:
    """Each batch's columns as an Arrow table, in order. Rows come packed as Arrow, a task's batches at a time, and never as Python objects."""
    own = batches(rows, batch_size, shuffle, seed, epoch)
    schema = own.select(*columns).schema
    names = [f"c{i}" for i in range(len(columns))]

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("slot")
        sink = pa.BufferOutputStream()
        body = pa.table(dict(zip(names, (t[n] for n in names))))
        with pa.ipc.new_stream(sink, body.schema) as out:
            out.write_table(body)
        return pa.table({"batch": t["batch"][:1], "body": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    slim = own.select("batch", "slot", *(F.col(c).alias(n) for c, n in zip(columns, names)))
    packed = slim.groupBy("batch").applyInArrow(pack, "batch long, body binary")
    for r in packed.orderBy("batch").toLocalIterator(prefetchPartitions=True):
        yield pa.ipc.open_stream(r.body).read_all().rename_columns(schema.names)


def _matrix(t: pa.Table, sensors: Sequence[str]) -> np.ndarray:
    return np.stack([t[s].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for s in sensors], axis=1).astype(np.float32)


def iterate(rows: DataFrame, sensors: Sequence[str], batch_size: int = 32, shuffle: bool = False, seed: int = 42, epoch: int = 0, with_meta: bool = False) -> Iterator[tuple]:
    """(x float32 [n, sensors, samples], y int64 [n]) for each batch, and (severities, speeds) if asked for."""
    for t in arrow_batches(rows, [*sensors, "y", *(["severity", "rpm"] if with_meta else [])], batch_size, shuffle, seed, epoch):
        x, y = _matrix(t, sensors), t["y"].to_numpy().astype(np.int64)
        yield (x, y, (t["severity"].to_pylist(), t["rpm"].to_numpy().astype(np.float32))) if with_meta else (x, y)


def iterate_features(rows: DataFrame, batch_size: int = 32, shuffle: bool = False, seed: int = 42, epoch: int = 0, with_meta: bool = False) -> Iterator[tuple]:
    """(x float32 [n, features], y int64 [n]) for each batch of feature rows, and (severities, speeds) if asked for. Needs flat()."""
    for t in arrow_batches(rows, ["features", "y", *(["severity", "rpm"] if with_meta else [])], batch_size, shuffle, seed, epoch):
        x, y = _matrix(t, ["features"])[:, 0], t["y"].to_numpy().astype(np.int64)
        yield (x, y, (t["severity"].to_pylist(), t["rpm"].to_numpy().astype(np.float32))) if with_meta else (x, y)


def flat(rows: DataFrame) -> DataFrame:
    """Feature rows with one array `features` (structs of sensors are laid out in their order) and flat_idx, which is made of the
    coordinates where it is missing: it orders fold, then file, then window."""
    if "features" not in rows.columns:
        own = [F.array(*(F.col(f"`{c}`.`{n}`").cast("float") for n in rows.schema[c].dataType.names)) for c in rows.columns if c not in META]
        rows = rows.select(*(c for c in META if c in rows.columns), F.concat(*own).alias("features"))
    if "flat_idx" not in rows.columns:
        rows = rows.withColumn("flat_idx", (F.col("fold").cast("long") * (1 << 21) + F.col("file_idx")) * (1 << 21) + F.col("win_idx"))
    return rows


def _torch(make: Callable[[int], Iterator[tuple]]):
    """A torch DataLoader whose epochs are make(0), make(1) and so on, if torch is there; else the first of them."""
    try:
        import torch
    except ImportError:
        return make(0)

    class Batches(torch.utils.data.IterableDataset):
        epoch = -1

        def __iter__(self):
            self.epoch += 1
            return ((torch.from_numpy(x), torch.from_numpy(y), *m) for x, y, *m in make(self.epoch))

    return torch.utils.data.DataLoader(Batches(), batch_size=None)


def _tensorflow(make: Callable[[], Iterator[tuple]], shape: tuple):
    """A tf.data dataset of make(), if TensorFlow is there; else make()."""
    try:
        import tensorflow as tf
    except ImportError:
        return make()
    return tf.data.Dataset.from_generator(make, output_signature=(tf.TensorSpec(shape, tf.float32), tf.TensorSpec((None,), tf.int32))).prefetch(tf.data.AUTOTUNE)


def get_pytorch_dataloader(windows: DataFrame, class_to_idx: dict[str, int], sensors: Sequence[str], batch_size: int = 32, shuffle: bool = True, seed: int = 42, with_meta: bool = False, valid_folds: Sequence[int] | None = None, valid_files: Sequence[int] | None = None):
    """A torch DataLoader over batches of windows, if torch is there; else the iterator itself. Folds and files restrict the windows."""
    rows = encoded(within(windows, valid_folds, valid_files), class_to_idx)
    return _torch(lambda epoch: iterate(rows, sensors, batch_size, shuffle, seed, epoch, with_meta))


def get_tensorflow_dataset(windows: DataFrame, class_to_idx: dict[str, int], sensors: Sequence[str], batch_size: int = 32, valid_folds: Sequence[int] | None = None, valid_files: Sequence[int] | None = None):
    """A tf.data dataset of ordered batches with int32 labels, if TensorFlow is there; else an iterator of the same."""
    rows = encoded(within(windows, valid_folds, valid_files), class_to_idx)
    return _tensorflow(lambda: ((x, y.astype(np.int32)) for x, y in iterate(rows, sensors, batch_size)), (None, len(sensors), None))


def get_pytorch_feature_loader(features: DataFrame, class_to_idx: dict[str, int], batch_size: int = 32, shuffle: bool = True, seed: int = 42, with_meta: bool = False, valid_folds: Sequence[int] | None = None, valid_files: Sequence[int] | None = None):
    """A torch DataLoader over batches of feature rows, if torch is there; else the iterator itself."""
    rows = encoded(flat(within(features, valid_folds, valid_files)), class_to_idx)
    return _torch(lambda epoch: iterate_features(rows, batch_size, shuffle, seed, epoch, with_meta))


def get_tensorflow_featureset(features: DataFrame, class_to_idx: dict[str, int], batch_size: int = 32, valid_folds: Sequence[int] | None = None, valid_files: Sequence[int] | None = None):
    """A tf.data dataset of ordered batches of feature rows with int32 labels, if TensorFlow is there; else an iterator of the same."""
    rows = encoded(flat(within(features, valid_folds, valid_files)), class_to_idx)
    return _tensorflow(lambda: ((x, y.astype(np.int32)) for x, y in iterate_features(rows, batch_size)), (None, None))


def feature_rows(windows: DataFrame, sensors: Sequence[str], names: Sequence[str] = tuple(REGISTRY)) -> DataFrame:
    """META and a struct of named features for each sensor, in expressions only."""
    own = [F.struct(*(REGISTRY[n](F.col(s).cast("array<double>")).cast("float").alias(n) for n in names)).alias(s) for s in sensors]
    return windows.select(*(c for c in META if c in windows.columns), *own)


def transformed(windows: DataFrame, sensors: Sequence[str], transform_fn: Callable[[np.ndarray], np.ndarray], window_size: int) -> DataFrame:
    """META and features array<float>, of any function of [sensors, samples]; one call on zeros tells the result's size."""
    n = int(np.asarray(transform_fn(np.zeros((len(sensors), window_size), np.float32))).size)
    keep = [c for c in META if c in windows.columns]

    def run(batches):
        for b in batches:
            x = np.stack([b.column(len(keep) + i).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) for i in range(len(sensors))], axis=1)
            out = np.stack([np.asarray(transform_fn(w), np.float32).reshape(n) for w in x]) if len(b) else np.zeros((0, n), np.float32)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), n).cast(pa.list_(pa.float32()))], [*keep, "features"])

    slim = windows.select(*keep, *(F.col(s).cast("array<float>") for s in sensors))
    return slim.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in slim.dtypes if c in keep) + ", features array<float>")


def write_features(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def read_features(spark, path: str) -> DataFrame:
    """The feature rows stored at path."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        raise


def feature_extraction_pipeline(windows: DataFrame, path: str, sensors: Sequence[str], transform_fn: Callable | None = None, window_size: int | None = None, names: Sequence[str] = tuple(REGISTRY)) -> DataFrame:
    """Features of all windows, written to path and read back: the named ones, or those of transform_fn over [sensors, window_size]."""
    if transform_fn and not window_size:
        raise ValueError("transform_fn needs window_size")
    write_features(transformed(windows, sensors, transform_fn, window_size) if transform_fn else feature_rows(windows, sensors, names), path)
    return read_features(windows.sparkSession, path)


def load_features(rows: DataFrame, selected_sensors="all", target_classes="all", target_severities="all", rpm_range="all") -> DataFrame:
    """Feature rows whose files match, with the selected sensors. Missing metadata columns are not tested; a sensor that is unknown is left out, all unknown raise."""
    own = [c for c in rows.columns if c not in META]
    want = own if selected_sensors == "all" else [selected_sensors] if isinstance(selected_sensors, str) else list(selected_sensors)
    if not (found := [c for c in want if c in own]):
        raise ValueError(f"none of {want} is stored")
    rows = rows.where(member(F.col("label"), target_classes))
    if "severity" in rows.columns:
        rows = rows.where(member(F.col("severity"), target_severities))
    if "rpm" in rows.columns and not isinstance(rpm_range, str):
        rows = rows.where(F.col("rpm").between(*rpm_range))
    return rows.select(*(c for c in META if c in rows.columns), *found)


def as_half(column: Column) -> Column:
    """A float array as half precision would hold it."""

    @F.pandas_udf("array<float>")
    def run(s):
        return s.map(lambda x: None if x is None else np.asarray(x, np.float16).astype(np.float32))

    return run(column)
