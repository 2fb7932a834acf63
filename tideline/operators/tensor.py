"""Filtered and aligned recordings, folds, windows and concatenation. All results are lazy DataFrames.

Recordings: file_idx, fault_type, fault_severity, rpm, n_samples and an array column for each sensor. The tensor has a
row for each fold and file: fold, file_idx, label, severity, rpm and the sensors' slices, all of one length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import labels

META = ["fold", "file_idx", "label", "severity", "rpm"]


def select_files(recordings: DataFrame, labeling_strategy: str = "only types", group_misalignment: bool = False, target_classes="all", target_severities="all", rpm_range="all", strict: bool = False) -> DataFrame:
    """Adds label and severity and keeps what the predicates hold for. They reach the scan: the range of rpm as a pushed filter,
    classes that are fault types as partition filters."""
    fault, severity, speed = labels.with_defaults(F.col("fault_type"), F.col("fault_severity"), F.col("rpm"))
    label, severity = labels.label_of(fault, severity, labeling_strategy, group_misalignment)
    rows = recordings
    if not isinstance(rpm_range, str):
        rows = rows.where(speed.between(*rpm_range) if rpm_range[0] <= 0 <= rpm_range[1] else F.col("rpm").between(*rpm_range))
    rows = rows.where(labels.member(label, target_classes, strict) & labels.member(severity, target_severities, strict))
    return rows.withColumns({"label": label, "severity": severity, "rpm": speed.cast("float")})


def load(recordings: DataFrame, folds: int = 4, selected_sensors: Sequence[str] = labels.ACCELEROMETERS, eager: bool = False, **filters) -> DataFrame:
    """The tensor: every file cut to the shortest selected one, in folds of equal length. eager: an empty selection raises."""
    folds = max(1, folds)
    rows = select_files(recordings, **filters)
    if eager and rows.isEmpty():
        raise ValueError("no recording matches the filters")
    shortest = rows.agg((F.floor(F.min("n_samples") / folds)).cast("int").alias("chunk")).scalar()
    rows = rows.select("file_idx", "label", "severity", "rpm", *selected_sensors).withColumn("chunk", shortest)
    sliced = (F.slice(F.col(s), F.col("fold") * F.col("chunk") + 1, F.col("chunk")).alias(s) for s in selected_sensors)
    return rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).select(*META, *sliced)


def shape(recordings: DataFrame, folds: int = 4, **filters) -> DataFrame:
    """n_files, min_length and chunk_length of the tensor."""
    rows = select_files(recordings, **filters)
    return rows.agg(F.count("*").alias("n_files"), F.min("n_samples").alias("min_length"), F.floor(F.min("n_samples") / max(1, folds)).cast("int").alias("chunk_length"))


def windows_per_series(length, size: int, step: int):
    """How many windows fit; a rest at the end is dropped, a shorter series has none."""
    return F.greatest(F.lit(0), F.floor((length - size) / step).cast("int") + 1)


def ordered(df: DataFrame, column: str, wanted: Sequence[int] | None, name: str) -> DataFrame:
    """Adds name, the position of column in wanted, and keeps only rows in wanted. None: all, by value (dense from 0)."""
    if wanted is None:
        return df.withColumn(name, F.col(column))
    spark = df.sparkSession
    place = spark.createDataFrame([(int(v), i) for i, v in enumerate(wanted)], f"{column} int, {name} int")
    return df.join(F.broadcast(place), column)


def windows(tensor: DataFrame, window_size: int = 2048, step_size: int = 512, sensors: Sequence[str] | None = None, valid_folds: Sequence[int] | None = None, valid_files: Sequence[int] | None = None, flat: bool = True) -> DataFrame:
    """A row for each window: META, win_idx, flat_idx and the sensors' slices, generated lazily.

    Lists of folds and files restrict and order: flat_idx counts folds, then files, then windows, in the lists' order. Without
    flat there is no flat_idx and no count of files is needed."""
    sensors = list(sensors or [c for c in tensor.columns if c not in META])
    rows = ordered(ordered(tensor, "fold", valid_folds, "fold_pos"), "file_idx", valid_files, "file_pos")
    per = windows_per_series(F.size(F.col(sensors[0])), window_size, step_size)
    rows = rows.withColumn("per", per).where("per > 0")
    if flat and valid_files is None:  # files keep their gaps out of the index
        dense = tensor.select("file_idx").distinct().select("file_idx", (F.row_number().over(_by("file_idx")) - 1).alias("file_pos"))
        rows = rows.drop("file_pos").join(F.broadcast(dense), "file_idx")
    if flat:
        n_files = F.lit(len(valid_files)) if valid_files is not None else tensor.agg(F.count_distinct("file_idx")).scalar()
        rows = rows.withColumn("first", (F.col("fold_pos").cast("long") * n_files + F.col("file_pos")) * F.col("per"))
    rows = rows.withColumn("win_idx", F.explode(F.sequence(F.lit(0), F.col("per") - 1)))
    own = [F.slice(F.col(s), F.col("win_idx") * step_size + 1, window_size).alias(s) for s in sensors]
    return rows.select(*META, "win_idx", *([(F.col("first") + F.col("win_idx")).alias("flat_idx")] if flat else []), *own)


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)


def get_window(tensor: DataFrame, i: int, window_size: int, step_size: int, n_folds: int, files: Sequence[int], chunk: int, sensors: Sequence[str] | None = None) -> DataFrame:
    """The window with flat index i: its coordinates are decoded here and pruned in the scan, so nothing else is expanded."""
    per = max(0, (chunk - window_size) // step_size + 1)
    if not 0 <= i < n_folds * len(files) * per:
        raise IndexError(f"window {i} of {n_folds * len(files) * per}")
    fold, rest = divmod(i, len(files) * per)
    place, w = divmod(rest, per)
    sensors = list(sensors or [c for c in tensor.columns if c not in META])
    row = tensor.where((F.col("fold") == fold) & (F.col("file_idx") == int(files[place])))
    return row.select(*META, F.lit(w).alias("win_idx"), F.lit(i).cast("long").alias("flat_idx"), *(F.slice(F.col(s), w * step_size + 1, window_size).alias(s) for s in sensors))


def materialised(tensor: DataFrame, path: str) -> DataFrame:
    """The tensor written to path and read back: later reads take only the sensors and files that they need from there."""
    tensor.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return tensor.sparkSession.read.parquet(path)


def concat_to(tensors: Sequence[DataFrame], path: str, axis: int = 0) -> DataFrame:
    """concat(), written to path and read back."""
    return materialised(concat(tensors, axis), path)


def concat(tensors: Sequence[DataFrame], axis: int = 0) -> DataFrame:
    """Tensors one after the other by fold (0), file (1), sensor (2) or time (3); duplicates stay."""
    first = tensors[0]
    if axis in (0, 1):
        if any(sorted(t.columns) != sorted(first.columns) for t in tensors):
            raise ValueError("tensors must have the same columns")
        # each tensor's extent by itself: shifts are sums of these, and plans grow in proportion to the number of tensors
        key, out, shift = ("fold", "file_idx")[axis], first, F.lit(0)
        for before, t in zip(tensors, tensors[1:]):
            shift = shift + before.agg((F.coalesce(F.max(key), F.lit(-1)) + 1).cast("int").alias("n")).scalar()
            out = out.unionByName(t.withColumn(key, (F.col(key) + shift).cast("int")))
        return out
    out = first
    for k, t in enumerate(tensors[1:], 1):
        sensors = [c for c in t.columns if c not in META]
        own = t.select("fold", "file_idx", *(F.col(c).alias(f"_{c}") for c in sensors))
        both = out.join(own, ["fold", "file_idx"])
        if axis == 2:
            out = both.select(*out.columns, *(F.col(f"_{c}").alias(c if c not in out.columns else f"{c}_{k}") for c in sensors))
        else:
            out = both.select(*(F.concat(F.col(c), F.col(f"_{c}")).alias(c) if c in sensors else F.col(c) for c in out.columns))
    return out
