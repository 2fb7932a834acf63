"""Few-shot episodes: for each requested class a seeded draw of windows without replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.labels import mixed


def capacity(windows: DataFrame) -> DataFrame:
    """label, files (in order) and n_windows of each class."""
    return windows.groupBy("label").agg(F.sort_array(F.collect_set("file_idx")).alias("files"), F.count("*").alias("n_windows"))


def validate(windows: DataFrame, names: dict[int, str], classes: Sequence[int], per_class: Sequence[int]) -> None:
    if len(classes) != len(per_class):
        raise ValueError("classes and counts differ in length")
    if unknown := [c for c in classes if c not in names]:
        raise ValueError(f"unknown class ids {unknown}")
    have = {r.label: r.n_windows for r in windows.where(F.col("label").isin([names[c] for c in classes])).groupBy("label").agg(F.count("*").alias("n_windows")).collect()}
    for c, k in zip(classes, per_class):
        if names[c] not in have:
            raise ValueError(f"class {names[c]} has no window in this split")
        if k > have[names[c]]:
            raise ValueError(f"{k} windows of {names[c]} requested, {have[names[c]]} exist")


def episode(windows: DataFrame, names: dict[int, str], classes: Sequence[int], per_class: Sequence[int], seed: int = 42, check: bool = True) -> DataFrame:
    """pos, req_pos, class_id and the columns of windows (which need label and flat_idx). A class that is requested twice is drawn twice.

    Top k of each request under a seeded order, which Spark limits before the shuffle."""
    if check:
        validate(windows, names, classes, per_class)
    asked = windows.sparkSession.createDataFrame([(i, int(c), names[c], int(k)) for i, (c, k) in enumerate(zip(classes, per_class))], "req_pos int, class_id long, label string, k int")
    key = mixed(F.col("flat_idx") + F.col("req_pos") * 7919, seed)
    most = max(map(int, per_class), default=0)
    drawn = windows.join(F.broadcast(asked), "label").withColumn("nth", F.row_number().over(Window.partitionBy("req_pos").orderBy(key, "flat_idx"))).where(F.col("nth") <= most).where("nth <= k")
    pos = F.row_number().over(Window.orderBy(mixed(F.col("flat_idx") * 31 + F.col("req_pos"), seed + 1), "req_pos", "flat_idx")) - 1  # of an episode's few rows
    return drawn.withColumn("pos", pos).drop("k", "nth")


def unavailable(windows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The requested labels that windows lack."""
    return wanted.join(windows.select("label").distinct(), "label", "left_anti")
