"""Leakage-free splits of files, stratified by label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.labels import mixed


def bounds(n: Column, train: float, val: float, strict: bool = False) -> tuple[Column, Column]:
    """How many of a class's n files are train, and train or validation. strict: a share of validation of 0 takes the branch for few files."""
    test = 1 - train - val
    one = lambda v: F.lit(v).cast("int")
    few = F.when(n == 4, one(2)).otherwise(one(1)), F.when(n == 4, one(3)).when(n == 3, one(2)).otherwise(n)
    if not strict and val <= 0.02 and test > 0.02:
        first = F.greatest(one(1), F.floor(n * F.lit(float(train))).cast("int"))
        return first, first
    if test <= 0.02:
        first = F.when(n == 4, one(3)).otherwise(F.greatest(one(1), F.bround(n * F.lit(float(train)), 0).cast("int")))
        return first, n
    if val <= 0.02:
        return few
    a, v = F.floor(n * F.lit(float(train))).cast("int"), F.ceil(n * F.lit(float(val))).cast("int")
    a = F.greatest(one(1), F.when(a + v >= n, F.greatest(one(1), n - v - 1)).otherwise(a))
    return F.when(n >= 4, a).otherwise(few[0]), F.when(n >= 4, a + F.greatest(one(1), v)).otherwise(few[1])


def stratified_file_split(files: DataFrame, train_ratio: float = 0.75, val_ratio: float = 0.25, random_seed: int = 42, strict: bool = False) -> DataFrame:
    """file_idx, label and split of each file (file_idx, label). A file is in one split; the order of files is a seeded mix of file_idx."""
    if train_ratio + val_ratio > 1 + 1e-9:
        raise ValueError("the ratios sum to more than 1")
    own = Window.partitionBy("label")
    rows = files.select("file_idx", "label", F.count("*").over(own).cast("int").alias("n"), F.row_number().over(own.orderBy(mixed(F.col("file_idx"), random_seed), "file_idx")).alias("nth"))
    a, b = bounds(F.col("n"), train_ratio, val_ratio, strict)
    return rows.select("file_idx", "label", F.when(F.col("nth") <= a, "train").when(F.col("nth") <= b, "val").otherwise("test").alias("split"))
