"""Recordings: CSV files in, Parquet in and out. One row a recording: metadata, and an array column for each sensor."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import labels
from tideline.functions.labels import SENSORS

META = "file_path string, original_filename string, fault_type string, fault_severity string, rpm int"


def parsed(content: bytes, kind=np.float32) -> np.ndarray:
    """Samples by sensors of a headerless CSV file."""
    import io

    return pd.read_csv(io.BytesIO(content), header=None, engine="c", dtype=np.float64).to_numpy().astype(kind)


def read_csv(spark: SparkSession, root: str, sensors: tuple[str, ...] = SENSORS, kind: str = "float") -> DataFrame:
    """rel (the path below root), error, n_samples and an array for each sensor (s0, s1 and so on) of all *.csv below root.

    Files are read whole, as the rows of a CSV scan have no order. kind: float, double, or half (values as half precision
    holds them, in float arrays)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(root)
    if files.limit(1).isEmpty():
        raise RuntimeError(f"no CSV file below {root}")
    half, kind = kind == "half", "float" if kind == "half" else kind
    dtype = {"float": np.float32, "double": np.float64}[kind]
    own = F.regexp_replace("path", r"^file:/+", "/")
    relative = F.when(F.instr(own, root.rstrip("/") + "/") == 1, F.substr(own, F.lit(len(root.rstrip("/")) + 2))).otherwise(own)
    names = [f"s{i}" for i in range(len(sensors))]
    schema = f"rel string, error string, n_samples int, {', '.join(f'{n} array<{kind}>' for n in names)}"

    def run(batches):
        for b in batches:
            for rel, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    x, error = parsed(content.as_buffer().to_pybytes(), np.float16 if half else dtype).astype(dtype), None
                    if x.shape[1] != len(sensors):
                        raise ValueError(f"{x.shape[1]} columns, not {len(sensors)}")
                except Exception as e:  # reported in the second frame
                    x, error = None, f"{type(e).__name__}: {e}"
                cols = [pa.array([None if x is None else x[:, i]], pa.list_(pa.from_numpy_dtype(dtype))) for i in range(len(sensors))]
                yield pa.RecordBatch.from_arrays([pa.array([rel]), pa.array([error], pa.string()), pa.array([None if x is None else len(x)], pa.int32()), *cols], ["rel", "error", "n_samples", *names])

    return files.select(relative.alias("rel"), "content").mapInArrow(run, schema)


def divided(got: DataFrame, sensors: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Of rows of read_csv() the recordings, with metadata from paths as expressions, and rel and error of the others."""
    names = [f"s{i}" for i in range(len(sensors))]
    path = F.col("rel")
    broken = labels.path_is_broken(path)
    good = got.where(F.col("error").isNull() & ~broken).select(
        labels.array_path(path).alias("file_path"), labels.file_name(path).alias("original_filename"), labels.fault_type(path).alias("fault_type"), labels.fault_severity(path).alias("fault_severity"), labels.rpm(path).alias("rpm"), "n_samples", *(F.col(n).alias(s) for n, s in zip(names, sensors))
    )
    errors = got.where(F.col("error").isNotNull() | broken).select("rel", F.coalesce("error", F.lit("the path names a fault that is not one of its folders")).alias("error"))
    return good, errors


def ingest_csv(spark: SparkSession, root: str, sensors: tuple[str, ...] = SENSORS, kind: str = "float") -> tuple[DataFrame, DataFrame]:
    """Recordings of all *.csv below root, and the files that cannot be read with their errors. Each frame parses the files when it is read."""
    return divided(read_csv(spark, root, sensors, kind), sensors)


def ingest(spark: SparkSession, root: str, path: str, sensors: tuple[str, ...] = SENSORS, kind: str = "half") -> DataFrame:
    """CSV files below root into the store at path, each parsed once; returns rel and error of those that cannot be read.

    What was parsed is kept beside the store, in path_parsed, until both parts are written."""
    base = path.rstrip("/")
    read_csv(spark, root, sensors, kind).write.mode("overwrite").parquet(f"{base}_parsed")
    good, errors = divided(spark.read.parquet(f"{base}_parsed"), sensors)
    write_store(good, path)
    errors.write.mode("overwrite").parquet(f"{base}_errors")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}_parsed")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return spark.read.schema(errors.schema).parquet(f"{base}_errors")


def write_store(recordings: DataFrame, path: str) -> None:
    """Overwrites the partitions that recordings have; others stay. Class predicates prune partitions, sensors prune columns."""
    recordings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("fault_type").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_file_index(recordings: DataFrame) -> DataFrame:
    """file_idx from 0 by file_path. Only paths are sorted; signals are not moved to one task."""
    index = recordings.select("file_path").distinct().withColumn("file_idx", F.row_number().over(Window.orderBy("file_path")) - 1)
    return recordings.join(index, "file_path")
