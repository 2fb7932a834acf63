"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a ring table.

The key is the doc_id, spread by the finalizer of SplitMix64. One more shard takes rows only into itself. Slots number
the rows of a shard without gaps: rows are dealt to (shard, cell) by key and text, numbered within a cell,
and a cell's first slot is the sum of the cells before it. So a shard is never sorted in one task; the number of cells
follows the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import U64

#: Rows that a cell has at most on average.
CELL_ROWS = 20_000


def spread(key: np.ndarray) -> np.ndarray:
    """SplitMix64's output for the state key."""
    z = key.view(U64) + U64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
    return z ^ (z >> U64(31))


def jump(key: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key (unsigned), by jump consistent hashing."""
    key, at, to = key.copy(), np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = to[live]
        key[live] = key[live] * U64(2862933555777941757) + U64(1)
        to[live] = ((at[live] + 1) * (float(1 << 31) / ((key[live] >> U64(33)) + U64(1)).astype(np.float64))).astype(np.int64)
        live = live[to[live] < shards]
    return at


def assign(docs: DataFrame, shards: int = 8, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of text and 1), text_crc32, shard, grown_shard (with one shard more) and slot for each row of docs.

    Null text: empty. Rows without doc_id share a key of their own. Rows that repeat a doc_id share a shard, with slots of
    their own. An empty table gives an empty result."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    cells = max(1, -(-docs.count() // (shards * cell_rows)))

    def run(batches):
        for b in batches:
            ids = b.column(0)
            key = spread(np.where(ids.is_null(), -1, ids.fill_null(0).to_numpy(zero_copy_only=False)))
            cell = spread(key ^ b.column(2).to_numpy(zero_copy_only=False).astype(U64)) % U64(cells)  # rows without an id are dealt by their texts
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(jump(key, shards).astype(np.int32)), pa.array(jump(key, shards + 1).astype(np.int32)), pa.array(cell.astype(np.int64))], ["doc_id", "size", "text_crc32", "shard", "grown_shard", "cell"])

    dealt = rows.mapInArrow(run, "doc_id long, size long, text_crc32 long, shard int, grown_shard int, cell long")
    full = dealt.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = full.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).drop("n")
    numbered = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")) - 1)
    return numbered.join(before, ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", "grown_shard", (F.col("before") + F.col("nth")).cast("long").alias("slot"))


def query(docs: DataFrame, shards: int = 8) -> DataFrame:
    """op6: one row for each document, law `key`."""
    return assign(docs, shards).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
