"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents; other columns of docs pass through, whatever their names. Verdicts of
quality and mix travel with their rows, and the others are matched by doc_id and text as lists of what goes, which are
broadcast if few: texts are not shuffled unless a stage rejects more rows than that. Null doc_ids, null and empty texts and
repeated rows pass like any other unless a stage says otherwise; an empty table gives an empty result in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontam, mixing, rules, sharding, simhash
from tideline.llm.kernel import discard, matched, written

#: Words of a document inside benchmark windows up to which it is kept, in percent.
MOST_HIT = 0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Texts of fewer than 50 words, null ones too, fail the base rules; equal rows share a verdict."""
    return rules.judged(docs, carry=True).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id; rows that repeat it go too.

    Near-duplicates are op4's: SimHash fingerprints, here of five-word shingles, compared bit-sliced with carry-save counters,
    joined by large-star and small-star rounds. The radius is that of sets alike by 0.8, and links hold if the sets are. Texts without a word are one group. A null doc_id is larger than any other."""
    found = written(simhash.similar(docs), "groups")
    first = found.groupBy("root").agg(F.min(F.struct("id", "crc")).alias("first"))
    gone = written(found.join(first, "root").where(F.struct("id", "crc") != F.col("first")).select("id", "crc").distinct(), "gone")
    twice = written(found.groupBy("id", "crc").count().where("count > 1").join(gone, ["id", "crc"], "left_anti"), "twice")
    kept = matched(docs, gone, "left_anti")
    if twice.isEmpty():
        return kept
    # rows that repeat doc_id and text: one of each
    many = matched(docs, twice, "left_semi")
    crc, row = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = many.select(F.col("doc_id").alias("i"), crc.alias("c"), row.alias("r")).groupBy("i", "c").agg(F.first("r").alias("r")).select("r.*")
    return matched(kept, twice, "left_anti").unionByName(one)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window. Those without a word have none; an empty benchmark rejects nothing."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = written(found.where(F.col("n_hit") * 100 > MOST_HIT * F.col("n_words")).select("id", "crc").distinct(), "hit")
    return matched(docs, hit, "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the fitted rate gives it; rows without a token once."""
    rows, _ = mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True)
    return rows.where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row; rows without doc_id share a key."""
    return sharding.query(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminated", decontaminated), ("mix", mix), ("shard", shard)]
#: The quality verdicts, fingerprints and fitted rates have no SQL: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        docs = written(made, f"stage-{name}")
        if held is not None:
            discard(held)
        held = docs
    return docs
