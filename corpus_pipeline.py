"""A corpus pipeline over documents, built of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import bpe, linededup, mixing, shingles, toxicity
from kbspark.llm.common import stored, table

#: Share of the tokens that mixing keeps: near all, so that only over-represented cells shrink.
MIX_KEEP = 0.85


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold of the toxicity operator stay, as they are."""
    found = toxicity.scored(docs, table(spark, sf_dir, "labels"), to="__toxicity")
    return found.where(F.col("__toxicity") < toxicity.THRESHOLD).drop("__toxicity")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks that an earlier document has are cut; a document of which nothing is left goes."""
    found = linededup.dedup_lines(docs)
    left = found.where((F.col("n_lines_deleted") == 0) | F.col("text").rlike(r"\S"))
    n_chars = F.when(F.col("n_lines_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by SimHash fingerprints (two bits) or five-word shingles (similarity 0.8) the one of least id stays."""
    return shingles.representatives(docs, distance=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by calibrated probabilities, raked to source, language and topic targets."""
    return mixing.mix(docs, keep=MIX_KEEP).where("mix_kept").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and a digest of what they decode to."""
    found = bpe.encode(docs, bpe.vocabulary())
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("source_mixing", mix_sources),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
