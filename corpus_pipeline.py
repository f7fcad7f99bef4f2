"""A corpus pipeline of four operators: toxic documents go, one document of each group of near copies stays, sources are mixed to
their target weights, and what is left is packed into windows of token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each stage's result to the shared folder and reads
it for the next, so that a lost executor costs one stage's work at most. All stages but the last return the columns of documents.

Defined cases, for each stage: an empty table gives an empty result; null and empty texts are never toxic, never near copies,
have no words to mix and pack as one end id; null doc_ids and sources are kept as any other; repeated rows are near copies of each other (one
stays), unless they have no words; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import documents, table
from tidelog.llm.minhash import one_of_each
from tidelog.llm.mixing import mix
from tidelog.llm.packing import pack
from tidelog.llm.toxicity import model_for, reject

THRESHOLD = 0.7
SHINGLE_WORDS, PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score reaches THRESHOLD; the model learns from the labels of two folds of three."""
    return reject(docs, model_for(spark, sf_dir), THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least doc_id, of each group that links of similarity 0.8 of five-word shingles connect."""
    return one_of_each(docs, SHINGLE_WORDS, PERCENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: 0, 1 or 2."""
    return mix(docs).filter("copies > 0").select(F.explode(F.array_repeat("record", F.col("copies"))).alias("record")).select("record.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; a repeated document has pieces for each copy."""
    import public_tokenizers

    packed = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), at_once=500, remembered=100_000)  # after three stages, workers have less room
    return packed.rows("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: A learned score and token ids aren't SQL; tests/llm/ holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
