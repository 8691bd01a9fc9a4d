"""Corpus pipeline: toxicity filter, n-gram near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. A document's row is kept or goes as a whole; the third
stage changes texts. Rows with a null doc_id are told apart by their sets of shingles: of those with one set, one stays, and
none if a row with an id has that set; without ids they link to no other sets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnex.llm import jaccard, packing, pii, toxicity
from anamnex.llm.common import Scratch, table
from anamnex.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose score reaches the threshold."""
    model = toxicity.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="__score").where(F.col("__score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one of the smallest id stays; of repeated rows, one. Rows of one id are told apart by their sets of shingles."""
    found = Scratch(spark).write(jaccard.join(docs.select("doc_id", "text")).where("doc_id is not null").select("doc_id", "set_key", "kept"))
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")  # ids of several rows, decided by set
    single = docs.join(found.where("kept").select("doc_id"), "doc_id", "left_semi").join(repeated, "doc_id", "left_anti")
    own = F.coalesce("set_key", F.lit("")).alias("__set_key")
    several = jaccard.with_keys(docs.join(repeated, "doc_id", "left_semi"), out="__set_key").withColumn("__set_key", F.coalesce("__set_key", F.lit("")))
    several = several.join(found.where("kept").select("doc_id", own).distinct(), ["doc_id", "__set_key"], "left_semi").dropDuplicates(["doc_id", "__set_key"])
    nameless = jaccard.with_keys(docs.where("doc_id is null"), out="__set_key")
    own_sets = nameless.where("__set_key is not null").dropDuplicates(["__set_key"]).join(found.where("set_key is not null").select(F.col("set_key").alias("__set_key")).distinct(), "__set_key", "left_anti")
    parts = [single, several, nameless.where("__set_key is null"), own_sets]
    return reduce(DataFrame.unionByName, (p.select(*docs.columns) for p in parts))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), most=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL can express neither the trained filter nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs)
    return docs
