"""The corpus pipeline: toxic texts out, near-duplicates out, repeated passages out, sources mixed, ids.

Every stage takes what its predecessor kept and returns the columns of ``documents``; the last one
returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultfold.llm import bpe, mixing, simhash, substring, toxicity
from faultfold.session import work_dir
from faultfold.sources.tables import read_table

#: Characters that a task holds when token ids are put in place.
BATCH_CHARS = 8 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this stage's input, does not reject."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.with_score(docs, model, "__score")
    return scored.where(F.col("__score") < toxicity.THRESHOLD).drop("__score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of fingerprints linked at four bits the document with the smallest doc_id."""
    return simhash.one_of_each(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller doc_id has; what is empty then goes."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    # In one struct, so that no column clashes with those of the operator.
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("__0"), *[F.col(f"`{c}`") for c in others]).alias("__others"))
    found = substring.substring_dedup(packed, "__others", with_text=True)
    found = found.where("n_removed = 0 or n_removed < n_words")
    columns = {c: F.col("__others")[c] for c in others}
    columns |= {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of ids and decoded bytes."""
    return bpe.byte_bpe(docs, with_ids=True, batch_chars=BATCH_CHARS)


STAGES = [
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_passages),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: The stages learn and hash as SQL cannot; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each result written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = work_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
