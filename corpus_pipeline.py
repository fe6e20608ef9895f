"""A corpus from raw documents to token ids, in five stages; each works on all that the one before it kept.

A stage is called when the result of the one before it has been written, so it first deletes that one's scratch tables.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.llm import bpe, common, fmindex, jaccard, langid, pii

#: Scratch tables of the stage before, by the thread that ran it: runs at the same time don't touch each other's.
HELD: dict[int, list[common.Scratch]] = {}


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        me = threading.get_ident()
        for done in HELD.pop(me, []):
            if done in common.OPEN:  # else release() has deleted it
                common.OPEN.remove(done)
                done.drop()
        before = list(common.OPEN)
        result = work(spark, docs, sf_dir)
        HELD[me] = [s for s in common.OPEN if s.owner == me and s not in before]
        return result

    run_stage.__doc__, run_stage.__name__ = work.__doc__, work.__name__
    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with that language in lang."""
    found = langid.identify(docs, F.col("text"), declared=F.col("lang"), host=F.col("source"), out="language_found")
    return found.where("language_found.keep").withColumn("lang", F.col("language_found.lang")).select(docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8."""
    return jaccard.keep_one(docs, jaccard.near_duplicates(docs, k=5, percent=80)).select(docs.columns)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that stand in a ten-word window of the benchmark; a text of nothing else goes."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = fmindex.contamination(docs, benchmark, out="hits_found")
    hit = F.aggregate("hits_found.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])
    left = found.where((hit == 0) | (hit < F.col("hits_found.n_words")))
    text = F.when(hit > 0, fmindex.cut(F.col("text"), F.col("hits_found.spans"))).otherwise(F.col("text"))
    return left.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("bigint")).select(docs.columns)


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which the name of its kind stands for each piece of personal data."""
    found = pii.detect(docs, out="pii_found", redacted=True)
    return found.withColumn("text", F.col("pii_found.redacted")).withColumn("n_chars", F.char_length("text").cast("bigint")).select(docs.columns)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = bpe.encode(docs, ranks, public_tokenizers.PATTERN, out="enc", decoded=True)
    same = F.col("enc.decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return done.select("doc_id", "lang", "source", "n_chars", "enc.n_tokens", "enc.ids", same.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: No SQL for the trained language model, the transducers and the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; every result but the last is written out and read again."""
    scratch = common.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        docs = scratch.keep(work(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
