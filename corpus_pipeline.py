"""Corpus pipeline: operators of ``premia.llm`` applied to documents one after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.llm import bpe, decontaminate, minhash, substrings, toxicity
from premia.llm.common import join_texts, read, settings, write_table
from premia.llm.queries import bpe_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is not among ``ids``; rows that share an id stay or go together."""
    ids = write_table(ids.select("doc_id").where("doc_id is not null").distinct(), "dropped")
    return join_texts(docs.select(*COLUMNS), ids, ids.count() * 16, "left_anti", ["doc_id"])


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are judged toxic."""
    judged = toxicity.score_toxicity(docs, read(spark, sf_dir, "labels"))
    return without(docs, judged.where("predicted = 1"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id."""
    first = without(docs, minhash.near_duplicates(docs).where("not kept"))
    # Rows that repeat the id of a kept document: one of them stays.
    again = first.groupBy("doc_id").count().where("doc_id is not null and count > 1")
    again = write_table(again.select("doc_id"), "repeated")
    if again.isEmpty():
        return first
    size = again.count() * 16
    repeated = join_texts(first, again, size, "left_semi", ["doc_id"]).dropDuplicates(["doc_id"])
    return join_texts(first, again, size, "left_anti", ["doc_id"]).union(repeated)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages that an earlier document holds; documents of nothing else go."""
    judged = substrings.remove_repeats(docs, carry=COLUMNS[1:]).where("n_removed = 0 or n_removed < n_words")
    cut = F.col("n_removed") > 0
    return judged.select(
        "doc_id",
        F.when(cut, F.col("kept")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark passage."""
    return without(docs, decontaminate.find_passages(docs, read(spark, sf_dir, "benchmark")).where("n_hit > 0"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")
    encoded = bpe.encode_texts(docs.select("doc_id", "lang", "source", digest, "text"), bpe_file(), decoded="decoded")
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        (F.sha2(F.col("decoded").cast("binary"), 256) == F.col("text_sha256")).alias("round_trip"),
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(name: str, work: Stage) -> tuple[str, Stage]:
    """A named stage that sets the session settings it relies on."""
    return name, lambda spark, docs, sf_dir: work(settings(spark), docs, sf_dir)


STAGES: list[tuple[str, Stage]] = [
    stage("toxicity", ordinary),
    stage("minhash", distinct),
    stage("substrings", unrepeated),
    stage("decontaminate", unseen),
    stage("tokens", tokens),
]

# Learned models, sketches and token ids are not expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each reads what its predecessor wrote."""
    docs = read(settings(spark), sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = write_table(work(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
