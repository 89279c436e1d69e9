"""Registered queries: each applies one operator to its whole table and derives digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.llm import (
    bpe,
    decontaminate,
    embeddings,
    infill,
    licences,
    merkle,
    minhash,
    preferences,
    substrings,
    suffixes,
    tokenfiles,
    toxicity,
    urls,
)
from premia.llm.common import read, settings
from premia.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run):
    """Register a function under its name; the session settings it relies on are set before it runs."""

    def with_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(settings(spark), sf_dir)

    with_settings.__name__ = run.__name__
    QUERIES[run.__name__] = with_settings
    return run


def bpe_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# The rules of the URL query, as host, path and verdict.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and verdict of every page's URL."""
    return urls.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


@query
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every vector with those of its label at a cosine of 0.93 and above."""
    return embeddings.near_vectors(read(spark, sf_dir, "embeddings"))


@query
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of five-word shingles are at least 85 % alike."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and completions of conversations that open alike, as digests."""
    made = preferences.format_pairs(preferences.pair_conversations(read(spark, sf_dir, "conversations")))

    def text(side: str, trained: bool):
        pieces = F.filter(side, lambda x: x["trained"]) if trained else F.col(side)
        return F.sha2(F.array_join(F.transform(pieces, lambda x: x["text"]), "").cast("binary"), 256)

    return made.select(
        "chosen_id",
        "rejected_id",
        F.col("n_common").cast("long").alias("n_common"),
        F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha256"),
        text("chosen", False).alias("chosen_sha256"),
        text("chosen", True).alias("chosen_trained_sha256"),
        text("rejected", False).alias("rejected_sha256"),
        text("rejected", True).alias("rejected_trained_sha256"),
    )


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark passages of ten words, and a digest of the items."""
    found = decontaminate.find_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that also stand in another document."""
    return suffixes.repeated_passages(read(spark, sf_dir, "documents"))


@query
def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, taken as a file of the folder of its source and language.

    Documents whose first or last line names a licence stand for licence files.
    """
    documents = read(spark, sf_dir, "documents").where("doc_id is not null")
    lines = F.split("text", r"\n")
    names_it = F.concat_ws("\n", lines[0], F.element_at(lines, -1)).rlike(r"(?i)licen[cs]e|all rights reserved")
    name = F.concat(F.when(names_it, "LICENCE.").otherwise("TEXT."), F.col("doc_id").cast("string"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), name)
    found = licences.scan_licences(documents.select(path.alias("path"), "text"), r"^LICENCE\.")
    return found.select(
        F.regexp_extract("path", r"\.(-?[0-9]+)$", 1).cast("long").alias("doc_id"),
        "path",
        "own_licence",
        F.round("score", 6).alias("score"),
        "licence",
        "inherited_from",
    )


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, how many an earlier document's windows cover, and a digest of the rest."""
    return substrings.remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the decoded text."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_texts(documents, bpe_file(), decoded="decoded").select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and lengths of every document's fill-in-middle output, digests of output and text rebuilt from it."""
    made = infill.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(infill.restored().cast("binary"), 256).alias("restored_sha256"),
    )


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that its leaf gives where a seventh are tampered with."""
    documents = read(spark, sf_dir, "documents")
    names = ("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in names]
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in names]
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    leaves = documents.select(
        "doc_id",
        "lang",
        merkle.record_digest(fields).alias("leaf"),
        F.when(tampered & F.col("n_chars").isNotNull(), merkle.record_digest(changed)).alias("other"),
    )
    proofs = merkle.build_manifest(leaves, keep=["other"]).proofs()
    claimed = F.coalesce("other", "leaf")
    found = proofs.withColumn("folded_root", merkle.folded(claimed, F.col("siblings"), F.col("path")))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.digest(F.array_join("siblings", "")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's token ids, read back from the files."""
    folder = scratch_path(spark, "token-files")
    tokenfiles.write_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), word_file(), folder)
    back = tokenfiles.read_tokens(spark, folder)
    return back.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
