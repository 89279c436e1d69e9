"""Benchmark passages in documents, by a positional inverted index.

Each window of an item is looked up from its rarest terms: their postings (word, document, position) are
stored, the lists of the two rarest are intersected at the offsets the window gives them, and only where
both stand in place are document and item compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.llm.common import join_texts, printed, write_table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters a to z and characters beyond ASCII, with A to Z lower-cased."""
    # The general lower() may only be used where no other upper-case letter would change.
    other_upper = text.rlike(r"[\p{javaUpperCase}\p{javaTitleCase}&&[^A-Z]]")
    lowered = F.when(other_upper, F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def anchors(benchmark: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Items with their words, and the positions of the words of each of their windows."""
    items = benchmark.where("item_id is not null and text is not null")
    items = items.select("item_id", words(F.col("text")).alias("item_words")).where(F.size("item_words") > 0).distinct()
    items = items.withColumn("item", F.sha2(F.concat_ws(" ", F.col("item_id").cast("string"), "item_words"), 256))
    items = items.withColumn("size", F.least(F.lit(length), F.size("item_words")))
    starts = items.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("item_words") - F.col("size"))))
    places = starts.withColumn("place", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)))
    return items, places.select("item", "start", "place", F.get("item_words", F.col("place")).alias("word"))


def find_passages(documents: DataFrame, benchmark: DataFrame, length: int = 10, slop: int = 0) -> DataFrame:
    """Words of documents that stand in a benchmark passage.

    A passage is any ``length`` consecutive words of an item (all of them if it has fewer, but not none).
    Returns ``doc_id``, ``n_words``, ``n_hit`` (words inside passages), ``items`` (sorted as strings, of
    which a passage occurs) and ``near_items`` (of which the two rarest words of a passage stand within
    ``slop`` words of each other's place). A null text has no words. Rows that share a ``doc_id`` are
    answered each; rows with a null ``doc_id`` only have their words counted. Items with a null id or
    without words are left out; texts that share an ``item_id`` all count for it. Other columns are ignored,
    empty tables have no passages.
    """
    items, places = anchors(benchmark, length)
    items, places = write_table(items, "items"), write_table(places, "places")
    vocabulary = places.select("word").distinct()
    texts = printed(documents)
    usable = texts.where("doc_id is not null and text is not null")

    counts = usable.select(F.explode(words(F.col("text"))).alias("word")).join(vocabulary, "word", "left_semi")
    counts = write_table(counts.groupBy("word").count(), "term-counts")
    ranked = places.join(counts, "word", "left").groupBy("item", "start").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "place", "word"))).alias("terms")
    )
    first, second = F.get("terms", F.lit(0)), F.coalesce(F.get("terms", F.lit(1)), F.get("terms", F.lit(0)))
    lookups = write_table(
        # A window whose rarest word no document holds occurs nowhere.
        ranked.where(first["count"] > 0).select(
            "item", first["word"].alias("word"), first["place"].alias("place"),
            second["word"].alias("next_word"), second["place"].alias("next_place"),
        ).distinct(),
        "lookups",
    )

    terms = lookups.select("word").union(lookups.select(F.col("next_word").alias("word"))).distinct()
    postings = usable.select("doc_id", "print", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    postings = write_table(postings.join(terms, "word", "left_semi"), "postings")
    shift = F.col("pos") - F.col("place")
    found = postings.join(lookups, "word").select("doc_id", "print", "item", "next_word", "next_place", shift.alias("shift"))
    found = found.withColumn("pos", F.col("shift") + F.col("next_place"))
    if slop:
        found = found.withColumn("pos", F.explode(F.sequence(F.col("pos") - slop, F.col("pos") + slop)))
    both = found.join(
        postings.withColumnRenamed("word", "next_word"), ["doc_id", "print", "next_word", "pos"], "left_semi"
    )
    aligned = both.select("doc_id", "print", "item", "shift").distinct().join(items.drop("text"), "item")
    per_doc = aligned.groupBy("doc_id", "print").agg(
        F.collect_list(F.struct("item_id", "item_words", "size", "shift")).alias("aligned")
    )
    per_doc = write_table(per_doc, "aligned")
    weight = F.aggregate("aligned", F.lit(64), lambda s, x: s + 16 * F.size(x["item_words"]) + 64)
    size = per_doc.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]

    all_words = F.col("words")

    def starts(x):
        """First words of the passages of an aligned item, as positions in the document."""
        last = F.size(x["item_words"]) - x["size"]
        return F.filter(
            F.transform(F.sequence(F.lit(0), last), lambda k: k + x["shift"]),
            lambda at: (at >= 0) & (at + x["size"] <= F.size(all_words))
            & (F.slice(all_words, F.greatest(at, F.lit(0)) + 1, x["size"]) == F.slice(x["item_words"], F.greatest(at - x["shift"], F.lit(0)) + 1, x["size"])),
        )

    joined = join_texts(texts, per_doc, size, "left").select("doc_id", words(F.col("text")).alias("words"), "aligned")
    joined = joined.withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    kind = "array<struct<item_id:bigint,starts:array<int>,size:int>>"
    hits = F.transform("aligned", lambda x: F.struct(x["item_id"].alias("item_id"), starts(x).alias("starts"), x["size"].alias("size")))
    judged = joined.select("doc_id", F.size("words").cast("long").alias("n_words"), F.coalesce(hits, F.array().cast(kind)).alias("hits"))
    positions = F.array_distinct(F.flatten(F.flatten(F.transform(
        "hits", lambda x: F.transform(x["starts"], lambda at: F.sequence(at, at + x["size"] - 1))
    ))))
    names = lambda found: F.array_sort(F.array_distinct(F.transform(found, lambda x: x["item_id"].cast("string"))))
    return judged.select(
        "doc_id",
        "n_words",
        F.size(positions).cast("long").alias("n_hit"),
        names(F.filter("hits", lambda x: F.size(x["starts"]) > 0)).alias("items"),
        names(F.col("hits")).alias("near_items"),
    )
