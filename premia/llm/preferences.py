"""Preference formatting: the common turns of two conversations once as a prompt, the rest as masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.llm.common import write_table


def gathered(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns`` (role and text, in the order of their turn)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.sort_array(F.collect_set(turn))
    found = conversations.where("conv_id is not null").groupBy("conv_id").agg(turns.alias("turns"))
    return found.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def misplaced(found: DataFrame) -> DataFrame:
    """Conversations against themselves with the last answer replaced by their first one, where it differs."""
    places = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.get("turns", i - 1)["role"] == "assistant")
    own = found.select("conv_id", "turns", places.alias("places")).where(F.size("places") > 1)
    first, last = F.get("turns", F.col("places")[0] - 1), F.element_at("places", -1) - 1
    swapped = F.transform("turns", lambda t, i: F.when(i == last, first).otherwise(t))
    own = own.select(F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), swapped.alias("rejected_turns"), F.col("turns").alias("chosen_turns"))
    return own.where("chosen_turns != rejected_turns")


def pair_conversations(conversations: DataFrame) -> DataFrame:
    """Pairs of a chosen and a rejected conversation: ``chosen_id``, ``rejected_id`` and their turns.

    Of conversations that open with the same turn, the one with the smallest id is the chosen answer and
    each other one a rejected answer, so a group of any size gives one row per conversation but one. Each
    conversation is also chosen over itself with its last answer replaced by its first one, where these
    differ (``rejected_id`` is then its own id). Rows with a null ``conv_id`` are left out, a null role or
    text counts as empty, repeated rows count once; rows of one turn number follow each other by role and
    text, a null turn comes first. Other columns are ignored; an empty table has no pairs.
    """
    opening = F.concat_ws("\n", F.col("turns")[0]["role"], F.col("turns")[0]["text"])
    found = write_table(gathered(conversations).withColumn("opening", F.sha2(opening, 256)), "conversations")
    # Written, so that the join with an opening that very many share can be split.
    chosen = found.groupBy("opening").agg(F.min("conv_id").alias("chosen_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    chosen = write_table(chosen, "openings")
    rejected = found.join(chosen, "opening").where("conv_id != chosen_id").select(
        "chosen_id", F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected_turns")
    )
    answers = found.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen_turns"))
    return rejected.join(answers, "chosen_id").select(
        "chosen_id", "rejected_id", "rejected_turns", "chosen_turns"
    ).union(misplaced(found))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def completion(turns: Column) -> Column:
    """Pieces of text and whether they are trained on: what the assistant says, with its end mark."""

    def pieces(turn):
        head = F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))
        body = F.concat(turn["text"], F.lit("<|end|>\n"))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("trained")),
            F.struct(body.alias("text"), (turn["role"] == "assistant").alias("trained")),
        )

    return F.flatten(F.transform(turns, pieces))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``prompt`` and masked completions of pairs of conversations.

    Returns ``chosen_id``, ``rejected_id``, ``n_common`` (length of the longest common prefix of turns),
    ``prompt`` (those turns, rendered once), ``chosen`` and ``rejected`` (arrays of ``text`` and ``trained``).
    A pair of equal conversations has empty completions, one that starts another has one empty completion.
    """
    a, b = F.col("chosen_turns"), F.col("rejected_turns")
    shorter = F.least(F.size(a), F.size(b))
    same = F.when(shorter > 0, F.transform(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda i: F.get(a, i - 1) == F.get(b, i - 1)))
    differs = F.array_position(same, False)
    common = F.when(shorter == 0, 0).when(differs > 0, differs.cast("int") - 1).otherwise(shorter)
    rest = lambda turns: completion(F.slice(turns, F.col("n_common") + 1, F.size(turns)))
    return pairs.withColumn("n_common", common).select(
        "chosen_id",
        "rejected_id",
        "n_common",
        F.array_join(F.transform(F.slice(a, 1, F.col("n_common")), rendered), "").alias("prompt"),
        rest(a).alias("chosen"),
        rest(b).alias("rejected"),
    )
