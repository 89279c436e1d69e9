"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

Each word is spelled by two models, one counted in toxic and one in ordinary documents: bytes given the
bytes of the word before them. What a class has not seen backs off to continuation counts that both
classes share and that all documents give, so rare spellings cost both the same. The difference of the
two log-likelihoods of a word, by its length, says how much it speaks for toxic text; a document is
judged by the word that says most, through a logistic curve.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.llm.common import WordHashes, column, join_texts, rows, write_table

# Bytes of a spelling (the byte and its context), and of the shared back-off.
ORDER, SHARED = 7, 3
DISCOUNT = 0.75
# Words and spellings whose differences are sent to executors, the most frequent ones; all others are joined.
SENT_WORDS, SENT_SPELLINGS = 1 << 19, 1 << 20
# Distinct words a task counts, and their bytes, before it passes them on.
COUNTED, COUNTED_BYTES = 200_000, 16 << 20
# Labelled documents the logistic curve is fitted on, at most; all counts cover all documents.
CURVE_ROWS = 20_000
# Lower-cases A to Z and makes all ASCII white space one space.
PLAIN = bytes(32 if b in b"\t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def spellings(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every byte of every word and the space after it: the bytes up to it, as one number.

    Returns the numbers, where in them each word starts, and the text of each word.
    """
    coded = [t.encode().translate(PLAIN) + b" " for t in texts]
    data = np.frombuffer(b" " * ORDER + b"".join(coded), np.uint8)
    letter = data != 32
    before = np.zeros_like(letter)
    before[1:] = letter[:-1]
    starts = np.flatnonzero(letter & ~before)
    at = np.flatnonzero(letter | before)
    word = np.searchsorted(starts, at, "right") - 1
    # The byte, those of the word before it, and the space before the word.
    known = np.minimum(at - starts[word] + 2, ORDER).astype(np.uint64)
    number = np.zeros(len(at), np.uint64)
    for k in range(ORDER):
        number |= data[at - k].astype(np.uint64) << np.uint64(8 * k)
    number &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - known * np.uint64(8))
    ends = ORDER + np.cumsum([len(c) for c in coded])
    return number, np.searchsorted(at, starts), np.searchsorted(ends, starts, "right")


COUNTS = ("n", "ordinary_0", "toxic_0", "ordinary_1", "toxic_1")


def plain_words(text: str) -> list[bytes]:
    return text.encode().translate(PLAIN).split()


def word_counts(labelled: DataFrame) -> DataFrame:
    """Every distinct ``word``, as bytes, and how often it occurs.

    The counts are those in all documents, and by class in two parts of the labelled ones. ``labelled`` has
    ``text`` and ``place``: 0 for no label, else the number of one of the other counts.
    """

    def work(batches):
        held: dict[bytes, list[int]] = {}
        size = 0

        def out():
            sums = np.array(list(held.values()), np.int64).reshape(-1, len(COUNTS))
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), *(pa.array(sums[:, i]) for i in range(len(COUNTS)))], ["word", *COUNTS]
            )

        for batch in batches:
            for text, place in rows([batch], "text", "place"):
                for word, n in Counter(plain_words(text)).items():
                    sums = held.get(word)
                    if sums is None:
                        sums = held[word] = [0] * len(COUNTS)
                        size += len(word)
                    sums[0] += n
                    if place:
                        sums[place] += n
                if len(held) > COUNTED or size > COUNTED_BYTES:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    made = labelled.mapInArrow(work, "word binary, " + ", ".join(f"{c} long" for c in COUNTS))
    return made.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))


def few_words(batch: pa.RecordBatch):
    """Slices of a batch with a bounded number and length of words, and the words of each."""
    words = batch.column(batch.schema.get_field_index("word")).to_pylist()
    start = 0
    while start < len(words):
        end, size = start, 0
        while end < len(words) and end - start < 4096 and size < 1 << 20:
            size += len(words[end])
            end += 1
        yield batch.slice(start, end - start), words[start:end]
        start = end


def totals(words: DataFrame) -> DataFrame:
    """How often each spelling occurs, from the counts of the words."""

    def work(batches):
        for batch in batches:
            for part, texts in few_words(batch):
                number = spellings([w.decode() for w in texts])[0]
                of = np.repeat(np.arange(len(texts)), [len(w) + 1 for w in texts])
                keys, where = np.unique(number, return_inverse=True)
                out = [column(keys, pa.int64())]
                for name in COUNTS:
                    count = part.column(part.schema.get_field_index(name)).to_numpy()
                    sums = np.zeros(len(keys), np.int64)
                    np.add.at(sums, where, count[of])
                    out.append(pa.array(sums))
                yield pa.RecordBatch.from_arrays(out, ["spelling", *COUNTS])

    made = words.mapInArrow(work, "spelling long, " + ", ".join(f"{c} long" for c in COUNTS))
    return made.groupBy("spelling").agg(*(F.sum(c).alias(c) for c in COUNTS))


def spelling_counts(labelled: DataFrame) -> DataFrame:
    """How often each spelling occurs in ``labelled`` (see ``word_counts``), with the same counts."""
    return totals(word_counts(labelled))


def differences(counts: DataFrame) -> DataFrame:
    """``spelling``, ``n``, and the difference of the log-likelihoods by the first part and by both parts."""
    low = F.col("spelling").bitwiseAND(F.lit((1 << 8 * SHARED) - 1))
    types = counts.groupBy(low.alias("low")).agg(F.count("*").alias("continuations"))
    after = types.groupBy(F.shiftright("low", 8).alias("low_context")).agg(
        F.sum("continuations").alias("all_continuations"), F.count("*").alias("kinds")
    )
    shared = types.join(after, F.shiftright("low", 8) == F.col("low_context")).select(
        F.col("low").alias("shared_low"),
        (
            F.greatest(F.col("continuations") - DISCOUNT, F.lit(0.0)) / F.col("all_continuations")
            + DISCOUNT * F.col("kinds") / F.col("all_continuations") / 256
        ).alias("shared"),
    )
    both = {
        "part": {"toxic": F.col("toxic_0"), "ordinary": F.col("ordinary_0")},
        "full": {"toxic": F.col("toxic_0") + F.col("toxic_1"), "ordinary": F.col("ordinary_0") + F.col("ordinary_1")},
    }
    seen = {f"{m}_{c}": count for m, classes in both.items() for c, count in classes.items()}
    counted = counts.select("spelling", "n", low.alias("low"), F.shiftrightunsigned("spelling", 8).alias("context"),
                            *(count.alias(name) for name, count in seen.items()))
    contexts = counted.groupBy(F.col("context").alias("of_context")).agg(
        *(F.sum(name).alias(f"{name}_all") for name in seen),
        *(F.count(F.when(F.col(name) > 0, 1)).alias(f"{name}_kinds") for name in seen),
    )
    full = counted.join(contexts, F.col("context") == F.col("of_context")).join(shared, F.col("low") == F.col("shared_low"))

    def likelihood(name: str) -> Column:
        every = F.col(f"{name}_all")
        own = F.greatest(F.col(name) - DISCOUNT, F.lit(0.0)) / every
        return F.when(every > 0, own + DISCOUNT * F.col(f"{name}_kinds") / every * F.col("shared")).otherwise(F.col("shared"))

    return full.select(
        "spelling", "n",
        *((F.log(likelihood(f"{m}_toxic")) - F.log(likelihood(f"{m}_ordinary"))).alias(m) for m in both),
    )


def sent_values(table: DataFrame, key: str, most: int):
    """Sends ``part`` and ``full`` of the most frequent rows, at most ``most``, sorted by ``key``.

    Returns the broadcast and the ``n`` from which on rows are in it.
    """
    step = F.floor(F.log2("n") * 8).cast("int").alias("step")
    steps = table.groupBy(step).agg(F.count("*").alias("rows"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    least, size = 1 << 62, 0
    for r in steps:
        size += r["rows"]
        if size > most:
            break
        least = r["least"]
    got = table.where(F.col("n") >= least).select(key, "part", "full").toArrow()
    keys = got[key].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    values = (keys[order], got["part"].to_numpy()[order], got["full"].to_numpy()[order])
    return table.sparkSession.sparkContext.broadcast(values), least


def found_in(known: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``codes`` are in the sorted ``known``, and where."""
    at = np.searchsorted(known, codes)
    hit = at < len(known)
    hit[hit] = known[at[hit]] == codes[hit]
    return hit, at


def word_values(words: DataFrame, difference: DataFrame) -> DataFrame:
    """``key`` (hash), ``n`` and, as ``part`` and ``full``, the mean difference of the spellings of every word."""
    difference = write_table(difference, "differences")
    sent, least = sent_values(difference, "spelling", SENT_SPELLINGS)

    def work(batches):
        known, *tables = sent.value
        for batch in batches:
            for part, texts in few_words(batch):
                number, starts, _ = spellings([w.decode() for w in texts])
                hit, at = found_in(known, number)
                sums = []
                for table in tables:
                    value = np.zeros(len(number))
                    value[hit] = table[at[hit]]
                    sums.append(pa.array(np.add.reduceat(value, starts)))
                ends = np.append(starts[1:], len(number))
                missed = np.concatenate([[0], np.cumsum(~hit)])
                offsets = np.append(missed[starts], missed[-1]).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(offsets), pa.array(number[~hit].view(np.int64)))
                keys = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts))
                n = part.column(part.schema.get_field_index("n"))
                yield pa.RecordBatch.from_arrays(
                    [column(keys, pa.int64()), n, pa.array(ends - starts), *sums, rest], ["key", "n", "length", "part", "full", "rest"]
                )

    local = words.select("word", "n").mapInArrow(work, "key long, n long, length long, part double, full double, rest array<long>")
    local = write_table(local, "words-sent")
    # What no labelled document holds says nothing.
    telling = difference.where(F.col("n") < least).where("part != 0 or full != 0").drop("n")
    rest = local.select("key", F.explode("rest").alias("spelling")).join(telling, "spelling")
    rest = rest.groupBy("key").agg(F.sum("part").alias("rest_part"), F.sum("full").alias("rest_full"))
    both = local.drop("rest").join(rest, "key", "left")
    return both.select(
        "key", "n", *(((F.col(c) + F.coalesce(f"rest_{c}", F.lit(0.0))) / F.col("length")).alias(c) for c in ("part", "full"))
    )


def strongest_words(documents: DataFrame, values: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``part`` and ``full``: the largest values of a word of each text; 0 without words.

    ``values`` has every word of the texts. The most frequent ones are sent to the executors, which look
    them up where the text lies; the others of each text are joined with their values.
    """
    sent, least = sent_values(values, "key", SENT_WORDS)
    kept = [documents.schema[c] for c in keep]

    def work(batches):
        known, *tables = sent.value
        memo = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [np.unique(memo.of(plain_words(t or ""))) for (t,) in rows([part], "text")]
                counts = np.array([len(f) for f in found])
                codes = np.concatenate(found)
                hit, at = found_in(known, codes)
                full, starts = counts > 0, np.cumsum(counts) - counts
                best = []
                for table in tables:
                    value = np.full(len(codes), -np.inf)
                    value[hit] = table[at[hit]]
                    most = np.zeros(len(found))
                    if full.any():
                        most[full] = np.maximum.reduceat(value, starts[full])
                    best.append(pa.array(most))
                rest = [f[~hit[s : s + n]].view(np.int64) for f, s, n in zip(found, starts, counts, strict=True)]
                columns = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *best, pa.array(rest, pa.list_(pa.int64()))], [*keep, "part", "full", "rest_keys"]
                )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "part double, full double, rest_keys array<long>"])
    local = documents.select(*keep, "text").mapInArrow(work, schema)
    local = write_table(local.withColumn("row", F.monotonically_increasing_id()), "strongest-sent")
    rest = local.select("row", F.explode("rest_keys").alias("key"))
    joined = rest.join(values.where(F.col("n") < least).select("key", "part", "full"), "key")
    joined = joined.groupBy("row").agg(F.max("part").alias("rest_part"), F.max("full").alias("rest_full"))
    best = (F.greatest(c, f"rest_{c}").alias(c) for c in ("part", "full"))
    return local.drop("rest_keys").join(joined, "row", "left").select(*keep, *best)


def curve(strongest: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve, by Newton steps with a small penalty on the slope."""
    if not len(toxic) or toxic.min() == toxic.max():
        return 1.0, 4.0 if len(toxic) and toxic[0] else -4.0
    x = np.column_stack([strongest, np.ones(len(strongest))])
    w, penalty = np.zeros(2), np.diag([1e-2, 1e-6])

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - toxic @ z + w @ penalty @ w / 2

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - toxic) + penalty @ w)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score_toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Toxicity of every whole text, learned from ``labels`` (``doc_id``, ``toxic``).

    Returns ``doc_id``, ``held_out`` (crc32 of the id as text is 2 modulo 4; labels of such rows are not
    learned from), ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on). A document with several
    labels is toxic if one says so; other labels than 0 and 1 count as none. A null or empty text scores as
    a text without a toxic word. Rows that share a ``doc_id`` are answered each; with a null ``doc_id`` a row
    has no label and is not held out. Without labels of both classes the curve has a fixed slope. Other
    columns are ignored; empty tables give empty results.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    texts = texts.withColumn("rest", F.coalesce(rest, F.lit(0)).cast("int"))
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = write_table(marks.agg(F.max("toxic").cast("int").alias("toxic")), "labels")
    joined = join_texts(texts, marks, marks.count() * 24, "left", ["doc_id"])
    # Two parts of the labelled documents: the curve is fitted on the second by counts of the first.
    known = F.col("toxic").isNotNull() & (F.col("rest") != 2)
    place = F.when(known & (F.col("rest") != 3), 1 + F.col("toxic")).when(known, 3 + F.col("toxic")).otherwise(0)
    words = write_table(word_counts(joined.where("text is not null").select("text", place.alias("place"))), "words")
    counts = write_table(totals(words), "spellings")
    values = write_table(word_values(words, differences(counts)), "word-values")
    scored = write_table(strongest_words(joined, values, ["doc_id", "rest", "toxic"]), "strongest")

    second = scored.where((F.col("rest") == 3) & F.col("toxic").isNotNull())
    # At most so many rows, chosen by their id; Spark takes them per task and merges the smallest.
    sample = second.orderBy(F.xxhash64("doc_id"), "doc_id").limit(CURVE_ROWS) if second.count() > CURVE_ROWS else second
    fitted = sample.select("part", "toxic").toArrow()
    slope, intercept = curve(fitted["part"].to_numpy(), fitted["toxic"].to_numpy().astype(float))

    score = 1 / (1 + F.exp(-(F.col("full") * slope + intercept)))
    return scored.select(
        "doc_id", (F.col("rest") == 2).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted")
    )
