"""Fill-in-middle transformation by counted quantifiers.

The units of a text are counted once; a pattern made for each row then takes the first ``a``
units, the next ``b - a`` and the rest in a single match, whose replacement is the output. All
quantifiers are possessive, so a match never steps back and its stack does not grow with the text.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space and the word after it, or the white space that ends a text.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
PLAIN, PSM, SPM = "plain", "psm", "spm"


def _draws(seed: int, key: str) -> list[Column]:
    """Four unsigned 32-bit integers that depend on the seed and the key alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * n, 8), 16, 10).cast("long") for n in range(4)]


def _checked(marks: tuple[str, str, str]) -> None:
    """A mark must be found where it was put, whatever text stands beside it."""
    for a, b in product(marks, marks):
        if not a or any(a[:n] == b[-n:] for n in range(1, min(len(a), len(b)) + (a != b))) or (a != b and a in b):
            raise ValueError(f"{a!r} and {b!r} overlap: a mark may not begin with the end of one or hold another")


def fill_in_middle(
    documents: DataFrame,
    seed: int = 42,
    rate: int = 50,
    spm_share: int = 80,
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
    text: str = "text",
    key: str = "doc_id",
    unit: str = UNIT,
) -> DataFrame:
    """``documents`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    Of 100 texts about ``rate`` are rearranged, of those ``spm_share`` with the suffix first. ``marks``
    stand before prefix, suffix and middle. A text without units, or one that holds a mark, stays plain.
    Cuts and form depend on ``seed`` and ``key`` alone, so repeated rows and a task that is run again give
    the same; a null key counts as an empty one. A null text counts as empty: no units, plain, an empty
    output. The lengths are null if plain. Whole texts are cut, however long. Input columns of the names
    above are replaced, all others pass through; an empty table stays empty.
    """
    _checked(marks)
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    if {text, key} & set(made):
        raise ValueError(f"{text!r} and {key!r} may not be named as one of {made}")
    kept = [f"`{c}`" for c in documents.columns if c not in made]
    quoted = [re.sub(r"([\\$])", r"\\\1", m) for m in marks]
    p, s, m = quoted
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    units = f"(?:{unit})"

    counted = documents.select(
        *kept, F.regexp_count(whole, F.lit(unit)).cast("long").alias("n"), F.array(*_draws(seed, key)).alias("_draws")
    )
    first, second = (F.pmod(F.col("_draws")[k], F.col("n") + 1) for k in (0, 1))
    holds = F.lit(False)
    for mark in marks:
        holds = holds | F.contains(whole, F.lit(mark))
    form = (
        F.when((F.col("n") == 0) | (F.col("_draws")[2] % 100 >= rate) | holds, PLAIN)
        .when(F.col("_draws")[3] % 100 < spm_share, SPM)
        .otherwise(PSM)
    )
    cut = counted.select(*kept, "n", form.alias("form"), F.least(first, second).alias("_a"), F.greatest(first, second).alias("_b"))
    a, b = F.col("_a").cast("string"), (F.col("_b") - F.col("_a")).cast("string")
    pattern = F.concat(F.lit(rf"\A({units}{{"), a, F.lit(rf"}}+)({units}{{"), b, F.lit(r"}+)([\s\S]*+)\z"))
    layout = F.when(F.col("form") == PSM, f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    output = F.when(F.col("form") == PLAIN, whole).otherwise(F.regexp_replace(whole, pattern, layout))
    placed = cut.select(*kept, "n", "form", output.alias("output"))
    pieces = F.when(F.col("form") != PLAIN, _pieces(F.col("output"), F.col("form"), marks))
    lengths = F.transform(F.slice(pieces, 1, 2), lambda x: F.length(x).cast("long"))
    return placed.select("*", lengths.alias("_lengths")).select(
        *kept, "n", "form", F.get("_lengths", 0).alias("prefix_chars"), F.get("_lengths", 1).alias("middle_chars"), "output"
    )


def _pieces(output: Column, form: Column, marks) -> Column:
    """Prefix, middle and suffix of an output that is not plain; no text holds a mark, so these cut it in four."""
    four = F.split(output, "|".join(map(re.escape, marks)), -1)

    def ordered(x: Column) -> Column:
        return F.when(form == PSM, F.array(x[1], x[3], x[2])).otherwise(F.array(x[2], x[3], x[1]))

    # Bound to a name, so that the output is cut once.
    return F.transform(F.array(four), ordered)[0]


def restored(
    output: str = "output", form: str = "form", marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")
) -> Column:
    """The text from which an output was made; a null output gives null."""
    out, kind = F.col(f"`{output}`"), F.col(f"`{form}`")
    return F.when(kind == PLAIN, out).otherwise(F.array_join(_pieces(out, kind, marks), ""))
