"""Licences of files: TF-IDF cosine of their lines to templates, else the nearest ancestor folder's licence."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.llm.common import write_table

WORD = r"[a-z0-9]+"

# Short notices by which files name their licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def weights(files: DataFrame, templates: list[tuple[str, str]]) -> tuple[dict[str, float], float]:
    """IDF of the templates' terms over all files, and that of any other term."""
    terms = sorted({w for _, text in templates for w in template_words(text)})
    held = F.array_intersect(words(F.col("text")), F.array(*map(F.lit, terms)))
    # One row per term of the templates, whatever the number of files.
    counts = files.select(F.explode(held).alias("term")).groupBy("term").count().collect()
    total = files.count()
    in_files = {r["term"]: r["count"] for r in counts}
    return {t: math.log((1 + total) / (1 + in_files.get(t, 0))) + 1 for t in terms}, math.log(1 + total) + 1


def telling_terms(vectors: list[dict[str, float]], least: float) -> list[str]:
    """Terms of which a line must hold one to reach a cosine of ``least`` with a template.

    The lightest terms of a template whose weights together stay below ``least`` cannot do it alone.
    """
    out = set()
    for vector in vectors:
        norm = math.sqrt(sum(w * w for w in vector.values()))
        room = (least * norm) ** 2 * (1 - 1e-9)
        for term, weight in sorted(vector.items(), key=lambda x: (x[1], x[0])):
            room -= weight * weight
            if room < 0:
                out.add(term)
    return sorted(out)


def detected(files: DataFrame, templates: list[tuple[str, str]], least: float) -> DataFrame:
    """``path``, ``licence`` and ``score`` of files that have a line like a template: the likest."""
    idf, other = weights(files, templates)
    vectors = []
    for _, text in templates:
        found = template_words(text)
        vectors.append({w: found.count(w) * idf[w] for w in dict.fromkeys(found)})
    telling = telling_terms(vectors, least)
    if not telling:
        return files.select("path", F.lit("").alias("licence"), F.lit(0.0).alias("score")).where("false")
    line = F.explode(F.split("text", r"[\r\n]+")).alias("line")
    lines = files.select("path", line).where(F.col("line").rlike(rf"(?i)(?<![a-z0-9])(?:{'|'.join(telling)})(?![a-z0-9])"))
    lines = lines.select("path", words(F.col("line")).alias("words"))

    idf_of = F.create_map(*(F.lit(x) for pair in idf.items() for x in pair))
    times = lambda x: F.size(F.filter("words", lambda y: y == x))
    square = F.aggregate(
        F.array_distinct("words"), F.lit(0.0),
        lambda s, x: s + F.pow(times(x) * F.coalesce(F.element_at(idf_of, x), F.lit(other)), F.lit(2.0)),
    )
    scored = []
    for (name, _), vector in zip(templates, vectors, strict=True):
        norm = math.sqrt(sum(w * w for w in vector.values()))
        dot = sum((times(F.lit(t)) * (idf[t] * w / norm) for t, w in vector.items()), F.lit(0.0))
        scored.append(F.struct((dot / F.sqrt("square")).alias("score"), F.lit(name).alias("licence")))
    lines = lines.withColumn("square", square).where("square > 0")
    lines = lines.select("path", F.explode(F.array(*scored)).alias("s")).where(F.col("s.score") >= least)
    best = lines.groupBy("path").agg(F.min(F.struct((-F.col("s.score")).alias("score"), "s.licence")).alias("b"))
    return best.select("path", F.col("b.licence").alias("licence"), (-F.col("b.score")).alias("score"))


def scan_licences(
    files: DataFrame, licence_files: str, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.7
) -> DataFrame:
    """Licence of every file, its own or that of the nearest folder above it.

    ``files`` has ``path`` and ``text``. A file's own licence is the template its likest line has a cosine of
    at least ``least`` with (equal cosines: the first name). Terms are weighted by how few files hold them;
    a term of no template counts as held by none. A folder has the licence that most of the files in it
    whose name matches ``licence_files`` have (equal numbers: the first name). Returns ``path``,
    ``own_licence`` and ``score`` (null if none), ``licence``, and ``inherited_from`` (the folder, empty for
    the root; null if the licence is the file's own or there is none). Rows that share a path are one file.
    Rows with a null path are left out, a null or empty text has no lines, other columns are ignored, an
    empty table gives an empty result.
    """
    files = files.select("path", "text").where("path is not null")
    own = write_table(detected(files, templates, least), "own-licences")
    named = own.where(F.element_at(F.split("path", "/"), -1).rlike(licence_files))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    folders = named.groupBy(folder.alias("folder"), "licence").count().groupBy("folder").agg(
        F.min(F.struct((-F.col("count")).alias("n"), "licence"))["licence"].alias("folder_licence")
    )
    folders = write_table(folders, "folder-licences")

    paths = files.select("path").distinct()
    judged = paths.join(own, "path", "left")
    parts = F.split("path", "/")
    depths = F.sequence(F.lit(0), F.size(parts) - 1)
    above = judged.withColumn("depth", F.explode(depths))
    above = above.withColumn("folder", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    joined = above.join(folders, "folder", "left")
    nearest = F.max(F.when(F.col("folder_licence").isNotNull(), F.struct("depth", "folder", "folder_licence")))
    found = joined.groupBy("path").agg(F.first("licence").alias("own_licence"), F.first("score").alias("score"), nearest.alias("n"))
    return found.select(
        "path",
        "own_licence",
        "score",
        F.coalesce("own_licence", "n.folder_licence").alias("licence"),
        F.when(F.col("own_licence").isNull(), F.col("n.folder")).alias("inherited_from"),
    )
