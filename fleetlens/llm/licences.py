"""Licence scan of files in a directory tree, in built-in expressions only.

Each line of a file is compared with short licence templates by the cosine of sparse TF-IDF vectors (idf over the
templates; a word of no template counts as the rarest). A file's own licence is the best of its lines at or above the
threshold. A file without takes that of the nearest ancestor directory, its own first, that has one from a licence file.

Only lines that hold one of a template's heaviest words can reach the threshold: without them the dot product is bounded
by the norm of the rest. One regular expression, made from the templates, keeps those lines; the others are never split.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import computed
from fleetlens.llm.shared import salted_lookup

#: Notices by SPDX id. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
}
LIKE = 0.8
_WORD = r"[a-z0-9]+(?:\.[0-9]+)*"


def vectors(templates: dict[str, str]) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """(idf of each word, weights of each template scaled to length 1)"""
    counts = {k: Counter(re.findall(_WORD, v.lower())) for k, v in templates.items()}
    df = Counter(w for c in counts.values() for w in c)
    idf = {w: math.log((1 + len(counts)) / (1 + n)) + 1 for w, n in df.items()}
    out = {}
    for k, c in counts.items():
        raw = {w: n * idf[w] for w, n in c.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out[k] = {w: v / norm for w, v in raw.items()}
    return idf, out


def needed_words(weights: dict[str, dict[str, float]], like: float) -> list[str]:
    """Words of which a line must hold one to reach ``like`` with some template."""
    out: set[str] = set()
    for template in weights.values():
        rest = 1.0
        for w, v in sorted(template.items(), key=lambda x: (-x[1], x[0])):
            if math.sqrt(max(0.0, rest)) < like:
                break
            out.add(w)
            rest -= v * v
    return sorted(out)


def _of(table: dict[str, float], word: Column, otherwise: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), word), F.lit(otherwise))


def _norm(words: Column, idf: dict[str, float], rarest: float) -> Column:
    """Length of a line's vector: one pass over its words in order, where equal ones follow each other."""
    squares = lambda run: run["s"] + F.pow(run["n"] * _of(idf, run["w"], rarest), F.lit(2.0))
    state = lambda w, n, s: F.struct(w.alias("w"), n.alias("n"), s.alias("s"))
    return F.aggregate(
        F.array_sort(words), state(F.lit(""), F.lit(0), F.lit(0.0)),
        lambda run, w: F.when(run["w"] == w, state(run["w"], run["n"] + 1, run["s"])).otherwise(state(w, F.lit(1), squares(run))),
        lambda run: F.sqrt(squares(run)))


def alike(lines: DataFrame, idf: dict[str, float], weights: dict[str, dict[str, float]], rarest: float, like: float) -> DataFrame:
    """(_path, licence, score) of each line (_path, _line) and each template that it is like, inside the row.

    A line's words stay in its row. Its vector is at least as long as if each word came once for each time it occurs, with
    the least idf for a word of a template; only lines that could be like a template by that have their words sorted.
    """
    rows = computed(lines, _words=F.regexp_extract_all(F.lower("_line"), F.lit(f"({_WORD})"))).drop("_line")
    rows = computed(rows, _known=F.filter("_words", lambda w: w.isin(*idf)))
    dot = lambda t: F.aggregate("_known", F.lit(0.0), lambda sum, w: sum + _of({x: idf[x] * v for x, v in t.items()}, w, 0.0))
    dots = F.array(*[F.struct(F.lit(k).alias("licence"), dot(t).alias("dot")) for k, t in weights.items()])
    shortest = F.sqrt((F.size("_words") - F.size("_known")) * F.lit(rarest**2) + F.size("_known") * F.lit(min(idf.values()) ** 2))
    rows = computed(rows, _dots=dots, _shortest=shortest)
    rows = rows.where(F.exists("_dots", lambda x: (x.dot > 0) & (x.dot >= F.lit(like - 1e-6) * F.col("_shortest"))))
    rows = computed(rows.select("_path", "_words", "_dots"), _long=_norm(F.col("_words"), idf, rarest))
    found = rows.select("_path", "_long", F.explode("_dots").alias("_x")).where("_x.dot > 0")
    return found.select("_path", "_x.licence", F.round(F.col("_x.dot") / F.col("_long"), 9).alias("score")).where(F.col("score") >= like)


def scanned(files: DataFrame, path: str = "path", text: str = "text", licence_file: Column | None = None,
            templates: dict[str, str] | None = None, like: float = LIKE) -> DataFrame:
    """(path, licence, score, origin, directory) of each row of ``files``.

    origin is ``own``, ``inherited`` (directory is then the ancestor's) or ``none``. licence_file tells which files speak for
    their directory (default: name begins with LICENSE, LICENCE, COPYING or NOTICE); of several the best score counts, then
    the licence's name. Ties of a file's lines go to the first licence by name. A null text has no line; a null path has
    no directory, so it inherits nothing. Rows of one path are one file with all their lines; each comes out.
    """
    templates = TEMPLATES if templates is None else templates
    idf, weights = vectors(templates)
    some = r"(?i)\b(?:" + "|".join(re.escape(w) for w in needed_words(weights, like)) + r")\b"

    if licence_file is None:
        licence_file = F.col(path).rlike(r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$")
    rows = files.select(F.col(path).alias("_path"), F.col(text).alias("_text"), F.coalesce(licence_file, F.lit(False)).alias("_speaks"))
    lines = rows.where(F.col("_text").rlike(some)).select("_path", F.explode(F.split("_text", r"[\r\n]+")).alias("_line")).where(F.col("_line").rlike(some))
    scores = alike(lines, idf, weights, math.log(1 + len(templates)) + 1, like)
    best = lambda rows, key: rows.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("_low"), F.col("licence"))).alias("_b")).select(
        key, F.col("_b.licence").alias("licence"), (-F.col("_b._low")).alias("score"))
    own = best(scores, "_path").withColumnRenamed("_path", "_own")

    folder = F.regexp_replace("_own", r"/?[^/]*$", "")
    speaking = rows.where("_speaks and _path is not null").select(F.col("_path").alias("_own")).distinct()
    by_folder = best(own.join(speaking, "_own", "left_semi").select(folder.alias("_folder"), "licence", "score"), "_folder")
    named = rows.select("_path").join(own, F.col("_path").eqNullSafe(F.col("_own")), "left").select("_path", "licence", "score")

    parts = F.split(F.regexp_replace("_path", r"/?[^/]*$", ""), "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("_depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("_folder")))
    bare = named.where("licence is null and _path is not null").select("_path").distinct()
    asked = bare.select("_path", F.explode(F.array_distinct(up)).alias("_x")).select("_path", "_x._depth", "_x._folder")
    found = salted_lookup(asked, by_folder, "_folder", "_path", 8).where("licence is not null")
    nearest = found.groupBy(F.col("_path").alias("_under")).agg(F.max(F.struct("_depth", "_folder", "licence", "score")).alias("_up"))
    out = named.join(nearest, F.col("_path") == F.col("_under"), "left")
    return out.select(
        F.col("_path").alias(path), F.coalesce("licence", "_up.licence").alias("licence"), F.coalesce("score", "_up.score").alias("score"),
        F.when(F.col("licence").isNotNull(), "own").when(F.col("_up").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("licence").isNull(), F.col("_up._folder")).alias("directory"))
