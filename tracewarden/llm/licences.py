"""Licence scans: sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory.

What is compared are the lines of a text that speak of a licence (its headers, wherever they stand), in licence files
the whole text as well: lines with short notices, usual headers and SPDX ids, whole files also with whole licence texts.  Equal ones are compared once: a line that half the files share is one row.  A file without
a licence of its own gets that of the closest directory above it that holds a licence file, by a join of directory
paths.  Only DataFrame operations are used.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.passing import named
from tracewarden.session import cut_lineage

SIMILAR = 0.6
#: In texts of over LONG words a name hardly counts, but other versions of the licence come up to 0.86.
SIMILAR_LONG, LONG = 0.9, 1000
CUE = r"(?i)licen[sc]e|copyright|copyleft|all rights reserved|public domain|spdx"
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[sc]e|copying|notice)[^/]*$"
WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"

# Short forms of common notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved.",
}
# Usual headers and titles of licences, one line each; their SPDX ids are added.
HEADERS = {
    "Apache-2.0": ["Apache License Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'],
    "MIT": ["The MIT License (MIT)", "MIT License", "Licensed under the MIT license."],
    "GPL-3.0": ["GNU General Public License version 3", "GNU GPL v3", "GPLv3"],
    "GPL-2.0": ["GNU General Public License version 2", "GNU GPL v2", "GPLv2"],
    "LGPL-3.0": ["GNU Lesser General Public License version 3", "GNU LGPL v3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License version 3", "GNU Affero General Public License", "GNU AGPL v3", "AGPLv3"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International Public License", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International Public License", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International Public License", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "Unlicense": ["The Unlicense"],
}
_SPDX = {"GPL-3.0", "GPL-2.0", "LGPL-3.0", "AGPL-3.0"}


def headers() -> list[tuple[str, str]]:
    """(licence, line) of the usual headers and SPDX ids; the GNU family has ids with a suffix."""
    out = [(name, line) for name, lines in HEADERS.items() for line in lines]
    for name in HEADERS:
        ids = [name, *(f"{name}-{x}" for x in ("only", "or-later"))] if name in _SPDX else [name]
        out += [(name, f"SPDX-License-Identifier: {i}") for i in ids]
    return out


def whole_texts() -> list[tuple[str, str]]:
    """(licence, whole text), read on the driver from the files of the package."""
    return [(n, pkgutil.get_data(__package__, f"licence_texts/{n}.txt").decode()) for n in TEMPLATES if n != "Proprietary"]


def _vectors(texts: list[str], tf) -> tuple[dict[str, float], float, list[dict[str, float]]]:
    words = [Counter(re.findall(WORD, text.lower())) for text in texts]
    having = Counter(w for c in words for w in c)
    idf = lambda n: math.log((1 + len(texts)) / (1 + n)) + 1
    vectors = []
    for c in words:
        raw = {w: tf(n) * idf(having[w]) for w, n in c.items()}
        size = math.sqrt(sum(x * x for x in raw.values()))
        vectors.append({w: x / size for w, x in raw.items()})
    return {w: idf(n) for w, n in having.items()}, idf(0), vectors


def weights(templates: dict[str, str]) -> tuple[dict[str, float], float, dict[str, dict[str, float]]]:
    """Inverse document frequencies, that of an unknown word, and the unit vector of each template."""
    idf, unknown, vectors = _vectors(list(templates.values()), lambda n: n)
    return idf, unknown, dict(zip(templates, vectors))


def similarities(units: DataFrame, templates: list[tuple[str, str]], damped: bool = False) -> DataFrame:
    """``(unit, best)``: the closest of ``templates`` (licence, text) of every text of ``units (unit, body)``.

    Ties go to the first by name.  ``damped`` counts a word ``1 + ln n`` times, so that common words do not outweigh
    all others in long texts.  The vocabulary of the templates is a small table of the code's own; it is broadcast.
    """
    spark = units.sparkSession
    names = [n for n, _ in templates]
    turns = {n: -k for k, n in enumerate(sorted({*names, *TEMPLATES}))}
    idf, unknown, vectors = _vectors([x for _, x in templates], (lambda n: 1 + math.log(n)) if damped else (lambda n: n))
    rows = [(w, x, [v.get(w, 0.0) for v in vectors]) for w, x in sorted(idf.items())]
    table = F.broadcast(spark.createDataFrame(rows, "word string, idf double, at array<double>"))
    words = units.select("unit", F.explode(F.regexp_extract_all(F.lower("body"), F.lit(WORD), F.lit(0))).alias("word"))
    counts = words.groupBy("unit", "word").agg(F.count("*").alias("n")).join(table, "word", "left")
    weight = (1 + F.log("n") if damped else F.col("n")) * F.coalesce("idf", F.lit(unknown))
    dots = [F.sum(weight * F.coalesce(F.col("at")[k], F.lit(0.0))).alias(f"d{k}") for k in range(len(names))]
    summed = counts.groupBy("unit").agg(F.sqrt(F.sum(weight * weight)).alias("size"), *dots)
    each = [F.struct(F.round(F.col(f"d{k}") / F.col("size"), 9).alias("similarity"), F.lit(turns[n]).alias("turn"), F.lit(n).alias("licence")) for k, n in enumerate(names)]
    best = F.greatest(*each) if len(each) > 1 else each[0]
    return summed.select("unit", best.alias("best"))


def near(units: DataFrame, templates: list[tuple[str, str]], similar: float, rank: int, damped: bool = False) -> DataFrame:
    """``similarities`` that reach ``similar``, and for long whole texts ``SIMILAR_LONG``; a higher ``rank`` goes first."""
    long = sorted({n for n, x in templates if damped and len(x.split()) > LONG})
    least = F.when(F.col("best.licence").isin(long), F.greatest(F.lit(SIMILAR_LONG), F.lit(similar))).otherwise(similar)
    close = similarities(units, templates, damped).where(F.col("best.similarity") >= least)
    return close.select("unit", F.struct(F.lit(rank).alias("rank"), "best.*").alias("best"))


def _directory(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("")), "/?[^/]*$", "")


def _ancestors(directory: Column) -> Column:
    """A directory and all above it, down to the empty path, each with its depth."""
    parts = F.split(directory, "/")
    depths = F.when(directory == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))
    return F.transform(depths, lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("above"), n.alias("depth")))


def scan(files: DataFrame, keep: list[str], path_col: str = "path", text_col: str = "text", templates: dict[str, str] | None = None, similar: float = SIMILAR) -> DataFrame:
    """``(row, licence, similarity, origin)`` of every row of ``files``; ``row`` holds the columns ``keep``.

    ``origin`` is ``own``, ``inherited`` or ``none`` (licence null, similarity 0).  Of several notices the closest
    counts, then the template first by name; of several licence files in a directory the same.  A null path is a
    file of the empty directory; a null text says nothing; repeated rows are judged each by its own text.  A licence
    file that is close to a whole licence text is judged by that, as such texts name other licences too ("All rights
    reserved." stands in BSD's); otherwise by its lines and the text as one notice.  With ``templates`` of the
    caller only these are compared.
    """
    known = templates is None
    templates = templates or TEMPLATES
    path, text = named(path_col).cast("string"), F.coalesce(named(text_col).cast("string"), F.lit(""))
    is_file = F.coalesce(path.rlike(LICENCE_FILE), F.lit(False))
    lines = F.array_distinct(F.filter(F.split(text, "\n"), lambda x: x.rlike(CUE)))
    notices = F.when(is_file & (text != ""), F.array_union(F.array(text), lines)).when(text.rlike(CUE), lines).otherwise(F.array().cast("array<string>"))
    row = F.struct(*[named(c) for c in keep]).alias("row")
    whole = F.when(is_file & (text != ""), text)
    base = files.select(row, _directory(path).alias("directory"), is_file.alias("is_file"), notices.alias("notices"), whole.alias("whole"))
    # rows without a notice get a key of their own kind that nothing matches
    key = F.when(F.size("notices") > 0, F.sha2(F.concat_ws("\n", F.col("is_file").cast("string"), F.array_join("notices", "\n")), 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("row").cast("string")))
    slim = base.select("row", "directory", "is_file", key.alias("key"))
    spoken = base.where(F.size("notices") > 0).select(key.alias("key"), "notices", "whole").groupBy("key").agg(F.max("notices").alias("notices"), F.max("whole").alias("whole"))
    spoken = cut_lineage(spoken)
    each = spoken.select("key", F.explode("notices").alias("body")).select("key", F.sha2("body", 256).alias("unit"), "body")
    units = each.groupBy("unit").agg(F.min("body").alias("body"))
    found = near(units, [*templates.items()], similar, 0)
    if known:
        found = found.unionByName(near(units, headers(), similar, 0))
    matched = each.select("key", "unit").join(found, "unit").select("key", "best")
    if known:
        whole_files = spoken.where("whole is not null").select(F.col("key").alias("unit"), F.col("whole").alias("body"))
        matched = matched.unionByName(near(whole_files, whole_texts(), similar, 1, True).withColumnRenamed("unit", "key"))
    own = cut_lineage(matched.groupBy("key").agg(F.max("best").alias("own")))
    held = slim.where("is_file").select("directory", "key").distinct().join(own, "key").groupBy("directory").agg(F.max("own").alias("theirs"))
    above = slim.select("directory").distinct().select("directory", F.explode(_ancestors(F.col("directory"))).alias("a"))
    reach = above.join(held.withColumnRenamed("directory", "holder"), F.col("a.above") == F.col("holder"))
    nearest = reach.groupBy("directory").agg(F.max_by("theirs", "a.depth").alias("theirs"))
    found = slim.join(own, "key", "left").join(nearest, "directory", "left")
    best = F.coalesce("own", "theirs")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("theirs").isNotNull(), "inherited").otherwise("none")
    return found.select("row", best["licence"].alias("licence"), F.coalesce(best["similarity"], F.lit(0.0)).alias("similarity"), origin.alias("origin"))
