"""Licence scans: TF-IDF cosine of files' lines and windows to licence templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import stage

#: fixed text: the header that files under licences of the GNU family carry; what it is, the licence's name, its version
GNU = """This {thing} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by
        the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version. This {thing} is distributed in the
        hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU {name} for more details."""


def _gnu(thing: str, name: str, version: str) -> tuple[str, ...]:
    return f"This work is licensed under the GNU {name}, version {version}", f"This {thing} is licensed under the GNU {name}, version {version}", GNU.format(thing=thing, name=name, version=version, mark=":", comma=",")


#: fixed texts: the sentences by which files declare a licence, then headers and licence texts as they are published
TEMPLATES = {
    "AGPL-3.0": _gnu("program", "Affero General Public License", "3"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
        or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
        met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    ),
    "BSD-2-Clause": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
        met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. This software is provided by the copyright holders and contributors "as is"
        and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular
        purpose are disclaimed.""",
    ),
    "CC-BY-3.0": ("This work is licensed under a Creative Commons Attribution 3.0 Unported License",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "GPL-2.0": _gnu("program", "General Public License", "2"),
    "GPL-3.0": _gnu("program", "General Public License", "3"),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies.""",
    ),
    "LGPL-2.1": _gnu("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("library", "Lesser General Public License", "3"),
    "MIT": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software.""",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0",),
    "Proprietary": ("All rights reserved", "All rights reserved. Unauthorized copying of this file is strictly prohibited"),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
}
#: cosine at which a line or window declares a licence
COSINE = 0.8
WORD = r"[a-z0-9]+(?:[.][a-z0-9]+)*"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _squares(words: Column, have: Column) -> Column:
    """Sum of squared weights of a template's words (array of word, square) that are in ``have``: cosines are at most its root."""
    return F.aggregate(F.filter(words, lambda x: F.array_contains(have, x["word"])), F.lit(0.0), lambda acc, x: acc + x["square"])


def _candidates(files: DataFrame, shapes: DataFrame, known: Column, rare: list[str], least: float) -> DataFrame:
    """file_id, license, content (words, one space between) of every line and window that can reach the template's cosine."""
    near = files.where(F.lower("text").rlike("|".join(map(re.escape, rare))) if rare else F.lit(False))
    near = near.select("file_id", "text", _words(F.col("text")).alias("words")).withColumn("have", F.array_intersect("words", known))
    near = near.join(F.broadcast(shapes), F.arrays_overlap("have", "rare")).where(_squares(F.col("squares"), F.col("have")) >= least)
    enough = lambda ws: _squares(F.col("squares"), ws) >= least
    last, n = F.size("words"), F.col("n_words")
    anchors = F.filter(F.sequence(F.lit(0), last - 1), lambda i: F.array_contains("rare", F.get("words", i)))
    starts = F.array_distinct(F.flatten(F.transform(anchors, lambda i: F.sequence(F.greatest(i - n + 1, F.lit(0)), F.least(i, F.greatest(last - n, F.lit(0)))))))
    windows = F.filter(F.transform(starts, lambda i: F.slice("words", i + 1, n)), enough)
    lines = F.filter(F.transform(F.split("text", "\n", -1), _words), enough)
    return near.select("file_id", "license", F.explode(F.array_distinct(F.transform(F.concat(windows, lines), lambda ws: F.array_join(ws, " ")))).alias("content"))


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, cosine: float = COSINE) -> DataFrame:
    """``files``: file_id, path, text. Returns file_id, path, own (the licence that the file declares, or null), own_cosine, license and
    license_from: its own and "file", or that of the nearest ancestor directory with a licence file and the directory's path, or nulls.

    Candidates are every line of the whole text, and for each template every window of as many words as it has, over the joined
    lines: so neither words before or after a declaration nor a line break or comment mark within hide it. Words of candidates and
    templates are weighted by their count times ln((1 + N) / (1 + n)) with n of all N files having the word, whichever word it is. A
    file declares the licence of one of its candidates with a cosine of at least ``cosine``: of the one that shares most with its template,
    less what only one of both has (3 c.t - t.t - c.c; ties: the first by name). Between licences whose texts differ in a version or
    a few words, or of which one contains the other, these words decide; their cosines are too near for that. A licence
    file is one named LICENSE, LICENCE or COPYING (any suffix); if a directory has several, the smallest path counts. Null texts and
    paths declare and inherit nothing; an empty table gives an empty one. A row in, a row out: rows are told apart by file_id, path and
    text, so a file_id may repeat; extra columns are not looked at. A licence may have several templates.

    A candidate's cosine is at most the norm of the template's words that it has, so only those where this reaches ``cosine`` go
    on. Equal candidates are scored once, and meet the document frequencies of their words by a join; the table of template words is
    fixed and small, so it is broadcast. Ancestors are an equi-join on directory paths: a file brings as many rows as its path has
    directories, and the nearest one is a max.
    """
    templates = templates or TEMPLATES
    spark = files.sparkSession
    files = files.select(F.col("file_id").alias("given_id"), F.col("path").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    files = files.withColumn("file_id", F.xxhash64("given_id", "path", "text"))
    counted = {f"{k}/{i}": re.findall(WORD, v.lower()) for k, vs in templates.items() for i, v in enumerate(vs)}
    vocabulary = sorted({w for v in counted.values() for w in v})
    total = files.count()
    seen = stage(files.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "license-words")
    n = {r["word"]: r["n"] for r in seen.where(F.col("word").isin(vocabulary)).collect()}  # as many rows as the templates have words
    idf = {w: math.log((1 + max(total, 1)) / (1 + n.get(w, 0))) for w in vocabulary}
    weights, shapes, norms, least = [], [], [], cosine * cosine - 1e-5  # cosines are rounded
    for name, ws in counted.items():
        tf = {w: ws.count(w) * idf[w] for w in ws}
        norm = math.sqrt(sum(x * x for x in tf.values())) or 1.0
        norms.append((name, norm))
        weights += [(name, w, x / norm) for w, x in sorted(tf.items())]
        rest, rare = 0.0, []  # a candidate without any of the heaviest words has a cosine below the norm of the others
        for w, x in sorted(tf.items(), key=lambda p: (p[1], p[0])):
            rest += (x / norm) ** 2
            if rest >= least:
                rare.append(w)
        shapes.append((name, len(ws), rare, [(w, (x / norm) ** 2) for w, x in sorted(tf.items())]))
    table = spark.createDataFrame(weights, "license string, word string, weight double")
    shaped = spark.createDataFrame(shapes, "license string, n_words int, rare array<string>, squares array<struct<word:string,square:double>>")
    candidates = stage(_candidates(files, shaped, F.array(*map(F.lit, vocabulary)), sorted({w for s in shapes for w in s[2]}), least), "license-candidates")
    counts = candidates.select("license", "content").distinct().select("license", "content", F.explode(F.split("content", " ", -1)).alias("word"))
    counts = counts.groupBy("license", "content", "word").agg(F.count("*").alias("tf"))
    needed = stage(counts.select("word").distinct().join(seen, "word").select("word", F.log(F.lit(1.0 + max(total, 1)) / (1 + F.col("n"))).alias("idf")), "license-idf")
    counts = counts.join(needed, "word").withColumn("x", F.col("tf") * F.col("idf")).join(F.broadcast(table), ["license", "word"], "left")
    scored = counts.groupBy("license", "content").agg(F.sum(F.col("x") * F.coalesce("weight", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    scored = scored.where("norm > 0").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= cosine)
    # shared mass, less what only the template and only the candidate has, in squared weights: texts of one family differ in a few words
    sized = scored.join(F.broadcast(spark.createDataFrame(norms, "license string, size double")), "license")
    told = F.round(3 * F.col("dot") * F.col("size") - F.col("size") * F.col("size") - F.col("norm") * F.col("norm"), 6)
    scored = stage(sized.select("license", "content", "cosine", told.alias("told")), "license-scored")
    scored = candidates.join(scored, ["license", "content"])
    best = scored.groupBy("file_id").agg(F.min(F.struct((-F.col("told")).alias("t"), "license", (-F.col("cosine")).alias("c"))).alias("b")).select("file_id", F.substring_index("b.license", "/", 1).alias("own"), (-F.col("b.c")).alias("own_cosine"))
    own = stage(files.select("file_id", "given_id", "path").join(best, "file_id", "left"), "license-own")

    base = F.element_at(F.split("path", "/", -1), -1)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    named = own.where("own is not null").where(base.rlike("(?i)^(licen[cs]e|copying)(\\.|$)")).groupBy(folder.alias("folder")).agg(F.min(F.struct("path", "own")).alias("f"))
    named = named.select("folder", F.col("f.own").alias("given"))
    parts = F.split(folder, "/", -1)
    up = own.where("own is null and path is not null").select("file_id", F.explode(F.concat(F.array(F.lit("")), F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/")))).alias("folder")).distinct()
    nearest = up.join(named, "folder").groupBy("file_id").agg(F.max(F.struct(F.char_length("folder").alias("depth"), "folder", "given")).alias("n"))
    out = own.join(nearest, "file_id", "left")
    return out.select(F.col("given_id").alias("file_id"), "path", "own", "own_cosine", F.coalesce("own", "n.given").alias("license"), F.when(F.col("own").isNotNull(), "file").otherwise(F.col("n.folder")).alias("license_from"))
