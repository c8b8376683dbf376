"""Licences of files: sparse TF-IDF cosine of header lines and licence files to templates, then inheritance by directory.

A line, or a whole file, is compared with each licence template by the cosine of TF-IDF vectors. Only words that some
template has can add to a dot product, so vectors stay sparse: other words count towards the length alone, at the
weight of a word never seen. A line close to a template must hold one of that template's heaviest words, so all
lines without any are dropped before vectors are built; no close line is lost. Files without a licence of their own take the one of the
nearest directory above them that has a licence file. All of it is DataFrame work on the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import materialise

COSINE = 0.6
FILE_NAMES = r"(?i)^(licen[cs]es?|copying|unlicense|notice)([._-][^/]*)?$"

# Short notices by which files name their licence.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": [
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0-1.0": ["Released into the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "Proprietary": ["All rights reserved."],
}


def notices(spark: SparkSession) -> DataFrame:
    """The built-in templates as ``(license_id, text)``."""
    return spark.createDataFrame([(k, t) for k, texts in NOTICES.items() for t in texts], "license_id string, text string")


def terms(text: Column) -> Column:
    """Lower-case words; version numbers stay whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z\p{L}]+|[0-9]+(?:\.[0-9]+)*"), F.lit(0))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", "digest", F.explode(F.split("text", r"\R")).alias("text"))


def _heavy(weights: dict[str, float], cosine: float) -> list[str]:
    """The heaviest words of a template, so many that all others together stay below the cosine.

    A text without any of them cannot reach the cosine: its dot product is at most its own length times that of the others.
    """
    total = sum(w * w for w in weights.values())
    rest, out = total, []
    for t, w in sorted(weights.items(), key=lambda x: (-x[1], -len(x[0]), x[0])):
        if rest < cosine * cosine * total:
            break
        out.append(t)
        rest -= w * w
    return out


def _near(texts: DataFrame, needles: list[str]) -> DataFrame:
    """``(path, digest, terms)`` of texts with one of the needles among their words, which are worked out once."""
    some = F.filter(F.array(terms(F.col("text"))), lambda ts: F.arrays_overlap(ts, F.array(*map(F.lit, needles))))
    return texts.select("path", "digest", F.explode(some).alias("terms"))


def _norms(distinct: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """``(line, norm)``: squared length of each of the texts ``distinct (line, terms)``, every word weighed by the lines it stands in."""
    each = materialise(distinct.select("line", F.explode("terms").alias("term")).groupBy("line", "term").agg(F.count(F.lit(1)).alias("k")), "licence-words")
    seen = lines.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("c"))
    idf = F.log(F.lit(float(n + 1)) / (F.coalesce("c", F.lit(0)) + 1)) + 1
    weights = materialise(each.select("term").distinct().join(seen, "term", "left").select("term", idf.alias("idf")), "licence-weights")
    return each.join(weights, "term").groupBy("line").agg(F.sum(F.col("k") * F.col("idf") * F.col("k") * F.col("idf")).alias("norm"))


def best_notices(files: DataFrame, templates: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(path, digest, license_id, score)``: for each file with a line or whole text close enough, the closest template.

    ``templates`` is a list of notices, small enough for the driver; words are weighed by the lines of all files.
    """
    folded = templates.where("license_id IS NOT NULL AND text IS NOT NULL").select("license_id", terms(F.col("text")).alias("terms")).distinct()
    listed = [(r.license_id, r.terms) for r in folded.collect() if r.terms]
    vocabulary = sorted({t for _, ts in listed for t in ts})
    own = files.where(F.col("text").isNotNull()).select("path", F.xxhash64("text").alias("digest"), "text")
    if not vocabulary:
        return own.select("path", "digest", F.lit("").alias("license_id"), F.lit(0.0).alias("score")).limit(0)
    words = F.array(*map(F.lit, vocabulary))
    # in how many lines of all files each template word stands; the empty word counts the lines
    seen = _lines(own).select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(terms(F.col("text")), words))).alias("term"))
    counts = {r.term: r["count"] for r in seen.groupBy("term").count().collect()}
    n = counts.get("", 0)
    idf = {t: math.log((n + 1) / (counts.get(t, 0) + 1)) + 1 for t in vocabulary}
    needles = sorted({t for _, ts in listed for t in _heavy({t: ts.count(t) * idf[t] for t in ts}, cosine)})
    whole = own.where(F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILE_NAMES))
    units = materialise(_near(_lines(own), needles).union(_near(whole, needles)), "licence-lines")
    # copies of a notice are one vector however many files hold it
    distinct = units.select("terms").distinct().withColumn("line", F.xxhash64("terms"))
    known, weight = F.array_intersect("terms", words), F.create_map(*(x for t in vocabulary for x in (F.lit(t), F.lit(idf[t]))))
    vector = F.transform(known, lambda t: F.struct(t.alias("term"), (F.size(F.filter("terms", lambda u: u == t)) * weight[t]).alias("w")))
    lines = distinct.select("line", "terms", vector.alias("vector"))
    lines = lines.select("line", "vector").join(_norms(distinct, _lines(own), n), "line")
    spark = files.sparkSession
    rows = [(i, k, t, ts.count(t) * idf[t], sum((ts.count(u) * idf[u]) ** 2 for u in set(ts))) for i, (k, ts) in enumerate(sorted(listed)) for t in sorted(set(ts))]
    of_templates = spark.createDataFrame(rows, "template int, license_id string, term string, tw double, tnorm double")
    of_lines = lines.select("line", "norm", F.explode("vector").alias("x")).select("line", "norm", "x.term", "x.w")
    dots = of_lines.join(of_templates, "term").groupBy("line", "template", "license_id", "norm", "tnorm").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.select("line", "license_id", F.round(F.col("dot") / F.sqrt(F.col("norm") * F.col("tnorm")), 9).alias("score")).where(F.col("score") >= cosine)
    least = lambda: F.min_by("license_id", F.struct(-F.col("score"), "license_id")).alias("license_id")
    best = scored.groupBy("line").agg(F.max("score").alias("score"), least())
    held = units.select("path", "digest", F.xxhash64("terms").alias("line")).join(best, "line")
    return held.groupBy("path", "digest").agg(F.max("score").alias("score"), least())


def ancestors(path: Column) -> Column:
    """Directories above a file, with their depth; the top one is ``""``."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.concat_ws("/", F.slice(parts, F.lit(1), i)).alias("dir"), i.alias("depth")))


def file_licenses(files: DataFrame, templates: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(file_id, path, license_id, origin, source_dir, score)`` for every row of ``files (file_id, path, text)``.

    ``origin``: ``header`` (a line of its own, or the whole text of a licence file, names it), ``inherited`` (from the nearest
    directory above with a licence file; ``source_dir``), else ``none``. Within a directory the licence file with the best score
    counts, then the smallest licence name. Of equally close templates the smallest name counts.

    A null or empty text has no header but can inherit; a null path can have a header but inherits nothing. Repeated
    rows are returned each. Other columns are not looked at. Empty tables are fine on either side; without templates all is ``none``.
    """
    own = files.select("file_id", "path", F.xxhash64("text").alias("digest"))
    found = materialise(best_notices(files.select("file_id", "path", "text"), templates, cosine), "licences-found")
    name, folder = F.regexp_extract("path", r"([^/]*)$", 1), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    governing = found.where(name.rlike(FILE_NAMES)).groupBy(folder.alias("dir")).agg(F.min_by("license_id", F.struct(-F.col("score"), "license_id")).alias("dir_license"))
    headed = own.join(found.select(F.col("path").alias("p"), F.col("digest").alias("g"), "license_id", "score"), F.col("path").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("g")), "left")
    headed = headed.select("file_id", "path", "license_id", "score")
    # each directory asks for its governing ancestor once, however many files it holds
    dirs = headed.where("license_id IS NULL AND path IS NOT NULL").select(folder.alias("home")).distinct()
    steps = dirs.select("home", F.explode(ancestors(F.concat("home", F.lit("/x")))).alias("a")).select("home", "a.dir", "a.depth")
    nearest = steps.join(governing, "dir").groupBy("home").agg(F.max_by(F.struct("dir", "dir_license"), "depth").alias("up"))
    out = headed.join(nearest, F.when(F.col("license_id").isNull(), folder) == F.col("home"), "left")
    own_license, up = F.col("license_id"), F.col("up.dir_license")
    return out.select(
        "file_id",
        "path",
        F.coalesce(own_license, up).alias("license_id"),
        F.when(own_license.isNotNull(), "header").when(up.isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(own_license.isNull(), F.col("up.dir")).alias("source_dir"),
        F.round("score", 6).alias("score"),
    )
