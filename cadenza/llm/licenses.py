"""Licence scan: TF-IDF cosine of notices and licence files to templates, then inheritance from directories.

Units are the lines of a text, each two lines in a row (blank ones left out) of which neither reaches the threshold, as
titles and headers break lines, and the whole text of a licence file. A unit's terms are its lower-cased runs of letters and digits, weighted by count times inverse
document frequency, counted over all lines of all files for every term. Only DataFrame functions are used.

A unit reaches the threshold only if the template's terms in it carry threshold^2 of the template's squared length
(Cauchy-Schwarz). So some terms of each template, up to where the others carry less, are its keys, and units without any
key are passed over without loss.
"""

from __future__ import annotations

import math
from importlib.resources import files as package_files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, materialize

#: Notices, titles and the lines that headers and permissions start with, as their licensors word them (fixed values).
NOTICES = {
    "MIT": (
        "Released under the MIT License.", "This software is released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
    ),
    "ISC": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License)", "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "This program is licensed under the GNU General Public License version 3",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or",
    ),
    "GPL-2.0": (
        "This program is licensed under the GNU General Public License version 2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "BSD 2-Clause License"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted", "BSD 3-Clause License"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Licensed under the Creative Commons Attribution 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "CC0 1.0 Universal"),
}


def known_templates() -> dict[str, tuple[str, ...]]:
    """NOTICES and the full texts in the folder ``license_texts``, with each paragraph of the texts of one page."""
    out = {k: list(v) for k, v in NOTICES.items()}
    for entry in sorted(package_files(__package__).joinpath("license_texts").iterdir(), key=lambda e: e.name):
        text, own = entry.read_text("utf-8"), out.setdefault(entry.name.removesuffix(".txt"), [])
        own.append(text)
        own += [p for p in text.split("\n\n") if p.startswith("Permission ")]
    return {k: tuple(dict.fromkeys(v)) for k, v in out.items()}


#: Names of licence files, in lower case and without what follows a dot.
LICENSE_FILES = ("license", "licence", "copying", "unlicense")


#: A tag that names licences outright, and what joins or extends their names in it.
TAG = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)"
TAG_WORDS = ("AND", "OR", "WITH")


def _tagged(text: Column) -> Column:
    """The licences that the tags of a text name, without what says whether later versions count."""
    names = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)), lambda t: F.split(F.regexp_replace(t, r"[()]", " "), r"[ \t]+")))
    plain = F.transform(names, lambda n: F.regexp_replace(n, r"(-only|-or-later|\+)$", ""))
    return F.array_distinct(F.filter(plain, lambda n: n.rlike("[A-Za-z0-9]") & ~n.isin(*TAG_WORDS)))


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _template_terms(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for t in "".join(c if c.isalnum() else " " for c in text.lower()).split():
        out[t] = out.get(t, 0) + 1
    return out


def _keys(vectors: dict[tuple[str, int], dict[str, float]], df: dict[str, int], threshold: float) -> set[str]:
    """Terms of which every unit that reaches the threshold with some template has at least one: those with most weight for
    the lines that hold them."""
    keys: set[str] = set()
    for weights in vectors.values():
        rest = sum(w * w for w in weights.values())
        least = threshold * threshold * rest * (1 - 1e-9)
        for term, w in sorted(weights.items(), key=lambda x: (-x[1] * x[1] / (1 + df.get(x[0], 0)), x[0])):
            if rest < least:
                break
            keys.add(term)
            rest -= w * w
    return keys


def scan(
    files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, templates: dict[str, tuple[str, ...]] | None = None
) -> DataFrame:
    """The licences of every file: its own, or else those of the nearest directory above it that has a licence file.

    Columns: ``id_col``, origin (``file`` if a licence of its own stands in a licence file, else ``notice``; ``inherited``;
    or ``none``), directory (where it was inherited from) and licenses: an array, by name, of license and score (cosine, of
    the licence file where inherited; 1 for a licence that an SPDX tag names), at most one entry a licence. One row for each
    file.

    ``path`` gives a file's place, with ``/``; its last part is its name. A licence file is one that is named so
    (``LICENSE_FILES``) and whose whole text, or a line or two, reaches the threshold. A unit speaks for one licence: the
    nearest, of equals the first by name. Of directories the longest path wins. Null texts are empty; texts of any length
    are read whole; a null path is a file at the root; rows of one id are one file, at the greatest of their paths; a null
    id is an id of its own. An empty table gives no rows. Other columns are not read.
    """
    spark = files.sparkSession
    templates = templates or known_templates()
    rows = files.select(F.col(id_col).alias("id"), F.coalesce(path, F.lit("")).alias("path"), body(text_col).alias("text"))
    name = F.lower(F.regexp_extract("path", r"([^/.]*)[^/]*$", 1))
    named = name.isin(*LICENSE_FILES)

    counts = {(license, i): _template_terms(t) for license, texts in templates.items() for i, t in enumerate(texts)}
    vocabulary = sorted({t for c in counts.values() for t in c})
    line_terms = rows.select(F.explode(F.split("text", "\n")).alias("line")).select(F.array_distinct(_terms(F.col("line"))).alias("t"))
    frequency = materialize(line_terms.select(F.explode(F.concat("t", F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    df = {r["term"]: r["df"] for r in frequency.where(F.col("term").isin("", *vocabulary)).collect()}  # one row a template term, and ""
    total = df.get("", 0)
    idf = {t: math.log((1 + total) / (1 + df.get(t, 0))) + 1 for t in vocabulary}
    vectors = {k: {t: n * idf[t] for t, n in c.items()} for k, c in counts.items()}
    lengths = {k: math.sqrt(sum(w * w for w in v.values())) for k, v in vectors.items()}
    keys = F.array(*[F.lit(t) for t in sorted(_keys(vectors, df, threshold))])
    # Bounds of a term's weight that need no join: half steps above those of the templates' terms, and that of the other
    # term which most lines hold.
    common = frequency.where(~F.col("term").isin("", *vocabulary)).agg(F.max("df").alias("df")).first()["df"] or 0
    least = math.log((1 + total) / (1 + common)) + 1
    steps: dict[float, list[str]] = {}
    for t in vocabulary:
        steps.setdefault(math.ceil(idf[t] * 2) / 2, []).append(t)

    def may_reach(terms: Column) -> Column:
        """Whether what the templates' terms carry at most, against what the others carry at least, allows the threshold."""
        most = lambda t: F.coalesce(*[F.when(t.isin(*ts), F.lit(step)) for step, ts in sorted(steps.items())])
        known = F.filter(terms, lambda t: t.isin(*vocabulary))
        times = lambda t: F.size(known) - F.size(F.array_remove(known, t))
        carried = F.aggregate(F.array_distinct(known), F.lit(0.0), lambda total, t: total + F.pow(times(t) * most(t), F.lit(2.0)))
        return (1 - threshold * threshold) * carried >= threshold * threshold * least * least * (F.size(terms) - F.size(known)) * (1 - 1e-9)

    # The templates' entries are constants of the plan, a text a template; they are as many as the templates have terms.
    entries = [F.struct(F.lit(k[0]).alias("license"), F.lit(k[1]).alias("variant"), F.lit("\n".join(f"{t} {w / lengths[k]!r}" for t, w in v.items())).alias("entries")) for k, v in vectors.items()]
    template = spark.range(1).select(F.inline(F.array(*entries))).select("license", "variant", F.explode(F.split("entries", "\n")).alias("e"))
    template = F.broadcast(template.select("license", "variant", F.split_part("e", F.lit(" "), F.lit(1)).alias("term"), F.split_part("e", F.lit(" "), F.lit(2)).cast("double").alias("share")))

    full = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    said = lambda terms: F.sha2(F.concat_ws(" ", terms), 256)
    held = lambda terms: F.arrays_overlap(terms, keys)
    some = rows.where(held(_terms(F.col("text")))).withColumn("lines", F.transform(full, _terms))
    places = some.select("id", "path", named.alias("named"), "lines", F.posexplode("lines").alias("i", "own")).withColumn("next", F.get("lines", F.col("i") + 1))
    both = F.concat("own", "next")
    nothing = F.lit(None).cast("string")
    single = F.struct(F.col("own").alias("terms"), nothing.alias("a"), nothing.alias("b"))
    double = F.struct(both.alias("terms"), said("own").alias("a"), said("next").alias("b"))
    near_key = places.where(held("own") | F.coalesce(held("next"), F.lit(False)))
    units = near_key.select("id", "path", "named", F.inline(F.array(single, double))).where(F.col("terms").isNotNull()).where(held("terms") & may_reach(F.col("terms")))
    whole = rows.where(named).select("id", "path", F.lit(True).alias("named"), _terms(F.col("text")).alias("terms"), nothing.alias("a"), nothing.alias("b")).where(held("terms"))
    units = materialize(units.unionByName(whole).withColumn("said", said("terms")), "units")

    def scores(some: DataFrame) -> DataFrame:
        """of, license and score of the units that reach the threshold. Units of the same terms are scored once."""
        bags = some.groupBy("said").agg(F.first("terms").alias("terms"))
        counted = bags.select("said", F.explode("terms").alias("term")).groupBy("said", "term").agg(F.count(F.lit(1)).alias("n"))
        weighed = counted.join(frequency, "term").withColumn("w", F.col("n") * (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0))
        square = F.col("w") * F.col("w")
        known = F.sum(F.when(F.col("term").isin(*vocabulary), square).otherwise(0.0))
        norms = weighed.groupBy("said").agg(F.sum(square).alias("all"), known.alias("known"), F.collect_list(F.struct("term", "w")).alias("bag"))
        # What the templates' terms carry bounds the cosine.
        near = norms.where(F.col("known") >= threshold * threshold * F.col("all") * (1 - 1e-9))
        dots = near.select("said", F.sqrt("all").alias("length"), F.explode("bag").alias("b")).select("said", "length", F.col("b.term").alias("term"), F.col("b.w").alias("w"))
        scored = dots.join(template, "term").groupBy("said", "license", "variant").agg((F.sum(F.col("w") * F.col("share")) / F.max("length")).alias("score"))
        best = scored.groupBy("said").agg(F.min(F.struct((-F.round("score", 12)).alias("minus"), "license", "score")).alias("b")).where(F.col("b.score") >= threshold - 1e-9)
        return materialize(best.select(F.substring("said", 1, 64).alias("of"), F.col("b.license").alias("license"), F.col("b.score").alias("score")), "scores")

    alone = units.where("a IS NULL")
    by_line = scores(alone)
    reached = by_line.select("of")
    pairs = units.where("a IS NOT NULL").join(reached, F.col("a") == F.col("of"), "left_anti").join(reached, F.col("b") == F.col("of"), "left_anti")
    told = lambda part, best: part.join(best, F.col("said") == F.col("of")).select("id", "path", "named", "license", "score")
    nearest_of = told(alone, by_line).unionByName(told(pairs, scores(pairs)))
    tags = rows.where(F.col("text").contains("SPDX-License-Identifier:")).select(
        "id", "path", named.alias("named"), F.explode(_tagged(F.col("text"))).alias("license"), F.lit(1.0).alias("score")
    )
    nearest_of = nearest_of.unionByName(tags)
    own = nearest_of.groupBy("id", "license").agg(
        F.max("score").alias("score"), F.bool_or("named").alias("named"), F.max("path").alias("path")
    )
    own = materialize(own, "own-licenses")

    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    owners = own.where("named").groupBy(folder.alias("directory"), "license").agg(F.max("score").alias("score"))
    owners = owners.groupBy("directory").agg(F.sort_array(F.collect_list(F.struct("license", "score"))).alias("licenses"))
    trimmed = owners.select(F.regexp_replace("directory", r"^/+|/+$", "").alias("of"), "directory", "licenses")
    held = own.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("license", "score"))).alias("own"), F.bool_or("named").alias("in_file")).withColumnRenamed("id", "own_id")
    all_files = rows.groupBy("id").agg(F.max("path").alias("path")).join(held, F.col("id").eqNullSafe(F.col("own_id")), "left").drop("own_id")

    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    up = all_files.where(F.col("own").isNull()).select("id", F.explode(above).alias("a")).select("id", F.col("a.depth").alias("depth"), F.col("a.above").alias("above"))
    nearest = up.join(trimmed, up["above"] == trimmed["of"]).groupBy("id").agg(F.max(F.struct("depth", "directory", "licenses")).alias("best"))
    joined = all_files.join(nearest.withColumnRenamed("id", "heir"), F.col("id").eqNullSafe(F.col("heir")), "left")
    origin = F.when(F.col("in_file"), "file").when(F.col("own").isNotNull(), "notice").when(F.col("best").isNotNull(), "inherited").otherwise("none")
    return joined.select(F.col("id").alias(id_col), origin.alias("origin"), F.col("best.directory").alias("directory"), F.coalesce("own", "best.licenses", F.array().cast("array<struct<license:string,score:double>>")).alias("licenses"))
