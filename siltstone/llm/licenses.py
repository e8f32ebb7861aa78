"""Licence scan: sparse TF-IDF cosine to licence templates, then inheritance from the nearest directory above.

Units of a text are held against all templates: the sentences that speak of a licence, windows of a few lines that begin
where one does (headers of several lines), and the whole text. The best one above a threshold is the file's own licence.
A licence file is one that is named so or whose whole text is close to a template; its licence holds for its directory.
A file without a licence of its own has that of the nearest directory above it (its own first). All of it is DataFrame
operations; the templates' terms are weighted once, in a small table of fixed size.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import written

#: Identifiers of the public licence list, each known by "SPDX-License-Identifier: <id>".
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: Licence names and the notices, titles and opening words by which they are known.
NOTICES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "Licensed under the GPL version 3"),
    ("GPL-3.0", _GNU.format("General Public License", 3)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This program is free software under the GNU General Public License, version 2"),
    ("GPL-2.0", "Licensed under the GPL version 2"),
    ("GPL-2.0", _GNU.format("General Public License", 2)),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", 3)),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", _GNU.format("Lesser General Public License", "2.1")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", _GNU.format("Affero General Public License", 3)),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution International"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0, Creative Commons Attribution ShareAlike"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("Proprietary", "Copyright, all rights reserved"),
)
TEMPLATES = (*NOTICES, *((name, f"SPDX-License-Identifier: {name}") for name in SPDX))
#: A notice that other licences go with: it counts only where there is no other.
LAST_RESORT = "Proprietary"
#: What a unit that speaks of a licence holds, in lower case.
HINTS = ("licen", "copyright", "spdx", "creative commons", "public domain", "permission", "redistribution", "all rights reserved")
#: Names of licence files, in lower case, without an ending.
FILE_NAMES = ("license", "licence", "copying", "copyright", "notice", "unlicense")
#: Least cosine of a header, and of a whole text that is a licence file by content.
LINE_COSINE, FILE_COSINE = 0.6, 0.7
#: Lines of the windows that begin at a line that speaks of a licence; marks between sentences.
WINDOWS, SENTENCE_END = (2, 4, 12), "[.;!?]\\s+"


def hinted(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for h in HINTS:
        out = out | low.contains(h)
    return out


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def template_weights(templates=TEMPLATES) -> tuple[list[tuple[str, float, list[tuple[str, float]]]], float]:
    """(term, idf, [(template's number and licence as "number license", weight of unit length)]) for all terms; the idf of any other term."""
    counts = [Counter(t for t in re.split("[^a-z0-9]+", text.lower()) if t) for _, text in templates]
    many, df = len(templates), Counter(t for c in counts for t in c)
    idf = {t: math.log((1.0 + many) / (1.0 + n)) + 1.0 for t, n in df.items()}
    of_term: dict[str, list[tuple[int, str, float]]] = {}
    for k, ((name, _), c) in enumerate(zip(templates, counts, strict=True)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        for t, n in c.items():
            of_term.setdefault(t, []).append((k, name, n * idf[t] / norm))
    return [(t, idf[t], rows) for t, rows in sorted(of_term.items())], math.log(1.0 + many) + 1.0


def units(text: Column) -> Column:
    """Sentences that speak of a licence, and windows of lines that begin where one does."""
    lines = F.split(text, "\n", -1)
    sentences = F.filter(F.flatten(F.transform(lines, lambda x: F.when(hinted(x), F.split(x, SENTENCE_END)).otherwise(F.expr("cast(array() as array<string>)")))), hinted)
    speaking = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: hinted(F.get(lines, i)))
    windows = F.flatten(F.transform(speaking, lambda i: F.transform(F.array(*map(F.lit, WINDOWS)), lambda n: F.array_join(F.slice(lines, i + 1, n), "\n"))))
    return F.array_distinct(F.concat(sentences, windows))


def cosines(rows: DataFrame, keys: list[str], templates=TEMPLATES) -> DataFrame:
    """keys, license, cosine: the best template of each unit of text (ties to the first license by name)."""
    weights, other = template_weights(templates)
    table = rows.sparkSession.createDataFrame(weights, "term string, idf double, weights array<struct<template:int,license:string,weight:double>>")
    counted = rows.select(*keys, F.explode(terms(F.col("text"))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    # As many rows as the templates have terms. Template -1 sums the squares of the unit's own weights.
    w = F.col("tf") * F.coalesce("idf", F.lit(other))
    own = F.array(F.struct(F.lit(-1).alias("template"), F.lit("").alias("license"), w.alias("weight")))
    parts = counted.join(F.broadcast(table), "term", "left").select(*keys, w.alias("w"), F.explode(F.concat(F.coalesce("weights", F.expr("cast(array() as array<struct<template:int,license:string,weight:double>>)")), own)).alias("x"))
    sums = parts.groupBy(*keys, "x.template", "x.license").agg(F.sum(F.col("w") * F.col("x.weight")).alias("dot"))
    mine = F.col("template") >= 0
    best = sums.groupBy(*keys).agg(F.max(F.when(~mine, F.col("dot"))).alias("norm"), F.min(F.when(mine, F.struct((-F.round("dot", 9)).alias("dot"), "license"))).alias("best"))
    return best.where("best is not null").select(*keys, F.col("best.license").alias("license"), F.round(-F.col("best.dot") / F.sqrt("norm"), 6).alias("cosine"))


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan(files: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: Column, line_cosine: float = LINE_COSINE, file_cosine: float = FILE_COSINE, templates=TEMPLATES) -> DataFrame:
    """One row for each row of ``files``: doc_id, path, license, cosine, origin (own, inherited or null), directory.

    ``directory`` is the one that an inherited licence comes from. A null or empty text has no licence of its own but
    may inherit one; a null path is in no directory, not even the root. Equal rows get equal results. "All rights
    reserved" counts where nothing else is found. If a directory has several licence files, the one of the largest
    cosine counts, then the first by path. No other column plays a part, and an empty table gives no row.
    """
    keys = ["row", "row2"]
    source = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), path.alias("path")]
    rows = files.select(*source).withColumns({"row": F.xxhash64("doc_id", "text", "path"), "row2": F.xxhash64(F.lit(1), "doc_id", "text", "path")})
    speaking = rows.where(hinted(F.col("text")))
    parts = speaking.select(*keys, "path", F.posexplode(F.concat(F.array("text"), units(F.col("text")))).alias("unit", "text"))
    # Equal rows have equal units, which count once.
    scored = cosines(parts.select(*keys, "unit", "text").distinct(), [*keys, "unit"], templates)
    head, whole = (F.col("unit") > 0) & (F.col("cosine") >= line_cosine), F.col("unit") == 0
    order = F.struct((F.col("license") == LAST_RESORT).alias("last"), (-F.col("cosine")).alias("c"), "license")
    of_row = scored.groupBy(*keys).agg(F.min(F.when(head, order)).alias("own"), F.min(F.when(whole, order)).alias("whole"))
    found = written(of_row.where("own is not null or whole is not null"), "licences")

    name = F.regexp_replace(F.lower(F.regexp_extract("path", "[^/]*$", 0)), "\\.[a-z]*$", "")
    placed = speaking.select(*keys, "path", name.isin(*FILE_NAMES).alias("named")).where("path is not null").join(found, keys)
    as_file = F.when(-F.col("whole.c") >= F.when(F.col("named"), F.lit(line_cosine)).otherwise(F.lit(file_cosine)), F.col("whole"))
    declared = placed.withColumn("file", F.least(as_file, F.when(F.col("named"), F.col("own")))).where("file is not null")
    # As many rows as there are directories with a licence file.
    declared = written(declared.groupBy(directory(F.col("path")).alias("above")).agg(F.min(F.struct("file.last", "file.c", "path", "file.license")).alias("best")).select("above", F.col("best.license").alias("inherited"), (-F.col("best.c")).alias("inherited_cosine")), "directories")

    # Nearest directory above, worked out for each different directory and not for each file.
    places = rows.where("path is not null").select(directory(F.col("path")).alias("dir")).distinct()
    depth = F.size(F.split("dir", "/"))
    up = F.transform(F.sequence(F.lit(0), depth), lambda k: F.array_join(F.slice(F.split(F.col("dir"), "/"), 1, k), "/"))
    ancestors = places.select("dir", F.explode(F.array_distinct(up)).alias("above"))
    nearest = written(ancestors.join(declared, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "inherited", "inherited_cosine")).alias("best")).select("dir", "best.above", "best.inherited", "best.inherited_cosine"), "nearest")
    own = found.where("own is not null").select(*keys, F.col("own.license").alias("own"), (-F.col("own.c")).alias("own_cosine"))
    out = rows.select("doc_id", "path", *keys, F.when(F.col("path").isNotNull(), directory(F.col("path"))).alias("dir")).join(own, keys, "left").join(nearest, "dir", "left")
    return out.select(
        "doc_id", "path", F.coalesce("own", "inherited").alias("license"), F.when(F.col("own").isNotNull(), F.col("own_cosine")).otherwise(F.col("inherited_cosine")).alias("cosine"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").alias("origin"), F.when(F.col("own").isNull(), F.col("above")).alias("directory"),
    )
