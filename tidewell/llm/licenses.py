"""License scans: MinHash bands over overlapping windows, then exact shingle containment (operator 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.native_text import words

SHINGLE = 5
# Notices by which licenses are named, and passages of their usual texts and headers.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "Apache-2.0-text": (
        'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "MIT-terms-text": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY"
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE'
    ),
    "BSD-2-Clause-text": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause-text": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "GPL-2.0-text": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1-text": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0-text": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0-text": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "EPL-2.0-text": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"
    ),
    "CC-BY-4.0-text": (
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit "
        "http://creativecommons.org/licenses/by/4.0/"
    ),
    "CC-BY-SA-4.0-text": (
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit "
        "http://creativecommons.org/licenses/by-sa/4.0/"
    ),
    "CC-BY-NC-4.0-text": (
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit "
        "http://creativecommons.org/licenses/by-nc/4.0/"
    ),
    "CC0-1.0-text": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain "
        "worldwide. This software is distributed without any warranty."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}
# Further wordings of one line, by license; the template's name is the license's with the wording's number.
NOTICES = {
    "MIT": ["licensed under the MIT License", "distributed under the MIT License", "available under the MIT License", "licensed under the terms of the MIT license"],
    "Apache-2.0": ["licensed under the Apache License 2.0", "licensed under the Apache-2.0 license", "released under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["licensed under the GNU GPL v3", "licensed under the GNU General Public License v3.0", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["licensed under the GNU GPL v2", "licensed under the GNU General Public License v2.0", "licensed under the GNU General Public License, version 2"],
    "LGPL": ["licensed under the GNU Lesser General Public License"],
    "AGPL": ["licensed under the GNU Affero General Public License"],
    "MPL-2.0": ["under the Mozilla Public License 2.0", "under the Mozilla Public License, Version 2.0"],
    "EPL": ["under the Eclipse Public License"],
    "BSD": ["licensed under the BSD License", "released under the BSD License", "licensed under the BSD 3-Clause License", "licensed under the BSD 2-Clause License"],
    "ISC": ["licensed under the ISC License", "released under the ISC License"],
    "CC-BY-4.0": ["licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["dedicated to the public domain under CC0", "released under CC0 1.0 Universal", "licensed under CC0 1.0 Universal"],
    "Unlicense": ["released under the Unlicense License", "released into the public domain under the Unlicense"],
}
TEMPLATES |= {f"{name}-notice-{k}-text": x for name, wordings in NOTICES.items() for k, x in enumerate(wordings, 1)}
#: Shingles of a window, each twice its step; the steps are multiples of the first's, ``STEP``.
WIDTHS = (1, 8, 32)
STEP = 4
BANDS = 10


def width_for(n: Column) -> Column:
    """The largest window of which a whole one lies in any ``n`` consecutive shingles, wherever the windows start."""
    out = F.lit(WIDTHS[0])
    for w in WIDTHS[1:]:
        out = F.when(n >= w + w // 2 - 1, w).otherwise(out)
    return out


def shingles(w: Column) -> Column:
    """64-bit hashes of the consecutive ``SHINGLE``-word runs; shorter texts have none."""
    last = F.size(w) - SHINGLE
    parts = [lambda i, k=k: F.get(w, i + k) for k in range(SHINGLE)]
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(p(i) for p in parts)))).otherwise(F.array().cast("array<bigint>"))


def numbers(w: Column) -> Column:
    """How many words with a digit each shingle has."""
    digit = lambda i: F.when(F.get(w, i).rlike("[0-9]"), 1).otherwise(0)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0))), lambda i: sum((digit(i + k) for k in range(1, SHINGLE)), digit(i)))


def blocks(h: Column) -> Column:
    """Each block of ``STEP`` shingles as a struct. ``h`` must be a plain column.

    Elements are fetched by index, as a slice would copy the whole array; past the end the last one counts again.
    """
    last = F.size(h) - 1
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(STEP))
    return F.transform(starts, lambda i: F.struct(*(F.get(h, F.least(i + k, last)).alias(f"x{k}") for k in range(STEP))))


def block_minima(block: Column, band: int) -> Column:
    """The least hash of each block under the band's own hash function. ``block`` must be a plain column."""
    return F.transform(block, lambda x: F.least(*(F.xxhash64(x[f"x{k}"], F.lit(band)) for k in range(STEP))))


def listed(values: set[int]) -> str:
    """The values as SQL text: thousands of literals one by one take the driver seconds."""
    return ", ".join(f"bigint('{x}')" for x in sorted(values))


def shingle_hits(wanted: set[int]) -> Column:
    """Shingles of ``h`` among the wanted as places (width, at, low); null if there are none."""
    return F.expr(f"case when exists(h, x -> x in ({listed(wanted)})) then filter(transform(h, (low, i) -> struct(1 as width, i as at, low as low)), x -> x.low in ({listed(wanted)})) end")


def window_hits(minima: str, wanted: dict[int, set[int]]) -> Column:
    """Windows (width, at, low) whose minimum is one of the templates' of that width; null if there are none. ``minima`` names a column of blocks' minima.

    A window is two half windows, the last one half alone. Its minimum is that of one of its blocks, so windows are only
    formed in texts of which a block has a wanted minimum.
    """

    def windows(width: int) -> str:
        n = width // 2 // STEP
        low = ", ".join(f"get({minima}, i + {k})" for k in range(2 * n))
        every = f"transform(sequence(0, greatest(size({minima}) - 1, 0), {n}), i -> struct({width} as width, i * {STEP} as at, least({low}) as low))"
        return f"filter({every}, x -> x.low in ({listed(wanted[width])}))"

    return F.expr(f"case when exists({minima}, x -> x in ({listed(set().union(*wanted.values()))})) then concat({', '.join(windows(w) for w in sorted(wanted))}) end")


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``license, hashes, marks, n, width``; templates without a whole shingle are left out. ``marks``: the shingles with most numbers, such as a version's, if there are any."""
    rows = spark.createDataFrame(list(templates.items()), "license string, notice string")
    rows = rows.select("license", words(F.col("notice")).alias("w"))
    rows = rows.select("license", shingles(F.col("w")).alias("h"), numbers(F.col("w")).alias("numbers"))
    most = F.array_max("numbers")
    marks = F.array_distinct(F.filter("h", lambda x, i: (most > 0) & (F.get("numbers", i) == most)))
    rows = rows.select("license", F.array_distinct("h").alias("hashes"), F.coalesce(marks, F.array().cast("array<bigint>")).alias("marks")).withColumn("n", F.size("hashes"))
    return rows.where("n > 0").withColumn("width", width_for(F.col("n")))


def band_table(templates: DataFrame) -> DataFrame:
    """``width, band, low, license``: minima of every window of every template, at all starts."""
    own = templates.withColumn("start", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n") - F.col("width") + 1, F.lit(1)))))
    own = own.withColumn("part", F.slice("hashes", F.col("start"), F.col("width"))).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))))
    low = F.when(F.col("width") > 1, F.array_min(F.transform("part", lambda x: F.xxhash64(x, F.col("band"))))).otherwise(F.get("part", F.lit(0)))
    return own.where("width > 1 or band = 0").select("width", "band", low.alias("low"), "license").distinct()


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """``doc_id, license, containment, word, best``: templates of which a document holds at least ``least`` of the shingles in one place.

    Notices of versions of one license share most words: of a template with numbers the place must also hold a shingle with as many of them as any of its shingles has.
    ``best``: no template found in an overlapping place has a higher containment, or the same and more shingles; ties go to the first name.

    Templates of fewer than 11 shingles, such as one-line notices, have a width of 1: they are found by equal shingles, without bands.
    Each template is looked for with windows of the largest width in ``WIDTHS`` of which its text always holds a whole one.
    A window within an occurrence with Jaccard similarity 0.5 or more to the template's same window shares a
    minimum in one of ``BANDS`` bands of one row with probability 1 - 0.5^10 > 0.999; an unchanged one always does.
    Windows overlap by half: each shingle is hashed once per band, for its block, and windows take the least of their blocks.
    The exact check counts the template's distinct shingles from one template length before the window to one after it; the
    best place counts (``word``: the window's first word; ties: the first). The table of templates is a parameter of
    the call and part of the plan; documents are read once, without a shuffle but for the few rows found.

    Null, empty or short texts have no shingles and no rows. Repeated rows give equal rows each. Other columns are ignored.
    """
    spark = docs.sparkSession
    known = template_table(spark, TEMPLATES if templates is None else templates)
    wanted: dict[tuple[int, int], set[int]] = {}
    bands = band_table(known).collect()
    for r in bands:
        wanted.setdefault((r["width"], r["band"]), set()).add(r["low"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    rows = rows.select("doc_id", shingles(F.col("w")).alias("h"))
    if not wanted:
        return rows.where("false").select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("word"), F.lit(True).alias("best"))
    wide = {b: {w: wanted[w, b] for w in WIDTHS[1:] if (w, b) in wanted} for b in sorted({b for w, b in wanted if w > 1})}
    # Each step is a column of its own: a lambda's inputs are worked out once per row, not once per element.
    rows = rows.select("*", blocks(F.col("h")).alias("blocks"))
    rows = rows.select("doc_id", "h", *(block_minima(F.col("blocks"), b).alias(f"m{b}") for b in wide))
    hits = [window_hits(f"m{b}", sets) for b, sets in wide.items()]
    if (1, 0) in wanted:
        hits.append(shingle_hits(wanted[1, 0]))
    rows_known = known.orderBy("license").collect()
    number = {r["license"]: k for k, r in enumerate(rows_known)}
    # Templates go by number: an element of an array is found at once, and no literal holds their text.
    names = F.expr("map(" + ", ".join(f"bigint('{low}'), array({', '.join(str(number[x]) for x in items)})" for low, items in lookup(bands).items()) + ")")
    sets, marked = (F.expr("array(" + ", ".join(f"cast(array({', '.join(f'''bigint('{x}')''' for x in r[c])}) as array<bigint>)" for r in rows_known) + ")") for c in ("hashes", "marks"))
    license = F.expr("array(" + ", ".join(quoted(r["license"]) for r in rows_known) + ")")

    def judged_hit(hit: Column, t: Column) -> Column:
        own, marks = F.get(sets, t), F.get(marked, t)
        n = F.size(own)
        first = F.greatest(hit["at"] - n, F.lit(0))
        part = F.slice("h", first + 1, hit["at"] + hit["width"] + n - first)
        exact = (F.size(marks) == 0) | F.arrays_overlap(marks, part)
        return F.struct(t.alias("t"), (F.size(F.array_intersect(own, part)) / n).alias("containment"), hit["at"].cast("long").alias("word"), n.alias("n"), hit.alias("hit"), exact.alias("exact"))

    # Places are judged in the row that holds the shingles; rows sent on hold what was found, not the document.
    # The outer explode keeps Spark from a filter on the places, which would be pushed below these steps with all of them written into it.
    judged = F.flatten(F.transform(F.array_distinct(F.flatten(F.array_compact(F.array(*hits)))), lambda x: F.transform(F.element_at(names, x["low"]), lambda t: judged_hit(x, t))))
    near = rows.select("doc_id", F.xxhash64("h").alias("k"), F.filter(judged, lambda x: x["exact"] & (x["containment"] >= least)).alias("places"))
    scored = near.select("doc_id", "k", F.explode_outer("places").alias("p")).where("p is not null").select("doc_id", "k", F.get(license, F.col("p.t")).alias("license"), "p.containment", "p.word", "p.n", "p.hit")
    # Each copy of a row gives each of its hits once.
    best = scored.groupBy("doc_id", "k", "license").agg(
        F.max(F.struct("containment", (-F.col("word")).alias("minus"))).alias("best"), (F.count("*") / F.size(F.collect_set("hit"))).cast("int").alias("copies"), F.max("n").alias("n")
    )
    # A document has one row per template at most, so what is gathered here is bounded by the table of templates.
    found = best.select("doc_id", "k", "copies", F.struct("license", "best.containment", (-F.col("best.minus")).alias("word"), "n").alias("x"))
    every = found.groupBy("doc_id", "k", "copies").agg(F.collect_list("x").alias("every")).withColumn("x", F.explode("every"))

    def better(y: Column) -> Column:
        x, same = F.col("x"), F.col("x.containment") == y["containment"]
        near = (F.col("x.word") < y["word"] + y["n"]) & (y["word"] < F.col("x.word") + F.col("x.n"))
        more = (y["containment"] > x["containment"]) | (same & ((y["n"] > x["n"]) | ((y["n"] == x["n"]) & (y["license"] < x["license"]))))
        return (y["license"] != x["license"]) & near & more

    judged = every.withColumn("best", ~F.exists("every", better)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return judged.select("doc_id", "x.license", "x.containment", "x.word", "best")


def quoted(text: str) -> str:
    """A SQL literal of the text, whatever it holds."""
    return f"decode(X'{text.encode().hex()}', 'UTF-8')"


def lookup(bands: list) -> dict[int, list[str]]:
    """Licenses by minimum."""
    out: dict[int, set[str]] = {}
    for r in bands:
        out.setdefault(r["low"], set()).add(r["license"])
    return {low: sorted(names) for low, names in out.items()}
