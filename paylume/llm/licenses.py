"""Licence notices found by the Dice coefficient of word bigrams.

Units of a text are its lines and its paragraphs of several lines; templates are licence notices. Both are lower-cased
(A-Z), cut into words of letters, digits and non-ASCII characters, and compared by their sets of word bigrams. The
coefficient ``2 |A & B| / (|A| + |B|)`` can reach the limit only if the sizes are within ``limit / (2 - limit)`` of each
other, and only if enough of the unit's bigrams stand in some template; what fails this is never compared.

Null and empty texts, and units of one word, have no bigrams and match nothing. Ties go to the template whose name comes
first. Repeated lines count each time. Very long texts are handled whole. Columns other than the id and the text are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import ALNUM, LOWER, Texts, mix, sub_batches

U64 = np.uint64
#: Notices by licence (fixed values, from the licences' public texts).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSD disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Unlicense grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}
SCHEMA = "doc_id long, found array<struct<template:string,dice:double,unit:string,first_byte:long,end_byte:long>>"
_FOUND = pa.list_(pa.struct([("template", pa.string()), ("dice", pa.float64()), ("unit", pa.string()), ("first_byte", pa.int64()), ("end_byte", pa.int64())]))


def bigrams(raw: bytes) -> set[tuple[bytes, bytes]]:
    data = np.frombuffer(raw, np.uint8)
    words = bytes(np.where(ALNUM[data], LOWER[data], 32).astype(np.uint8)).split()
    return set(zip(words, words[1:], strict=False))


class Templates:
    """Templates by bigram and by size."""

    def __init__(self, texts: dict[str, str], limit: float):
        self.limit = limit
        # by size, so that those which a unit's size admits stand side by side
        self.sets = sorted(((name, b) for name, t in texts.items() if (b := bigrams(t.encode()))), key=lambda x: (len(x[1]), x[0]))
        self.sizes = sizes = [len(b) for _, b in self.sets]
        self.low, self.high = (math.ceil(min(sizes) * limit / (2 - limit) - 1e-9), math.floor(max(sizes) * (2 - limit) / limit + 1e-9)) if sizes else (1, 0)
        self.least_overlap = math.ceil(limit * (min(sizes) + 1) / 2 - 1e-9) if sizes else 1
        column = pa.array([b" ".join(x) for _, b in self.sets for x in b], pa.binary())
        t = Texts(column)
        starts, ends, _ = t.words(ALNUM)
        self.words = np.unique(t.hashes(starts, ends))

    def best(self, unit: bytes) -> tuple[str, float] | None:
        """The most alike template, the first by name of several, if it reaches the limit. Only templates of a size that can
        reach it are compared."""
        own, ratio = bigrams(unit), self.limit / (2 - self.limit)
        a = len(own)
        low, high = bisect_left(self.sizes, ratio * a - 1e-9), bisect_right(self.sizes, a / ratio + 1e-9)
        scores = [(-2 * len(own & other) / (a + len(other)), name) for name, other in self.sets[low:high]]
        dice, name = min(scores, default=(0.0, ""))
        return (name, -dice) if name and -dice >= self.limit else None


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, limit: float = 0.8) -> DataFrame:
    """``doc_id, found``: the units of each document that reach the limit, with their best template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, limit)
        paragraph = re.compile(rb"\r*[^\r\n][^\n]*(?:\n\r*[^\r\n][^\n]*)+")
        for batch in sub_batches(batches, "text"):
            texts = Texts(batch.column(1))
            starts, ends, of = texts.words(ALNUM)
            hashes = texts.hashes(starts, ends, lower=True)
            at = np.minimum(np.searchsorted(known.words, hashes), max(len(known.words) - 1, 0))
            hit = known.words[at] == hashes if len(known.words) else np.zeros(len(hashes), bool)
            total = np.r_[0, np.cumsum(hit)]
            found: list[list] = [[] for _ in range(len(texts))]
            breaks = np.flatnonzero(texts.data == 10)
            # lines: from each start of a text or byte after a newline to the next of these
            first = np.unique(np.r_[texts.at[:-1], breaks + 1])
            first = first[first < texts.at[-1]]
            last = np.r_[first[1:], texts.at[-1]][: len(first)]
            a, b = np.searchsorted(starts, first), np.searchsorted(starts, last)
            # words of templates that a unit needs: one more than the least overlap
            good = np.flatnonzero((total[b] - total[a] > known.least_overlap) & (b - a > known.low))
            raw = texts.data.tobytes()
            owner = np.searchsorted(texts.at, first, "right") - 1
            for i in good.tolist():
                unit = raw[first[i] : last[i]].rstrip(b"\r\n")
                if (x := known.best(unit)) is not None:
                    low = int(texts.at[owner[i]])
                    found[owner[i]].append({"template": x[0], "dice": x[1], "unit": unit.decode(), "first_byte": int(first[i]) - low, "end_byte": int(first[i]) - low + len(unit)})
            many = np.searchsorted(breaks, texts.at[1:]) - np.searchsorted(breaks, texts.at[:-1])
            per_text = total[of[1:]] - total[of[:-1]]
            for d in np.flatnonzero((many > 0) & (per_text > known.least_overlap)).tolist():
                low = int(texts.at[d])
                for m in paragraph.finditer(raw[low : texts.at[d + 1]]):
                    # repeated words make no bigrams, so the number of words bounds the set from above only
                    i, j = np.searchsorted(starts, (low + m.start(), low + m.end()))
                    if j - i > known.low and total[j] - total[i] > known.least_overlap and (x := known.best(m[0])) is not None:
                        found[d].append({"template": x[0], "dice": x[1], "unit": m[0].decode(), "first_byte": m.start(), "end_byte": m.end()})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _FOUND)], names=["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    best = F.array_sort("found", lambda a, b: F.when(a["dice"] != b["dice"], F.signum(b["dice"] - a["dice"]).cast("int")).when(a["template"] < b["template"], -1).when(a["template"] > b["template"], 1).otherwise(0))
    return found.withColumn("best", F.get(best, F.lit(0))).select("doc_id", F.size("found").cast("long").alias("n_notices"), F.col("best.template").alias("license"), F.round("best.dice", 6).alias("dice"))


def _sql() -> str:
    rows = ", ".join("('" + n.replace("'", "''") + "', '" + t.replace("'", "''") + "')" for n, t in sorted(TEMPLATES.items()))
    words = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH t(template, text) AS (VALUES {rows}),
tb AS (SELECT template, w[i] || ' ' || w[i + 1] AS g FROM (SELECT template, w, unnest(range(1, len(w))) AS i FROM (SELECT template, {words.format("text")} AS w FROM t)) GROUP BY ALL),
tn AS (SELECT template, count(*) AS b FROM tb GROUP BY template),
u AS (SELECT row_number() OVER () AS unit_id, doc_id, unit FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '\r*[^\r\n][^\n]*(?:\n\r*[^\r\n][^\n]*)+')) AS unit FROM documents)),
ub AS (SELECT unit_id, doc_id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT unit_id, doc_id, w, unnest(range(1, len(w))) AS i FROM (SELECT unit_id, doc_id, {words.format("unit")} AS w FROM u)) GROUP BY ALL),
un AS (SELECT unit_id, doc_id, count(*) AS a FROM ub GROUP BY ALL),
both_sets AS (SELECT unit_id, template, count(*) AS shared FROM ub JOIN tb USING (g) GROUP BY ALL),
scored AS (SELECT un.doc_id, un.unit_id, template, 2.0 * shared / (a + b) AS dice FROM both_sets JOIN un USING (unit_id) JOIN tn USING (template)),
best AS (SELECT doc_id, unit_id, template, dice, row_number() OVER (PARTITION BY unit_id ORDER BY dice DESC, template) AS k FROM scored WHERE dice >= 0.8),
per AS (SELECT doc_id, count(*) AS n, first(template ORDER BY dice DESC, template) AS template, max(dice) AS dice FROM best WHERE k = 1 GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, template AS license, round(CAST(dice AS DOUBLE), 6) AS dice FROM documents d LEFT JOIN per USING (doc_id)
"""


OP3_SQL = _sql()
