"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every line of a text that holds a cue word is compared, alone and as the run of neighbouring cue
lines it stands in. Notices that are wrapped or share their line are found by windows: every run of
words around a cue, across line breaks, that is as long as a template is compared with it, and the
whole text with all templates. A file is a licence file by its name, or if its licence lines or the
window of its licence make up at least half of its words. A file without a licence of
its own inherits from the nearest directory above it that holds a licence file.

Defined results: null and empty texts have no licence of their own; null paths inherit nothing; of
equal cosines the template first in order wins; several licence files in a directory: the one with
the greatest cosine, then the first path; repeated rows are scanned each; an empty table gives no
rows; columns other than those named are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import materialise

LEAST_COSINE = 0.5
CUES = r"(?i)\b(?:licen[cs]\w*|copyright\w*|copyleft|warrant\w*|permission\w*|spdx\S*|public domain|redistribut\w*|cc[ -]by\S*|cc0)\b"
FILE_NAMES = r"(?i)^(?:licen[cs]e|copying|notice|unlicense|copyright)(?:[.-].*)?$"

#: What the licences' notices say.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT license"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0 public domain dedication"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
]
WORD = r"[a-z]+(?:-[a-z]+)*|[0-9]+(?:\.[0-9]+)*"


def tokens(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def template_vectors() -> tuple[list[tuple[int, str, float]], dict[str, float], float]:
    """(template, word, weight of length 1), idf of each word, idf of a word in no template."""
    bags = [Counter(tokens(t)) for _, t in TEMPLATES]
    n = len(bags)
    seen = Counter(w for b in bags for w in b)
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in seen.items()}
    rows = []
    for k, bag in enumerate(bags):
        length = math.sqrt(sum((c * idf[w]) ** 2 for w, c in bag.items()))
        rows += [(k, w, c * idf[w] / length) for w, c in sorted(bag.items())]
    return rows, idf, math.log(1 + n) + 1


def scan(files: DataFrame, least_cosine: float = LEAST_COSINE, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """doc_id, path, license, cosine, is_license_file, inherited_from of every file.

    license is the file's own or the inherited one; inherited_from is the directory it comes from,
    null for the file's own.
    """
    spark = files.sparkSession
    d = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    units = cue_units(d)
    windows = best_windows(d, least_cosine)
    keep = ["doc_id", "path", "key"]
    best = materialise(best_templates(units.where(F.size("units") > 0), windows, spark, least_cosine), "licences")
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILE_NAMES)
    rows = units.select(*keep, F.coalesce(named, F.lit(False)).alias("named"), "cue_words", "n_words")
    own = rows.join(best.withColumnsRenamed({c: f"b_{c}" for c in keep}), F.col("doc_id").eqNullSafe(F.col("b_doc_id")) & F.col("path").eqNullSafe(F.col("b_path")) & (F.col("key") == F.col("b_key")), "left")
    matched = F.greatest(F.when(F.col("lined"), F.col("cue_words")), "n_matched")
    file_like = F.col("named") | F.coalesce(2 * matched >= F.greatest("n_words", F.lit(1)), F.lit(False))
    own = materialise(own.select("doc_id", "path", "license", "cosine", (file_like & F.col("license").isNotNull()).alias("is_license_file")), "own")
    return inherit(own)


def cue_units(d: DataFrame) -> DataFrame:
    """doc_id, path, key, units array<string> (cue lines and runs of them), cue_words, n_words of every file."""
    lines = F.when(F.col("text").rlike(CUES), F.split("text", r"\r\n|\n|\r", -1))
    marked = F.transform(lines, lambda x: F.when(x.rlike(CUES), x).otherwise(""))
    # Runs of neighbouring cue lines are what stands between the others.
    runs = F.split(F.array_join(marked, "\n"), r"\n{2,}|^\n+|\n+$", -1)
    d = d.withColumn("cues", F.filter(marked, lambda x: x != "")).withColumn("runs", F.transform(F.filter(runs, lambda x: x.contains("\n")), lambda x: F.replace(x, F.lit("\n"), F.lit(" "))))
    n_words = lambda c: F.size(F.array_remove(F.split(c, r"\s+", -1), ""))
    units = F.coalesce(F.concat("cues", "runs"), F.array().cast("array<string>"))
    return d.select("doc_id", "path", F.xxhash64("text").alias("key"), units.alias("units"), F.coalesce(n_words(F.array_join("cues", " ")), F.lit(0)).alias("cue_words"), n_words(F.col("text")).alias("n_words"))


class Windows:
    """Compares runs of a text's words with templates of their length."""

    def __init__(self, least_cosine: float):
        rows, self.idf, self.rare = template_vectors()
        self.least_cosine = least_cosine
        self.weights: list[dict[str, float]] = [{} for _ in TEMPLATES]
        for k, w, weight in rows:
            self.weights[k][w] = weight * self.idf[w]
        self.by_length: dict[int, list[int]] = {}
        for k, (_, text) in enumerate(TEMPLATES):
            self.by_length.setdefault(len(tokens(text)), []).append(k)

    def runs(self, words: list[str], first: int, last: int, size: int, templates: Iterable[int]) -> Iterator[tuple[float, int, int]]:
        """(cosine, -template, size) of the windows that begin at ``first`` to ``last``."""
        bag = Counter(words[first : first + size])
        squares = {w: self.idf.get(w, self.rare) ** 2 for w in bag}
        norm = sum(c * c * squares[w] for w, c in bag.items())
        dots = {k: sum(c * self.weights[k].get(w, 0.0) for w, c in bag.items()) for k in templates}
        for at in range(first, last + 1):
            if at > first:
                for w, step in ((words[at - 1], -1), (words[at + size - 1], 1)):
                    if w not in squares:
                        squares[w] = self.idf.get(w, self.rare) ** 2
                    norm += (2 * step * bag[w] + 1) * squares[w]
                    bag[w] += step
                    for k in dots:
                        dots[k] += step * self.weights[k].get(w, 0.0)
            for k, dot in dots.items():
                yield round(dot / math.sqrt(norm), 9), -k, size

    def best(self, text: str) -> tuple[float, int, int] | None:
        """(cosine, -template, words matched) of the nearest window or the whole text, if near enough."""
        text = text.lower()
        found = [(m.start(), m[0]) for m in re.finditer(WORD, text)]
        words, starts = [w for _, w in found], [a for a, _ in found]
        cues = sorted({max(0, bisect_right(starts, m.start()) - 1) for m in re.finditer(CUES, text)})
        if not words or not cues:
            return None
        near = [x for x in self.runs(words, 0, 0, len(words), range(len(TEMPLATES))) if x[0] >= self.least_cosine]
        for size, templates in self.by_length.items():
            done = -1
            for cue in cues:
                # Neighbouring cues share one run of windows.
                first, last = max(cue - size + 1, done + 1, 0), min(cue, len(words) - size)
                if first <= last:
                    near += [x for x in self.runs(words, first, last, size, templates) if x[0] >= self.least_cosine]
                    done = last
        return max(near, default=None)


def best_windows(d: DataFrame, least_cosine: float) -> DataFrame:
    """doc_id, path, key, template, cosine, n_matched: the nearest window of every file that has one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(least_cosine)
        for batch in batches:
            best = [windows.best(t.as_py()) for t in batch.column(3)]
            at = [i for i, b in enumerate(best) if b]
            own = [best[i] for i in at]
            columns = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(3)]
            columns += [pa.array([-b[1] for b in own], pa.int32()), pa.array([b[0] for b in own], pa.float64()), pa.array([b[2] for b in own], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "path", "key", "template", "cosine", "n_matched"])

    cued = d.where(F.col("text").rlike(CUES)).select("doc_id", "path", F.xxhash64("text").alias("key"), "text")
    return cued.mapInArrow(run, "doc_id long, path string, key long, template int, cosine double, n_matched int")


def best_templates(units: DataFrame, windows: DataFrame, spark, least_cosine: float) -> DataFrame:
    """doc_id, path, key, license, cosine, n_matched (words of the window, 0 for a line), lined (a line is near enough): the nearest template of any unit or window, if near enough."""
    rows, idf, rare = template_vectors()
    # As large as the templates are, whatever the input: they may be broadcast.
    weights = F.broadcast(spark.createDataFrame(rows, "template int, t_word string, weight double"))
    idfs = F.broadcast(spark.createDataFrame(list(idf.items()), "i_word string, idf double"))
    keys = ["doc_id", "path", "key", "unit"]
    words = units.select("doc_id", "path", "key", F.explode(F.array_distinct("units")).alias("line")).withColumn("unit", F.xxhash64("line")).distinct()
    words = words.select(*keys, F.explode(F.regexp_extract_all(F.lower("line"), F.lit(WORD), F.lit(0))).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))
    words = words.join(idfs, F.col("word") == F.col("i_word"), "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(rare)))
    lengths = words.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = words.join(weights, F.col("word") == F.col("t_word")).groupBy(*keys, "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    names = F.array(*[F.lit(n) for n, _ in TEMPLATES])
    near = dots.alias("d").join(lengths.alias("l"), [F.col(f"d.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]).select("d.doc_id", "d.path", "d.key", "template", F.round(F.col("dot") / F.col("length"), 9).alias("cosine")).where(F.col("cosine") >= least_cosine)
    near = near.withColumn("n_matched", F.lit(0)).unionByName(windows)
    top = near.groupBy("doc_id", "path", "key").agg(F.max(F.struct("cosine", (-F.col("template")).alias("first"), "n_matched")).alias("top"), F.max(F.col("n_matched") == 0).alias("lined"))
    return top.select("doc_id", "path", "key", F.element_at(names, 1 - F.col("top.first")).alias("license"), F.col("top.cosine").alias("cosine"), F.col("top.n_matched").alias("n_matched"), "lined")


def inherit(own: DataFrame) -> DataFrame:
    """Gives files without a licence that of the nearest directory above them with a licence file."""
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    holders = own.where("is_license_file and path is not null").groupBy(directory.alias("h_dir")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "license")).alias("h"))
    holders = materialise(holders.select("h_dir", F.col("h.license").alias("h_license")), "holders")
    parts = F.split(directory, "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    wanting = materialise(own.where("license is null and path is not null").select("path", F.explode(F.array_union(above, F.array(F.lit("")))).alias("dir")).distinct(), "wanting")
    # The longest directory is the nearest.
    found = wanting.join(holders, F.col("dir") == F.col("h_dir")).groupBy(F.col("path").alias("i_path")).agg(F.max(F.struct(F.length("dir").alias("depth"), "dir", "h_license")).alias("i"))
    found = materialise(found.select("i_path", F.col("i.dir").alias("i_dir"), F.col("i.h_license").alias("i_license")), "inherited")
    out = own.join(found, F.col("license").isNull() & (F.col("path") == F.col("i_path")), "left")
    return out.select("doc_id", "path", F.coalesce("license", "i_license").alias("license"), "cosine", "is_license_file", F.when(F.col("license").isNull(), F.col("i_dir")).alias("inherited_from"))
