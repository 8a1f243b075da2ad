"""Licences of files: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Every line, every paragraph and the whole of a text is a unit. A unit's vector holds its word counts times the inverse
document frequency of the words, which is counted over all texts of the corpus for the words of the templates; other
words take the weight of a word that one text has. Units are compared with notices from a cosine of ``threshold`` on, whole
texts also with full licence texts from ``full_threshold`` on; the identifiers of an SPDX line are looked up. The licence of a
file is the full text that the whole of it matches, else the match with the largest cosine of any unit; all matches of
a file are its spans. A file that matches a full text, or whose licence unit holds at least half of its words, is a licence
file. A file without a licence of its own takes that of the licence file in the nearest directory above it: the directories
that occur are joined with their ancestors, so the work follows the directories, not the files below them.

Defined results: null and empty texts have no licence of their own; null paths have no directory, inherit nothing and
give nothing; ties go to the smaller start, then the longer unit, then the licence that sorts first; several licence
files in one directory: the highest cosine counts, then the smaller path; repeated rows are judged alike; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licence_texts import FULL_TEXTS
from .tables import chunks, fresh, text_buffer, written
from .words import lowered, slices, word_hashes, words

THRESHOLD = 0.75
FULL_THRESHOLD = 0.9  # of whole texts, where sibling licences and long prose have many words in common



def _gnu(thing: str, kind: str, version: str) -> list[str]:
    """The customary header of a GNU licence: its first paragraph, with and without later versions, and the whole."""
    first = f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    only = f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License version {version} as published by the Free Software Foundation."
    rest = f"This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details. You should have received a copy of the GNU {kind}General Public License along with this {thing}. If not, see <https://www.gnu.org/licenses/>."
    return [first, only, f"{first} {rest}"]


# The notices that the licences ask for or that are customary, in the wording of their publishers.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "MIT License",
        "The MIT License (MIT)",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3.",
        *_gnu("program", "", "3"),
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", *_gnu("program", "", "2")],
    "LGPL-2.1": _gnu("library", "Lesser ", "2.1"),
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", *_gnu("library", "Lesser ", "3")],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", *_gnu("program", "Affero ", "3")],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "All-rights-reserved": ["All rights reserved.", "Copyright. All rights reserved."],
}

# Two texts follow from others: the Affero licence by its name in the text of the GPL (section 13 differs, which
# leaves it nearest by far), and the BSD licence of two clauses without the third.
FULL = {
    **FULL_TEXTS,
    "AGPL-3.0": re.sub(r"(?i)(GNU )(General Public License)", r"\1Affero \2", FULL_TEXTS["GPL-3.0"]),
    "BSD-2-Clause": re.sub(r"\n3\. Neither.*?permission\.", "", FULL_TEXTS["BSD-3-Clause"], flags=re.DOTALL),
}

SPDX = {name.lower() + end: name for name in {*TEMPLATES, *FULL} - {"All-rights-reserved"} for end in ("", "+", "-only", "-or-later")}
_SPDX_LINE = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)")
_SPDX_NAME = re.compile(rb"[a-z0-9][a-z0-9.+-]*")


def _tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text, hash) of the words: digits, letters and bytes beyond ASCII, A-Z in lower case."""
    data = lowered(data)
    inside = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128)
    start, end, text = words(offsets, data, ~inside)
    return start, end, text, word_hashes(slices(data, start, end))


def _distinct(unit: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, word, count) without repetition; sorted by unit."""
    order = np.lexsort((code, unit))
    unit, code = unit[order], code[order]
    new = np.ones(len(unit), bool)
    new[1:] = (unit[1:] != unit[:-1]) | (code[1:] != code[:-1])
    at = np.flatnonzero(new)
    return unit[at], code[at], np.diff(np.append(at, len(unit)))


class Model:
    """Templates as vectors over their words, with the weights of the corpus."""

    def __init__(self, templates: dict[str, list[str]], texts: int = 0, found: dict[int, int] | None = None):
        self.names = [name for name in sorted(templates) for _ in templates[name]]
        offsets, data = text_buffer(pa.array([t for name in sorted(templates) for t in templates[name]]))
        _, _, of, hashes = _tokens(offsets, data)
        self.words = np.unique(hashes)
        counts = np.array([(found or {}).get(int(np.int64(w.view(np.int64))), 0) for w in self.words], float)
        self.weight = np.log((1 + texts) / (1 + counts)) + 1
        self.other = np.log((1 + texts) / 2) + 1
        self.vectors = np.zeros((len(self.words), len(self.names)))
        np.add.at(self.vectors, (np.searchsorted(self.words, hashes), of), 1)
        self.vectors *= self.weight[:, None]
        self.vectors = np.asfortranarray(self.vectors / np.linalg.norm(self.vectors, axis=0))

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word among the words of the templates, -1 for others."""
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == hashes, at, -1)

    def cosines(self, unit: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(largest cosine, its template) of ``n`` units, given the unit of each word."""
        of, code, count = _distinct(unit, hashes)
        word = self.known(code)
        weight = count * np.where(word >= 0, self.weight[word], self.other)
        norm = np.sqrt(np.bincount(of, weight**2, n))
        mine = word >= 0
        of, word, weight = of[mine], word[mine], weight[mine]
        best, which = np.zeros(n), np.zeros(n, np.int64)
        for k in range(len(self.names)):
            cosine = np.bincount(of, weight * self.vectors[:, k][word], n) / np.maximum(norm, 1e-12)
            better = cosine > best
            best[better], which[better] = cosine[better], k
        best[np.bincount(of, minlength=n) < 2] = 0  # one word, as the German "mit", is no notice
        return best, which


def _number(marks: np.ndarray, start: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A number for the stretch between two marks in which each word lies; texts end a stretch."""
    stretch = np.searchsorted(marks, start)
    new = np.zeros(len(start), np.int64)
    new[1:] = (stretch[1:] != stretch[:-1]) | (text[1:] != text[:-1])
    return np.cumsum(new)


Found = tuple[str, float, int, int, bool, list[dict[str, object]]]


def _identifiers(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, str, int, int]]:
    """(text, licence, start, end in bytes) of the known identifiers of the SPDX lines."""
    raw = lowered(data).tobytes()
    for line in _SPDX_LINE.finditer(raw):
        i = int(np.searchsorted(offsets, line.start(), "right")) - 1
        if line.start(1) <= offsets[i + 1]:  # else the prefix runs on into the next text
            for name in _SPDX_NAME.finditer(raw, line.start(1), min(line.end(1), int(offsets[i + 1]))):
                if (licence := SPDX.get(name.group().decode())) is not None:
                    yield i, licence, int(line.start() - offsets[i]), int(name.end() - offsets[i])


def scan(model: Model, full: Model, offsets: np.ndarray, data: np.ndarray, threshold: float, full_threshold: float) -> list[Found | None]:
    """Per text: (licence, cosine, start, end in bytes, is a licence file, all spans), or None."""
    out: list[Found | None] = [None] * (len(offsets) - 1)
    start, end, text, hashes = _tokens(offsets, data)
    if not len(start):
        return out
    lines = np.flatnonzero(data == 10)
    blank = lines[1:][np.add.reduceat(data > 32, lines)[:-1] == 0] if len(lines) > 1 else lines[:0]
    many = np.bincount(text, minlength=len(out))
    rows = []
    for marks, tool, least in ((lines, model, threshold), (blank, model, threshold), (lines[:0], model, threshold), (lines[:0], full, full_threshold)):
        unit = _number(marks, start, text)
        n = int(unit[-1]) + 1
        best, which = tool.cosines(unit, hashes, n)
        first = np.searchsorted(unit, np.arange(n))
        last = np.append(first[1:], len(unit)) - 1
        for u in np.flatnonzero(best >= least - 1e-9):
            i = int(text[first[u]])
            a, b = int(start[first[u]] - offsets[i]), int(end[last[u]] - offsets[i])
            whole = tool is full or 2 * (last[u] - first[u] + 1) >= many[i]
            rows.append((i, tool is not full, -round(float(best[u]), 9), a, -b, tool.names[which[u]], bool(whole)))
    for i, licence, a, b in _identifiers(offsets, data):
        within = int(np.searchsorted(start, offsets[i] + b) - np.searchsorted(start, offsets[i] + a))
        rows.append((i, True, -1.0, a, -b, licence, 2 * within >= int(many[i])))
    spans: dict[int, dict[tuple[int, int, str], float]] = {}
    for i, _, cosine, a, b, name, _ in sorted(rows):
        of = spans.setdefault(i, {})
        of[a, -b, name] = max(-cosine, of.get((a, -b, name), 0.0))
    for i, _, cosine, a, b, name, whole in sorted(rows, reverse=True):
        every = [{"licence": n, "cosine": c, "start": x, "end": y} for (x, y, n), c in sorted(spans[i].items())]
        out[i] = (name, -cosine, a, -b, whole, every)
    return out


def _frequencies(docs: DataFrame, templates: dict[str, list[str]], text_col: str) -> tuple[int, dict[int, int]]:
    """Number of texts, and in how many of them each word of the templates occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(templates)
        seen, texts = np.zeros(len(model.words), np.int64), 0
        for batch in chunks(batches):
            offsets, data = text_buffer(batch.column("text"))
            texts += batch.num_rows
            _, _, text, hashes = _tokens(offsets, data)
            word = model.known(hashes)
            mine = word >= 0
            pairs = np.unique(text[mine] * len(model.words) + word[mine])
            seen += np.bincount(pairs % len(model.words), minlength=len(model.words))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(seen))], pa.int64()), pa.array([texts, *seen.tolist()], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    count = {r["word"]: r["n"] for r in rows}
    own = Model(templates).words.view(np.int64)
    return count.get(-1, 0), {int(w): count.get(i, 0) for i, w in enumerate(own)}


RESULT = ("path", "whole_text", "licence", "cosine", "start", "end", "licence_file", "spans", "licence_source", "from_path")


def own_licences(
    files: DataFrame,
    templates: dict[str, list[str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    path_col: str = "path",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    full: dict[str, str] = FULL,
    full_threshold: float = FULL_THRESHOLD,
) -> DataFrame:
    """Per file: ``keep``, path, licence, cosine, start, end (bytes of the original text), licence_file, spans (all matches).

    A kept column of one of these names, or of those that :func:`inherited` adds, is replaced.
    """
    keep = tuple(c for c in keep if c.lower() not in RESULT)
    context = files.sparkSession.sparkContext
    whole = {name: [text] for name, text in full.items()}
    texts, found = _frequencies(files, {"": [t for part in (templates, whole) for of in part.values() for t in of]}, text_col)
    models = context.broadcast((Model(templates, texts, found), Model(whole, texts, found)))
    taken = files.select(*[F.col(c) for c in keep], F.col(path_col).alias("path"), F.col(text_col).alias("whole_text"))
    names = [*taken.columns[:-1], "licence", "cosine", "start", "end", "licence_file", "spans"]
    span = pa.list_(pa.struct([("licence", pa.string()), ("cosine", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "whole_text"):
            rows = [r or (*(None,) * 5, []) for r in scan(*models.value, *text_buffer(batch.column("whole_text")), threshold, full_threshold)]
            parts = zip(*rows, strict=True)
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), span)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(list(p), k) for p, k in zip(parts, kinds, strict=True))], names=names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[:-1])
    return taken.mapInArrow(run, f"{kept}, licence string, cosine double, start long, `end` long, licence_file boolean, spans array<struct<licence: string, cosine: double, start: long, `end`: long>>")


def _folder(path):
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited(found: DataFrame) -> DataFrame:
    """The files with source (``own``, ``inherited`` or null) and from_path, the licence file that gave the licence."""
    folder, near = fresh(found, "folder", "near")
    files = found.withColumn(folder, _folder(F.col("path")))
    best = F.struct((-F.col("cosine")).alias("c"), "path", "licence")
    given = files.where(F.col("licence_file") & F.col("path").isNotNull()).groupBy(F.col(folder).alias("above")).agg(F.min(best).alias("given"))
    given = given.select("above", F.col("given.licence").alias("their"), F.col("given.path").alias("from_path"))
    folders = files.where(F.col(folder).isNotNull() & F.col("licence").isNull()).select(F.col(folder).alias("below")).distinct()
    parts = F.split("below", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    nearest = (
        folders.select("below", F.explode(F.array_distinct(above)).alias("above"))
        .join(given, "above")
        .groupBy(F.col("below").alias(folder))
        .agg(F.max_by(F.struct("their", "from_path"), F.length("above")).alias(near))
    )
    joined = files.join(nearest, folder, "left")
    mine, theirs = F.col("licence").isNotNull(), F.col(near).isNotNull()
    return joined.select(
        *[F.coalesce("licence", f"{near}.their").alias(c) if c == "licence" else F.col(f"`{c}`") for c in found.columns],
        F.when(mine, "own").when(theirs, "inherited").alias("licence_source"),
        F.when(~mine & theirs, F.col(f"{near}.from_path")).alias("from_path"),
    )


def licences(files: DataFrame, **options) -> DataFrame:
    """Own and inherited licences of all files."""
    return inherited(written(own_licences(files, **options)))
