"""License text in documents by an exact set-similarity join with license templates.

A template is a short notice or a passage of a license. A block is a line of a text, or one of the
windows of ``WINDOW`` words that start every half window and together cover the text, so that a
passage is found however its lines are wrapped. A block matches a template if it holds at least the
needed number of the template's distinct words: ``CONTAINMENT`` of them, or all of a notice of fewer
than ``NOTICE`` words. A notice is sought in lines, a passage in lines and windows. A match goes where
the same block matches a template that has all its words and more ("CC BY" within "CC BY-NC").

1. The blocks that hold each template word are counted over all documents; this gives the global
   order of words, rarest first. The table has one row for each template word, so it is bounded.
2. A template's prefix in that order is as long as the words it may lack, and one. A block that
   matches holds a word of the prefix, and early enough in its own order (prefix filter).
3. A block with fewer template words than needed goes at once (length filter). Where a common word
   leaves too few words behind it in either set, the pair goes (positional filter).
4. The pairs that are left are counted exactly.

The templates come as a Python list and go to the tasks with the code: their size is what the caller
writes down, not what the documents hold. Every text is split as a whole; a task holds a batch.

Defined results: null and wordless texts have no blocks, empty labels, null first and last word and
score 0; repeated rows each give a row; an empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, CONTAINMENT, NOTICE = 256, 0.8, 20
#: ASCII that is no letter or digit parts words; other code points are letters.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 10 if c == 10 else 32 for c in range(256))

# Phrases of the contract and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Notices and passages of public licenses, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0"),
)


def words_of(text: str | None) -> list[list[bytes]]:
    """The words of each line, as UTF-8."""
    return [line.split() for line in (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split(b"\n")]


class Template(NamedTuple):
    label: str
    words: frozenset
    needed: int
    in_windows: bool


def prepared(templates=TEMPLATES, containment: float = CONTAINMENT, notice: int = NOTICE) -> list[Template]:
    out = []
    for label, text in templates:
        words = frozenset(w for line in words_of(text) for w in line)
        if not words:
            raise ValueError(f"the template of {label} has no word")
        passage = len(words) >= notice
        # the smallest count at or above the share, without rounding of the share
        out.append(Template(label, words, -int(-len(words) * round(containment * 1000) // 1000) if passage else len(words), passage))
    return out


def blocks(lines: list[list[bytes]], window: int = WINDOW) -> Iterator[tuple[bool, list[bytes]]]:
    """The lines with a word, then the windows, with a mark on windows."""
    lines = [line for line in lines if line]
    for line in lines:
        yield False, line
    flat = [w for line in lines for w in line]
    for at in range(0, max(len(flat) - window // 2, 1 if flat else 0), window // 2):
        yield True, flat[at : at + window]


def word_frequencies(docs: DataFrame, templates: list[Template], *, text_col="text", window=WINDOW) -> dict[bytes, int]:
    """The number of blocks that hold each word of the templates."""
    vocabulary = frozenset().union(*(t.words for t in templates))

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                for _, block in blocks(words_of(text.as_py()), window):
                    seen.update(vocabulary.intersection(block))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    # at most one row for each word of the templates reaches the driver
    found = docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(vocabulary, 0) | {bytes(r.word): r.n for r in found}


class TemplateIndex:
    """Templates under the words of their prefixes, in the global order of words."""

    def __init__(self, templates: list[Template], frequency: dict[bytes, int]):
        self.templates = templates
        self.within = {k: {j for j, other in enumerate(templates) if t.words < other.words} for k, t in enumerate(templates)}
        self.order = {w: i for i, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
        self.least = [min((t.needed for t in templates if t.in_windows or not windows), default=1 << 62) for windows in (False, True)]
        self.prefixes: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(templates):
            ordered = sorted(t.words, key=self.order.__getitem__)
            for i, w in enumerate(ordered[: len(t.words) - t.needed + 1]):
                self.prefixes.setdefault(w, []).append((k, i))

    def matches(self, block: list[bytes], windows: bool) -> list[tuple[int, int]]:
        """(template, common words) of the templates that the block contains well enough."""
        common, least = self.order.keys() & block, self.least[windows]
        if len(common) < least:
            return []
        ordered, met, out = sorted(common, key=self.order.__getitem__), set(), []
        for j, w in enumerate(ordered[: len(ordered) - least + 1]):
            for k, i in self.prefixes.get(w, ()):
                t = self.templates[k]
                if k in met or windows and not t.in_windows:
                    continue
                met.add(k)  # the first word that both prefixes share bounds the overlap
                if 1 + min(len(t.words) - i - 1, len(ordered) - j - 1) >= t.needed and (n := len(t.words & common)) >= t.needed:
                    out.append((k, n))
        return [(k, n) for k, n in out if self.within[k].isdisjoint(j for j, _ in out)]


def phrase_places(flat: list[bytes], phrases=PHRASES) -> list[tuple[int, str]]:
    """(first word, label) of every place where the words of a phrase stand consecutively."""
    joined, out = b" %s " % b" ".join(flat), []
    for phrase, label in phrases:
        at = joined.find(sought := f" {phrase} ".encode())
        while at >= 0:
            out.append((joined.count(b" ", 0, at), label))
            at = joined.find(sought, at + 1)
    return out


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long"


def scan_licenses(docs: DataFrame, *, id_col="doc_id", text_col="text", templates=TEMPLATES, containment=CONTAINMENT, notice=NOTICE, window=WINDOW) -> DataFrame:
    """For each document: words, places of the base phrases, labels, the best containment of a matching template, and the matching blocks."""
    known = prepared(templates, containment, notice)
    if window < 2 * max((len(words_of(text)[0]) for _, text in templates), default=1):
        raise ValueError("a window has to be twice as long as the longest template")
    index = TemplateIndex(known, word_frequencies(docs, known, text_col=text_col, window=window))

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(1):
                lines = words_of(text.as_py())
                flat = [w for line in lines for w in line]
                places, labels, score, n_blocks = phrase_places(flat), set(), 0.0, 0
                for windows, block in blocks(lines, window):
                    found = index.matches(block, windows)
                    n_blocks += bool(found)
                    for k, n in found:
                        labels.add(known[k].label)
                        score = max(score, n / len(known[k].words))
                base, at = {x for _, x in places}, [x for x, _ in places]
                out.append((len(flat), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score, n_blocks))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[id_col, *(x.split()[0] for x in SCHEMA.split(", "))])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}")


_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PHRASES = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES)
_TEMPLATES = ", ".join(f"({k}, '{label}', '{text}')" for k, (label, text) in enumerate(TEMPLATES))
#: Every block against every template.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER.format("coalesce(text, '')")} AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, {_WORDS}) AS ws FROM d),
ph(p, label) AS (VALUES {_PHRASES}),
places AS (SELECT r, i - 1 AS pos, label FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE text LIKE '%licens%' OR text LIKE '%cc%') q, ph WHERE ws[i] = p[1] AND ws[i : i + len(p) - 1] = p),
base AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY r),
t AS (SELECT k, label, list_distinct(regexp_extract_all({_LOWER.format("text")}, {_WORDS})) AS ts FROM (VALUES {_TEMPLATES}) v(k, label, text)),
tn AS (SELECT *, len(ts) >= {NOTICE} AS passage, CASE WHEN len(ts) >= {NOTICE} THEN ceil(len(ts) * {round(CONTAINMENT * 1000)} / 1000::DECIMAL(9, 0)) ELSE len(ts) END AS needed FROM t),
b AS (SELECT r, 0 AS win, i, regexp_extract_all(line, {_WORDS}) AS bs FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM w)
  UNION ALL SELECT r, 1, i, ws[i + 1 : i + {WINDOW}] FROM (SELECT r, ws, unnest(range(0, greatest(len(ws) - {WINDOW // 2}, 1), {WINDOW // 2})) AS i FROM w)),
m AS MATERIALIZED (SELECT r, win, i, k, label, n, size FROM (SELECT r, win, i, k, label, len(list_intersect(ts, bs)) AS n, len(ts) AS size, needed FROM b, tn WHERE len(bs) > 0 AND (passage OR win = 0)) WHERE n >= needed),
sub AS (SELECT x.k, y.k AS larger FROM t x JOIN t y ON len(y.ts) > len(x.ts) AND list_has_all(y.ts, x.ts)),
hit AS (SELECT r, list(DISTINCT label) AS labels, max(n::DOUBLE / size) AS score, count(DISTINCT (win, i)) AS n_blocks FROM m ANTI JOIN (SELECT r, win, i, sub.k FROM m JOIN sub ON sub.larger = m.k) z USING (r, win, i, k) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(hit.labels, [])))), ',') AS labels,
  coalesce(score, 0)::DOUBLE AS score, coalesce(n_blocks, 0)::BIGINT AS n_blocks
FROM w LEFT JOIN base USING (r) LEFT JOIN hit USING (r)
"""
