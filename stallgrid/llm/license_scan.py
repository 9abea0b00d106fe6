"""License scans as an exact set-similarity join of text blocks with license templates.

A block matches a template if it holds at least ``threshold`` of the template's distinct words (containment).
Words are ordered by their number of occurrences in the whole corpus, rarest first. A template of n words that
must be hit h = ceil(threshold * n) times has a prefix of its n - h + 1 rarest words: a block that shares none of
them cannot reach h (prefix filter). Blocks of fewer than h words are skipped (length filter), and while a
template's words are counted off in that order the rest must still suffice (positional filter).

Blocks are lines, and notices are often wrapped over several: of a template of n words every stretch of n / threshold
words that goes over a line end is a block too, unless one of its lines has the template already. Stretches overlap
by all words but one; only those that hold a word of the template's prefix are looked at.

The join finds every block over the threshold. A block gives its label only if it holds the words that tell the notice
from its relatives: four words of "released under the mit license" are no MIT notice without "mit".

Two passes over the texts: one counts the templates' words over the corpus, one joins. Templates are a bounded
side (checked); texts stay where they are, so nothing but counts is shuffled.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases of the base scan, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# License notices, and the labels that the join gives to blocks that contain them. Behind a short notice
# stand the words that tell it from its relatives: those that must stand in it, and those that must not.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2", ""),
    ("mit", "Released under the MIT License", "mit license", ""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "general public 3", "lesser affero"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc nc 4", "nd sa"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "commons attribution", "noncommercial noderivatives noderivs sharealike"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "commons attribution noncommercial 4", "noderivatives noderivs sharealike"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "commons attribution sharealike 4", "noncommercial"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("copyright", "Copyright holder all rights reserved no part may be reproduced without permission", "reproduced permission", ""),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)

#: Notices of up to this many words are so short that their words must also stand in their order, within twice their length.
SHORT = 16
#: Most distinct words of all templates together that are sent to the workers.
MAX_TEMPLATE_WORDS = 200_000
#: A longer line is cut into windows of this many words, or of two stretches of the longest template if that is more,
#: each starting half a window on.
BLOCK_WORDS = 200

_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD_BYTES or c == 0x0A else 0x20 for c in range(256))


def normal_bytes(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased, line ends kept, and every other byte outside words as a space."""
    return (text or "").encode("utf-8", "replace").translate(_TO_WORDS)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]  # in their order
    must: frozenset[bytes] = frozenset()
    never: frozenset[bytes] = frozenset()

    @property
    def distinct(self) -> tuple[bytes, ...]:
        return tuple(sorted(set(self.words)))


def template_words(templates=TEMPLATES) -> list[Template]:
    """Templates (label, text, and optionally the words that must and must not stand in a match) as words; those without any are left out."""
    split = lambda text: normal_bytes(text).split()
    out = [Template(label, tuple(split(text)), *(frozenset(split(x)) for x in marks)) for label, text, *marks in templates]
    if sum(len(t.distinct) for t in out) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words to send to every worker; scan in several calls")
    return [t for t in out if t.words]


def in_order(words: tuple[bytes, ...], block: list[bytes]) -> int:
    """Most words of a template that stand in a block one behind another (longest common subsequence)."""
    best = [0] * (len(words) + 1)
    for w in block:
        for i in range(len(words), 0, -1):
            if words[i - 1] == w:
                best[i] = max(best[i], max(best[:i]) + 1)
    return max(best)


def corpus_counts(docs: DataFrame, words: set[bytes], text: str = "text") -> dict[bytes, int]:
    """Occurrences of ``words`` (a bounded set) in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                total.update(filter(words.__contains__, normal_bytes(t.as_py()).split()))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text).cast("string")).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


class TemplateIndex:
    """Templates with their words rarest first, found by the words of their prefixes."""

    def __init__(self, templates: list[Template], counts: dict[bytes, int], threshold: float):
        self.by_word: dict[bytes, list[tuple[int, int]]] = {}
        self.items = []
        self.templates = templates
        self.stretch = [max(1, math.ceil(len(t.words) / threshold - 1e-9)) for t in templates]
        self.block_words = max([BLOCK_WORDS, *(2 * n for n in self.stretch)])
        self.word_sets = [frozenset(t.words) for t in templates]
        for k, label, words in ((k, t.label, t.distinct) for k, t in enumerate(templates)):
            ordered = sorted(words, key=lambda w: (counts.get(w, 0), w))
            need = max(1, math.ceil(threshold * len(ordered) - 1e-9))
            self.items.append((label, ordered, need))
            for at, w in enumerate(ordered[: len(ordered) - need + 1]):
                self.by_word.setdefault(w, []).append((k, at))
        self.prefix_words = frozenset(self.by_word)

    def matches(self, block: set[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of all templates that the block contains."""
        first: dict[int, int] = {}
        for w in block & self.prefix_words:
            for k, at in self.by_word[w]:
                first[k] = min(at, first.get(k, at))
        out = []
        for k, at in first.items():
            _, words, need = self.items[k]
            if len(block) < need:
                continue
            hits, left = 0, len(words) - at  # words before ``at`` are not in the block
            for w in words[at:]:
                if hits + left < need:
                    break
                hits += w in block
                left -= 1
            if hits >= need:
                out.append((k, hits / len(words)))
        return out

    def holds(self, k: int, block: list[bytes]) -> bool:
        """Whether a block that contains a template is this notice, and no relative of it.

        Words that must not stand there count from three words before it to three behind it. Short notices also need
        their words in their order.
        """
        t, of, need = self.templates[k], self.word_sets[k], self.items[k][2]
        short = len(t.words) <= SHORT
        if not (t.must or t.never or short):
            return True
        size = 2 * len(t.words)
        for p, w in enumerate(block):
            if w in of:
                near = block[p : p + size]
                if t.must.issubset(near) and t.never.isdisjoint(block[max(0, p - 3) : p + size + 3]) and (not short or in_order(t.words, near) >= need):
                    return True
        return False

    def stretches(self, words: list[bytes], line_ends: list[int], found: set[tuple[int, int]]) -> list[tuple[int, int, float]]:
        """(first word number, template, containment) of the stretches over line ends that contain a template.

        Of overlapping stretches the first of the fullest ones; ``line_ends`` are the numbers of the words that begin
        a line behind another, ``found`` the (template, line) that have been found.
        """
        if not line_ends:
            return []
        places: dict[int, list[int]] = {}
        for p, w in enumerate(words):
            for k, _ in self.by_word.get(w, ()):
                places.setdefault(k, []).append(p)
        out = []
        for k, prefix in places.items():
            size, need, of = self.stretch[k], self.items[k][2], self.word_sets[k]
            runs: list[list[int]] = []  # words that a stretch with a prefix word can hold
            for p in prefix:
                a, b = max(0, p - size + 1), min(len(words), p + size)
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            for a, b in runs:
                if bisect_left(line_ends, b) == bisect_right(line_ends, a):
                    continue
                at = [p for p in range(a, b) if words[p] in of]
                held: Counter = Counter()
                first, best = 0, None
                for p in at:
                    held[words[p]] += 1
                    while at[first] <= p - size:
                        w = words[at[first]]
                        held[w] -= 1
                        if not held[w]:
                            del held[w]
                        first += 1
                    if len(held) < need:
                        continue
                    lines = range(bisect_right(line_ends, at[first]), bisect_right(line_ends, p) + 1)
                    if len(lines) < 2 or any((k, line) in found for line in lines):
                        continue
                    if best and at[first] > best[1]:
                        out.append((best[0], k, best[2] / len(of)))
                        best = None
                    if not best or len(held) > best[2]:
                        best = (at[first], p, len(held))
                if best:
                    out.append((best[0], k, best[2] / len(of)))
        return out


def blocks_of(data: bytes, wanted: frozenset[bytes], most: int = BLOCK_WORDS) -> Iterator[tuple[int, list[bytes]]]:
    """(first word number, words) of the text's lines and windows; lines without a wanted word are passed over."""
    at = 0
    for line in data.split(b"\n"):
        words = line.split()
        if not wanted.isdisjoint(words):
            if len(words) <= most:
                yield at, words
            else:
                for k in range(0, len(words) - most // 2, most // 2):
                    yield at + k, words[k : k + most]
        at += len(words)


def phrase_places(data: bytes) -> list[tuple[int, str]]:
    """(first word number, label) of every place where a base phrase's words stand one after another."""
    if not any(p.split()[0].encode() in data for p, _ in PHRASES):
        return []
    words = data.split()
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in PHRASES:
        look = b" " + phrase.encode() + b" "
        at = joined.find(look)
        while at >= 0:
            out.append((joined.count(b" ", 0, at), label))
            at = joined.find(look, at + 1)
    return out


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """doc_id, n_words, places array<struct<word,label>>, blocks and wrapped array<struct<word,label,containment,holds>> of every row.

    ``blocks`` are all matches of lines and their windows, ``wrapped`` those of stretches over line ends; ``holds`` says
    whether the words that tell the notice from its relatives are there too, and a short notice's words in their order.
    Null text is empty: no words, empty arrays. Rows with equal ids are scanned on their own; ties between
    templates are all reported.
    """
    words = template_words(templates)
    counts = corpus_counts(docs, {w for t in words for w in t.words}, text)
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(words, counts, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            n, places, blocks, wrapped = [], [], [], []
            for t in batch.column(1):
                data = normal_bytes(t.as_py())
                words = data.split()
                n.append(len(words))
                places.append([{"word": w, "label": k} for w, k in phrase_places(data)])
                hits, over = [], []
                if not ix.prefix_words.isdisjoint(words):
                    lines = [len(line.split()) for line in data.split(b"\n")]
                    line_ends = sorted({e for e in accumulate(lines) if 0 < e < len(words)})
                    hits = [(at, k, c, ix.holds(k, block)) for at, block in blocks_of(data, ix.prefix_words, ix.block_words) for k, c in ix.matches(set(block))]
                    over = ix.stretches(words, line_ends, {(k, bisect_right(line_ends, at)) for at, k, _, _ in hits})
                    over = [(at, k, c, ix.holds(k, words[at : at + ix.stretch[k]])) for at, k, c in over]
                for out, found in ((blocks, hits), (wrapped, over)):
                    out.append([{"word": at, "label": ix.items[k][0], "containment": c, "holds": sure} for at, k, c, sure in found])
            place, block = pa.struct([("word", pa.int64()), ("label", pa.string())]), pa.struct([("word", pa.int64()), ("label", pa.string()), ("containment", pa.float64()), ("holds", pa.bool_())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(places, pa.list_(place)), pa.array(blocks, pa.list_(block)), pa.array(wrapped, pa.list_(block))], ["doc_id", "n_words", "places", "blocks", "wrapped"])

    schema = "doc_id bigint, n_words bigint, places array<struct<word:bigint,label:string>>, blocks array<struct<word:bigint,label:string,containment:double,holds:boolean>>, wrapped array<struct<word:bigint,label:string,containment:double,holds:boolean>>"
    return docs.select(F.col("doc_id").cast("bigint"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """License digest of every document: the base phrases, and the labels of the template join."""
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("blocks", F.concat("blocks", "wrapped"))
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    sure = F.filter("blocks", lambda b: b["holds"])
    more = F.array_distinct(F.transform(sure, lambda p: p["label"]))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(sure, lambda b: b["containment"])), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["word"])).alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, more)), ",").alias("labels"),
        score.alias("score"),
        F.size("blocks").cast("long").alias("n_blocks"),
    )
