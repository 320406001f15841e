"""License scans: an exact set-similarity join of text blocks with license templates.

A text is cut in blocks of 64 words, one every 32, so any passage of up to 33 words lies in a block; where a template is
longer, blocks grow so that a passage of its length lies in one. Blocks and
templates are sets of the templates' words, ordered by their frequency over all texts, rarest first. A pair may reach
the containment threshold only if they share one of the template's first |T| - need + 1 words (prefix), the block
has need words (length) and enough words remain after the shared one on both sides (position); what is left is
verified by the whole intersection. Phrases are templates that need all their words, whose places are then read off
the block. License texts are templates too, passage by passage: each block that contains a passage up to the threshold gets
the text's label, so texts that were cut or changed in places are found by what is left of them; texts that have a passage
in common, such as a disclaimer, get each other's.

Defined results: null and empty texts have no words and no labels; repeated rows have equal results; an empty table
gives an empty result. Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import NOT_WORD, words

#: Words of a block, and from one block's start to the next one's, as far as no template is longer.
BLOCK, STRIDE = 64, 32


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    threshold: float = 0.8
    phrase: bool = False  # its words have to stand in a row

    @property
    def need(self) -> int:
        return math.ceil(self.threshold * len(set(self.words)) - 1e-9)


def _phrase(label: str, text: str) -> Template:
    return Template(label, tuple(text.split()), 1.0, True)


def _notice(label: str, text: str) -> Template:
    found = tuple(text.split())
    return Template(label, found, 1.0 if len(found) < 8 else 0.8)


PHRASES = (
    _phrase("gpl", "gnu general public license"),
    _phrase("apache", "apache license"),
    _phrase("cc-by", "cc by"),
    _phrase("mit", "mit license"),
)
NOTICES = (
    _notice("notice:apache-2.0", "licensed under the apache license version 2 0"),
    _notice("notice:apache-2.0", "you may not use this file except in compliance with the license"),
    _notice("notice:gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    _notice("notice:gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    _notice("notice:mit", "released under the mit license"),
    _notice("notice:mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    _notice("notice:cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    _notice("notice:bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
)


def passages(label: str, text: str, most: int = STRIDE + 1) -> tuple[Template, ...]:
    """A license's text as templates, one after the other, of about equal lengths that lie in a block wherever they stand."""
    found = tuple(w for w in re.split(NOT_WORD, text.lower()) if w)
    n = math.ceil(len(found) / most)
    return tuple(Template(label, found[k * len(found) // n : (k + 1) * len(found) // n]) for k in range(n))


# Texts of licenses, as their authors publish them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as
being the original software. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You
may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
License for the specific language governing permissions and limitations under the License."""
_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that
it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
General Public License for more details. You should have received a copy of the GNU General Public License along with this program."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In
jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the
public domain."""
NOTICES += tuple(
    t
    for label, text in (("text:mit", _MIT), ("text:bsd-2-clause", _BSD_2), ("text:isc", _ISC), ("text:zlib", _ZLIB), ("text:apache-2.0", _APACHE_NOTICE), ("text:gpl-3.0", _GPL_NOTICE), ("text:unlicense", _UNLICENSE))
    for t in passages(label, text)
)


def word_frequency(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows of texts (column words) each word of the vocabulary stands; as many numbers as it has words."""
    found = F.array_intersect("words", F.array(*map(F.lit, vocabulary)))
    counts = texts.select(F.explode(found).alias("word")).groupBy("word").count().collect()
    return {r["word"]: r["count"] for r in counts}


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def scan_blocks(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """doc_id, text_hash, block, template (index), overlap, starts: each block that meets a template, once for equal rows.

    starts has the words at which a phrase begins in the first half of the block, so that every place counts in one block.
    """
    spark: SparkSession = docs.sparkSession
    longest = max(len(t.words) for t in templates)
    stride = max(STRIDE, longest - 1)
    block = max(BLOCK, stride + longest - 1)
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words(F.col("text")).alias("words"))
    vocabulary = sorted({w for t in templates for w in t.words})
    seen = word_frequency(texts, vocabulary)
    ranked = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i + 1 for i, w in enumerate(ranked)}

    prefixes = []
    for k, t in enumerate(templates):
        sets = sorted({rank[w] for w in t.words})
        prefixes += [(r, k, i, len(sets), t.need, sets, list(t.words) if t.phrase else None) for i, r in enumerate(sets[: len(sets) - t.need + 1])]
    prefix_words = _strings(sorted({ranked[p[0] - 1] for p in prefixes}))
    row = lambda p: "named_struct('r', {}, 'template', {}, 'i', {}, 'size', {}, 'need', {}, 'ranks', array({}), 'phrase', {})".format(*p[:5], ",".join(map(str, p[5])), "array({})".format(",".join(f"'{w}'" for w in p[6])) if p[6] else "cast(null as array<string>)")
    probes = spark.sql(f"SELECT inline(array({','.join(map(row, prefixes))}))")

    texts = texts.filter(F.size(F.array_intersect("words", prefix_words)) > 0)
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"(size(words) - 1) div {stride}").cast("int")), lambda b: F.struct(b.alias("block"), F.slice("words", b * stride + 1, F.lit(block)).alias("part")))
    blocks = texts.select("doc_id", "text_hash", F.explode(cut).alias("b")).select("doc_id", "text_hash", "b.*")
    blocks = blocks.filter(F.arrays_overlap("part", prefix_words))
    known = F.array_intersect("part", _strings(ranked))  # by a hash set; only what it leaves is looked up
    ranks = F.array_sort(F.transform(known, lambda w: F.array_position(_strings(ranked), w).cast("int")))
    blocks = blocks.withColumn("own", ranks)
    places = blocks.select("doc_id", "text_hash", "block", "part", "own", F.posexplode("own").alias("j", "r"))
    enough = (F.size("own") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("i") - 1, F.size("own") - F.col("j") - 1) >= F.col("need"))
    pairs = places.join(F.broadcast(probes), "r").filter(enough)
    pairs = pairs.withColumn("overlap", F.size(F.array_intersect("own", "ranks"))).filter("overlap >= need")
    starts = F.filter(F.sequence(F.lit(0), F.lit(stride - 1)), lambda i: F.slice("part", i + 1, F.size("phrase")) == F.col("phrase"))
    starts = F.transform(F.when(F.col("phrase").isNull(), F.array().cast("array<int>")).otherwise(starts), lambda i: i.cast("long") + F.col("block") * stride)
    pairs = pairs.select("doc_id", "text_hash", "block", "template", "overlap", "size", starts.alias("starts"))
    return pairs.dropDuplicates(["doc_id", "text_hash", "block", "template"])


def scan_licenses(docs: DataFrame, phrases: tuple[Template, ...] = PHRASES, notices: tuple[Template, ...] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks (how many meet a notice)."""
    templates = (*phrases, *notices)
    hits = scan_blocks(docs, templates)
    label = F.element_at(_strings([t.label for t in templates]), F.col("template") + 1)
    base = F.col("template") < len(phrases)
    hits = hits.filter(~base | (F.size("starts") > 0))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = hits.groupBy("doc_id", "text_hash").agg(
        F.sum(F.size("starts")).alias("n_base"),
        F.min(F.array_min("starts")).alias("first_word"),
        F.max(F.array_max("starts")).alias("last_word"),
        joined(F.when(base, label)).alias("base_labels"),
        joined(label).alias("labels"),
        F.max(F.col("overlap") / F.col("size")).alias("score"),
        F.count_if(~base).alias("blocks"),
    )
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    same = texts["doc_id"].eqNullSafe(found["doc_id"]) & (texts["text_hash"] == found["text_hash"])
    out = texts.join(found, same, "left")
    return out.select(
        texts["doc_id"],
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks"),
    )
