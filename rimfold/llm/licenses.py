r"""License scans: phrases, and an exact set-similarity join of text blocks with license templates. DataFrame functions only.

Words: runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z is lower-cased (found here on the text as it is, ignoring the case of A-Z). A template's blocks are
as many consecutive words as its text has and a quarter more, BLOCK at least, and start at every word. A template labels a
text if a block holds at least `least` of the template's distinct words (containment of the template in the block).

The join: template words are ordered by their count over the whole corpus, rarest first. A block that holds all but
|T| - need of a template's |T| words (need = ceil(least * |T|)) must hold one of its |T| - need + 1 rarest (prefix
filter), so only what lies less than a block around these words is looked at. Length filter: there must be `need` different
words of templates there. Positional filter: with j of the template's words before the rare one in the order, the block can
share at most j and at most the earlier words that are there, and as to the others at most |T| - j and the later words that are
there; the sum must reach `need`. What is left is counted exactly, in each block that starts at a word of the template and holds the
rare word; a block that starts elsewhere holds no more than the one at its first word of the template. The templates are
a constant of this module, so the broadcast table has a fixed size. Function words (COMMON) belong to no template's set.

Defined cases: null and empty texts have no words, no labels and score 0; repeated rows are each scanned.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimfold.llm.common import read, stored

OUT = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # on the text as it is: A-Z belong to words
TOKEN = rf"[^{OUT}]+"
BLOCK, LEAST = 32, 0.9
COMMON = {"a", "all", "and", "any", "are", "by", "in", "is", "may", "not", "of", "or", "the", "this", "to", "under", "you"}
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices, then paragraphs of public license texts.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "gpl-3.0": ["licensed under the gnu general public license version 3"],
    "gpl-2.0": ["licensed under the gnu general public license version 2"],
    "gpl-or-later": ["gnu general public license either version of the license or any later version"],
    "lgpl": ["licensed under the gnu lesser general public license"],
    "mpl-2.0": ["subject to the terms of the mozilla public license v 2 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "creative commons attribution sharealike international license"],
    "cc-by-4.0": ["licensed under a creative commons attribution 4 0 international license"],
    "cc0": ["dedicated to the public domain under cc0 1 0 universal"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}

PARAGRAPHS = {
    "apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    ],
    "mit": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software.""",
        """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "bsd": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission.""",
        """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
        LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
        SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
        """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    ],
    "gpl-or-later": [
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
        """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
        for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.""",
    ],
    "unlicense": [
        """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
        compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ],
}


def templates() -> list[tuple[int, str, list[str], int]]:
    """(number, label, distinct words, words of a block) of each template."""
    texts = [(label, text) for kind in (TEMPLATES, PARAGRAPHS) for label, of_label in kind.items() for text in of_label]
    words = [re.findall(r"[0-9a-z]+", text.lower()) for _, text in texts]
    return [(n, label, sorted(set(own) - COMMON), max(BLOCK, math.ceil(1.25 * len(own)))) for n, ((label, _), own) in enumerate(zip(texts, words))]


def found_words(docs: DataFrame) -> DataFrame:
    """_row (doc_id and text hash), n_words, hits: place and lower-cased form of the words of phrases and templates."""
    wanted = sorted({w for _, _, own, _ in templates() for w in own} | {w for p in PHRASES for w in p.split()})
    words = F.regexp_extract_all("_own", F.lit(TOKEN), F.lit(0))
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_own")).select(
        "doc_id", F.struct(F.col("doc_id"), F.xxhash64("_own").alias("h")).alias("_row"), words.alias("_words")
    )
    # lower() also maps some other signs to a-z: only words of one byte a character are compared
    hit = F.filter(F.transform("_words", lambda w, i: F.struct(i.alias("at"), F.lower(w).alias("word"), w.alias("own"))), lambda x: x["word"].isin(wanted) & (F.octet_length(x["own"]) == F.length(x["own"])))
    return known.select("doc_id", "_row", F.size("_words").cast("long").alias("n_words"), F.transform(hit, lambda x: F.struct(x["at"].alias("at"), x["word"].alias("word"))).alias("hits"))


def word_order(words: DataFrame) -> dict[str, int]:
    """Rank by corpus count, rarest first, of every template word; at most as many counts as there are such words."""
    names = sorted({w for _, _, own, _ in templates() for w in own})
    counts = {r["word"]: r["count"] for r in words.groupBy("word").count().collect()}
    return {w: i for i, w in enumerate(sorted(names, key=lambda w: (counts.get(w, 0), w)))}


def template_labels(texts: DataFrame, order: dict[str, int], *, least: float = LEAST) -> DataFrame:
    """_row, method_labels (sorted set), containment (the highest) of the texts that hold a block that meets the
    threshold; texts: _row, hits."""
    prefix, reach = [], {}
    for n, label, own, span in templates():
        ranks = sorted(order[w] for w in own)
        need = math.ceil(least * len(own) - 1e-9)
        names = sorted(own, key=order.__getitem__)
        for j, w in enumerate(names[: len(own) - need + 1]):
            prefix.append((w, ranks[j], j, n, label, need, span, ranks))
            reach[w] = max(span, reach.get(w, 0))
    schema = "word string, rank int, j int, template int, label string, need int, span int, own array<int>"
    prefixes = F.broadcast(texts.sparkSession.createDataFrame(prefix, schema))
    numbered = F.transform("hits", lambda x, i: F.struct(x["at"].alias("at"), x["word"].alias("word"), i.alias("i")))
    rare = F.filter(numbered, lambda x: x["word"].isin(sorted(reach)))

    def wide(x):  # the longest block of the word's templates
        return reduce(lambda rest, span: F.when(x["word"].isin([w for w in reach if reach[w] == span]), F.lit(span)).otherwise(rest), sorted(set(reach.values())), F.lit(BLOCK))

    # hits are in order of place, so those less than a block away are less than its words away as hits
    around = F.transform(rare, lambda x: F.struct(x["at"].alias("at"), x["word"].alias("word"), F.slice("hits", F.greatest(x["i"] - (wide(x) - 2), F.lit(1)), 2 * wide(x) - 1).alias("near")))
    anchors = texts.select("_row", F.explode(around).alias("x")).select("_row", "x.*").join(prefixes, "word")
    names = F.split(F.lit(" ".join(sorted(order, key=order.__getitem__))), " ")  # by rank, which is the place here
    ranked = F.transform("near", lambda x: F.struct(x["at"].alias("at"), (F.array_position(names, x["word"]) - 1).cast("int").alias("rank")))
    near = F.filter(ranked, lambda x: (F.abs(x["at"] - F.col("at")) < F.col("span")) & (x["rank"] >= 0))
    different = anchors.withColumn("near", near).withColumn("ranks", F.array_distinct("near.rank")).where(F.size("ranks") >= F.col("need"))
    earlier = F.size(F.filter("ranks", lambda r: r < F.col("rank")))
    most = F.least("j", earlier) + F.least(F.size("own") - F.col("j"), F.size("ranks") - earlier)
    candidates = different.where(most >= F.col("need")).withColumn("near", F.filter("near", lambda x: F.array_contains("own", x["rank"])))
    starts = F.filter("near", lambda x: x["at"] <= F.col("at"))

    def held(start):
        inside = F.filter("near", lambda x: (x["at"] >= start["at"]) & (x["at"] < start["at"] + F.col("span")))
        return F.size(F.array_distinct(F.transform(inside, lambda x: x["rank"])))

    both = candidates.withColumn("common", F.array_max(F.transform(starts, held))).where(F.col("common") >= F.col("need"))
    return both.groupBy("_row").agg(F.array_sort(F.collect_set("label")).alias("method_labels"), F.max(F.col("common") / F.size("own")).alias("containment"))


def places(phrase: str) -> F.Column:
    """Where the phrase's words stand consecutively, as starts; each is a hit, so they are neighbours in hits."""
    words = phrase.split()
    first = F.filter(F.transform("hits", lambda x, i: F.struct(x["at"].alias("at"), x["word"].alias("word"), i.alias("i"))), lambda x: x["word"] == words[0])

    def whole(x):
        follows = [(F.get("hits", x["i"] + k)["word"] == w) & (F.get("hits", x["i"] + k)["at"] == x["at"] + k) for k, w in enumerate(words) if k]
        return F.coalesce(reduce(lambda a, b: a & b, follows), F.lit(False))

    return F.transform(F.filter(first, whole), lambda x: x["at"].cast("long"))


def scan(docs: DataFrame, *, least: float = LEAST) -> DataFrame:
    """doc_id with the facts, labels and score of each text. Rows of equal doc_id and text share what is found."""
    texts = stored(found_words(docs))
    words = texts.select(F.explode("hits.word").alias("word"))
    found = template_labels(texts, word_order(words), least=least).withColumnRenamed("_row", "_r")
    starts = texts.select("doc_id", "_row", "n_words", *[places(p).alias(f"_{k}") for k, p in enumerate(PHRASES)])
    joined = starts.join(found, starts["_row"].eqNullSafe(F.col("_r")), "left")
    every = F.concat(*[F.col(f"_{k}") for k in range(len(PHRASES))])
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"_{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())])))
    labels = F.array_sort(F.array_union(base, F.coalesce("method_labels", F.array().cast("array<string>"))))
    score = F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0)))
    return joined.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).alias("first_word"), F.array_max(every).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    """The same by counting the words of blocks at every start, in the texts that hold enough of a template as a whole."""
    rows = ", ".join(f"({n}, '{label}', '{word}', {math.ceil(LEAST * len(own) - 1e-9)}, {len(own)}, {span})" for n, label, own, span in templates() for word in own)
    return rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
u as (select doc_id, generate_subscripts(w, 1) - 1 as i, unnest(w) as x from d),
n as (select *, lead(x) over p as x1, lead(x, 2) over p as x2 from u window p as (partition by doc_id order by i)),
base as (select doc_id, i, case when x = 'cc' and x1 = 'by' then 'cc-by' when x = 'general' and x1 = 'public' and x2 = 'license' then 'gpl' when x = 'all' and x1 = 'rights' and x2 = 'reserved' then 'reserved' end as label from n),
t(tmpl, label, word, need, size, span) as (values {rows}),
h as (select doc_id, i, x, tmpl, label, need, size, span from u join t on u.x = t.word),
e as (select doc_id, tmpl from h group by doc_id, tmpl, need having count(distinct x) >= need),
b as (select doc_id, unnest(range(greatest(i - span + 1, 0), i + 1)) as block, x, tmpl, label, need, size from h semi join e using (doc_id, tmpl)),
m as (select doc_id, block, tmpl, label, count(distinct x) as common, any_value(need) as need, any_value(size) as size from b group by 1, 2, 3, 4),
hit as (select doc_id, label, max(common / size) as share from m where common >= need group by 1, 2),
one as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from base where label is not null group by 1),
l as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from base where label is not null union select doc_id, label from hit) group by 1),
s as (select doc_id, max(share) as share from hit group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
case when n_base > 0 then 1.0e0 else coalesce(share, 0) end::double as score
from d left join one using (doc_id) left join l using (doc_id) left join s using (doc_id)
"""
