"""License texts in documents, found by votes: where many word runs of a template stand at the same offset, it stands there.

Every run of four words of every document is hashed and joined by Spark with the runs of the templates. A hit votes for a
diagonal, the document's position less the template's; diagonals a few words apart belong to one place in which
words were put in or left out. What counts are the template's words that lie in runs held to be equal word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, lower_ascii, written

#: Words of a run; a place is kept if so much of its template lies in equal runs and it is at most so many times as long.
RUN, LEAST_SHARE, MOST_LONG = 4, 0.7, 1.5

# Phrases whose plain places are counted, with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Notices by which licenses are given, with their labels.
TEMPLATES = [
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    ),
    ("mit", "Released under the MIT License."),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
        License.""",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
        either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of
        the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source
        code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely""",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]


def plain(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with one blank between them."""
    return F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def words_of(line: Column) -> Column:
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def runs(words: Column) -> Column:
    """Hashes of all runs of four words, by position."""
    n = F.size(words) - RUN + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, RUN)))).otherwise(F.array().cast("array<long>"))


def template_runs(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """``(template, tpos, gram, run, label, length)``: each template's runs of words with their hashes."""
    given = spark.createDataFrame([(k, label, text) for k, (label, text) in enumerate(templates)], "template int, label string, notice string")
    cut = given.select("template", "label", words_of(plain(F.col("notice"))).alias("w")).withColumn("length", F.size("w"))
    each = cut.select("template", "label", "length", "w", F.posexplode(runs(F.col("w"))).alias("tpos", "gram"))
    return each.select("template", "tpos", "gram", F.slice("w", F.col("tpos") + 1, RUN).alias("run"), "label", "length")


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, text: str = "text") -> DataFrame:
    """``docs`` without their text, and ``n_words``, ``phrases`` (label, start) and ``notices`` (label, start, end, score) of each.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the whole text, A-Z lower-cased, counted from 0. ``phrases``: each place where a
    phrase's words stand one after another. ``notices``: places (end exclusive) of templates; diagonals up to an eighth of the
    template's length apart, 8 words at most, are one place. A notice is kept if ``LEAST_SHARE`` of the template's words lie in equal
    runs of four words (its score) and it is at most ``MOST_LONG`` times as long; templates under four words are never found.

    A null text is empty; repeated rows and ids are scanned one by one; both lists are sorted, so ties have one order; an empty
    table gives an empty result; columns with the new names are replaced. Runs of all positions of texts of any length are
    joined; templates are broadcast while they have at most ``BROADCAST_ROWS`` runs.
    """
    new = ("n_words", "phrases", "notices")
    others = [c for c in docs.columns if c not in (*new, text)]
    lines = docs.select(F.struct(*others).alias("doc") if others else F.struct(F.lit(0)).alias("doc"), plain(F.col(text)).alias("line"))
    cut = lines.select(F.monotonically_increasing_id().alias("row"), "doc", "line", words_of(F.col("line")).alias("w"))
    places = [_places(F.col("line"), F.col("w"), phrase, label) for phrase, label in phrases]
    found = F.array_sort(F.concat(*places)) if places else F.array().cast("array<struct<label:string,start:long>>")
    # the first entry of each document's list is no run: its row keeps the document, whether or not a run is found
    cut = cut.select("row", "w", F.struct("doc", F.size("w").cast("long").alias("n_words"), found.alias("phrases")).alias("head"), F.concat(F.array(F.lit(0).cast("long")), runs(F.col("w"))).alias("grams"))
    each = cut.select("row", "w", "head", F.posexplode("grams").alias("pos", "gram"))
    # a row carries its own four words, not its document's, and the first entry's row all else of the document
    own = F.when(F.col("pos") > 0, F.slice("w", F.greatest("pos", F.lit(1)), RUN)).alias("own")
    each = each.select("row", "pos", "gram", F.when(F.col("pos") == 0, F.col("head")).alias("head"), own)
    known = template_runs(docs.sparkSession, templates)
    nothing = docs.sparkSession.range(1).select(*[(F.lit(0) if f.name == "gram" else F.lit(None)).cast(f.dataType).alias(f.name) for f in known.schema])
    known = known.union(nothing)
    if sum(t.count(" ") + t.count("\n") + 1 for _, t in templates) <= BROADCAST_ROWS:
        known = F.broadcast(known)
    hits = each.join(known, (each["gram"] == known["gram"]) & each["own"].eqNullSafe(known["run"]))
    hits = written(hits.select("row", "head", (F.col("pos") - 1).alias("pos"), "template", "tpos", "label", "length"), "license-hits")
    notices = _notices(hits.where("template is not null").drop("head")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", "start", "end", "score"))).alias("notices"))
    blank = F.array().cast("array<struct<label:string,start:long,end:long,score:double>>")
    whole = hits.where("template is null").select("row", "head").join(notices, "row", "left")
    return whole.select(*[F.col("head.doc")[c].alias(c) for c in others], "head.n_words", "head.phrases", F.coalesce("notices", blank).alias("notices"))


def _places(line: Column, words: Column, phrase: str, label: str) -> Column:
    parts = phrase.split()
    at = lambda i: F.forall(F.sequence(F.lit(0), F.lit(len(parts) - 1)), lambda k: F.element_at(words, (i + k + 1).cast("int")) == F.element_at(F.array(*map(F.lit, parts)), (k + 1).cast("int")))
    every = F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0)))
    starts = F.transform(F.filter(every, at), lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start")))
    there = F.contains(F.concat(F.lit(" "), line, F.lit(" ")), F.lit(f" {phrase} "))
    return F.when(there, starts).otherwise(F.array().cast("array<struct<label:string,start:long>>"))


def _notices(hits: DataFrame) -> DataFrame:
    """``(row, label, start, end, score)`` of templates, from ``(row, pos, template, tpos, label, length)`` of equal runs."""
    votes = hits.groupBy("row", "template", "label", "length", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("held"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.greatest(F.lit(1), F.least(F.lit(8), F.floor(F.col("length") / 8)))
    step = F.col("diagonal") - F.lag("diagonal").over(along)
    placed = votes.withColumn("new", F.when(step <= apart, 0).otherwise(1)).withColumn("place", F.sum("new").over(along))
    ends = placed.withColumns({"from": F.col("diagonal") + F.array_min("held"), "to": F.col("diagonal") + F.array_max("held") + RUN})
    merged = ends.groupBy("row", "template", "label", "length", "place").agg(
        F.min("from").cast("long").alias("start"), F.max("to").cast("long").alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("held")))).alias("held")
    )
    # words that the runs cover: each run adds four, or as many as it is further than the one before
    covered = F.expr(f"aggregate(held, named_struct('last', cast(-{RUN} as int), 'n', 0), (a, t) -> named_struct('last', t, 'n', a.n + least({RUN}, t - a.last)), a -> a.n)")
    scored = merged.withColumn("score", covered / F.col("length"))
    kept = (F.col("score") >= LEAST_SHARE) & (F.col("end") - F.col("start") <= MOST_LONG * F.col("length"))
    return scored.where(kept).select("row", "label", "start", "end", "score")


def license_digest(scanned: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``: the places of phrases, and all labels of a
    document; its score is 1 with a phrase, else that of its best notice, 0 without one."""
    starts, base, own = F.transform("phrases", lambda p: p["start"]), F.transform("phrases", lambda p: p["label"]), F.transform("notices", lambda p: p["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("notices", lambda p: p["score"])), F.lit(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(best).alias("score"),
    )
