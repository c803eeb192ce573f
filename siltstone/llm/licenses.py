"""License scans: Dice coefficient over word bigrams against license templates.

Every line of a text, and every paragraph of several lines, is normalised and
compared to the templates. A template is a candidate for a passage only if the
numbers of bigrams allow the threshold: with a Dice coefficient of t at least,
sizes differ by a factor of (2 - t) / t at most. All within the row: no shuffle.

Notices that share their line or paragraph with other words, or are wrapped, and whole
licenses are found by word windows over the whole text. A window begins and ends at
bigrams of the template, since others at its ends only lower the coefficient; and it
begins where a run of those does, or at the template's first one, since a window that
is extended to the left within a run has a coefficient at least as high.

Short licenses and notices are built in. Longer ones (Apache, GPL, MPL) are read from a
folder of license texts, such as a Linux distribution's, with :func:`from_folder`.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import table, text_of

BLANK = r"\n[\x20\x09-\x0D]*\n"

# Names and notices of public licenses.
TEMPLATES = {
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ARR": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
# Whole licenses, for windows only.
WHOLE = {
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + _AS_IS,
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS,
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Zlib-text": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
THRESHOLD = 0.8
GROUP = 256  # pieces of a text whose words are summed up together
FOLDER_CHARS = 4 << 20  # of all texts of a folder of licenses, which go to the driver and into the plan
HITS = "array<struct<passage:int,license:string,dice:double>>"


def once(value: Column, of) -> Column:
    """``of`` of a value that is computed once, however often ``of`` uses it."""
    return F.transform(F.array(value), of)[0]


def template_bigrams(text: str) -> list[str]:
    """As in :func:`bigrams`; templates have no letters beyond ASCII."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def bigrams(passage: Column) -> Column:
    """The distinct pairs of neighbouring words of letters and digits, in lower case."""
    return F.array_distinct(all_bigrams(passage))


def words(passage: Column) -> Column:
    return F.filter(F.split(F.lower(passage), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def all_bigrams(passage: Column) -> Column:
    return once(words(passage), lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def from_folder(spark: SparkSession, folder: str) -> dict[str, str]:
    """File name (without .txt) to text of every license text in a folder, for ``whole``.

    Raises beyond FOLDER_CHARS characters in all: more templates take several scans.
    """
    files = spark.read.option("wholetext", True).text(folder).select(F.col("_metadata.file_path").alias("path"), "value")
    total = files.agg(F.sum(F.length("value"))).first()[0] or 0
    if total > FOLDER_CHARS:
        raise ValueError(f"{total} characters of license texts; scan with {FOLDER_CHARS} at most at a time")
    return {PurePosixPath(r["path"]).name.removesuffix(".txt"): r["value"] for r in files.collect()}


def passages(text: Column) -> Column:
    """Lines, then paragraphs (between blank lines) of more than one line."""
    paragraphs = F.filter(F.split(text, r"\n[\x20\x09-\x0D]*\n"), lambda p: F.contains(p, F.lit("\n")))
    return F.concat(F.filter(F.split(text, "\n"), lambda p: p != ""), F.when(F.regexp_like(text, F.lit(r"\n[\x20\x09-\x0D]*\n")), paragraphs).otherwise(F.array().cast("array<string>")))


def passage_hits(text: Column, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """array<struct<passage, license, dice>>: every passage with each template it resembles.

    ``passage`` counts from 0 through lines that aren't empty, then paragraphs. A
    null or empty text has no hits; nor has a passage of fewer than two words.
    """
    known = {k: g for k, t in sorted(templates.items()) if (g := template_bigrams(t))}
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = min(len(g) * low for g in known.values()), max(len(g) * high for g in known.values())

    def compare(grams: Column, place: Column) -> Column:
        found = []
        for name, own in known.items():
            shared = F.size(F.array_intersect(grams, F.array(*[F.lit(x) for x in own])))
            dice = F.when(F.size(grams).between(len(own) * low, len(own) * high), 2.0 * shared / (F.size(grams) + len(own)))
            found.append(F.struct(place.alias("passage"), F.lit(name).alias("license"), dice.alias("dice")))
        none = F.array().cast(HITS)
        return F.when(F.size(grams).between(least, most), F.filter(F.array(*found), lambda x: x["dice"] >= threshold)).otherwise(none)

    return F.flatten(F.transform(F.transform(passages(text), bigrams), compare))


def word_sums(pieces: Column) -> Column:
    """struct<counts, groups>: the words of each piece, and those before each group of GROUP
    pieces, so that a piece's place takes a few steps however many pieces there are."""

    def grouped(counts: Column) -> Column:
        total = lambda i: F.aggregate(F.slice(counts, i * GROUP + 1, GROUP), F.lit(0), lambda a, x: a + x)
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(counts) / GROUP).cast("int")), total)
        step = lambda acc, x: F.struct((acc["n"] + x).alias("n"), F.array_append(acc["out"], acc["n"]).alias("out"))
        before = F.aggregate(sums, F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])
        return F.struct(counts.alias("counts"), before.alias("groups"))

    return once(F.transform(pieces, lambda p: F.size(words(p))), grouped)


def place_of(sums: Column, i: Column) -> Column:
    """struct<a, b>: the first and last word of the i-th piece, from 0."""
    group = F.floor(i / GROUP).cast("int")
    a = F.get(sums["groups"], group) + F.aggregate(F.slice(sums["counts"], group * GROUP + 1, i - group * GROUP), F.lit(0), lambda x, y: x + y)
    return F.struct(a.alias("a"), (a + F.get(sums["counts"], i) - 1).alias("b"))


def passage_places(text: Column, wanted: Column) -> Column:
    """array<struct<a, b>>: for each of the ``wanted`` of :func:`passages` (numbers from 0) the
    first and last of the text's words."""
    paragraphs = F.split(text, BLANK)
    several = F.array_compact(F.transform(paragraphs, lambda p, i: F.when(F.contains(p, F.lit("\n")), i)))
    parts = F.struct(word_sums(F.filter(F.split(text, "\n"), lambda p: p != "")).alias("lines"), word_sums(paragraphs).alias("blocks"), several.alias("several"))

    def placed(x: Column) -> Column:
        n = F.size(x["lines"]["counts"])
        block = lambda k: place_of(x["blocks"], F.get(x["several"], k - n))
        return F.transform(wanted, lambda k: F.when(k < n, place_of(x["lines"], k)).otherwise(block(k)))

    return once(parts, placed)


def found_hits(text: Column, passages_of: dict[str, str], templates: dict[str, str], threshold: float) -> Column:
    """:func:`passage_hits` of the first templates, then the word windows of the whole text
    that resemble one of the others, as hits without a passage.

    The text's bigrams are worked out once. Unless it has as many of a template's as a
    hit must share, nothing else is done with it.

    From every place where a run of the template's bigrams begins, the best window is
    taken; of overlapping ones of a template the best stays, and none that touches a
    passage that is a hit; of windows of several templates that mean the same words,
    those of the most alike template stay.
    """
    known = {k: g for k, t in sorted(templates.items()) if (g := template_bigrams(t))}
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    lists = lambda grams: F.split(F.lit(",".join(grams)), ",")
    all_templates = F.array(*[F.struct(F.lit(k).alias("license"), lists(g).alias("own"), F.lit(len(g)).alias("n")) for k, g in known.items()])
    every = lists(list(dict.fromkeys(x for g in known.values() for x in g)))
    none = F.array().cast(HITS)

    def best_from(marks: Column, start: Column, n: Column) -> Column:
        """The best window from a mark: a bigram counts where it is first met in the window."""

        def step(acc: Column, x: Column) -> Column:
            new = x["last"] < start["i"]
            size, shared = acc["size"] + new.cast("int"), acc["shared"] + (new & x["own"]).cast("int")
            dice = 2.0 * shared / (size + n)
            better = dice > acc["dice"]
            return F.struct(size.alias("size"), shared.alias("shared"), F.when(better, dice).otherwise(acc["dice"]).alias("dice"), F.when(better, x["i"]).otherwise(acc["end"]).alias("end"))

        zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("shared"), F.lit(0.0).alias("dice"), F.lit(-1).alias("end"))
        within = F.slice(marks, start["i"] + 1, F.floor(n * high + 1e-9).cast("int"))
        return F.aggregate(within, zero, step, lambda acc: F.struct(start["i"].alias("a"), (acc["end"] + 1).alias("b"), acc["dice"].alias("dice")))

    def apart(windows: Column) -> Column:
        """Of overlapping windows (sorted by their start) the best, of equals the first."""

        def step(acc: Column, x: Column) -> Column:
            last = F.element_at(acc, -1)
            kept = F.when(x["dice"] > last["dice"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))).otherwise(acc)
            return F.when(F.size(acc) == 0, F.array(x)).when(x["a"] > last["b"], F.concat(acc, F.array(x))).otherwise(kept)

        return F.aggregate(windows, F.array().cast("array<struct<a:int,b:int,dice:double>>"), step)

    def of_template(t: Column, met: Column, taken: Column) -> Column:
        def search(marks: Column) -> Column:
            begins = lambda x, i: x["own"] & (x["first"] | (i == 0) | ~F.coalesce(F.get(marks, i - 1)["own"], F.lit(False)))
            found = F.transform(F.filter(marks, begins), lambda x: best_from(marks, x, t["n"]))
            free = F.filter(found, lambda x: (x["dice"] >= threshold) & ~F.exists(taken, lambda h: (h["license"] == t["license"]) & (h["a"] <= x["b"]) & (x["a"] <= h["b"])))
            return F.transform(apart(free), lambda x: F.struct(t["license"].alias("license"), x["a"].alias("a"), x["b"].alias("b"), x["dice"].alias("dice")))

        marks = F.transform(met, lambda x: F.struct(x["i"].alias("i"), x["last"].alias("last"), F.array_contains(t["own"], x["g"]).alias("own"), (x["g"] == t["own"][0]).alias("first")))
        return once(marks, search)

    def most_alike(windows: Column) -> Column:
        """Hits of the windows, without those that lie half or more within half or more of a better one."""

        def beats(y: Column, x: Column) -> Column:
            common = F.least(x["b"], y["b"]) - F.greatest(x["a"], y["a"])
            return (y["dice"] > x["dice"]) & (2 * common >= F.greatest(x["b"] - x["a"], y["b"] - y["a"]))

        kept = lambda ws: F.filter(ws, lambda x: ~F.exists(ws, lambda y: beats(y, x)))
        return F.transform(once(windows, kept), lambda x: F.struct(F.lit(None).cast("int").alias("passage"), x["license"], x["dice"]))

    def search_text(grams: Column, near: Column, hits: Column) -> Column:
        ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        before = lambda o: F.concat(F.array(F.struct(F.lit("").alias("g"), F.lit(-1).alias("i"))), F.slice(o, 1, F.size(o) - 1))
        met = once(ordered, lambda o: F.zip_with(o, before(o), lambda x, y: F.struct(x["i"].alias("i"), F.when(x["g"] == y["g"], y["i"]).otherwise(-1).alias("last"), x["g"].alias("g"))))
        places = passage_places(text, F.transform(hits, lambda h: h["passage"]))
        taken = F.when(F.size(hits) > 0, F.zip_with(hits, places, lambda h, x: F.struct(h["license"].alias("license"), x["a"].alias("a"), x["b"].alias("b"))))
        no_hits = F.array().cast("array<struct<license:string,a:int,b:int>>")
        return once(F.struct(F.array_sort(met).alias("met"), F.coalesce(taken, no_hits).alias("taken")), lambda x: most_alike(F.flatten(F.transform(near, lambda t: of_template(t, x["met"], x["taken"])))))

    def resembled(grams: Column) -> Column:
        near = once(F.array_intersect(grams, every), lambda seen: F.when(F.size(seen) > 0, F.filter(all_templates, lambda t: F.size(F.array_intersect(seen, t["own"])) >= t["n"] * low - 1e-9)))
        both = lambda ts: once(passage_hits(text, passages_of, threshold), lambda hits: F.concat(hits, search_text(grams, ts, hits)))
        return once(near, lambda ts: F.when(F.size(F.coalesce(ts, F.array().cast(near_type))) > 0, both(ts)).otherwise(none))

    near_type = "array<struct<license:string,own:array<string>,n:int>>"
    return once(all_bigrams(text), resembled)


def license_hits(text: Column, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, whole: dict[str, str] = WHOLE) -> Column:
    """:func:`passage_hits`, then windows of the text (``passage`` null) that they don't cover."""
    return once(text, lambda t: found_hits(t, templates, {**templates, **whole}, threshold))


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, whole: dict[str, str] = WHOLE) -> DataFrame:
    """doc_id and hits, for each row of ``docs``.

    A null or empty text has no hits, nor has one of fewer than two words; whole texts
    are searched, however long; repeated rows get equal hits; templates that tie in
    their coefficient are all hits; an empty table gives an empty result; other
    columns, whatever their names, aren't read.
    """
    return docs.select("doc_id", license_hits(text_of(docs), templates, threshold, whole).alias("hits"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the number of hits, the distinct licenses, and the best hit (of
    equals the first by name), null where there is none."""
    hits = F.col("hits")
    best = F.array_min(F.transform(hits, lambda x: F.struct((-x["dice"]).alias("d"), x["license"].alias("license"))))
    return scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.size(hits).cast("long").alias("n_hits"),
        F.array_join(F.array_sort(F.array_distinct(hits["license"])), ",").alias("licenses"),
        best["license"].alias("best_license"),
        (-best["d"]).alias("best_dice"),
    )


def oracle_sql() -> str:
    """The lines and paragraphs, with bigrams that SQL makes of the templates' texts."""
    values = ", ".join("('" + k.replace("'", "''") + "', '" + t.replace("'", "''") + "')" for k, t in sorted(TEMPLATES.items()))
    low, high = THRESHOLD / (2 - THRESHOLD), (2 - THRESHOLD) / THRESHOLD
    return rf"""
WITH texts(license, t) AS (VALUES {values}),
split AS (SELECT license, list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM texts),
templates AS (SELECT license, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS own FROM split),
lines AS (
  SELECT doc_id, unnest(list_concat(
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda p: p <> ''),
    CASE WHEN regexp_matches(coalesce(text, ''), '\n[\x20\x09-\x0D]*\n')
         THEN list_filter(regexp_split_to_array(coalesce(text, ''), '\n[\x20\x09-\x0D]*\n'), lambda p: contains(p, chr(10))) ELSE [] END)) AS p
  FROM documents),
words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(p), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM lines),
grams AS (
  SELECT doc_id, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS g FROM words),
hits AS (
  SELECT doc_id, license, 2.0::DOUBLE * len(list_intersect(g, own)) / (len(g) + len(own)) AS dice
  FROM grams JOIN templates ON len(g) BETWEEN len(own) * {low} AND len(own) * {high}),
per AS (
  SELECT doc_id, count(*) AS n_hits, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
         arg_min(license, (-dice, license)) AS best_license, max(dice) AS best_dice
  FROM hits WHERE dice >= {THRESHOLD} GROUP BY doc_id)
SELECT doc_id, coalesce(n_hits, 0)::BIGINT AS n_hits, coalesce(licenses, '') AS licenses, best_license, best_dice
FROM documents LEFT JOIN per USING (doc_id)
"""
