"""License scan by the Dice coefficient over word bigrams, in DataFrame operations only.

Every line and every whole text is normalised and compared to the templates. A text of ``a`` distinct bigrams can reach
a coefficient ``t`` with a template of ``b`` only if ``b t / (2 - t) <= a <= b (2 - t) / t``: all other templates are
pruned before any intersection. A text that lacks too many of every template's words is not looked into at all. In the words that are left, runs of consecutive words are compared, whatever lines and
sentences they lie in: a run starts and ends with a bigram of the template, and as many of the template's bigrams as the
threshold needs must lie close enough together before any run is compared.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import text_or_empty

#: Common one-paragraph license notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS"'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Full license texts, compared to runs of words only. Those of Apache-2.0 and GPL-3.0 hold notices of ``TEMPLATES``.
FULL_TEXTS = [
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_AS_IS} AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
]


def template_bigrams(text: str) -> list[str]:
    """Distinct bigrams of the normalised text, in order."""
    words = re.sub(r"[^\w]|_", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def size_bounds(n: int, threshold: float) -> tuple[float, float]:
    """How many distinct bigrams a text may have to reach the threshold with a template of n; rounding loses no case."""
    return n * threshold / (2 - threshold) - 1e-9, n * (2 - threshold) / threshold + 1e-9


@dataclass(frozen=True)
class Needed:
    """What a text must hold to reach the threshold with a template: one of ``anchors``, and words of ``least`` in all.

    A text that reaches it lacks at most ``lacking`` of the template's bigrams. A word that it does not hold costs it all
    bigrams with that word, so of words in more bigrams than that it holds one; and as a bigram has two words, the
    numbers of bigrams of the words it does not hold add up to twice ``lacking`` at most.
    """

    anchors: list[str]
    words: dict[str, int]
    least: int

    @classmethod
    def of(cls, bigrams: list[str], threshold: float) -> Needed:
        held = [set(b.split(" ")) for b in bigrams]
        lacking = len(bigrams) - math.ceil(size_bounds(len(bigrams), threshold)[0])
        words = {w: sum(w in h for h in held) for w in sorted(set().union(*held), key=lambda w: (-len(w), w))}
        chosen = [w for w, n in words.items() if n > lacking][:1]
        for word in words:
            if sum(not h.isdisjoint(chosen) for h in held) > lacking:
                break
            chosen.append(word)
        return cls(chosen, words, sum(words.values()) - 2 * lacking)


def _may_match(words: Column, known: list[tuple[str, list[str]]], threshold: float) -> Column:
    """False only for texts that no template can match."""
    needed = [Needed.of(b, threshold) for _, b in known]
    spec = json.dumps([{"anchors": n.anchors, "words": [{"word": w, "n": k} for w, k in n.words.items()], "least": n.least} for n in needed])
    rules = F.from_json(F.lit(spec), "array<struct<anchors:array<string>,words:array<struct<word:string,n:int>>,least:int>>")
    count = lambda held, rule: F.aggregate(rule["words"], F.lit(0), lambda a, x: a + F.when(F.array_contains(held, x["word"]), x["n"]).otherwise(F.lit(0)))
    every = _strings(sorted({w for n in needed for w in n.words}))
    return _let(F.array_intersect(words, every), lambda held: F.exists(rules, lambda rule: F.arrays_overlap(held, rule["anchors"]) & (count(held, rule) >= rule["least"])))


NO_WORD = r"[^\p{L}\p{N}]+"


def _words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), NO_WORD, -1), lambda w: w != "")


def _strings(values: list[str]) -> Column:
    """A constant array of strings without line feeds, as one literal."""
    return F.split(F.lit("\n".join(values)), "\n")


def _pairs(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def _bigrams(words: Column) -> Column:
    return F.array_distinct(_pairs(words))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _marks(pairs: Column, known: list[tuple[str, list[str]]]) -> Column:
    """(at, gram): where a text's bigrams are any template's."""
    grams = sorted({g for _, b in known for g in b})
    return F.filter(F.transform(pairs, lambda g, i: F.when(g.isin(grams), F.struct(i.alias("at"), g.alias("gram")))), lambda m: m.isNotNull())


def _starts(marks: Column, bigrams: list[str], threshold: float, then: Callable[[Column, Column, int, int], Column]) -> Column:
    """``then`` of the template's marks and of those, with index, from which the needed number of marks is near enough."""
    low, high = size_bounds(len(bigrams), threshold)
    need, most = math.ceil(low), math.floor(high)
    starts = lambda own: F.filter(F.transform(own, lambda m, i: F.when(F.get(own, i + (need - 1))["at"] - m["at"] < most, F.struct(m["at"].alias("at"), i.alias("i")))), lambda m: m.isNotNull())
    return _let(F.filter(marks, lambda m: F.array_contains(_strings(bigrams), m["gram"])), lambda own: then(own, starts(own), need, most))


def _runs(pairs: Column, marks: Column, near: Column, known: list[tuple[str, list[str]]], threshold: float) -> Column:
    """Runs of consecutive words that reach the threshold with a template: the best first, none that overlaps a better one."""

    def of(k: int, name: str, bigrams: list[str]) -> Column:
        def dice(at: Column, end: Column) -> Column:
            return _let(F.array_distinct(F.slice(pairs, at + 1, end - at + 1)), lambda w: 2.0 * F.size(F.array_intersect(w, _strings(bigrams))) / (F.size(w) + len(bigrams)))

        def compared(own: Column, starts: Column, need: int, most: int) -> Column:
            ends = lambda s: F.filter(F.slice(own, s["i"] + need, most), lambda e: e["at"] - s["at"] < most)
            return F.flatten(F.transform(starts, lambda s: F.transform(ends(s), lambda e: F.struct((-dice(s["at"], e["at"])).alias("less"), F.lit(name).alias("license"), s["at"].alias("at"), e["at"].alias("end")))))

        found = F.filter(_starts(marks, bigrams, threshold, compared), lambda x: -x["less"] >= threshold)
        return F.when(near[k], found).otherwise(F.array().cast("array<struct<less:double,license:string,at:int,end:int>>"))

    found = F.array_sort(F.concat(*[of(k, n, b) for k, (n, b) in enumerate(known)]))
    best = F.reduce(found, F.array().cast("array<struct<less:double,license:string,at:int,end:int>>"), lambda a, x: F.when(F.exists(a, lambda y: (y["at"] <= x["end"]) & (x["at"] <= y["end"])), a).otherwise(F.concat(a, F.array(x))))
    return F.transform(best, lambda x: F.struct((-x["less"]).alias("dice"), x["license"].alias("license")))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", full_texts: list[tuple[str, str]] = FULL_TEXTS) -> DataFrame:
    """One row per input row: id, license (of the best match, or null), dice (0 without match), n_matches, licenses.

    Lines of a text, and the text as a whole, are each compared to every template that the size bounds leave. Where the
    whole does not match, so are runs of consecutive words outside the lines that do, of any length within the size bounds,
    also to ``full_texts``; of overlapping runs the best counts. ``n_matches`` counts the lines, texts and runs that reach ``threshold`` with some template, ``licenses`` names all matched. Ties go to the
    first license by name. Null counts as empty: no match. Repeated rows, null ids and further columns are harmless; an
    empty table gives an empty result.
    """
    known = [(name, template_bigrams(text)) for name, text in templates]
    runs_of = known + [(name, template_bigrams(text)) for name, text in full_texts]
    low, _ = size_bounds(min(len(b) for _, b in known), threshold)
    _, high = size_bounds(max(len(b) for _, b in known), threshold)
    hit = "struct<dice:double,license:string>"
    better = lambda a, x: F.when(a.isNull() | (x["dice"] > a["dice"]) | ((x["dice"] == a["dice"]) & (x["license"] < a["license"])), x).otherwise(a)

    def best(unit: Column) -> Column:
        """The best template of a unit's distinct bigrams, or null."""

        def dice(name: str, bigrams: list[str]) -> Column:
            size = F.size(unit)
            fits = size.between(*size_bounds(len(bigrams), threshold))
            value = 2.0 * F.size(F.array_intersect(unit, _strings(bigrams))) / (size + len(bigrams))
            return F.when(fits, F.struct(value.alias("dice"), F.lit(name).alias("license")))

        found = F.filter(F.array(*[dice(n, b) for n, b in known]), lambda x: x.isNotNull() & (x["dice"] >= threshold))
        return F.when(F.size(unit).between(low, high), F.reduce(found, F.lit(None).cast(hit), better))

    raw = docs.select(id_col, text_or_empty(text_col).alias("_raw")).withColumn("_all", F.split(F.lower("_raw"), NO_WORD, -1))
    # A text that lacks too many words of every template counts as empty from here on.
    base = raw.select(id_col, F.when(_may_match(F.col("_all"), runs_of, threshold), F.col("_raw")).otherwise(F.lit("")).alias("_t"))
    split = base.withColumn("_lines", F.transform(F.split("_t", "\n", -1), _words))
    # A line of n words has at most n - 1 distinct bigrams; repeated words make fewer, so only the lower bound prunes words.
    lined = split.withColumn("_found", F.transform("_lines", lambda w: F.when(F.size(w) - 1 >= low, _let(_bigrams(w), best))))
    whole = lined.withColumn("_whole", F.when(F.size("_lines") > 1, _let(_bigrams(F.flatten("_lines")), best)))
    # Lines that match are left out of the runs: one word that is no template's stands for each.
    left = F.flatten(F.zip_with("_lines", "_found", lambda w, h: F.when(h.isNull(), w).otherwise(F.array(F.lit("\n")))))
    left = whole.withColumn("_pairs", F.when(F.col("_whole").isNull(), _let(left, _pairs))).withColumn("_marks", _marks(F.col("_pairs"), runs_of))
    near = F.array(*[_starts(F.col("_marks"), b, threshold, lambda own, starts, need, most: F.size(starts) > 0) for _, b in runs_of])
    marked = left.withColumn("_near", F.when(F.size("_marks") >= math.ceil(low), near))
    runs = F.when(F.array_contains("_near", True), _runs(F.col("_pairs"), F.col("_marks"), F.col("_near"), runs_of, threshold))
    no_hits = F.array().cast(f"array<{hit}>")
    units = F.filter(F.concat("_found", F.array("_whole")), lambda x: x.isNotNull())
    hits = marked.withColumn("_hits", F.concat(units, F.coalesce(runs, no_hits)))
    top = F.reduce("_hits", F.lit(None).cast(hit), better)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("_hits", lambda x: x["license"]))), ",")
    return hits.withColumn("_top", top).select(id_col, F.col("_top.license").alias("license"), F.coalesce(F.col("_top.dice"), F.lit(0.0)).alias("dice"), F.size("_hits").cast("long").alias("n_matches"), names.alias("licenses"))


def license_oracle(threshold: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """DuckDB SQL of :func:`scan_licenses` over ``documents``."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quoted(n)}, [{', '.join(map(quoted, template_bigrams(t)))}])" for k, (n, t) in enumerate(templates))
    return rf"""
        WITH tpl(k, license, grams) AS (VALUES {values}),
        lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS u FROM documents
                  UNION ALL SELECT doc_id, text FROM documents WHERE contains(text, chr(10))),
        w AS (SELECT row_number() OVER () AS unit, doc_id, list_filter(string_split_regex(lower(u), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM lines),
        g AS (SELECT unit, doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) >= 2),
        d AS (SELECT unit, doc_id, license, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM g JOIN tpl
              ON len(g) BETWEEN len(grams) * {threshold} / (2 - {threshold}) - 1e-9 AND len(grams) * (2 - {threshold}) / {threshold} + 1e-9),
        b AS (SELECT unit, doc_id, max(dice) AS dice, min_by(license, (-dice, license)) AS license FROM d WHERE dice >= {threshold} GROUP BY ALL),
        r AS (SELECT doc_id, min_by(license, (-dice, license)) AS license, max(dice) AS dice, count(*) AS n_matches,
                     array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses FROM b GROUP BY doc_id)
        SELECT doc_id, license, coalesce(dice, 0) AS dice, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses
        FROM documents LEFT JOIN r USING (doc_id)"""
