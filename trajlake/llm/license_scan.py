"""Licence scans: normalised text against licence templates, by Dice coefficient over word bigrams."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import cut

#: Public licence notices by SPDX identifier; in brackets what further wordings of a licence are.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-NC-4.0": 'Licensed under CC BY-NC 4.0.',
    "CC-BY-NC-4.0 (notice)": 'This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.',
    "CC-BY-4.0 (short)": 'Licensed under CC BY 4.0.',
    "CC-BY-SA-4.0": 'This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.',
    "CC-BY-SA-4.0 (short)": 'Licensed under CC BY-SA 4.0.',
    "CC-BY-ND-4.0": 'This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.',
    "CC-BY-ND-4.0 (short)": 'Licensed under CC BY-ND 4.0.',
    "CC-BY-NC-SA-4.0": 'This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.',
    "CC-BY-NC-SA-4.0 (short)": 'Licensed under CC BY-NC-SA 4.0.',
    "CC-BY-NC-ND-4.0": 'This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.',
    "CC-BY-NC-ND-4.0 (short)": 'Licensed under CC BY-NC-ND 4.0.',
    "MIT (text)": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC (text)": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause (text)": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause (text)": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.',
    "Apache-2.0 (notice)": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0 (notice)": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
    "GPL-2.0 (notice)": 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.',
    "GPL-2.0 (short)": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1 (short)": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "CC-BY-3.0": "This work is licensed under a Creative Commons Attribution 3.0 International License.",
    "CC-BY-3.0 (unported)": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-SA-3.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "LGPL-2.1": 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.',
    "AGPL-3.0 (notice)": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
    "Unlicense": 'This is free and unencumbered software released into the public domain.',
}


def _python_bigrams(text: str) -> list[str]:
    """The bigrams of a template: the same rule as ``_bigrams``, for the few literals of a plan."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def versions(name: str, grams: list[str]) -> list[str]:
    """Bigrams of which a match must have one to be of the version that a template's name ends in; none needs no such.

    The version's two numbers side by side where the template has them so, else what it has before the first.
    """
    found = re.search(r"-(\d+)\.(\d+)", name)
    if not found:
        return []
    both = " ".join(found.groups())
    return [both] if both in grams else [g for g in grams if g.endswith(f" {found[1]}")]


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def _bigrams(words: Column) -> Column:
    return F.array_distinct(_pairs(words))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a column that the optimizer doesn't compute again wherever it is used."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _literals(grams: Iterable[str]) -> Column:
    """An array of strings without ``|`` as one literal, however many they are."""
    return F.split(F.lit("|".join(grams)), r"\|")


def _ratio(threshold: float) -> tuple[int, int]:
    """The threshold as a fraction of whole numbers, so that no bound is rounded: 0.8 is 4 / 5."""
    f = Fraction(threshold).limit_denominator(10_000)
    return f.numerator, f.denominator


def _markers(grams: Mapping[str, list[str]], ratio: tuple[int, int]) -> list[str]:
    """Words and bigrams of which every match has one: without them, each template has too few bigrams left.

    Dice of ``a / b`` takes at least ``a / (2 b - a)`` of a template's bigrams. Long words come first, those that serve
    most templates; where only short words are left, bigrams do, which are as rare.
    """
    a, b = ratio
    left = {name: set(own) for name, own in grams.items()}
    spare = lambda name: (2 * b - a) * len(left[name]) - a * len(grams[name])  # noqa: E731  (at least 0: more are needed)
    has = lambda mark, gram: mark == gram or mark in gram.split()
    marks: list[str] = []
    for choices in ({w for own in grams.values() for g in own for w in g.split() if len(w) > 6}, {g for own in grams.values() for g in own}):
        while any(spare(n) >= 0 for n in left):
            gain = {c: sum(min(sum(has(c, g) for g in left[n]), 1 + spare(n) // (2 * b - a)) for n in left if spare(n) >= 0) for c in choices}
            best = max(choices, key=lambda c: (gain[c], len(c), c), default=None)
            if best is None or not gain[best]:
                break
            marks.append(best)
            left = {n: {g for g in own if not has(best, g)} for n, own in left.items()}
    return sorted(marks)


def _pattern(marks: list[str]) -> str:
    """One pattern for all markers in a lower-case text, by first letter, so that most places are told by one letter."""
    own = [m.replace(" ", r"[^\p{L}\p{N}]+") for m in marks]
    firsts = sorted({m[0] for m in own})
    return "|".join(f"{c}(?:{'|'.join(m[1:] for m in own if m[0] == c)})" for c in firsts)


def _marked(norm: Column, marks: list[str]) -> Column:
    """Whether a normalised text has a marker."""
    return norm.rlike(r"(?<![\p{L}\p{N}])(?:" + _pattern(marks) + r")(?![\p{L}\p{N}])")


def _windows(lines: DataFrame, grams: Mapping[str, list[str]], lengths: Mapping[str, int], threshold: float, best: Callable[[Column], Column]) -> DataFrame:
    """Matches of word windows, which neither overlap each other nor a matched line; ``lines`` has doc_id and _lines.

    A match shares at least t / (2 - t) of a template's bigrams, so only such texts and templates are looked at. There,
    windows of all lengths within the template's bounds start at each of its bigrams. A window smaller than the template
    counts as being of its size: else it would be more similar for leaving out the words that differ.
    """
    a, b = _ratio(threshold)
    docs = _once(lines, "_words", F.flatten("_lines.words"))
    shared = F.array_intersect(_bigrams(F.col("_words")), _literals(sorted({g for own in grams.values() for g in own})))
    docs = _once(docs, "_shared", shared)
    enough = F.array(*[F.when((2 * b - a) * F.size(F.array_intersect("_shared", _literals(own))) >= a * len(own), F.lit(k)) for k, own in grams.items()])
    docs = _once(docs, "_near", F.array_compact(enough)).where((F.size("_near") > 0) & ~F.coalesce(best(_bigrams(F.col("_words")))["dice"] >= threshold, F.lit(False)))
    # The position of each line's first word and of the word after its last, for all lines and for those that match.
    spans = F.aggregate("_lines", F.array().cast("array<struct<a:int,b:int,unit:int>>"), lambda acc, x: F.concat(acc, F.array(F.struct(
        F.coalesce(F.get(acc, F.size(acc) - 1)["b"], F.lit(0)).alias("a"), (F.coalesce(F.get(acc, F.size(acc) - 1)["b"], F.lit(0)) + F.size(x["words"])).alias("b"), x["unit"].alias("unit")))))
    matched = F.transform("_lines", lambda x: F.coalesce(best(_bigrams(x["words"]))["dice"] >= threshold, F.lit(False)))
    docs = _once(_once(_once(docs, "_spans", spans), "_pairs", _pairs(F.col("_words"))), "_matched", matched)
    docs = docs.withColumn("_taken", F.filter("_spans", lambda _, i: F.get("_matched", i)))
    table = F.create_map(*[x for k, own in grams.items() for x in (F.lit(k), F.struct(_literals(own).alias("grams"), _literals(versions(k, own)).alias("versions"), F.lit(lengths[k] * (2 * b - a) // a + 1).alias("most")))])

    def at(k: Column) -> Column:
        own = table[k]
        starts = F.filter(F.transform("_pairs", lambda g, i: F.when(F.array_contains(own["grams"], g), i)), lambda i: i.isNotNull())

        def grow(acc: Column, g: Column) -> Column:
            new = ~F.array_contains(acc["seen"], g)
            hits = acc["hits"] + F.when(new & F.array_contains(own["grams"], g), 1).otherwise(0)
            seen, length = F.when(new, F.array_append(acc["seen"], g)).otherwise(acc["seen"]), acc["length"] + 1
            dice = F.lit(2.0) * hits / (F.greatest(F.size(seen), F.size(own["grams"])) + F.size(own["grams"]))
            more = dice > acc["dice"]
            return F.struct(seen.alias("seen"), hits.alias("hits"), length.alias("length"), F.when(more, dice).otherwise(acc["dice"]).alias("dice"), F.when(more, length).otherwise(acc["end"]).alias("end"), F.when(more, F.size(seen)).otherwise(acc["n"]).alias("n"))

        zero = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).alias("hits"), F.lit(0).alias("length"), F.lit(0.0).alias("dice"), F.lit(0).alias("end"), F.lit(0).alias("n"))
        grown = lambda i: F.aggregate(F.slice("_pairs", i + 1, own["most"]), zero, grow)
        found = F.transform(starts, lambda i: F.transform(F.array(grown(i)), lambda x: F.struct((-x["dice"]).alias("order"), i.alias("a"), (i + x["end"] + 1).alias("b"), k.alias("license_id"), x["n"].alias("n")))[0])
        named = lambda x: (own["versions"][0] == "") | F.arrays_overlap(F.slice("_pairs", x["a"] + 1, x["b"] - x["a"] - 1), own["versions"])
        return F.filter(found, lambda x: (-x["order"] >= threshold) & named(x))

    docs = _once(docs, "_found", F.array_sort(F.flatten(F.transform("_near", at))))
    apart = lambda x, y: (x["b"] <= y["a"]) | (x["a"] >= y["b"])
    free = F.filter("_found", lambda x: F.forall("_taken", lambda y: apart(x, y)))
    kept = F.aggregate(free, F.slice(free, 1, 0), lambda acc, x: F.when(F.forall(acc, lambda y: apart(x, y)), F.array_append(acc, x)).otherwise(acc))
    hits = docs.select("doc_id", "_spans", F.explode(kept).alias("_w"))
    line = F.filter("_spans", lambda y: (y["a"] <= F.col("_w.a")) & (F.col("_w.a") < y["b"]))[0]["unit"]
    return hits.select("doc_id", (F.lit(-2) - line).cast("long").alias("unit"), "_w.license_id", F.col("_w.n").cast("long").alias("n_bigrams"), (-F.col("_w.order")).alias("dice"))


def scan_licenses(docs: DataFrame, *, templates: Mapping[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """Licence matches of whole texts: doc_id, unit, license_id, wording, n_bigrams, dice.

    Normalised: lower case, everything but letters and digits is space. Compared are every line (``unit`` 0, 1, ...)
    and the whole text (-1, if it has several lines with words), and, where the whole text matches nothing, windows of
    words across lines or within one (-2 minus the line that they start in). Dice is ``2 shared / (own + template's)``
    over sets of word bigrams. It can reach the threshold t only with between ``t / (2 - t)`` and ``(2 - t) / t`` times
    the template's bigrams, so other templates are left out before anything is intersected; all bounds are compared in
    whole numbers. Before that, texts and lines without any of a few words and bigrams that every match has (see
    ``_markers``) are left out by a search. No shuffle.

    A template's name is an SPDX id (``license_id``), with a further wording in brackets. A template whose id ends in a
    version matches only text that names this version (``versions``): other versions' notices are nearly the same.

    Defined results: null and empty texts and lines of one word match nothing; texts of any length are compared whole;
    of several templates that match, the most similar one counts, then the last by name; repeated rows give repeated
    matches; an empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    grams = {k: _python_bigrams(v) for k, v in (templates or TEMPLATES).items()}
    grams = {k: v for k, v in grams.items() if v}
    a, b = _ratio(threshold)
    marks = _markers(grams, (a, b))
    low = docs.select("doc_id", F.lower("text").alias("_low")).where(F.col("_low").rlike(_pattern(marks)))  # one search, before anything is normalised
    norm = _once(low, "_norm", F.regexp_replace("_low", r"[^\p{L}\p{N}\n]+", " ")).select("doc_id", "_norm")
    norm = cut(norm.where(_marked(F.col("_norm"), marks)))  # few texts: the rest reads them several times
    some = lambda s, by: F.filter(F.split(s, by), lambda w: w != "")
    line = lambda text, i: F.struct(i.alias("unit"), some(text, " ").alias("words"))
    lines = F.filter(F.transform(F.split("_norm", "\n"), line), lambda x: F.size(x["words"]) > 0)
    few, many = min(len(v) for v in grams.values()), max(len(v) for v in grams.values())
    fits = lambda n: ((2 * b - a) * n >= a * few) & (a * n <= (2 * b - a) * many)
    marked = F.filter(F.transform(F.split("_norm", "\n"), lambda text, i: F.struct(text.alias("text"), i.alias("i"))), lambda x: _marked(x["text"], marks))
    alone = norm.select("doc_id", F.explode(F.transform(marked, lambda x: line(x["text"], x["i"]))).alias("u"))
    whole = _once(norm.where(F.size(F.filter(F.split("_norm", "\n"), lambda x: F.trim(x) != "")) > 1), "u", F.struct(F.lit(-1).alias("unit"), some(F.col("_norm"), "[ \n]+").alias("words"))).select("doc_id", "u")
    units = alone.unionByName(whole).where((2 * b - a) * (F.size("u.words") - 1) >= a * few)
    units = _once(units, "_b", _bigrams(F.col("u.words"))).select("doc_id", "u.unit", "_b", F.size("_b").alias("_n")).where(fits(F.col("_n")))

    def best(own: Column) -> Column:
        scores, n = [], F.size(own)
        for name, template in grams.items():
            m = len(template)
            near = ((2 * b - a) * n >= a * m) & (a * n <= (2 * b - a) * m)
            dice = F.lit(2.0) * F.size(F.array_intersect(own, _literals(template))) / (n + m)
            if needed := versions(name, template):
                near &= F.arrays_overlap(own, _literals(needed))
            scores.append(F.when(near, F.struct(dice.alias("dice"), F.lit(name).alias("license_id"))))
        return F.array_max(F.array(*scores))

    units = _once(units, "_hit", best(F.col("_b"))).where(F.col("_hit.dice") >= threshold)
    units = units.select("doc_id", F.col("unit").cast("long").alias("unit"), "_hit.license_id", F.col("_n").cast("long").alias("n_bigrams"), "_hit.dice")
    lengths = {k: len("".join(c if c.isalnum() else " " for c in v.lower()).split()) for k, v in (templates or TEMPLATES).items()}
    found = units.unionByName(_windows(_once(norm, "_lines", lines).drop("_norm"), grams, lengths, threshold, best)).withColumnRenamed("license_id", "wording")
    return found.select("doc_id", "unit", F.regexp_replace("wording", r" \(.*\)$", "").alias("license_id"), "wording", "n_bigrams", "dice")
