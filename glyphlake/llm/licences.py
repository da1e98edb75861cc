"""Licence scans by Dice coefficients over word bigrams (operator 1), in Spark SQL functions only.

Units of a document are its lines, the whole text where it has several, and
passages: word windows as long as a template, which find notices that are wrapped
over lines or stand inside other prose.  A unit is normalised (A-Z in lower case, every other character than a-z and 0-9 a
separator) and its set of word bigrams is compared with those of each template.
Two sets of sizes a and b reach a Dice coefficient t only if
``a * t <= b * (2 - t)`` and the reverse: units and templates whose sizes can't
match are left out before any comparison.  A window opens at a bigram that its
template has and reaches t only if it holds ``b * t / (2 - t)`` such bigrams: windows
with fewer are left out by their places alone.  Everything happens inside one row, so
nothing is shuffled and a hot source or group of copies costs no more than others.

Defined cases: a null or empty text has no units and no licence; ties go to the
first identifier, and to the first of a template's best windows; repeated rows return
once each; a very long text is compared whole, in memory in proportion to its words;
columns of df named like ``into`` or ``passages`` are an error; an empty table gives
an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glyphlake.llm.common import table

#: Least Dice coefficient of a match.
THRESHOLD = 0.8

# Notices of public licences, the opening paragraphs of two, and whole texts.
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES: dict[str, str] = {
    "agpl-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "bsd-2-clause": "Released under the BSD 2-Clause License.",
    "bsd-2-clause-text": f"{_BSD_2}\n{_BSD_END}",
    "bsd-3-clause": "Released under the BSD 3-Clause License.",
    "bsd-3-clause-text": f"{_BSD_2}\n{_BSD_3}\n{_BSD_END}",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": _ISC_GRANT,
    "isc-text": _ISC_GRANT + """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "lgpl-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-permission": _MIT_GRANT,
    "mit-text": _MIT_GRANT + """
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_words(text: str) -> list[str]:
    """Words of a template, normalised like units."""
    low = text.translate(str.maketrans(_UP, _LOW))
    return "".join(c if c in _LOW or c in "0123456789" else " " for c in low).split()


def bigrams(words: list[str]) -> list[str]:
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def _may_match(a: Column, b: Column, mille: int) -> Column:
    """The size bound, in whole thousandths so that a bound that is just met holds."""
    return (a * mille <= b * (2000 - mille)) & (b * mille <= a * (2000 - mille))


def _unit_words(line: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.translate(line, _UP, _LOW), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _unit_bigrams(words: Column) -> Column:
    return F.array_distinct(F.transform(F.slice(words, F.lit(2), F.size(words) - 1), lambda w, i: F.concat(F.get(words, i), F.lit(" "), w)))


def licence_hits(df: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text", into: str = "_hits", passages: str = "_passages") -> DataFrame:
    """``df`` with ``into``: an array of (score, licence, unit) of every match; unit 0 .. n-1 are lines, -1 the whole text;
    and ``passages``: (score, licence, word) of each template's best window, by the word where it begins."""
    if {into, passages} & set(df.columns):
        raise ValueError(f"df has a column named {into} or {passages}")
    sets = {k: bigrams(normal_words(v)) for k, v in sorted(templates.items())}
    sizes = [len(s) for s in sets.values()]
    mille = round(1000 * threshold)
    # A unit of n words has n - 1 bigrams at most: too few words rule it out at once.
    least = -(-min(sizes) * mille // (2000 - mille))
    known = F.array(*[F.struct(F.lit(k).alias("licence"), F.array(*map(F.lit, s)).alias("grams")) for k, s in sets.items()])
    temporary = next(c for i in range(len(df.columns) + 1) if (c := f"_words{i}") not in df.columns)
    lines = df.withColumn(temporary, F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), _unit_words))
    whole = F.when(F.size(temporary) > 1, F.array(F.struct(F.lit(-1).alias("unit"), F.flatten(temporary).alias("words")))).otherwise(F.expr("cast(array() as array<struct<unit:int,words:array<string>>>)"))
    units = F.concat(F.transform(temporary, lambda w, i: F.struct(i.alias("unit"), w.alias("words"))), whole)
    units = F.filter(units, lambda u: F.size(u["words"]) > least)
    sets_of = F.transform(units, lambda u: F.struct(u["unit"].alias("unit"), _unit_bigrams(u["words"]).alias("grams")))
    longest = F.lit(max(sizes) * (2000 - mille) // mille)
    sets_of = F.filter(sets_of, lambda u: F.size(u["grams"]) <= longest)

    def compared(u: Column) -> Column:
        near = F.filter(known, lambda t: _may_match(F.size(u["grams"]), F.size(t["grams"]), mille))
        scores = F.transform(near, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(u["grams"], t["grams"])) / (F.size(u["grams"]) + F.size(t["grams"]))).alias("score"), t["licence"].alias("licence"), u["unit"].alias("unit")))
        return F.filter(scores, lambda h: h["score"] >= threshold)

    found = _passages(F.flatten(temporary), {k: (len(normal_words(templates[k])), s) for k, s in sets.items()}, threshold)
    return lines.withColumns({into: F.flatten(F.transform(sets_of, compared)), passages: found}).drop(temporary)


def _least_shared(n: int, threshold: float) -> int:
    """Bigrams of a template of n that a window must hold to reach the threshold: as many as it has itself, at best."""
    mille = round(1000 * threshold)
    return -(-n * mille // (2000 - mille))


def _once(value: Column, use) -> Column:
    """``use(value)``, with value computed once and not for each element of a nested function."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _passages(words: Column, sets: dict[str, tuple[int, list[str]]], threshold: float) -> Column:
    """Each template's best window of its own number of words, if it reaches the threshold."""
    grams = sorted({g for _, s in sets.values() for g in s})
    known = F.array(*[F.struct(F.lit(k).alias("licence"), F.lit(n).alias("n"), F.lit(_least_shared(len(s), threshold)).alias("least"), F.array(*map(F.lit, s)).alias("grams")) for k, (n, s) in sets.items()])

    def of_words(ws: Column) -> Column:
        marked = F.transform(ws, lambda w, i: _once(F.concat(w, F.lit(" "), F.get(ws, i + 1)), lambda g: F.when(g.isin(grams), F.struct(i.alias("at"), g.alias("gram")))))
        return _once(F.filter(marked, lambda m: m.isNotNull()), lambda places: F.filter(F.transform(known, lambda t: best(ws, places, t)), lambda h: h["score"] >= threshold))

    def best(ws: Column, places: Column, t: Column) -> Column:
        own = F.transform(F.filter(places, lambda m: F.array_contains(t["grams"], m["gram"])), lambda m: m["at"])
        starts = _once(own, lambda at: F.filter(at, lambda p, i: F.get(at, i + t["least"] - 1) - p <= t["n"] - 2))
        scored = F.transform(starts, lambda p: _once(_unit_bigrams(F.slice(ws, p + 1, t["n"])), lambda g: F.struct((F.lit(2.0) * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + F.size(t["grams"]))).alias("score"), (-p).alias("back"))))
        return _once(F.array_max(scored), lambda h: F.struct(h["score"].alias("score"), t["licence"].alias("licence"), (-h["back"]).alias("word")))

    return _once(words, of_words)


def op1_licence_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = licence_hits(docs).drop("text")
    every = F.concat(*[F.transform(c, lambda h: F.struct(h["score"].alias("score"), h["licence"].alias("licence"))) for c in ("_hits", "_passages")])
    hits = hits.withColumn("_every", every).withColumn("_best", F.array_max(F.transform("_every", lambda h: h["score"])))
    first = F.array_min(F.transform(F.filter("_every", lambda h: h["score"] == F.col("_best")), lambda h: h["licence"]))
    return hits.select("doc_id", first.alias("licence"), F.col("_best").alias("score"), F.size("_hits").cast("bigint").alias("n_matches"), F.size("_passages").cast("bigint").alias("n_passages"))


def _sql() -> str:
    values = ", ".join("('{}', '{}')".format(k, " ".join(normal_words(v))) for k, v in sorted(TEMPLATES.items()))
    return f"""
WITH template(licence, body) AS (VALUES {values}),
template_words AS (SELECT licence, string_split(body, ' ') AS w FROM template),
template_grams AS (SELECT DISTINCT licence, w[i] || ' ' || w[i + 1] AS g FROM (SELECT licence, w, unnest(range(1, len(w))) AS i FROM template_words)),
template_size AS (SELECT licence, count(*) AS b FROM template_grams GROUP BY licence),
doc AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT r, unnest(range(1, len(lines) + 1)) AS unit, lines FROM doc),
unit AS (SELECT r, unit, lines[unit] AS body FROM line UNION ALL SELECT r, -1, array_to_string(lines, ' ') FROM doc WHERE len(lines) > 1),
words AS (SELECT r, unit, list_filter(string_split(regexp_replace(translate(body, '{_UP}', '{_LOW}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM unit),
grams AS (SELECT DISTINCT r, unit, w[i] || ' ' || w[i + 1] AS g FROM (SELECT r, unit, w, unnest(range(1, len(w))) AS i FROM words)),
size AS (SELECT r, unit, count(*) AS a FROM grams GROUP BY ALL),
shared AS (SELECT r, unit, licence, count(*) AS n FROM grams JOIN template_grams USING (g) GROUP BY ALL),
hit AS (SELECT r, licence, 2.0::DOUBLE * n / (a + b) AS score FROM shared JOIN size USING (r, unit) JOIN template_size USING (licence) WHERE 2.0::DOUBLE * n / (a + b) >= {THRESHOLD}),
text_words AS (SELECT r, list_filter(string_split(regexp_replace(translate(array_to_string(lines, ' '), '{_UP}', '{_LOW}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM doc),
text_grams AS (SELECT r, i, w[i] || ' ' || w[i + 1] AS g FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM text_words)),
place AS (SELECT r, licence, i, g FROM text_grams JOIN template_grams USING (g)),
opening AS (SELECT p.r, p.licence, p.i, len(t.w) AS n, count(DISTINCT q.g) AS shared FROM place p JOIN template_words t USING (licence) JOIN place q ON q.r = p.r AND q.licence = p.licence AND q.i BETWEEN p.i AND p.i + len(t.w) - 2 GROUP BY ALL),
passage AS (SELECT o.r, o.licence, o.i, max(2.0::DOUBLE * shared) AS twice, count(DISTINCT x.g) AS a FROM opening o JOIN template_size s USING (licence) JOIN text_grams x ON x.r = o.r AND x.i BETWEEN o.i AND o.i + o.n - 2 WHERE 2 * shared >= {THRESHOLD} * s.b GROUP BY ALL),
found AS (SELECT r, licence, max(twice / (a + b)) AS score FROM passage JOIN template_size USING (licence) WHERE twice / (a + b) >= {THRESHOLD} GROUP BY ALL),
counted AS (SELECT r, count(*) AS n FROM hit GROUP BY r),
counted_found AS (SELECT r, count(*) AS n FROM found GROUP BY r),
every AS (SELECT r, licence, score FROM hit UNION ALL SELECT r, licence, score FROM found),
best AS (SELECT r, max(score) AS score FROM every GROUP BY r)
SELECT doc_id, min(h.licence) AS licence, max(b.score) AS score, coalesce(max(c.n), 0)::BIGINT AS n_matches, coalesce(max(f.n), 0)::BIGINT AS n_passages
FROM doc LEFT JOIN best b USING (r) LEFT JOIN every h ON h.r = doc.r AND h.score = b.score LEFT JOIN counted c ON c.r = doc.r LEFT JOIN counted_found f ON f.r = doc.r GROUP BY doc.r, doc_id
"""


SQL = _sql()
