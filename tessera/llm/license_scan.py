"""License scans: normalised passages against license templates by Dice coefficient over word bigrams (native)."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: License notices by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "This work has been dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "Proprietary": "All rights reserved. No part of this work may be reproduced without permission.",
}
#: Longer notices, which are looked for beside TEMPLATES anywhere in a text: licenses' own texts, or the part that all copies of them open with.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the 'License'); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an 'AS IS' BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "GPL-3.0": [
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
}
#: Least Dice coefficient of a match.
THRESHOLD = 0.8
#: Words by this pattern, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between words.
_BETWEEN = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def _words(text: str) -> list[str]:
    import re

    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def _bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _must(known: list[list[str]], reach: float) -> list[str]:
    """Words of which any text that shares `reach` of one of the bigram sets holds one: it has one of any few more than the rest of them."""
    return sorted({max(g.split(" "), key=lambda w: (len(w), w)) for b in known for g in sorted(b, key=lambda g: -max(map(len, g.split(" "))))[: len(b) - math.ceil(reach * len(b) - 1e-9) + 1]})


def _literals(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def _once(rows: DataFrame, name: str, made: Column, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds a column that expressions over it don't compute again, as a projection may."""
    return rows.select(*[c for c in rows.columns if c not in drop], F.explode(F.array(made)).alias(name))


def _spoken(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _passage_matches(templates: Mapping[str, list[str]], threshold: float) -> Column:
    """(passage, license, n_bigrams, dice) of the passages' sets of bigrams that match a template."""
    listed = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(len(b)).cast("long").alias("size"), _literals(b).alias("grams")) for k, b in templates.items()])

    def of(passage: Column) -> Column:
        n = F.size(passage["grams"]).cast("long")
        fits = F.filter(listed, lambda t: F.lit(2.0) * F.least(t["size"], n) >= F.lit(threshold) * (t["size"] + n))
        dice = lambda t: F.lit(2.0) * F.size(F.array_intersect(passage["grams"], t["grams"])) / (t["size"] + n)
        return F.filter(F.transform(fits, lambda t: F.struct(passage["passage"].alias("passage"), t["license"].alias("license"), n.alias("n_bigrams"), dice(t).alias("dice"))), lambda m: m["dice"] >= threshold)

    return F.flatten(F.transform("sets", of))


def _window_matches(known: list[tuple[str, int, list[str]]], threshold: float) -> Column:
    """(passage, license, n_bigrams, dice): the best window of each license, of as many words as a template of it, whatever the lines; passage is the window's first line.

    A window that starts before its first bigram of the template is no better than the one that starts there, so only those are tried.
    """
    reach = threshold / (2 - threshold)

    def best(size: int, bigrams: list[str]) -> Column:
        these = _literals(bigrams)
        starts = F.filter(F.transform("grams", lambda g, i: F.when(F.array_contains(these, g), i)), lambda i: i.isNotNull())
        window = lambda i: F.array_distinct(F.slice("grams", i + 1, F.lit(size)))
        scored = F.transform(starts, lambda i: F.struct((F.lit(2.0) * F.size(F.array_intersect(window(i), these)) / (F.lit(len(bigrams)) + F.size(window(i)))).alias("dice"), (-i).alias("back"), F.size(window(i)).cast("long").alias("n_bigrams")))
        enough = F.size(F.array_intersect("grams", these)) >= math.ceil(reach * len(bigrams) - 1e-9)
        return F.when(enough, F.array_max(F.filter(scored, lambda m: m["dice"] >= threshold)))

    of = {k: [best(n, b) for name, n, b in known if name == k] for k, _, _ in known}
    tops = F.array(*[F.struct(F.lit(k).alias("license"), F.array_max(F.array(*v)).alias("top")) for k, v in of.items()])
    found = F.filter(tops, lambda m: m["top"].isNotNull())
    return F.transform(found, lambda m: F.struct(F.get(F.col("said.line"), -m["top"]["back"]).alias("passage"), m["license"].alias("license"), m["top"]["n_bigrams"].alias("n_bigrams"), m["top"]["dice"].alias("dice")))


def scan_licenses(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = TEMPLATES, notices: Mapping[str, list[str]] = NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """The best license of each passage (line) of each document, and of the whole text; and licenses that stand in the text otherwise.

    A license that matches neither a line nor the whole is looked for anywhere, in windows of its template's or notices' size:
    inside a sentence, over several lines, in a longer text. It gives one row a document, of the best window, of these the first.

    A passage's and a template's sets of distinct word bigrams A, B match when 2 |A and B| / (|A| + |B|) >= threshold.
    Size bounds prune first: 2 min(|A|, |B|) / (|A| + |B|) must reach the threshold. They also bound the overlap from below:
    a text or passage without a word of enough of each template's bigrams matches none, before any bigram is made.

    Returns one row per passage and template that match: id, passage (0: the whole text, else the line's number from 1; a window's first line),
    license, n_bigrams, dice. A one-line text gives its line only. Null and empty texts, passages of one word
    and an empty table give no rows. Each row is judged by itself, so repeated rows repeat their matches, and ids of any type, repeated or
    null, go along. Other columns are ignored. Nothing is shuffled; a text's bigrams fit one row (2 GB). Templates are part of
    the plan, so their number and length should stay in the thousands.
    """
    known = [(k, _words(v)) for k, v in [*templates.items(), *((k, v) for k, vs in notices.items() for v in vs)]]
    known = [(k, len(w) - 1, _bigrams(w)) for k, w in known if len(w) > 1]
    whole_known = {k: b for k, b in ((k, _bigrams(_words(v))) for k, v in templates.items()) if b}
    reach = threshold / (2 - threshold)
    sizes = [len(b) for b in whole_known.values()]
    least, most = min(sizes, default=0) * reach, max(sizes, default=0) / reach
    # lower-cased texts with a word that a match must hold
    texts = documents.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.where(F.arrays_overlap(F.split(F.translate("text", _UPPER + _BETWEEN, _UPPER.lower() + " " * len(_BETWEEN)), " "), _literals(_must([b for _, _, b in known], reach))))
    texts = _once(texts, "lowered", F.translate("text", _UPPER, _UPPER.lower()), ("text",))
    rows = _once(texts, "lines", F.transform(F.split("lowered", "\n", -1), lambda line, i: F.struct((i + 1).alias("passage"), _spoken(line).alias("words"))), ("lowered",))
    rows = _once(rows, "said", F.flatten(F.transform("lines", lambda p: F.transform(p["words"], lambda w: F.struct(p["passage"].alias("line"), w.alias("w")))))).where(F.size("said") > 1)
    rows = _once(rows, "grams", F.transform(F.sequence(F.lit(0), F.size("said") - 2), lambda i: F.concat_ws(" ", F.get("said", i)["w"], F.get("said", i + 1)["w"])))
    # passages' sets of bigrams, of lines that could match and of the text; one of a single line is that line
    must = _literals(_must(list(whole_known.values()), reach))
    could = F.filter("lines", lambda p: (F.size(p["words"]) > max(least, 1)) & F.arrays_overlap(p["words"], must))
    bigrams = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))
    of_lines = F.transform(could, lambda p: F.struct(p["passage"].alias("passage"), bigrams(p["words"]).alias("grams")))
    of_text = F.array(F.struct(F.lit(0).alias("passage"), F.array_distinct("grams").alias("grams")))
    sets = F.concat(of_lines, F.when(F.size("lines") > 1, of_text).otherwise(F.slice(of_text, 1, 0)))
    rows = _once(rows, "sets", F.filter(sets, lambda p: F.size(p["grams"]).between(least, most)), ("lines",))
    rows = _once(rows, "matches", _passage_matches(whole_known, threshold), ("sets",))
    elsewhere = F.filter(_window_matches(known, threshold), lambda m: ~F.exists("matches", lambda x: x["license"] == m["license"]))
    found = rows.select("id", F.explode(F.concat("matches", elsewhere)).alias("m"))
    return found.select(F.col("id").alias(id_col), "m.passage", "m.license", "m.n_bigrams", "m.dice")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_values(items) -> str:
    return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in items)


_WORD_SQL = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_GRAMS_SQL = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
OP10_SQL = f"""
WITH lowered AS (SELECT doc_id, {_LOWER_SQL.format("text")} AS text FROM documents WHERE length(text) > 0),
cut AS (SELECT doc_id, CAST(i AS INTEGER) AS passage, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM lowered), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)),
passages AS (SELECT * FROM cut UNION ALL SELECT doc_id, 0, text FROM lowered WHERE contains(text, chr(10))),
bags AS (SELECT doc_id, passage, list_distinct({_GRAMS_SQL}) AS grams FROM (SELECT doc_id, passage, regexp_extract_all(line, '{_WORD_SQL}') AS w FROM passages)),
lists AS (SELECT * FROM (VALUES {_sql_values(TEMPLATES.items())}) AS v(license, t)),
all_lists AS (SELECT *, true AS short FROM lists UNION ALL SELECT *, false FROM (VALUES {_sql_values((k, v) for k, vs in NOTICES.items() for v in vs)}) AS v(license, t)),
known AS (SELECT license, short, len(w) - 1 AS n, list_distinct({_GRAMS_SQL}) AS g FROM (SELECT license, short, regexp_extract_all({_LOWER_SQL.format("t")}, '{_WORD_SQL}') AS w FROM all_lists)),
scored AS (
  SELECT doc_id, passage, license, len(grams) AS n_bigrams, 2.0::DOUBLE * len(list_intersect(grams, g)) / (len(g) + len(grams)) AS dice
  FROM bags JOIN known ON short AND 2 * least(len(g), len(grams)) >= {THRESHOLD} * (len(g) + len(grams)) WHERE len(grams) > 0
), matched AS (SELECT doc_id, passage, license, n_bigrams, dice FROM scored WHERE dice >= {THRESHOLD}),
said AS (SELECT doc_id, line, w, row_number() OVER (PARTITION BY doc_id ORDER BY line, k) AS place FROM (SELECT doc_id, passage AS line, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS k FROM (SELECT doc_id, passage, regexp_extract_all(line, '{_WORD_SQL}') AS w FROM cut))),
texts AS (SELECT doc_id, lines, {_GRAMS_SQL} AS grams FROM (SELECT doc_id, list(w ORDER BY place) AS w, list(line ORDER BY place) AS lines FROM said GROUP BY doc_id HAVING count(*) > 1)),
starts AS (SELECT doc_id, license, n, g, i, lines[i] AS passage, list_distinct(grams[i:i + n - 1]) AS part FROM (
  SELECT doc_id, license, n, g, lines, grams, unnest(range(1, len(grams) + 1)) AS i FROM texts JOIN known ON len(list_intersect(list_distinct(grams), g)) >= ceil({THRESHOLD} / (2 - {THRESHOLD}) * len(g) - 1e-9)) WHERE list_contains(g, grams[i])),
windows AS (SELECT doc_id, license, passage, len(part) AS n_bigrams, 2.0::DOUBLE * len(list_intersect(part, g)) / (len(g) + len(part)) AS dice, i FROM starts),
best AS (SELECT doc_id, passage, license, n_bigrams, dice FROM windows WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, i, n_bigrams DESC) = 1)
SELECT * FROM matched UNION ALL SELECT best.* FROM best ANTI JOIN matched USING (doc_id, license)
"""
