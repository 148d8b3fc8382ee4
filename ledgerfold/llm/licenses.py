"""Operator 1: licence scans by sentence rules, in DataFrame functions.

A text is cut into sentences (at line ends, and after ``.``, ``!`` or ``?``
followed by a blank), each sentence is normalised (ASCII lower case, everything
but letters and digits one blank) and looked up among the known licence
sentences.  A known sentence may be wrapped over the lines of a paragraph, and is
cut where its own text is (``v. 2.0``): the pieces in a row that make it up count as
it.  The leftmost, then longest is taken, from the start of a piece to the end of
one.  The identifiers found, in text order, form the document's sequence;
ordered rules are matched against it.  A rule is a list of identifiers that stand
one after another in the sequence; rules are tried longest first, then in the
order given, and a match's identifiers are consumed, so that a short rule does
not fire inside a longer one's match.

Catalogue and rules are literals of the plan (a few dozen entries, given by the
caller): no shuffle, no join, no Python.

Defined results: a null or empty text has no sentences and no licence; repeated
rows give repeated results; an empty table gives no rows; further columns are
ignored; a null identifier stays null; texts are cut whole, however long; of known
sentences that begin together the longest counts, of rules of one length the first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm.common import table, text_of

#: Licence sentences, by identifier.
SENTENCES = {
    "apache-grant": "Licensed under the Apache License, Version 2.0.",
    "apache-use": "You may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-spdx": "SPDX-License-Identifier: Apache-2.0",
    "mit-release": "Released under the MIT License.",
    "mit-title": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-nowarranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl3-spdx": "SPDX-License-Identifier: GPL-3.0-or-later",
    "ccbync-grant": "Licensed under CC BY-NC 4.0.",
    "ccby-grant": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbysa-grant": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-grant": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mpl-grant": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "All rights reserved.",
}
#: Ordered rules, licence and identifiers.
RULES = [
    ("Apache-2.0", ["apache-grant", "apache-use", "apache-copy", "apache-asis"]),
    ("Apache-2.0", ["apache-grant", "apache-use"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-nowarranty"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-names"]),
    ("Apache-2.0", ["apache-grant"]),
    ("Apache-2.0", ["apache-spdx"]),
    ("MIT", ["mit-release"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-spdx"]),
    ("GPL-3.0-only", ["gpl3-work"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-3.0-or-later", ["gpl3-spdx"]),
    ("CC-BY-NC-4.0", ["ccbync-grant"]),
    ("CC-BY-4.0", ["ccby-grant"]),
    ("CC-BY-SA-4.0", ["ccbysa-grant"]),
    ("CC0-1.0", ["cc0-grant"]),
    ("BSD-2-Clause", ["bsd-grant"]),
    ("MPL-2.0", ["mpl-grant"]),
    ("Proprietary", ["reserved"]),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def pieces(text: Column) -> Column:
    """The normalised sentences as one string.  Between two stands ``S`` where a
    sentence ends, else ``L`` for a line end or ``P`` for several."""
    low = F.translate(text, UPPER, LOWER)
    for pattern, mark in (
        (r"[.!?](?=[ \t\r\f\n])", "S"), (r"[^a-z0-9\nS]+", " "), (r" ?([S\n]) ?", "$1"), ("S+", "S"),
        (r"S?\n(?:S?\n)+S?", "P"), (r"S\nS|S\n|\nS", "S"), (r"\n", "L"),
    ):
        low = F.regexp_replace(low, pattern, mark)
    return F.trim(low)


def count_pieces(joined: Column) -> Column:
    return F.size(F.filter(F.split(joined, "[SLP]", -1), lambda s: s != "")).cast("bigint")


def piece_pattern(sentence: str) -> str:
    """What a known sentence looks like in joined pieces."""
    words = re.split("([^a-z0-9]+)", sentence.translate(str.maketrans(UPPER, LOWER)))
    words = words[2 if words[0] == "" else 0 : -2 if words[-1] == "" else None]
    gap = lambda s: "[ SLP]" if s.count("\n") > 1 else "[ SL]" if re.search(r"[.!?][ \t\r\f\n]", s) else "[ L]"
    return "".join(gap(w) if i % 2 else w for i, w in enumerate(words))


def known(joined: Column, catalogue: dict[str, str]) -> Column:
    """Identifiers of the known sentences, in order."""
    ids = F.create_map(*[F.lit(x) for k, v in catalogue.items() for x in (normalised(v), k)])
    longest = sorted((v for v in catalogue.values() if normalised(v)), key=lambda v: -len(normalised(v)))
    pattern = f"(?<=[SLP])(?:{'|'.join(piece_pattern(v) for v in longest)})(?=[SLP])"
    found = F.regexp_extract_all(F.concat(F.lit("P"), joined, F.lit("P")), F.lit(pattern), F.lit(0))
    return F.transform(found, lambda s: F.element_at(ids, F.translate(s, "SLP", "   ")))


def ordered_rules(rules: list[tuple[str, list[str]]]) -> list[tuple[str, list[str]]]:
    return sorted(rules, key=lambda r: -len(r[1]))  # stable: then as given


def match_rules(sequence: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Matches in text order as an array of licences.

    The sequence is the string ``,a,b,c,``; each rule in turn replaces its
    identifiers by ``,=licence,``, which no later rule can match.  Separators are
    doubled first, so that adjacent identifiers don't share one."""
    text = F.concat(F.lit(","), F.array_join(sequence, ",,"), F.lit(","))
    for licence, ids in ordered_rules(rules):
        text = F.replace(text, F.lit("," + ",,".join(ids) + ","), F.lit(f",={licence},"))
    return F.filter(F.split(text, ",", -1), lambda s: s.startswith("="))


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  catalogue: dict[str, str] | None = None, rules: list | None = None) -> DataFrame:
    """One row per row: the id, ``n_sentences``, ``sentence_ids`` (in order) and
    ``matches`` (licences in text order)."""
    catalogue, rules = catalogue or SENTENCES, rules or RULES
    cut = docs.select(F.col(id_column), pieces(text_of(text_column)).alias("s"))
    found = cut.select(id_column, count_pieces(F.col("s")).alias("n_sentences"), known(F.col("s"), catalogue).alias("sentence_ids"))
    return found.withColumn("matches", F.transform(match_rules(F.col("sentence_ids"), rules), lambda s: F.substring(s, F.lit(2), F.length(s))))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every whole document."""
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_sentences", F.size("sentence_ids").cast("bigint").alias("n_known"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join(F.array_sort(F.array_distinct("matches")), ",").alias("licenses"),
        F.coalesce(F.try_element_at("matches", F.lit(1)), F.lit("")).alias("first_license"),
    )


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(normalised(v))}, {quote(k)})" for k, v in SENTENCES.items())
    text = "',' || coalesce(string_agg(k.id, ',,' ORDER BY i), '') || ','"
    for licence, ids in ordered_rules(RULES):
        text = f"replace({text}, {quote(',' + ',,'.join(ids) + ',')}, {quote(f',={licence},')})"
    return rf"""
WITH k(s, id) AS (VALUES {values}),
d AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '([.!?])[ \t\r\f]+', '\1' || chr(10), 'g'), chr(10)),
    lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'), ' ')), lambda x: x <> '') AS s FROM documents),
u AS (SELECT doc_id, i, s[i] AS s FROM d, unnest(generate_series(1, len(s))) AS g(i)),
m AS (SELECT doc_id, count(*) AS n_known, string_agg(k.id, ',' ORDER BY i) AS ids, {text} AS text
  FROM u JOIN k ON u.s = k.s GROUP BY doc_id),
r AS (SELECT *, list_transform(list_filter(string_split(text, ','), lambda x: starts_with(x, '=')), lambda x: x[2:]) AS found FROM m)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_sentences, CAST(coalesce(n_known, 0) AS BIGINT) AS n_known,
  coalesce(ids, '') AS sentence_ids, coalesce(array_to_string(list_sort(list_distinct(found)), ','), '') AS licenses,
  coalesce(found[1], '') AS first_license
FROM d LEFT JOIN r USING (doc_id)
"""


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLE = {"op1_license_scan": _oracle()}
