"""Licence scan: known sentences become identifiers, identifier sequences match ordered rules (DataFrame functions only).

Each text is cut into sentences, with line ends as spaces (wrapped notices); a
sentence that is not known is cut again at its line ends. A normalised sentence
(lower case, runs of other characters than a-z and 0-9 as one space) that is a
known one becomes its identifier; all others vanish. So both ways of cutting
give one sequence in the text's order. The rules are then tried on it in their
order, the longest first; a rule that finds its identifiers in sequence takes
them, so that a part of a longer notice is not reported again.

A known sentence that the cut itself divides ("v. 2.0"), or that is usually set
in two paragraphs, is known by its parts where they follow each other.

Every known sentence holds one of ``MARKS``, each within one word, so a text
with none of them has no finding and is not cut. Rows are independent: no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = ("licen", "permission", "warrant", "redistribut", "unencumbered", "copyright", "liable")

# Sentences of public licence texts and notices.
SENTENCES = {
    1: "Released under the MIT License",
    2: "Licensed under the MIT License",
    3: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    4: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    5: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    6: "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    10: "Licensed under the Apache License, Version 2.0",
    11: "Licensed under the Apache License, Version 2.0 (the \"License\")",
    12: "you may not use this file except in compliance with the License",
    13: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    14: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    15: "See the License for the specific language governing permissions and limitations under the License",
    20: "This work is licensed under the GNU General Public License, version 3",
    21: "This work is licensed under the GNU General Public License, version 2",
    22: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    23: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    24: "either version 2 of the License, or (at your option) any later version",
    25: "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    26: "See the GNU General Public License for more details",
    30: "Licensed under CC BY-NC 4.0",
    31: "Licensed under CC BY 4.0",
    32: "Licensed under CC BY-SA 4.0",
    33: "This work is licensed under a Creative Commons Attribution 4.0 International License",
    40: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    41: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    42: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    43: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    50: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    60: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    61: "This is free and unencumbered software released into the public domain",
}

# Rules, longest first: licence, kind of evidence and identifiers in sequence.
RULES = [
    ("Apache-2.0", "notice", (11, 12, 13, 14, 15)),
    ("MIT", "text", (3, 4, 5, 6)),
    ("BSD-3-Clause", "text", (40, 41, 42, 43)),
    ("GPL-2.0-or-later", "notice", (23, 24, 25, 26)),
    ("GPL-3.0-or-later", "notice", (22, 25, 26)),
    ("BSD-2-Clause", "text", (40, 41, 42)),
    ("MIT", "text", (3, 4)),
    ("GPL-2.0-or-later", "notice", (23, 24)),
    ("Apache-2.0", "notice", (11, 12)),
    ("GPL-3.0-or-later", "notice", (22,)),
    ("MIT", "reference", (1,)),
    ("MIT", "reference", (2,)),
    ("Apache-2.0", "reference", (10,)),
    ("Apache-2.0", "reference", (11,)),
    ("GPL-3.0-only", "reference", (20,)),
    ("GPL-2.0-only", "reference", (21,)),
    ("CC-BY-NC-4.0", "reference", (30,)),
    ("CC-BY-4.0", "reference", (31,)),
    ("CC-BY-SA-4.0", "reference", (32,)),
    ("CC-BY-4.0", "reference", (33,)),
    ("ISC", "text", (50,)),
    ("MPL-2.0", "reference", (60,)),
    ("Unlicense", "text", (61,)),
]

LINE_ENDS = r"[.!?;:]+[ \t\r\n\f]+|\n"
SPACE_ENDS = r"[.!?;:]+[ \t\r\n\f]+|\n[ \t\r\f]*\n"
_OTHER = "[^a-z0-9]+"


def normalised(sentence: str) -> str:
    return re.sub(_OTHER, " ", sentence.lower()).strip(" ")


def _parted() -> list[tuple[list[str], str]]:
    """Normalised parts, and the normalised sentence, of known sentences that texts may have in parts."""
    own = [(re.split(SPACE_ENDS, s), s) for s in SENTENCES.values()]
    own.append((SENTENCES[13].rsplit(" ", 1), SENTENCES[13]))      # the address in a paragraph of its own
    return [([normalised(x) for x in parts], normalised(s)) for parts, s in own if len(parts) > 1]


def _known() -> dict[str, str]:
    """Normalised known sentences and their identifiers."""
    return {normalised(s): f"<{k}>" for k, s in SENTENCES.items()}


def _phrases() -> list[str]:
    """Normalised known sentences and the parts of those that texts may have in parts."""
    return [*_known(), *(x for parts, _ in _parted() for x in parts)]


def _norm(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), _OTHER, " "))


def _identified(joined: Column) -> Column:
    """Identifiers, as ``<1><3>``, of the known ones among normalised sentences ``[..][..]``."""
    known = F.create_map(*(F.lit(x) for pair in _known().items() for x in pair))
    joined = F.replace(joined, F.lit("[]"), F.lit(""))
    for parts, whole in _parted():
        joined = F.replace(joined, F.lit("".join(f"[{x}]" for x in parts)), F.lit(f"[{whole}]"))
    return F.array_join(F.transform(F.split(joined, r"[\[\]]+"), lambda s: F.element_at(known, s)), "")


def _bracketed(sentences: Column) -> Column:
    return F.array_join(F.transform(sentences, lambda s: F.concat(F.lit("["), _norm(s), F.lit("]"))), "")


def _sequence(text: Column, ends: str) -> Column:
    """Identifiers of the known sentences in their order, by one way of cutting."""
    return _identified(_bracketed(F.split(text, ends)))


def _placed_sequence(text: Column) -> Column:
    """Identifiers of the known sentences in their order, by both ways of cutting: a sentence is read whole if it is known, else line by line."""
    phrases = F.array(*map(F.lit, _phrases()))

    def read(s: Column) -> Column:
        whole = _norm(s)
        return F.when(F.array_contains(phrases, whole), F.concat(F.lit("["), whole, F.lit("]"))).otherwise(_bracketed(F.split(s, "\n")))

    return _identified(F.array_join(F.transform(F.split(text, SPACE_ENDS), read), ""))


def _apply_rules(sequence: Column) -> Column:
    """Licences and kinds that the rules find, each rule taking the identifiers it used."""
    rules = F.array(*(F.struct(F.lit(f"{name} ({kind})").alias("finding"), F.lit("".join(f"<{i}>" for i in ids)).alias("ids"))
                      for name, kind, ids in RULES))
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        return F.when(F.instr(state["rest"], rule["ids"]) > 0,
                      F.struct(F.replace(state["rest"], rule["ids"], F.lit("|")).alias("rest"),
                               F.array_append(state["found"], rule["finding"]).alias("found"))).otherwise(state)
    return F.aggregate(rules, start, step)["found"]


def scan_licenses(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of every row, ``line_sequence``, ``wrapped_sequence``, ``sequence`` and ``findings`` (sorted "licence (kind)" strings).

    ``sequence`` is what the rules are tried on; the first two are the sentences
    that line ends as sentence ends, and as spaces, show alone. A null or empty
    text, and one without a known sentence, has empty sequences and no findings.
    Repeated rows each give a row; an empty table gives an empty result.
    ``columns`` pass through and may not be named like the results.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(whole)
    marked = F.contains(low, F.lit(MARKS[0]))
    for mark in MARKS[1:]:
        marked = marked | F.contains(low, F.lit(mark))
    made = {"line_sequence": _sequence(whole, LINE_ENDS), "wrapped_sequence": _sequence(whole, SPACE_ENDS), "sequence": _placed_sequence(whole)}
    rows = docs.select(*columns, *(F.when(marked, e).otherwise("").alias(n) for n, e in made.items()))
    none = F.array().cast("array<string>")
    return rows.withColumn("findings", F.when(F.col("sequence") == "", none).otherwise(F.array_sort(F.array_distinct(_apply_rules(F.col("sequence"))))))


def _oracle() -> str:
    """DuckDB SQL of the same tables: sentences, parts and rules."""
    known = ", ".join(f"'{k}': '{v}'" for k, v in _known().items())
    phrases = ", ".join(f"'{x}'" for x in _phrases())

    def cut(ends: str) -> str:
        ends = ends.replace("\\t", "\t").replace("\\r", "\r").replace("\\n", "\n").replace("\\f", "\f")
        return f"string_split(regexp_replace(t, '{ends}', chr(1), 'g'), chr(1))"

    def norm(x: str) -> str:
        return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"

    def bracketed(sentences: str, x: str) -> str:
        return f"array_to_string(list_transform({sentences}, lambda {x}: '[' || {norm(x)} || ']'), '')"

    def identified(joined: str) -> str:
        joined = f"replace({joined}, '[]', '')"
        for parts, whole in _parted():
            joined = f"replace({joined}, '{''.join(f'[{x}]' for x in parts)}', '[{whole}]')"
        return f"array_to_string(list_transform(regexp_split_to_array({joined}, '[\\[\\]]+'), lambda k: coalesce(known[k], '')), '')"

    placed = (f"array_to_string(list_transform({cut(SPACE_ENDS)}, lambda s: CASE WHEN list_contains(phrases, {norm('s')}) THEN '[' || {norm('s')} || ']' "
              f"ELSE {bracketed('string_split(s, chr(10))', 'l')} END), '')")
    steps = []
    for n, (name, kind, ids) in enumerate(RULES):
        p = "".join(f"<{i}>" for i in ids)
        steps.append(f"r{n} AS (SELECT * REPLACE (replace(q, '{p}', '|') AS q, CASE WHEN contains(q, '{p}') THEN list_append(f, '{name} ({kind})') ELSE f END AS f) FROM {f'r{n - 1}' if n else 'r'})")
    return f"""WITH tables AS (SELECT MAP {{{known}}} AS known, [{phrases}] AS phrases),
        texts AS (SELECT doc_id, coalesce(text, '') AS t, known, phrases FROM documents, tables),
        cuts AS (SELECT doc_id, {identified(bracketed(cut(LINE_ENDS), 's'))} AS line_sequence, {identified(bracketed(cut(SPACE_ENDS), 's'))} AS wrapped_sequence,
                        {identified(placed)} AS sequence FROM texts),
        r AS (SELECT *, sequence AS q, CAST([] AS VARCHAR[]) AS f FROM cuts),
        {', '.join(steps)}
        SELECT doc_id, line_sequence, wrapped_sequence, sequence, array_to_string(list_sort(list_distinct(f)), ', ') AS findings FROM r{len(RULES) - 1}"""


ORACLE_SQL = _oracle()
