"""Licence scan by sentence rules.

Texts are cut into sentences; each is normalised (lower case, comment leaders, quotes and
asterisks removed, white space collapsed, end punctuation stripped). Blank lines end sentences too. A known licence sentence
may begin at any line of a text sentence (a line above need not end in a full stop), so each
sentence offers its line suffixes up to the length of the longest known one. Normalised
sentences are mapped to identifiers by a map of the known sentences (a parameter), and the
identifiers of a document, in text order, are matched against ordered rules: each rule
rewrites its identifier sequence to its licence, earlier rules first; what no rule takes is
reported as it is. More than ``MAX_GAP`` unknown sentences between two known ones break a sequence.

Everything is row-local DataFrame functions: no shuffle, no Python.

Defined cases: null or empty text has no sentences; repeated rows are reported each; without
known sentences nothing is found; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustq.llm.common import let

# fixed values: known licence sentences (public licence texts and usual notices)
SENTENCES: dict[str, str] = {
    "apache2-short": "Licensed under the Apache License, Version 2.0.",
    "apache2-grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may "
                     "not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-asis": "Unless required by applicable law or agreed to in writing, software "
                    "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache2-see": "See the License for the specific language governing permissions and "
                   "limitations under the License.",
    "mit-short": "Released under the MIT License.",
    "mit-short2": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy "
                 "of this software and associated documentation files (the \"Software\"), to deal "
                 "in the Software without restriction, including without limitation the rights "
                 "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
                 "copies of the Software, and to permit persons to whom the Software is "
                 "furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in "
                  "all copies or substantial portions of the Software.",
    "mit-asis": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
                "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
                "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under "
                "the terms of the GNU General Public License as published by the Free Software "
                "Foundation, either version 3 of the License, or (at your option) any later "
                "version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under "
                 "the terms of the GNU General Public License as published by the Free Software "
                 "Foundation; either version 2 of the License, or (at your option) any later "
                 "version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT "
                "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
                "FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without "
                 "modification, are permitted provided that the following conditions are met:",
    "cc-by-nc4": "Licensed under CC BY-NC 4.0.",
    "cc-by4": "Licensed under CC BY 4.0.",
    "cc-by-sa4": "Licensed under CC BY-SA 4.0.",
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
}

# fixed values: rules in order; each maps a sequence of identifiers to a licence
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("apache2-grant", "apache2-copy", "apache2-url", "apache2-asis",
                    "apache2-see")),
    ("Apache-2.0", ("apache2-grant", "apache2-copy", "apache2-url", "apache2-asis")),
    ("Apache-2.0", ("apache2-grant", "apache2-copy", "apache2-url")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("Apache-2.0", ("apache2-short",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-short2",)),
    ("GPL-3.0", ("gpl3-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4",)),
    ("CC-BY-4.0", ("cc-by4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4",)),
    ("MPL-2.0", ("mpl2",)),
]

# more known sentences and rules of the operator
_HOPE = ("This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
         "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.")
_FREE = ("This {0} is free software{1} you can redistribute it and/or modify it under the terms of the "
         "GNU {2} General Public License as published by the Free Software Foundation{3} either version "
         "{4} of the License, or (at your option) any later version.")
SPDX = ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC0-1.0", "CC-BY-4.0",
        "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense", "0BSD",
        *(f"{n}-{k}" for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
          for k in ("only", "or-later")))
MORE_SENTENCES: dict[str, str] = {
    "apache2-asf": "The ASF licenses this file to You under the Apache License, Version 2.0 (the "
                   "\"License\"); you may not use this file except in compliance with the License.",
    "apache2-url-https": "https://www.apache.org/licenses/LICENSE-2.0",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list "
                  "of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this "
                  "list of conditions and the following disclaimer in the documentation and/or other "
                  "materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be "
                 "used to endorse or promote products derived from this software without specific "
                 "prior written permission.",
    "bsd-asis": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
                "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES "
                "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "lgpl21-free": _FREE.format("library", ";", "Lesser", ";", "2.1"),
    "lgpl3-free": _FREE.format("program", ":", "Lesser", ",", "3"),
    "lgpl-hope": _HOPE.format("library"),
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "agpl-free": _FREE.format("program", ":", "Affero", ",", "3"),
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose "
                 "with or without fee is hereby granted, provided that the above copyright notice and "
                 "this permission notice appear in all copies.",
    "isc-asis": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
                "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "cc0-grant": "To the extent possible under law, the author(s) have dedicated all copyright and "
                 "related and neighboring rights to this software to the public domain worldwide.",
    "cc0-short": "Licensed under CC0 1.0.",
    **{f"spdx-{i}": f"SPDX-License-Identifier: {i}" for i in SPDX},
}
MORE_RULES: list[tuple[str, tuple[str, ...]]] = [
    *(("Apache-2.0", (g, "apache2-copy", u, "apache2-asis", "apache2-see")[:n])
      for n in (5, 4, 3) for g, u in (("apache2-grant", "apache2-url-https"),
                                      ("apache2-asf", "apache2-url"),
                                      ("apache2-asf", "apache2-url-https"))),
    ("Apache-2.0", ("apache2-asf",)),
    ("Apache-2.0", ("apache2-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-asis")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-see")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "gpl-hope", "lgpl-see")),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope", "agpl-see")),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("ISC", ("isc-grant", "isc-asis")),
    ("ISC", ("isc-grant",)),
    ("CC0-1.0", ("cc0-grant",)),
    ("CC0-1.0", ("cc0-short",)),
    *((i, (f"spdx-{i}",)) for i in SPDX),
]
ALL_SENTENCES = {**SENTENCES, **MORE_SENTENCES}
ALL_RULES = [*RULES, *MORE_RULES]
MAX_GAP = 5  # parameter: unknown sentences that a sequence may hold between two known ones

# fixed values: how sentences are cut and normalised (valid for Java and RE2 alike)
LEADER = r"(^|\n)[ \t\x0B\f\r]*(//+|--+|[*#;]+)?[ \t\x0B\f\r]*"  # white space and comment marks
# marks that open and close a block comment on the line of a sentence (the closing one ends it), and
# SPDX lines, which end with their line
SPDX_LINE = r"(SPDX-License-Identifier:[^\n]*)\n"
OPENS = r"(^|\n)[ \t\x0B\f\r]*(/\*+|<!--+)"
CLOSES = r"[ \t\x0B\f\r]*(\*+/|--+>)[ \t\x0B\f\r]*(\n|$)"
CUT = r"([.!?][ \n]|:\n)"         # after a full stop, or a colon at the end of a line
SPACES = r"[ \t\x0B\f\r]+"
PARAGRAPH = r" ?\n ?\n[ \n]*"
LINES = r" ?\n ?"
TAIL = r"[.!?;:, \n]+$"
DROP = "*\"'`\x01"
_BREAK = "\x01"


def normalise(sentence: str) -> str:
    """Normal form of a known sentence (the same steps as ``_sentences``)."""
    import re
    s = re.sub(LEADER, "\n", sentence).lower()
    s = "".join(c for c in s if c not in DROP)
    s = re.sub(SPACES, " ", s)
    s = re.sub(TAIL, "", re.sub(LINES, "\n", re.sub(PARAGRAPH, "\n", s)).strip(" \n"))
    return s.replace("\n", " ")


def _sentences(text: Column) -> Column:
    """Array of normalised sentences; line breaks inside them are kept as \\n."""
    text = F.when(F.contains(text, F.lit("/*")) | F.contains(text, F.lit("*/")) | F.contains(text, F.lit("<!--"))
                  | F.contains(text, F.lit("-->")),
                  F.regexp_replace(F.regexp_replace(text, OPENS, "$1"), CLOSES, "\n\n")).otherwise(text)
    text = F.when(F.contains(text, F.lit("SPDX-License-Identifier:")),
                  F.regexp_replace(text, SPDX_LINE, "$1\n\n")).otherwise(text)
    s = F.translate(F.lower(F.regexp_replace(text, LEADER, "\n")), DROP, "")
    s = F.regexp_replace(F.regexp_replace(s, SPACES, " "), PARAGRAPH, _BREAK)
    s = F.regexp_replace(s, LINES, "\n")
    parts = F.split(F.regexp_replace(s, CUT, "$1" + _BREAK), _BREAK)
    return F.transform(parts, lambda x: F.btrim(F.regexp_replace(x, TAIL, ""), F.lit(" \n")))


def _suffixes(sentence: Column, longest: int) -> Column:
    """Line suffixes of a sentence that are at most ``longest`` characters."""
    tail = F.right(sentence, F.lit(longest + 1))
    lines = F.split(tail, "\n")
    whole = F.when(F.length(sentence) > longest, F.lit(2)).otherwise(F.lit(1))
    return F.when(F.instr(tail, "\n") == 0,
                  F.when(F.length(sentence) <= longest, F.array(sentence))
                  .otherwise(F.array().cast("array<string>"))) \
        .otherwise(F.transform(
            F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: i >= whole),
            lambda i: F.array_join(F.slice(lines, i, F.size(lines)), " ")))


def _known_ids(text: Column, sentences: Mapping[str, str]) -> Column:
    """Array of (id, at) of the known sentences of a text, in order; ``at`` is the number of the
    text's sentence. The known sentences are a parameter of the call (a small map), so this is
    row-local."""
    known = {normalise(s): i for i, s in sentences.items()}
    if not known:
        return F.array().cast("array<struct<id:string,at:int>>")
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    longest = max(map(len, known))
    ids = F.flatten(F.transform(_sentences(text), lambda s, i: F.transform(
        _suffixes(s, longest), lambda x: F.struct(F.try_element_at(table, x).alias("id"), i.alias("at")))))
    return F.filter(ids, lambda x: x["id"].isNotNull())


def apply_rules(sequence: Column, rules: Sequence[tuple[str, tuple[str, ...]]]) -> Column:
    """Rewrite ``<id><id>...`` by the rules in order: matched sequences become ``{licence}``."""
    for licence, ids in rules:
        sequence = F.replace(sequence, F.lit("".join(f"<{i}>" for i in ids)),
                             F.lit("{" + licence + "}"))
    return sequence


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
         sentences: Mapping[str, str] = ALL_SENTENCES,
         rules: Sequence[tuple[str, tuple[str, ...]]] = ALL_RULES, max_gap: int = MAX_GAP) -> DataFrame:
    """One row per document row: id, n_sentences (known ones), sentence_ids (in text order),
    licences (sorted distinct), unmatched (identifiers that no rule took, in order)."""
    none = F.array().cast("array<string>")

    def marked(found: Column) -> Column:
        """<id><id><~><id>: the identifiers, with a mark where too many unknown sentences lie."""
        return F.array_join(F.transform(found, lambda x, j: F.concat(
            F.when((j > 0) & (x["at"] - F.get(found, j - 1)["at"] > max_gap + 1), F.lit("<~>"))
            .otherwise(F.lit("")), F.lit("<"), x["id"], F.lit(">"))), "")

    def result(found: Column) -> Column:
        return F.when(F.size(found) > 0, let(apply_rules(marked(found), rules), lambda done: F.struct(
            F.size(found).cast("bigint").alias("n_sentences"),
            F.transform(found, lambda x: x["id"]).alias("sentence_ids"),
            F.array_sort(F.array_distinct(F.regexp_extract_all(
                done, F.lit(r"\{([^}]*)\}"), F.lit(1)))).alias("licences"),
            F.regexp_extract_all(done, F.lit("<([^>~]+)>"), F.lit(1)).alias("unmatched"))))

    text_col = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    d = docs.select(F.col(f"`{id_col}`"), let(_known_ids(text_col, sentences), result).alias("__r"))
    return d.select(
        F.col(f"`{id_col}`"), F.coalesce("__r.n_sentences", F.lit(0)).alias("n_sentences"),
        *[F.coalesce(f"__r.{c}", none).alias(c) for c in ("sentence_ids", "licences", "unmatched")])


def oracle_sql(sentences: Mapping[str, str] = ALL_SENTENCES,
               rules: Sequence[tuple[str, tuple[str, ...]]] = ALL_RULES, max_gap: int = MAX_GAP) -> str:
    """DuckDB twin of the op1 query, of all sentences and rules. The known sentences are
    normalised in SQL."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({q(i)}, {q(s)})" for i, s in sentences.items())
    norm = (f"regexp_replace(regexp_replace(regexp_replace(translate(lower(regexp_replace({{x}}, "
            f"{q(LEADER)}, chr(10), 'g')), '*\"''`' || chr(1), ''), {q(SPACES)}, ' ', 'g'), "
            f"{q(PARAGRAPH)}, chr(1), 'g'), {q(LINES)}, chr(10), 'g')")
    plain = (f"regexp_replace(regexp_replace(regexp_replace(text, {q(OPENS)}, '\\1', 'g'), {q(CLOSES)}, "
             f"chr(10) || chr(10), 'g'), {q(SPDX_LINE)}, '\\1' || chr(10) || chr(10), 'g')")
    tidy = f"trim(regexp_replace({{x}}, {q(TAIL)}, ''), ' ' || chr(10))"
    done = "ids"
    for licence, seq in rules:
        done = f"replace({done}, {q(''.join(f'<{i}>' for i in seq))}, {q('{' + licence + '}')})"
    return f"""
WITH known AS (
  SELECT id, replace({tidy.format(x="trim(" + norm.format(x="s") + ", ' ' || chr(10) || chr(1))")},
                     chr(10), ' ') AS norm
  FROM (VALUES {values}) v(id, s)),
t AS (
  SELECT doc_id, string_split(regexp_replace({norm.format(x=plain)}, {q(CUT)}, '\\1' || chr(1), 'g'), chr(1)) AS xs
  FROM documents),
s AS (SELECT doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS pos FROM t),
l AS (
  SELECT doc_id, pos, string_split({tidy.format(x="x")}, chr(10)) AS lines FROM s),
c AS (
  SELECT doc_id, pos, i, array_to_string(lines[i:], ' ') AS norm
  FROM l, unnest(range(1, len(lines) + 1)) AS u(i)),
f AS (
  SELECT doc_id, pos, i, id, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos, i) > {max_gap + 1} AS far
  FROM c JOIN known USING (norm)),
h AS (
  SELECT doc_id, string_agg(CASE WHEN far THEN '<~>' ELSE '' END || '<' || id || '>', '' ORDER BY pos, i) AS ids,
         count(*) AS n
  FROM f GROUP BY doc_id),
r AS (SELECT doc_id, n, ids, {done} AS done FROM h)
SELECT d.doc_id, coalesce(r.n, 0)::BIGINT AS n_sentences,
       coalesce(array_to_string(regexp_extract_all(r.ids, '<([^>~]+)>', 1), ','), '')
         AS sentence_ids,
       coalesce(array_to_string(list_sort(list_distinct(
         regexp_extract_all(r.done, '\\{{([^}}]*)\\}}', 1))), ','), '') AS licences,
       coalesce(array_to_string(regexp_extract_all(r.done, '<([^>~]+)>', 1), ','), '') AS unmatched
FROM documents d LEFT JOIN r USING (doc_id)
"""
