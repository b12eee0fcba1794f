"""Licence scans by sentence rules, with column functions only and no shuffle.

A text is brought to its normal form, words of a-z and digits with blanks for all else, so that sentences may be
wrapped, quoted, bordered by comment signs, or stand within a longer line. Known licence sentences, themselves
normal, are replaced by their identifiers wherever they stand as whole words, longer ones first; what is left between is
dropped, which gives the text's sequence of sentence identifiers. Ordered rules (sequences of identifiers, longest
first) are matched against the sequence; what a rule has matched is taken out, so a long licence isn't reported
again by its parts.

Edge cases: a null or empty text, or one without a known sentence, has no row in ``scan`` and no
licences in ``label``; repeated sentences count each time; texts are whole; other columns than
the id and the text are ignored by ``scan``; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences by identifier.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "apache-may-not": "you may not use this file except in compliance with the License",
    "apache-short-may-not": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache-quoted": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-copy-open": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-short": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-project": "This project is licensed under the MIT License",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-licensed": "Licensed under the GNU General Public License, version 3",
    "gpl2-short": "This work is licensed under the GNU General Public License, version 2",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-useful": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-merchant": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "lgpl21-short": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "agpl3-short": "This work is licensed under the GNU Affero General Public License, version 3",
    "bsd-redistribute": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd3-short": "Licensed under the BSD 3-Clause License",
    "bsd2-short": "Licensed under the BSD 2-Clause License",
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-nd-4": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa-4": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0": "This work is dedicated to the public domain under CC0 1.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "all-rights": "All rights reserved",
}
# Rules, each a licence and the identifiers that show it, in order.
RULES = (
    ("Apache-2.0", ("apache-short-may-not", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-quoted", "apache-may-not", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-quoted", "apache-may-not", "apache-copy-open", "apache-as-is", "apache-see")),
    ("MIT", ("mit-permission", "mit-notice", "mit-as-is")),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-useful", "gpl-merchant", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-useful", "gpl-merchant", "gpl-details")),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("MPL-2.0", ("mpl2", "mpl2-copy")),
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("apache-quoted",)),
    ("Apache-2.0", ("apache-short-may-not",)),
    ("MIT", ("mit-permission",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-project",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("GPL-3.0-only", ("gpl3-licensed",)),
    ("GPL-2.0-only", ("gpl2-short",)),
    ("LGPL-2.1-only", ("lgpl21-short",)),
    ("AGPL-3.0-only", ("agpl3-short",)),
    ("BSD-3-Clause", ("bsd3-short",)),
    ("BSD-2-Clause", ("bsd2-short",)),
    ("MPL-2.0", ("mpl2",)),
    ("ISC", ("isc-permission",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("LicenseRef-All-Rights-Reserved", ("all-rights",)),
)
#: Every known sentence has one of these, however its words are parted; texts without any aren't cut up.
ANCHORS = r"(?i)licen|permi|warrant|redistribut|copyright|public[^a-z0-9]+domain|copy[^a-z0-9]+of[^a-z0-9]+the[^a-z0-9]+mpl|rights[^a-z0-9]+reserved|endorse"



def normal(text: str) -> str:
    """A sentence's normal form: lower-case a-z and digits, all else one blank."""
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def _wrapped(sentence: str) -> str:
    """The normal form with blanks of its own around each word: sentences that follow one another share none."""
    return " " + normal(sentence).replace(" ", "  ") + " "


def _longest_first(sentences: dict[str, str]) -> list[tuple[str, str]]:
    return sorted(((_wrapped(v), k) for k, v in sentences.items()), key=lambda x: (-len(x[0]), x))


def sequence(text: Column, sentences=SENTENCES) -> Column:
    """The identifiers of the known sentences of a text, in order, each as <identifier>."""
    words = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    marked = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for known, name in _longest_first(sentences):
        marked = F.replace(marked, F.lit(known), F.lit(f"<{name}>"))
    return F.array_join(F.regexp_extract_all(marked, F.lit("<[a-z0-9-]+>"), F.lit(0)), "")


def _steps(df: DataFrame, seq: str, rules, tag: str) -> DataFrame:
    """Adds a count by rule, each taken from what the rules before have left of the sequence."""
    for i, (_, ids) in enumerate(rules):
        pattern = "".join(f"<{k}>" for k in ids)
        rest = F.replace(F.col(f"{seq}{i}"), F.lit(pattern), F.lit("|"))
        df = df.withColumn(f"{seq}{i + 1}", rest)
        n = ((F.char_length(f"{seq}{i}") - F.char_length(f"{seq}{i + 1}")) / F.lit(len(pattern) - 1)).cast("long")
        df = df.withColumn(f"{tag}{i}", n)
    return df


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences=SENTENCES, rules=RULES, anchors: str = ANCHORS) -> DataFrame:
    """One row by document and licence found: the id, license, n (times found)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(anchors))
    rows = _steps(rows.select("id", sequence(F.col("text"), sentences).alias("a0")).where("a0 <> ''"), "a", rules, "m")
    names = list(dict.fromkeys(name for name, _ in rules))
    times = {k: sum((F.col(f"m{i}") for i, r in enumerate(rules) if r[0] == k), F.lit(0)) for k in names}
    each = F.array(*(F.struct(F.lit(k).alias("license"), times[k].cast("long").alias("n")) for k in names))
    out = rows.select("id", F.explode(F.filter(each, lambda x: x.n > 0)).alias("x"))
    return out.select(F.col("id").alias(id_col), "x.license", "x.n")


def oracle() -> str:
    """The scan in DuckDB: known sentences replaced by their identifiers, longer ones first, then a step by rule."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    marked = "' ' || replace(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ', '  ') || ' '"
    for known, name in _longest_first(SENTENCES):
        marked = f"replace({marked}, {q(known)}, '<{name}>')"
    steps, last = [], "s0"
    for i, (_, ids) in enumerate(RULES):
        pattern = "".join(f"<{k}>" for k in ids)
        steps.append(f"s{i + 1} AS (SELECT doc_id, replace(seq, {q(pattern)}, '|') AS seq, list_append(ns, (length(seq) - length(replace(seq, {q(pattern)}, '|'))) // {len(pattern) - 1}) AS ns FROM s{i})")
        last = f"s{i + 1}"
    names = "[" + ", ".join(q(n) for n, _ in RULES) + "]"
    return f"""
WITH s0 AS (SELECT doc_id, array_to_string(regexp_extract_all({marked}, '<[a-z0-9-]+>'), '') AS seq, CAST([] AS BIGINT[]) AS ns FROM documents WHERE text IS NOT NULL),
{", ".join(steps)},
n AS (SELECT doc_id, unnest({names}) AS license, unnest(ns) AS n FROM {last} WHERE len(ns) > 0)
SELECT doc_id, license, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY doc_id, license HAVING sum(n) > 0
"""
