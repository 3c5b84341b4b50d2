"""License scans: sentences to licence-sentence identifiers, then identifier sequences against ordered rules.

A text is cut into sentences at blank lines (lines without a letter or digit) and at . ! ? before white space or the end;
line ends within a sentence are blanks. A sentence is normalised: A-Z lowered, every run of characters other than a-z,
0-9, '.', '-' and '+' made one blank, words without a letter or digit left out, outer dots cut off. It carries the
identifier of every known sentence whose words it holds in a row, in order of place; one that lies within a longer one
is not counted. So wrapped lines, comment signs, inner colons and words around a known sentence lose nothing. A rule is
an ordered list of identifiers, and a document holds the rule if the identifiers follow one another in this order, other
licence sentences between them allowed; a licence whose rule includes another's hides that one. Built-in expressions on
one row only; nothing is shuffled.

Defined cases: null and empty texts have no licence; repeated sentences count once per rule, and a known sentence that
one sentence repeats counts there once; a licence named by several rules is listed once, in the order of RULES; extra
columns of the input are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import ascii_lower, let, text_of

# Sentences of published licences, by identifier.
PUBLISHED: dict[str, str] = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as-is-software": "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-disclaim": "The software is provided as is and the author disclaims all warranties with regard to this software",
    "apache2-title": "Apache License Version 2.0, January 2004",
    "apache2-comply": "you may not use this file except in compliance with the License",
    "apache2-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl2-title": "GNU General Public License Version 2, June 1991",
    "gpl3-title": "GNU General Public License Version 3, 29 June 2007",
    "lgpl21-title": "GNU Lesser General Public License Version 2.1, February 1999",
    "lgpl3-title": "GNU Lesser General Public License Version 3, 29 June 2007",
    "agpl3-title": "GNU Affero General Public License Version 3, 19 November 2007",
    "gpl2-free": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    "gpl3-free": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "lgpl21-free": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "lgpl3-free": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    "agpl3-free": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "gnu-hope": "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "bsd-redistribute": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-advertise": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "mpl2-source": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "epl1-made": "are made available under the terms of the Eclipse Public License v1.0",
    "epl2-made": "are made available under the terms of the Eclipse Public License 2.0",
    "unlicense-domain": "This is free and unencumbered software released into the public domain",
    "zlib-as-is": "This software is provided as-is, without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "wtfpl-copies": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    "cc0-waived": "has waived all copyright and related rights",
    "cc0-domain": "has waived all copyright and related or neighboring rights",
    "rights-reserved": "All rights reserved",
}

# Names that licences go by after "under the" or "under".
NAMES: dict[str, tuple[str, ...]] = {
    "mit": ("MIT License", "MIT/X11 License", "Expat License"),
    "isc": ("ISC License",),
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License"),
    "gpl-2.0": ("GNU General Public License version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2"),
    "gpl-3.0": ("GNU General Public License version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3"),
    "lgpl-2.1": ("GNU Lesser General Public License version 2.1", "GNU LGPL version 2.1", "LGPLv2.1"),
    "lgpl-3.0": ("GNU Lesser General Public License version 3", "GNU LGPL version 3", "LGPLv3"),
    "agpl-3.0": ("GNU Affero General Public License version 3", "GNU AGPL version 3", "AGPLv3"),
    "bsd-3-clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License"),
    "bsd-2-clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "mpl-2.0": ("Mozilla Public License 2.0", "MPL 2.0"),
    "epl-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "zlib": ("zlib License",),
    "bsl-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "cc-by-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "cc-by-sa-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-nd-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "cc-by-nc-sa-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "cc-by-nc-nd-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}

# Identifiers after "SPDX-License-Identifier:"; those of GNU licences also end in the words below.
SPDX = ("MIT", "ISC", "0BSD", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "MPL-2.0", "EPL-1.0", "EPL-2.0", "Unlicense", "Zlib", "BSL-1.0", "WTFPL", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")
GNU_ENDS = ("", "-only", "-or-later", "+")

# Licences and the sentence sequences that show them; rules by name follow from the tables above.
SEQUENCES: list[tuple[str, tuple[str, ...]]] = [
    ("mit", ("mit-grant", "mit-notice", "as-is-software")),
    ("isc", ("isc-grant", "isc-disclaim")),
    ("0bsd", ("0bsd-grant", "isc-disclaim")),
    ("apache-2.0", ("apache2-title",)),
    ("gpl-2.0", ("gpl2-title",)),
    ("gpl-2.0", ("gpl2-free", "gnu-hope")),
    ("gpl-3.0", ("gpl3-title",)),
    ("gpl-3.0", ("gpl3-free", "gnu-hope")),
    ("lgpl-2.1", ("lgpl21-title",)),
    ("lgpl-2.1", ("lgpl21-free", "gnu-hope")),
    ("lgpl-3.0", ("lgpl3-title",)),
    ("lgpl-3.0", ("lgpl3-free", "gnu-hope")),
    ("agpl-3.0", ("agpl3-title",)),
    ("agpl-3.0", ("agpl3-free", "gnu-hope")),
    ("bsd-4-clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse")),
    ("bsd-3-clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("bsd-2-clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("mpl-2.0", ("mpl2-source",)),
    ("mpl-2.0", ("mpl2-title",)),
    ("epl-1.0", ("epl1-made",)),
    ("epl-2.0", ("epl2-made",)),
    ("unlicense", ("unlicense-domain",)),
    ("zlib", ("zlib-as-is", "zlib-grant")),
    ("bsl-1.0", ("bsl-grant",)),
    ("wtfpl", ("wtfpl-copies",)),
    ("cc0-1.0", ("cc0-waived",)),
    ("cc0-1.0", ("cc0-domain",)),
    ("proprietary", ("rights-reserved",)),
]
HIDES = {"bsd-4-clause": ("bsd-3-clause", "bsd-2-clause"), "bsd-3-clause": ("bsd-2-clause",)}

# Every known sentence holds one of these, so texts and sentences without any have no identifier.
ANCHORS = ("licen", "copyright", "permission", "redistribut", "warrant", "rights", "public domain", "under cc by", "under the cc by", "gpl", "mpl", "derived from this software", "advertising materials")

#: What ends a sentence, and what a normalised one does not keep; RE2 and Java read both alike.
ENDS = r"\n[^\p{L}\p{N}\n]*\n|[.!?]+(?:[ \t\r\n]+|$)"
OTHER = r"[^a-z0-9.+-]+"


def normal(sentence: str) -> str:
    words = re.sub(OTHER, " ", sentence.translate({c: c + 32 for c in range(65, 91)})).split(" ")
    return " ".join(w for w in words if re.search("[a-z0-9]", w)).strip(".")


def known_sentences() -> dict[str, str]:
    out = {name: normal(s) for name, s in PUBLISHED.items()}
    for licence, names in NAMES.items():
        for i, name in enumerate(names):
            out[f"{licence}-name{i}"] = normal(f"under the {name}")
            out[f"{licence}-name{i}b"] = normal(f"under {name}")
    for x in SPDX:
        for end in GNU_ENDS if "GPL" in x else ("",):
            out[f"spdx-{x.lower()}{end}"] = normal(f"SPDX-License-Identifier: {x}{end}")
    return out


def rules() -> list[tuple[str, tuple[str, ...]]]:
    out = list(SEQUENCES)
    for licence, names in NAMES.items():
        out += [(licence, (f"{licence}-name{i}{b}",)) for i in range(len(names)) for b in ("", "b")]
    return out + [(x.lower(), (f"spdx-{x.lower()}{end}",)) for x in SPDX for end in (GNU_ENDS if "GPL" in x else ("",))]


SENTENCES, RULES = known_sentences(), rules()


def normal_column(sentence: Column) -> Column:
    ws = F.filter(F.split(F.regexp_replace(sentence, OTHER, " "), " "), lambda w: w.rlike("[a-z0-9]"))
    return F.trim(F.array_join(ws, " "), F.lit("."))


def any_of(text: Column, strings: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in strings:
        out = out | F.contains(text, F.lit(s))
    return out


def sentence_ids(text: Column, sentences: dict[str, str], anchors: tuple[str, ...]) -> Column:
    """Identifiers of a text's known sentences, in order."""
    known = F.array(*[F.struct(F.lit(f" {k} ").alias("text"), F.lit(len(k)).alias("size"), F.lit(name).alias("name")) for name, k in sentences.items()])

    def found(s: Column) -> Column:
        hits = F.filter(F.transform(known, lambda k: F.struct(F.call_function("locate", k["text"], s).alias("at"), k["size"].alias("size"), k["name"].alias("name"))), lambda h: h["at"] > 0)
        longer = lambda x, y: (y["size"] > x["size"]) & (y["at"] <= x["at"]) & (y["at"] + y["size"] >= x["at"] + x["size"])
        return let(hits, lambda h: F.transform(F.array_sort(F.filter(h, lambda x: ~F.exists(h, lambda y: longer(x, y)))), lambda x: x["name"]))

    parts = F.filter(F.transform(F.split(ascii_lower(text), ENDS), normal_column), lambda s: any_of(s, anchors))
    return F.flatten(F.transform(parts, lambda s: found(F.concat(F.lit(" "), s, F.lit(" ")))))


def by_licence(rules: list[tuple[str, tuple[str, ...]]]) -> dict[str, str]:
    """A pattern over identifiers between bars for each licence, in the order of its first rule."""
    out: dict[str, list[str]] = {}
    for name, rule in rules:
        out.setdefault(name, []).append("\\|" + "\\|(?:.*\\|)?".join(map(re.escape, rule)) + "\\|")
    return {name: "|".join(f"(?:{p})" for p in patterns) for name, patterns in out.items()}


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES, anchors: tuple[str, ...] = ANCHORS, hides: dict[str, tuple[str, ...]] = HIDES) -> DataFrame:
    """One row per document: doc_id, n_sentences (known sentences), sentence_ids (joined by '|', in text order),
    licenses (joined by '|', in rule order) and n_licenses.

    A byte search for the anchors comes first; it only skips texts that cannot hold a known sentence.
    """
    if missing := [k for k in sentences.values() if not any(a in k for a in anchors)]:
        raise ValueError(f"sentences without an anchor: {missing}")
    text = text_of(docs)
    # an anchor's words may stand on two lines, so only the first word is looked for here
    heads = tuple(dict.fromkeys(a.split(" ")[0] for a in anchors))
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.when(any_of(ascii_lower(text), heads), F.array_join(sentence_ids(text, sentences, anchors), "|")).otherwise("").alias("sentence_ids"))
    path = F.concat(F.lit("|"), F.col("sentence_ids"), F.lit("|"))
    found = F.array_compact(F.array(*[F.when(path.rlike(pattern), F.lit(name)) for name, pattern in by_licence(rules).items()]))
    hidden = F.flatten(F.array(*[F.when(F.array_contains(F.col("names"), n), F.lit(list(h))).otherwise(F.array().cast("array<string>")) for n, h in hides.items()])) if hides else F.array().cast("array<string>")
    rows = rows.withColumn("names", F.when(F.col("sentence_ids") == "", F.array().cast("array<string>")).otherwise(found)).withColumn("names", F.array_except("names", hidden))
    n_ids = F.when(F.col("sentence_ids") == "", 0).otherwise(F.size(F.split("sentence_ids", "\\|"))).cast("long")
    return rows.select("doc_id", n_ids.alias("n_sentences"), "sentence_ids", F.array_join("names", "|").alias("licenses"), F.size("names").cast("long").alias("n_licenses"))


def oracle_sql(sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES, anchors: tuple[str, ...] = ANCHORS, hides: dict[str, tuple[str, ...]] = HIDES) -> str:
    """The same rows in DuckDB."""
    known = ", ".join(f"{{'text': ' {k} ', 'size': {len(k)}, 'name': '{name}'}}" for name, k in sentences.items())
    hits = ", ".join(f"CASE WHEN regexp_matches('|' || sentence_ids || '|', '{pattern}') THEN '{name}' END" for name, pattern in by_licence(rules).items())
    some = " OR ".join(f"contains(s, '{a}')" for a in anchors)
    hidden = " OR ".join(f"(n IN ({', '.join(map(repr, h))}) AND list_contains(hit, '{name}'))" for name, h in hides.items())
    return f"""
WITH parts AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ENDS}'),
    lambda s: trim(array_to_string(list_filter(string_split(regexp_replace(s, '{OTHER}', ' ', 'g'), ' '), lambda w: regexp_matches(w, '[a-z0-9]')), ' '), '.')), lambda s: {some}) AS parts
  FROM documents
), cut AS (
  SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS nth FROM parts
), known AS (
  SELECT unnest([{known}], recursive := true)
), hits AS (
  SELECT doc_id, nth, strpos(' ' || s || ' ', text) AS place, size, name FROM cut, known WHERE strpos(' ' || s || ' ', text) > 0
), kept AS (
  SELECT * FROM hits x WHERE NOT EXISTS (SELECT 1 FROM hits y WHERE y.doc_id = x.doc_id AND y.nth = x.nth AND y.size > x.size AND y.place <= x.place AND y.place + y.size >= x.place + x.size)
), paths AS (
  SELECT doc_id, string_agg(name, '|' ORDER BY nth, place, size, name) AS sentence_ids, count(*) AS n FROM kept GROUP BY doc_id
), found AS (
  SELECT doc_id, n, sentence_ids, list_filter([{hits}], lambda x: x IS NOT NULL) AS hit FROM paths
), named AS (
  SELECT doc_id, n, sentence_ids, list_filter(hit, lambda n: NOT ({hidden or 'false'})) AS names FROM found
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids, coalesce(array_to_string(names, '|'), '') AS licenses, coalesce(len(names), 0)::BIGINT AS n_licenses
FROM documents d LEFT JOIN named ON d.doc_id = named.doc_id"""
