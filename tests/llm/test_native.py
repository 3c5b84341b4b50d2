"""Syncmers, quality rules and licence scans against brute force."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from marlstone.llm import licenses, quality_rules, syncmers


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_edits_and_likeness(odd, clashing, empty):
    rows = syncmers.compared(odd.where("doc_id is not null").dropDuplicates()).collect()
    text = {r.doc_id: r.text or "" for r in odd.where("doc_id is not null").collect()}
    ids = sorted(text)
    for r in rows:
        t, after = text[r.doc_id], text[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and r.n_chars == len(t)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint and by[1].near_next == 1.0
    assert by[4].fingerprint == by[5].fingerprint == by[7].fingerprint == "" and by[4].near_next == 1.0
    assert by[1].near_edited > by[5].near_edited - 1
    assert syncmers.compared(odd).count() == odd.count()
    assert syncmers.compared(empty).count() == 0
    assert syncmers.compared(clashing).count() == odd.count()
    assert no_python(syncmers.compared(odd))


def test_neighbours_over_gaps(table):
    docs = table([(i * i * 37, f"text {i}", "en", "s", 0) for i in range(60)] + [(-9, "below", "en", "s", 0), (None, "null", "en", "s", 0)])
    got = {r.text: r.next_text for r in syncmers.with_next(docs, lambda t: F.array(F.length(t))).collect()}
    order = ["null", "below"] + [f"text {i}" for i in range(60)]
    assert got == {a: b for a, b in zip(order, order[1:] + order[:1])}


def test_anchors_are_free_of_context(table):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = table([(1, passage, "en", "s", 0), (2, "other words go first " + passage + " and last", "en", "s", 0)])
    a, b = (r.anchors for r in syncmers.fingerprints(docs).orderBy("doc_id").collect())
    assert {x.hash for x in a} <= {x.hash for x in b}
    shift = {x.hash: x.position for x in b}
    assert {shift[x.hash] - x.position for x in a} == {4}
    k, w = syncmers.K, syncmers.K - syncmers.S + 1
    assert 0.25 * (40 - k) < len(a) < 0.85 * (40 - k) and w == 4


def test_every_anchor_counts(table):
    base = [f"w{i}" for i in range(1500)]
    docs = table([(i, " ".join(base[:i] + [f"new{i}"] + base[i + 1 :]), "en", "s", 0) for i in range(300, 1500, 100)])
    found = {r.doc_id: r for r in syncmers.fingerprints(docs).collect()}
    hashes = {d: {a.hash for a in r.anchors} for d, r in found.items()}
    rows = {r.doc_id: r for r in syncmers.compared(docs).collect()}
    ids = sorted(rows)
    assert min(map(len, hashes.values())) > 400 and len({r.fingerprint for r in rows.values()}) == len(ids)
    for d, after in zip(ids, ids[1:] + ids[:1]):
        assert rows[d].fingerprint == "".join(f"{a.hash & (1 << 64) - 1:016x}{a.position:08x}" for a in found[d].anchors)
        a, b = hashes[d], hashes[after]
        assert rows[d].near_next == 2 * len(a & b) / (len(a) + len(b)) < 1


def test_positional_matching(table):
    a, b = " ".join(f"a{i}" for i in range(200)), " ".join(f"b{i}" for i in range(200))
    docs = table([(1, f"{a} {b}", "en", "s", 0), (2, f"{b} {a}", "en", "s", 0), (3, f"x y z {b} {a}", "en", "s", 0), (4, "again " * 500, "en", "s", 0), (5, "again " * 500, "en", "s", 0)])
    rows = {r.doc_id: r for r in syncmers.compared(docs).collect()}
    found = {r.doc_id: {h.hash: h.position for h in reversed(r.anchors)} for r in syncmers.fingerprints(docs).collect()}
    for d, after in ((1, 2), (2, 3), (3, 4), (4, 5), (5, 1)):
        x, y = found[d], found[after]
        apart = Counter(x[h] - y[h] for h in x.keys() & y.keys())
        assert rows[d].aligned_next == 2 * max(apart.values(), default=0) / (len(x) + len(y)) <= rows[d].near_next
    assert rows[1].near_next > 0.95 and rows[1].aligned_next < 0.6 and rows[2].aligned_next > 0.95 and rows[4].aligned_next == 1.0


def test_rows_without_ids_are_dealt_out(table):
    docs = table([(None, f"text {i}", "en", "s", 0) for i in range(300)] + [(i, f"own {i}", "en", "s", 0) for i in range(5)])
    got = {r.text: r.next_text for r in syncmers.with_next(docs, lambda t: F.array(F.length(t))).collect()}
    tie = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted((t for t in tie if t[0] == "t"), key=tie.get) + [f"own {i}" for i in range(5)]
    assert got == {a: b for a, b in zip(order, order[1:] + order[:1])}


def brute_repeats(ws):
    c = Counter(zip(ws, ws[1:], ws[2:]))
    return len({i + d for i in range(len(ws) - 2) if c[tuple(ws[i : i + 3])] > 1 for d in (0, 1, 2)})


def test_quality_measures(odd, clashing, empty, marks, table):
    labels = marks([(1, 1, 0), (3, 1, 0), (8, 0, 0), (None, 1, 0), (2, None, None)])
    rows = {r.doc_id: r for r in quality_rules.judge(odd, labels).collect() if r.doc_id is not None}
    for d, t in odd.where("doc_id is not null").select("doc_id", "text").collect():
        ws = [w.decode() for w in (t or "").encode().split()]
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = rows[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(map(len, ws)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), brute_repeats(ws))
        assert r.base_failed == (len(ws) < 50 or 100 * r.n_repeat_words > 50 * len(ws)) and not (r.kept and r.base_failed)
    assert quality_rules.judge(odd, marks([])).count() == odd.count()
    assert quality_rules.judge(empty, labels).count() == 0
    out = quality_rules.judge(clashing, labels)
    assert out.count() == odd.count() and no_python(out)


def test_repeats_overlap_and_collide(table):
    texts = ["a b c a b c", "a a a a", "a b c d e f", "x y z x y", "q w e r t y q w e", "a b c x a b c y a b c", "one two", ""]
    got = {r.text: r.n for r in table([(i, t, "en", "s", 0) for i, t in enumerate(texts)]).select("text", quality_rules.repeated_words(quality_rules.words(F.col("text"))).alias("n")).collect()}
    assert got == {t: brute_repeats(t.split()) for t in texts}


def test_junk_scores_below_trusted(table, marks):
    good = [(i, " ".join(f"good{(i * 7 + j) % 90}" for j in range(80)), "en", "s", 0) for i in range(60)]
    junk = [(100 + i, " ".join(f"JUNK{(i * 3 + j) % 50}!!" for j in range(80)), "en", "s", 0) for i in range(20)]
    labels = marks([(i, 1, 0) for i in range(0, 60, 2)])
    rows = quality_rules.judge(table(good + junk), labels).collect()
    assert all(r.kept == (r.doc_id < 100) for r in rows)


def test_licences(table, odd, clashing, empty):
    mit = ". ".join(licenses.PUBLISHED[k] for k in ("mit-grant", "mit-notice", "as-is-software"))
    swapped = ". ".join(licenses.PUBLISHED[k] for k in ("mit-notice", "mit-grant", "as-is-software"))
    docs = table([
        (1, "Some words.\nReleased under the MIT License.", "en", "s", 0),
        (2, mit + ".", "en", "s", 0),
        (3, swapped, "en", "s", 0),
        (4, "LICENSED under the Apache License, Version 2.0.\nAll rights reserved. More: licensed under CC BY-NC 4.0!", "en", "s", 0),
        (5, "I lost my licence and all rights were reserved", "en", "s", 0),
        (6, "Licensed under the MIT License, see LICENSE file.", "en", "s", 0),
    ])
    got = {r.doc_id: (r.licenses, r.n_sentences) for r in licenses.scan(docs).collect()}
    assert got == {1: ("mit", 1), 2: ("mit", 3), 3: ("", 3), 4: ("apache-2.0|proprietary|cc-by-nc-4.0", 3), 5: ("", 0), 6: ("mit", 1)}
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(empty).count() == 0
    out = licenses.scan(clashing)
    assert out.count() == odd.count() and no_python(out)


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""


# What published licences say of themselves, as far as their rules go.
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
AGPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software."
ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def test_ten_licences_at_any_width(table):
    import textwrap

    texts = {"isc": ISC, "lgpl-2.1": LGPL, "agpl-3.0": AGPL, "mpl-2.0": MPL, "zlib": ZLIB, "unlicense": UNLICENSE, "bsd-3-clause": BSD + "\n\n" + ENDORSE, "mit": MIT, "gpl-3.0": GPL, "apache-2.0": APACHE}
    rows = [(name, "\n\n".join(textwrap.fill(p, width, initial_indent=lead, subsequent_indent=lead) for p in text.split("\n\n"))) for name, text in texts.items() for width in (72, 76, 80) for lead in ("", "# ", " * ")]
    docs = table([(i, t, "en", "s", 0) for i, (_, t) in enumerate(rows)])
    got = {r.doc_id: r.licenses for r in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [name for name, _ in rows]


def test_known_sentences_are_whole():
    assert all(s and licenses.normal(s) == s for s in licenses.SENTENCES.values())
    assert {x for _, rule in licenses.RULES for x in rule} <= set(licenses.SENTENCES)


def test_wrapped_licences(table):
    texts = {}
    for name, text in (("apache-2.0", APACHE), ("mit", MIT), ("gpl-3.0", GPL), ("bsd-2-clause", BSD)):
        for start, lead, end in (("", "", ""), ("/*\n", " * ", "\n */\nint x;"), ("", "# ", "\nx = 1"), ("", "-- ", ""), ("", "// ", "\r\n")):
            texts[start + "\n".join(lead + x for x in text.split("\n")) + end] = name
        texts[text.replace("\n", "\r\n")] = name
    texts |= {"// SPDX-License-Identifier: MIT\nint x;": "mit", "# SPDX-License-Identifier: Apache-2.0": "apache-2.0", "/* SPDX-License-Identifier: GPL-3.0-only */": "gpl-3.0"}
    texts |= {"It is released under\nthe MIT\nLicense": "mit", "Released under. The MIT License": "", "SPDX-License-Identifier:\n\nMIT": "", "released under the MIT " + "\n" * 80 + "license": ""}
    docs = table([(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    got = {r.doc_id: r.licenses for r in licenses.scan(docs).collect()}
    assert {t: got[i] for i, t in enumerate(texts)} == texts


def test_licences_like_sql(spark, sf):
    import duckdb

    got = sorted(map(tuple, licenses.scan(spark.read.parquet(f"{sf}/documents.parquet")).collect()))
    assert got == sorted(duckdb.sql(licenses.oracle_sql().replace("FROM documents", f"FROM '{sf}/documents.parquet'")).fetchall())
