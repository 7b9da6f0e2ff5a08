"""Quality rules and licence scans: defined cases, and SQL on the driver's tables."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from pairmill.llm import license_scan, quality_rules, queries

PROSE = " ".join(f"Sentence {i} tells of place {i * 3} that {i * 5} people have seen, near {i * 7} old trees." for i in range(12))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rel = con.sql(queries.SQL[name])
    assert sorted(rel.columns) == cols
    assert Counter(tuple(r) for r in df.select(*cols).collect()) == Counter(rel.project(", ".join(cols)).fetchall())


def _brute(t):
    import re

    t = t or ""
    words = [w for w in re.split("[ \t-\r]+", t) if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if re.search("[^ \t-\r]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t ", "one", PROSE, "a " * 400, "x\ny\nx\n\n\nx \r\n", " ".join("abcdefgh") + " z " + " ".join("abcdefgh"), "é€😀 # | < > $$\x0b\x0cword", PROSE + "\n" + PROSE,
    " ".join(str(i % 9) for i in range(3000)), "w" * 100_000, " ".join(map(str, range(30_000))) + " " + " ".join(map(str, range(15_000))),
]


def test_base_counts_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, PROSE, 1)], "doc_id long, text string, n_words int")
    rows = {r["doc_id"]: r for r in quality_rules.quality_report(df).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == _brute(t), i
        n, _, _, _, rep = _brute(t)
        assert r["base_failed"] == (n < 20 or 100 * rep > 30 * n)
        assert not (r["base_failed"] and r["kept"])
    assert rows[None]["kept"] and rows[4]["kept"] and rows[4]["clean_text"] == PROSE


def test_lines_that_fail_go_and_the_rest_stays(spark):
    page = "\n".join(["Home", "Menu | News | Sport | Weather", PROSE, "", "All rights reserved.", "buy now", "w### w$$$ x***", PROSE.upper()])
    df = spark.createDataFrame([(1, page, "kept as it is")], "doc_id long, text string, clean string")
    out = quality_rules.clean(df).collect()
    assert [tuple(r) for r in out] == [(1, "\n".join([PROSE, "", PROSE.upper()]), "kept as it is")]


def test_documents_that_lose_too_much_go(spark):
    page = "\n".join([PROSE[:200] + ".", *["one | two | three | four | five | six"] * 40])
    df = spark.createDataFrame([(1, page), (2, PROSE), (2, PROSE)], "doc_id long, text string")
    assert [r["doc_id"] for r in quality_rules.clean(df).collect()] == [2, 2]
    assert quality_rules.clean(df.limit(0)).count() == 0


def test_every_known_sentence_has_a_trigger_and_recognises_itself(spark):
    df = spark.createDataFrame([(k, v.replace("#", "3.0").upper() + ".") for k, v in license_scan.SENTENCES.items()], "doc_id string, text string")
    assert df.filter(~F.col("text").rlike(license_scan.TRIGGER)).count() == 0
    assert all(r["sentence_ids"] == r["doc_id"] for r in license_scan.license_scan(df).collect())


def test_ordered_rules(spark):
    s = license_scan.SENTENCES
    full = f"{s['mit_grant']}. Some words. {s['mit_condition']}! {s['mit_warranty']}."
    swapped = f"{s['mit_condition']}. {s['mit_grant']}."
    both = f"Hello.\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License."
    rows = [(1, full), (2, swapped), (3, both), (4, None), (5, ""), (6, "the licence of nothing known"), (7, "Licensed under CC BY-NC 4.0."), (7, "Licensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert (got[1]["rules"], got[1]["licenses"], got[1]["n_sentences"]) == ("mit_full", "MIT", 3)
    assert got[2]["rules"] == "mit_text"
    assert (got[3]["rules"], got[3]["licenses"]) == ("mit_short apache_short", "MIT Apache")
    assert [got[i]["rules"] for i in (4, 5, 6)] == ["", "", ""] and got[4]["n_sentences"] == 0
    assert got[7]["licenses"] == "CC-BY-NC"


NOTICES = {
    "gpl_full": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "mit_full": """Permission is hereby granted, free of charge, to any person obtaining a copy
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
AUTHORS BE LIABLE FOR ANY CLAIM.""",
    "apache_full": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "lgpl_full": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public
License along with this library; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA""",
    "agpl_full": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU Affero General Public License for more details.

You should have received a copy of the GNU Affero General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "mpl_full": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "isc_full": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES.""",
    "unlicense_full": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "bsd_three": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.""",
    "bsd_full": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE.""",
}


def test_licence_texts_as_they_are_published(spark):
    rows = []
    for rule, text in NOTICES.items():
        lines = text.split("\n")
        rows += [(rule, text), (rule, text.replace("\n", "\r\n"))]
        rows += [(rule, "\n\n".join(p.replace("\n", " ") for p in text.split("\n\n"))), (rule, " ".join(text.split()))]
        rows += [(rule, "\n".join(f"{sign} {x}".rstrip() for x in lines)) for sign in ("#", "//", " *")]
    rows.append(("gpl_full", NOTICES["gpl_full"].replace("software:", "software;").replace("program.  If not", "program; if not").replace("version 3", "version 2")))
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == 7 * len(NOTICES) + 1 and [(r["doc_id"], r["rules"]) for r in got if r["rules"] != r["doc_id"]] == []


def test_sql_equals_the_scan_on_published_texts_and_odd_cases(spark, tmp_path):
    import duckdb

    lines = lambda t, sign: "\n".join(f"{sign} {x}".rstrip() for x in t.split("\n"))
    texts = [t for n in NOTICES.values() for t in (n, n.replace("\n", "\r\n"), " ".join(n.split()), lines(n, "#"), lines(n, " *"), lines(n, ">"))]
    texts += [f"{a}\n{b}" for a in ("Released under the MIT License.", "MIT. 2.0 \x0b; # x") for b in ("Licensed under CC BY 4.0;", "# \r\n#\r\n# Licensed under CC BY 4.0")]
    texts += ["", " ", None, "x" * 100_000 + ". Released under the MIT License.", "Licensed under the Apache License.\u2028Version 2"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, cid int")
    assert license_scan.license_scan(df.limit(0)).count() == 0
    mine = sorted(map(tuple, license_scan.license_scan(df).collect()))
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    assert mine == sorted(con.sql(queries.SQL["op2_license_scan"]).fetchall())


def test_native(spark, sf_dir):
    for name in ("op1_quality_rules", "op2_license_scan"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize(
    "text, rules, licenses",
    [
        ("// SPDX-License-Identifier: MIT\nint x;", "spdx_mit", "MIT"),
        ("# spdx-license-identifier: GPL-2.0-or-later", "spdx_gpl_n_or_later", "GPL"),
        ("/* SPDX-License-Identifier: BSD-3-Clause */", "spdx_bsd_n_clause", "BSD"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
         "Neither the name of Some Firm GmbH & Co nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
         "THIS SOFTWARE IS PROVIDED BY SOME FIRM ''AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.", "bsd_three", "BSD"),
        ("# Licensed to the Apache Software Foundation (ASF) under one or more\n# contributor license agreements.  See the NOTICE file.\n# The ASF licenses this file to You under the Apache License, Version 2.0\n# (the \"License\"); you may not use this file except in compliance with\n# the License.", "asf_header apache_short", "Apache"),
        ("This program is free software; you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation.", "gpl_only_grant", "GPL"),
    ],
)
def test_notices_tags_and_holders(spark, text, rules, licenses):
    got = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["licenses"] == licenses and got["rules"].split(" ")[0] == rules.split(" ")[0]


def test_full_texts_of_a_machine(spark):
    import os

    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache", "Artistic": "Artistic", "BSD": "BSD", "CC0-1.0": "CC0", "GFDL-1.2": "GFDL", "GFDL-1.3": "GFDL", "GPL-1": "GPL", "GPL-2": "GPL", "GPL-3": "GPL", "LGPL-2": "LGPL", "LGPL-2.1": "LGPL", "LGPL-3": "LGPL", "MPL-1.1": "MPL", "MPL-2.0": "MPL"}
    there = [n for n in names if os.path.isfile(f"{folder}/{n}")]
    if not there:
        pytest.skip("no licence texts here")
    rows = [(n, open(f"{folder}/{n}", errors="replace").read()) for n in there]
    got = {r["doc_id"]: r["licenses"] for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {n: names[n] for n in there}


def test_phrases_of_four_languages(spark):
    lines = ["Startseite", "MENÜ", "à propos", "Précédent »", "Leer más", "ÜBER UNS", "Alle Rechte vorbehalten, Firma 2020.", "Politique de confidentialité et plus encore ici.", "Aceptar todas las cookies de este sitio ahora."]
    page = "\n".join([*lines[:5], PROSE, *lines[5:], PROSE.upper()])
    out = quality_rules.clean(spark.createDataFrame([(1, page)], "doc_id long, text string")).first()
    assert out["text"] == "\n".join([PROSE, PROSE.upper()])
