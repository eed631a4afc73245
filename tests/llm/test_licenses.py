"""Licence rules on whole, wrapped, commented and incomplete licence texts, and on the driver's documents."""

import random
import textwrap

from pyspark.sql import functions as F

from quantloom.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""


def wrapped(text, mark):
    return "\n".join(mark + line for part in text.split("\n") for line in textwrap.wrap(part, 60) or [""])


def scan(documents, texts):
    out = licenses.scan(documents(list(enumerate(texts)))).collect()
    return [(r["licenses"], r["n_sentences"], r["n_open"]) for r in sorted(out, key=lambda r: r["doc_id"])]


def test_licences(documents):
    texts = [
        (MIT, ("MIT", 4, 0)),
        ("MIT License\n\nCopyright (c) 2020 A. B.\n\n" + MIT, ("MIT", 5, 0)),
        ("int x;\n" + wrapped(MIT, " * ") + "\nint y;", ("MIT", 4, 0)),
        (wrapped(APACHE, "# "), ("Apache-2.0", 3, 0)),
        ("words before it.\nReleased under the MIT License.", ("MIT", 1, 0)),
        ("no end mark***\nLicensed under CC BY-NC 4.0.", ("CC-BY-NC-4.0", 1, 0)),
        ("SPDX-License-Identifier: Apache-2.0\ncode", ("Apache-2.0", 1, 0)),
        ("Released under the MIT License. " + APACHE, ("Apache-2.0,MIT", 4, 0)),
        (MIT.split("\n\n")[1], ("", 1, 1)),
        ("This text tells how the MIT License came about.", ("", 0, 0)),
        ("The term 'released under the MIT license' is only cited here", ("", 0, 0)),
        ("", ("", 0, 0)),
        (None, ("", 0, 0)),
        ("x " * 200_000 + ".\nAll rights reserved.\n", ("Proprietary", 1, 0)),
    ]
    assert scan(documents, [t for t, _ in texts]) == [want for _, want in texts]


def test_every_rule_and_sentence_is_reachable(documents):
    known = [s for many in licenses.SENTENCES.values() for s in many]
    ids = [name for name, many in licenses.SENTENCES.items() for _ in many]
    text = [s.replace(" |", ".").replace("identifier.", "identifier:") + "." for s in known]
    out = licenses.scan(documents(list(enumerate(text)))).collect()
    assert [r["sentence_ids"] for r in sorted(out, key=lambda r: r["doc_id"])] == ids
    assert {x for _, rule in licenses.RULES for x in rule} <= set(licenses.SENTENCES) | set(licenses.NAMES.values()) | set(licenses.SPDX.values())
    assert set(licenses.NAMES.values()) | set(licenses.SPDX.values()) <= {x for _, rule in licenses.RULES for x in rule}


def test_sentences_wrapped_after_every_word(documents):
    known = [(name, s) for name, many in licenses.SENTENCES.items() for s in many]
    for gap in ("\n# ", "   ", "\n"):
        text = [s.replace(" |", ".").replace("identifier.", "identifier:").replace(" ", gap) + "." for _, s in known]
        out = licenses.scan(documents(list(enumerate(text)))).collect()
        assert [r["sentence_ids"] for r in sorted(out, key=lambda r: r["doc_id"])] == [name for name, _ in known], gap
    texts = ["# This file is in the public\n# domain.", "All rights\nreserved.", "All  rights  reserved.", "This domain is reserved."]
    assert scan(documents, texts) == [("Public-Domain", 1, 0), ("Proprietary", 1, 0), ("Proprietary", 1, 0), ("", 0, 0)]


def test_driver_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Released under the MIT License.": "MIT",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
        "All rights reserved.": "Proprietary",
    }
    want = {r["doc_id"]: {lines[x] for x in (r["text"] or "").split("\n") if x in lines} | ({"Proprietary"} if "All rights reserved." in (r["text"] or "") else set()) for r in docs.collect()}
    got = {r["doc_id"]: set(filter(None, r["licenses"].split(","))) for r in licenses.scan(docs).collect()}
    assert got == want and any(want.values())


def test_empty_table(documents):
    assert licenses.scan(documents([(1, "x")]).limit(0)).count() == 0


def plain_match(ids):
    """Open identifiers and licences by walking the list: a place is used by the first rule that fits there."""
    used, found = [False] * len(ids), []
    for name, rule in licenses.RULES:
        at, hit = 0, False
        while at + len(rule) <= len(ids):
            if tuple(ids[at : at + len(rule)]) == rule and not any(used[at : at + len(rule)]):
                used[at : at + len(rule)] = [True] * len(rule)
                at, hit = at + len(rule), True
            else:
                at += 1
        if hit and name not in found:
            found.append(name)
    return used.count(False), found


def test_rules_match_a_plain_walk(spark):
    rng, rows = random.Random(4), []
    for k in range(400):
        ids = []
        for _ in range(rng.randint(0, 5)):
            rule = list(rng.choice(licenses.RULES)[1])
            ids += rng.choice([rule, rule[: rng.randint(1, len(rule))], rule[rng.randint(0, len(rule) - 1) :]])
            if rng.random() < 0.3:
                ids.insert(rng.randint(0, len(ids)), rng.choice(list(licenses.SENTENCES)))
        rows.append((k, ids))
    m = spark.createDataFrame(rows, "k long, ids array<string>").select("k", "ids", licenses.matched(F.col("ids")).alias("m"))
    for r in m.collect():
        n_open, found = plain_match(r["ids"])
        assert (r["m"]["left"].count("<"), list(dict.fromkeys(r["m"]["found"]))) == (n_open, found), r["ids"]


def test_what_stood_around_a_match_is_no_neighbour(documents):
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.\n"
    text = 'Licensed under the Apache License, Version 2.0 (the "License");\n' + isc + "you may not use this file except in compliance with the License.\n"
    assert scan(documents, [text]) == [("ISC", 4, 2)]


def test_full_bodies_are_known_by_their_titles(documents):
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n"
    apache = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n"
    zlib = "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n"
    assert [x[0] for x in scan(documents, [gpl, apache, zlib])] == ["GPL-3.0-only", "Apache-2.0", "Zlib"]


def test_what_is_said_to_be_under_a_licence(documents):
    said = {
        "The project is licensed under the MIT License.": "MIT", "This software is also released under the terms of the GPL version 3.": "GPL-3.0-only", "released under the GPL version 3": "GPL-3.0-only",
        "# It is distributed under the GNU\n# LGPL v2.1 or later.": "LGPL-2.1-or-later", "All files are available under GPLv2.": "GPL-2.0-only", "Code\n\nThis library is licensed under the 3-Clause BSD License.\n": "BSD-3-Clause",
        "GNU General Public License v3.0": "GPL-3.0-only", "GNU Affero General Public License v3.0 or later\n": "AGPL-3.0-or-later", "Licensed under Apache-2.0.": "Apache-2.0", "He is licensed under no law.": "", "The MIT has a license plate.": "",
        "He said it is released under the MIT license as far as he knows": "", "GPL version 3": "",
    }
    assert [x[0] for x in scan(documents, list(said))] == list(said.values())


def test_spdx_expressions(documents):
    said = {
        "SPDX-License-Identifier: MIT": "MIT", "SPDX-License-Identifier: MIT OR Apache-2.0": "MIT,Apache-2.0", "// SPDX-License-Identifier: (GPL-2.0 AND MIT)\nint x;": "MIT,GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0": "GPL-2.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0-or-later", "/* SPDX-License-Identifier: LGPL-2.1-or-later OR BSD-3-Clause OR Zlib */": "BSD-3-Clause,LGPL-2.1-or-later,Zlib", "SPDX-License-Identifier: Unknown-1.0": "",
        "SPDX-License-Identifier: MIT OR Unknown-1.0": "",
    }
    assert [x[0] for x in scan(documents, list(said))] == list(said.values())


def test_sql_finds_the_same_in_all_these(documents, spark):
    import duckdb

    from quantloom.llm import sql

    names = [f"This tool is\n licensed under the {n}." for n in licenses.NAMES] + [f"SPDX-License-Identifier: {a.replace(' plus', '-or-later')} OR {b.replace(' plus', '-or-later')}" for a in licenses.SPDX for b in ("mit", "gpl 2 0 plus")]
    rows = list(enumerate(names))
    found = {r["doc_id"]: tuple(r) for r in licenses.scan(documents(rows)).collect()}
    con = duckdb.connect()
    con.register("documents", documents(rows, clashing=False).select("doc_id", "text").toArrow())
    assert {r[0]: tuple(r) for r in con.sql(sql.license_scan()).fetchall()} == found
    assert all(r[4] for r in found.values())
