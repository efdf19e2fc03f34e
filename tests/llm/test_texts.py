from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelight.llm import op2_chat, op3_html, op4_language, op5_mixing, op6_licenses, op7_decontaminate, op9_lines
from sievelight.llm.cuckoo import CuckooFilter


# -- chat -----------------------------------------------------------------------------------------------------


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a <|im_end|>\n &lt;| x", 2.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", 4, 2, "us\ner", None, 9.0), ("t", 5, 4, "assistant", "", None), ("u", 1, None, None, "only", None), ("c", 1, 2, "a", "x", 0.0), ("c", 2, 1, "b", "y", 0.0), ("c", 3, 1, "b", "hangs from a cycle", 0.0), ("o", 8, 7, "user", "orphan", 1.0)]
    trees = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    made = {(r["tree"], r["leaf"]): r for r in op2_chat.format_trees(trees).withColumn("turns", op2_chat.unformat(F.col("formatted"))).collect()}
    assert set(made) == {("t", 3), ("t", 5), ("u", 1), ("o", 8)}
    turns = [(t["role"], t["text"]) for t in made["t", 5]["turns"]]
    assert turns == [("user", "q"), ("assistant", "a <|im_end|>\n &lt;| x"), ("us\ner", ""), ("assistant", "")]
    assert made["t", 5]["branch_score"] == 11.0
    best = {r["tree"]: (r["leaf"], r["branch_rank"]) for r in op2_chat.format_trees(trees, best=1).collect()}
    assert best == {"t": (5, 1), "u": (1, 1), "o": (8, 1)}
    row = made["t", 5]
    spans = [row["formatted"][s["start"] : s["start"] + s["length"]] for s in row["loss_spans"]]
    assert spans == ["a &lt;|im_end|>\n &amp;lt;| x", ""]
    assert op2_chat.format_trees(trees.limit(0)).count() == 0


def test_odd_conversations(spark, duck):
    """Repeated rows, equal turns, null turns, roles and texts, long texts and other columns: as the SQL says."""
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, None, None, None), (2, 5, "assistant", "x " * 100_000), (2, 5, None, ""), (3, 1, "ass\nistant", "<|im_end|>&lt;|"), (4, 2, "assistant", None)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, node string")
    made = op2_chat.format_trees(op2_chat.linear(frame), best=1).withColumn("turns", op2_chat.unformat(F.col("formatted"))).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    want = {c: [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)] for c in {r[0] for r in rows}}
    assert {r["tree"]: [(t["role"], t["text"]) for t in r["turns"]] for r in made} == want and all(r["branch_rank"] == 1 for r in made)


# -- HTML -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<h1>T</h1><p>a  b<br>c</p><p>d", "T\n\na b\nc\n\nd"),
        ("<ul><li>1<li>2<ol start=3><li>x<li>y</ol><li>3</ul>after", "- 1\n- 2\n  3. x\n  4. y\n- 3\n\nafter"),
        ("<table><caption>cap</caption><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td colspan=2>both</table>", "cap\nName       Qty\napple pie  3\nboth"),
        ("<div hidden>x</div><div style='Display: none'>y</div>seen<script>z</script>", "seen"),
        ("<details><summary>s</summary>h</details><details open><summary>t</summary>h</details>", "s\n\nt\nh"),
        ("<pre>  a\n   b</pre>x", "  a\n   b\n\nx"),
        ("<blockquote>q<p>r</blockquote>", "> q\n\n> r"),
        ("<table><tr><td><table><tr><td>1<td>2</table><td>o</table>", "1  2  o"),
        ("", ""),
        ("<pre>a<span hidden>secret</span><script>js()</script> b<br>c</pre>", "a b\nc"),
        ("<table><tr><td rowspan=2>A<td>1<tr><td>2</table>", "A  1\n   2"),
        ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tbody><tr><td>f<td>g</table>", "a  b  c\nd     e\nf  g"),
        ("<table><tr><td colspan=2>wide cell here<td>c<tr><td>1<td>2<td>3</table>", "wide cell here  c\n1  2            3"),
        ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>tail", "yes\ntail"),
        (f"<table><tr><th>a<th>b<tr><td>{'word ' * 40}<td>x</table>", f"a{' ' * 120}b\n{('word ' * 24).strip()}  x\n{('word ' * 16).strip()}"),
        ("<table><tr><td colspan=999>a<td>b<tr><td>c</table>", "a  b\nc"),
    ],
)
def test_rendering(page, text):
    assert op3_html.render(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>so <math display=block><semantics><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></mrow><annotation>tex</annotation></semantics></math> holds", "so x= 1 2 holds"),
        ("<math><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mn>3</mn></mtd></mtr></mtable></math>", "1 2\n3"),
        ("<svg><title>t</title><desc>d</desc><defs><text>u</text></defs><rect/><text>A</text><text>B<tspan>b</tspan></text><text display=none>h</text></svg>", "A\nBb"),
        ("a <map name=m><p>in a map</p><area alt=x></map> b", "a\n\nin a map\n\nb"),
        ("<table>s1<tr><td>1</td></tr>s2<tr><td>2</td></tr>s3</table>", "s1 s2 s3\n1\n2"),
        ("<table><thead>h<tr><th>H</tr>t</thead><tfoot>f<tr><td>F</tr></tfoot></table>", "h t f\nH\nF"),
        ("<table><tr>x<td>1</td>y<td>2</td>z</tr></table>", "1      2\nx y z"),
        ("<table><tr><input value=go><td>1</table>", "go  1"),
        ("<table><tr><td>1</td></tr><pre>a\n b</pre></table>", "1\na\n b"),
    ],
)
def test_nothing_visible_is_lost(page, text):
    assert op3_html.render(page) == text


def random_page(rnd: random.Random, shown: list[str], hidden: list[str]) -> str:
    """A page of elements that the builder leaves where they are; shown and hidden get the words that are to be seen or not."""
    count = 0

    def word(seen: bool) -> str:
        nonlocal count
        count += 1
        (shown if seen else hidden).append(f"w{count}w")
        return f" w{count}w "

    def make(depth: int, there: bool, drawn_: bool, kinds: list[str]) -> str:
        tag = rnd.choice(kinds)
        style, here, now = "", there, drawn_
        roll = rnd.random()
        if roll < 0.08:
            style, here = " hidden", False
        elif roll < 0.14:
            style, here = " style='color: red; display:none'", False
        elif roll < 0.22:
            style, now = " style='visibility: hidden'", False
        elif roll < 0.3:
            style, now = " style='visibility:visible'", True
        if tag in ("script", "style", "svg-title"):
            inside = word(False)
            return f"<script>{inside}</script>" if tag != "svg-title" else f"<svg><title>{inside}</title></svg>"
        if tag == "table":
            rows = "".join("<tr>" + "".join(f"<td rowspan={rnd.randrange(3)} colspan={rnd.randrange(1, 3)}>{body(depth + 1, here, now)}</td>" for _ in range(rnd.randrange(1, 4))) + "</tr>" for _ in range(rnd.randrange(1, 4)))
            return f"<table{style}>{rows}</table>"
        if tag in ("ul", "ol"):
            return f"<{tag}{style}>" + "".join(f"<li>{body(depth + 1, here, now)}</li>" for _ in range(rnd.randrange(1, 4))) + f"</{tag}>"
        return f"<{tag}{style}>{body(depth + 1, here, now, ['b', 'span'] if tag in ('pre', 'b', 'span') else None)}</{tag}>"

    def body(depth: int, there: bool, drawn_: bool, kinds: list[str] | None = None) -> str:
        out = ""
        for _ in range(rnd.randrange(0, 4) if depth < 5 else 0):
            out += word(there and drawn_) if rnd.random() < 0.5 else make(depth, there, drawn_, kinds or ["div", "section", "b", "span", "pre", "table", "ul", "ol", "blockquote", "script", "svg-title"])
        return out

    return body(0, True, True)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9))
def test_random_trees(seed):
    """Each visible word once, none of the others."""
    shown: list[str] = []
    hidden: list[str] = []
    page = random_page(random.Random(seed), shown, hidden)
    assert sorted(re.findall(r"w\d+w", op3_html.render(page))) == sorted(shown), page


def test_html_edge_cases(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "<div>" * 4000 + "deep"), (None, "<p>x")], "page_id long, html string")
    got = sorted((str(r["page_id"]), r["text"], r["error"]) for r in op3_html.extract_text(rows).collect())
    assert got == [("1", None, None), ("1", None, None), ("2", "", None), ("3", "deep", None), ("None", "x", None)]


def test_html_on_the_tables(spark, data):
    """By the grammar of these pages: no markup and no script is left, and every paragraph is there."""
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in op3_html.op3_html(spark, data).collect():
        assert "track(" not in r["text"] and "<p>" not in r["text"] and r["error"] is None
        squeezed = re.sub(r"\s+", "", r["text"])
        for p in re.findall(r"<p>([^<&]+)", pages[r["page_id"]]):
            assert re.sub(r"\s+", "", p) in squeezed


# -- language -------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark, data):
    made = op4_language.op4_language(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = made.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")), F.count("*")).first()
    assert right >= 0.95 and n > 20
    assert made.where("score < 0 or score > 1").count() == 0


def test_language_edge_cases(spark, docs, nothing):
    model = op4_language.learn(docs)
    odd = spark.createDataFrame([(1, "\u00bd \u00b2 123 ..."), (2, "\u00bdeine kleine Katze\u00b2"), (3, "eine kleine Katze " * 100_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in op4_language.classify(odd, model, ["doc_id"]).collect()} == {1: "und", 2: "de", 3: "de"}
    got = {(r["doc_id"], r["lang_pred"], r["rejected"]) for r in op4_language.classify(docs, model, ["doc_id", "size"]).collect()}
    assert (9, "und", True) in got and (7, "und", True) in got and (8, "und", True) in got and (1, "de", False) in got and (3, "en", False) in got
    assert op4_language.learn(nothing) == []
    assert {r["lang_pred"] for r in op4_language.classify(docs, [], ["doc_id"]).collect()} == {"und"}
    assert op4_language.classify(nothing, model, ["doc_id"]).count() == 0


# -- mixing ---------------------------------------------------------------------------------------------------


def test_targets(spark):
    sized = spark.createDataFrame([(k, s, n) for k, (s, n) in enumerate([("a", 100), ("b", 100), ("c", 1000), (None, 50), ("z", 0)])], "doc_id long, source string, size long")
    got = {r["source"]: r["target"] for r in op5_mixing.targets(sized).collect()}
    # 1875 words are wanted. Weights by name: a 3, b 1, c 2, z 3, none 1. a, z and the rows without a source are full.
    assert got["a"] == 200 and got["z"] == 0 and got[None] == 100 and abs(got["b"] - 200) < 1e-9 and abs(got["c"] - 1375) < 1e-9
    assert abs(sum(got.values()) - 1.5 * 1250) < 1e-9


def test_mix(spark, docs, nothing):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randrange(1, 200), "en", "abcd"[min(3, rng.randrange(9))], 0) for k in range(3000)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long")
    sized = op5_mixing.sizes(many)
    per = op5_mixing.copies(sized, sized, op5_mixing.targets(sized), 64).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")), F.first("target"), F.max("copies"))
    for _, taken, target, most in per.collect():
        assert abs(taken - target) <= 0.02 * target and most <= 2
    mixed = op5_mixing.mix(many)
    assert mixed.columns == many.columns and sorted(map(str, mixed.collect())) == sorted(map(str, op5_mixing.mix(many.repartition(7)).collect()))
    sized = op5_mixing.sizes(docs)
    made = op5_mixing.copies(sized, sized, op5_mixing.targets(sized), op5_mixing.slices_for(12))
    assert op5_mixing.slices_for(10**7) == 64 and op5_mixing.slices_for(10**10) == 1563
    assert made.count() == docs.count() and op5_mixing.mix(docs).columns == docs.columns
    assert op5_mixing.mix(nothing).count() == 0


# -- licences -------------------------------------------------------------------------------------------------


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    wrapped = "Licensed under the Apache License,\nVersion 2.0."
    rows = [(1, f"x.\n{mit}\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."), (2, wrapped), (3, "Released under the MIT License.\nAll rights reserved."), (4, None), (5, ""), (6, "my licence is none of these.")]
    got = {r["doc_id"]: (r["licences"], r["n_finds"], r["n_known"]) for r in op6_licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", 1, 2), 2: ("Apache-2.0", 1, 0), 3: ("MIT,proprietary", 2, 2), 4: ("", 0, 0), 5: ("", 0, 0), 6: ("", 0, 0)}


GPL_HOPE = "This {0} is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details."
GPL_FREE = "This {0} is free software{1} you can redistribute it and/or modify\nit under the terms of the GNU {2} as published by\nthe Free Software Foundation{3} either version {4} of the License, or\n(at your option) any later version.\n\n" + GPL_HOPE
BSD = """Copyright (c) 2020, X.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""
BSD_NAMES = "\n3. Neither the name of {0} nor the names of its contributors may be used to endorse or promote products\nderived from this software without specific prior written permission.\n"


def test_official_notices(spark):
    """Notices with marks inside, as they stand in files."""
    commented = lambda text: "/*\n" + "\n".join(" * " + x for x in text.split("\n")) + "\n */"
    cases = [
        (GPL_FREE.format("program", ":", "General Public License", ",", "3"), "GPL-3.0"),
        (commented(GPL_FREE.format("program", ";", "General Public License", ";", "2")), "GPL-2.0"),
        (GPL_FREE.format("library", ";", "Lesser General Public License", ";", "2.1"), "LGPL-2.1"),
        (GPL_FREE.format("library", ";", "Library General Public License", ";", "2"), "LGPL-2.0"),
        (GPL_FREE.format("program", ":", "Lesser General Public License", ",", "3"), "LGPL-3.0"),
        (GPL_FREE.format("program", ":", "Affero General Public License", ",", "3"), "AGPL-3.0"),
        ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.", "GPL-2.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.", "MPL-2.0"),
        (BSD, "BSD-2-Clause"), (BSD + BSD_NAMES.format("the copyright holder"), "BSD-3-Clause"), (BSD + BSD_NAMES.format("X, Inc. of Y"), "BSD-3-Clause"),
        ("This is free and unencumbered software released into the public\ndomain.", "Unlicense"),
        ("// SPDX-License-Identifier: MIT\nint x;", "MIT"), ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("/* SPDX-License-Identifier: GPL-3.0-only */", "GPL-3.0"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
        ("SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL-3.0"), ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"), ("SPDX-License-Identifier: GPL-2.0+", "GPL-2.0"),
        ("SPDX-License-Identifier: Zlib\n\nOr maybe:\n\nMIT", "Zlib"), ("SPDX-License-Identifier: Other\n\nOr maybe:\n\nMIT", ""), ("This program is free software: I wrote it.\n\nYou can redistribute it and/or modify it under the terms of the license.", ""),
    ]
    rows = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: (r["licences"], r["n_finds"]) for r in op6_licenses.scan(rows).collect()}
    assert got == {k: (licence, 1 if licence else 0) for k, (_, licence) in enumerate(cases)}


ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

{0}THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""


def test_wrapped_notices(spark):
    """Longest rules first, each sentence used once, two notices in one text, every known sentence with a cue."""
    cases = [
        (ZLIB, "Zlib", 1), (APACHE, "Apache-2.0", 1), (MIT.format(""), "MIT", 1), (MIT.format("The Software shall be used for Good, not Evil.\n\n"), "JSON", 1),
        (MIT.format("") + "\n" + ZLIB + "\n" + MIT.format(""), "MIT,Zlib", 3),
        (BSD + "\n3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\n   This product includes software.\n", "BSD-4-Clause", 1),
        ("This program and the accompanying materials are made available under the terms\nof the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/", "", 0),
        ("This program and the accompanying materials are made available under the terms\nof the Eclipse Public License 2.0 which is available at\n\nhttps://www.eclipse.org/legal/epl-2.0/", "EPL-2.0", 1),
        ("words " * 30_000 + "\nLicensed under CC BY 4.0.\n" + "words " * 30_000, "CC-BY-4.0", 1), (None, "", 0), ("", "", 0), ("license\n: \n;", "", 0),
    ]
    rows = spark.createDataFrame([(k, text, "x") for k, (text, _, _) in enumerate(cases)] + [(1, APACHE, "y")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["licences"], r["n_finds"]) for r in op6_licenses.scan(rows).collect())
    assert got == sorted([(k, licence, n) for k, (_, licence, n) in enumerate(cases)] + [(1, "Apache-2.0", 1)])
    assert op6_licenses.scan(rows.limit(0)).count() == 0
    cue = re.compile("|".join(op6_licenses.CUES), re.IGNORECASE)
    assert all(cue.search(s) for s in op6_licenses.SENTENCES.values()) and len({x for x, _ in op6_licenses.RULES}) > 30


# -- decontamination ------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(2, 5))
def test_automaton(items, words, window):
    coded = [(str(k), [w.encode() for w in item]) for k, item in enumerate(items)]
    automaton = op7_decontaminate.SuffixAutomaton(coded, window)
    spans, found, longest = automaton.run([w.encode() for w in words])
    assert longest == max((n for item in items for i in range(len(item)) for n in range(1, len(item) - i + 1) if any(words[j : j + n] == item[i : i + n] for j in range(len(words) - n + 1))), default=0)
    assert automaton.run([w.encode() for w in words], brief=False)[1] == found - automaton.brief
    hit, who = set(), set()
    for k, item in enumerate(items):
        for n in ([window] if len(item) >= window else [len(item)] if item else []):
            grams = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    who.add(k)
    assert {p for a, b in spans for p in range(a, b)} == hit and found == who
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_shards_agree(spark, data):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    one = op7_decontaminate.matched(docs, op7_decontaminate.shards(items)).drop("text")
    several = op7_decontaminate.shards(items, shard_words=700)
    assert several.n > 2
    many = op7_decontaminate.matched(docs, several).drop("text")
    assert sorted(map(str, one.collect())) == sorted(map(str, many.select(*one.columns).collect()))


def test_removal(spark, docs, nothing):
    items = spark.createDataFrame([(1, "Quick brown fox jumps over the lazy dog"), (2, None), (None, "one")], "item_id long, text string")
    automata = op7_decontaminate.shards(items)
    cut = {r["doc_id"]: (r["text"], r["n_hit"]) for r in op7_decontaminate.remove_spans(docs, automata, coverage=0.8).collect()}
    assert cut[5] == ("The  again and again", 8) and cut[2] == (None, 1) and cut[9] == (None, 0) and cut[7] == ("", 0)
    left = op7_decontaminate.clean(docs, automata)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert left.columns == docs.columns and {r["doc_id"]: r["text"] for r in left.collect() if r["doc_id"]} == {d: t for d, t in texts.items() if d in (1, 7, 8, 9)}
    assert op7_decontaminate.clean(nothing, automata).count() == 0
    assert op7_decontaminate.clean(docs, op7_decontaminate.shards(items.limit(0))).count() == docs.count()


@pytest.mark.parametrize("shard_words", [op7_decontaminate.SHARD_WORDS, 1])
def test_short_items(spark, shard_words):
    """Long matches, two items and coverage drop a text; one full window is cut from it; short items count for the coverage only."""
    items = spark.createDataFrame([(1, "yes"), (2, "new york"), (3, "a b c d e f g h i j"), (4, None), (5, " ".join(f"q{k}" for k in range(20)))], "item_id long, text string")
    texts = {
        1: "oh yes that is what they said in the end", 2: "Yes, New York is a big town of many people", 3: "yes!", 4: "new york city", 5: "in new york then",
        6: "x " * 500 + "b c d e f g h i " + "x " * 500, 7: "a b c d e f g and no more", 8: None, 9: "", 10: "yes yes no no", 11: "yes yes yes no no",
        12: "x " * 50 + " ".join(f"q{k}" for k in range(3, 16)), 13: "x " * 50 + " ".join(f"q{k}" for k in range(3, 15)), 14: "x " * 50 + "a b c d e f g h q0 q1 q2 q3 q4 q5 q6 q7",
    }
    docs = spark.createDataFrame([(t, k, [k], None if t is None else len(t)) for k, t in texts.items()], "text string, doc_id long, more array<long>, n_chars long")
    automata = op7_decontaminate.shards(items, shard_words=shard_words)
    assert (automata.n > 1) == (shard_words == 1)
    left = op7_decontaminate.clean(docs, automata)
    assert left.schema == docs.schema
    want = {k: texts[k] for k in (1, 2, 5, 7, 8, 9, 10)} | {6: "x " * 500 + " " + "x " * 500, 13: "x " * 50}
    assert {r["doc_id"]: r["text"] for r in left.collect()} == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in left.collect())


# -- lines ----------------------------------------------------------------------------------------------------


def test_cuckoo():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    made = CuckooFilter.of(keys)
    assert made.contains(keys).all()
    others = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    assert made.contains(others).mean() < 0.002
    again = CuckooFilter.load(made.dump())
    again.delete(keys[:5000])
    assert again.contains(keys[5000:]).all() and again.contains(keys[:5000]).mean() < 0.01
    assert not CuckooFilter(0).contains(keys[:3]).any()


def kept_lines(texts: dict[int, str]) -> dict[int, str]:
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    first: dict[str, int] = {}
    for doc in sorted(texts):
        for line in texts[doc].split("\n"):
            first.setdefault(key(line), doc)
    return {d: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == d) for d, t in texts.items()}


def line_texts(seed: int, docs: range) -> dict[int, str]:
    rnd = random.Random(seed)
    pool = [f"a line of number {k} äö" if k % 3 else f"kurz{k}" for k in range(40)]
    return {d: "\n".join(rnd.choice([x, " " + x.upper().replace("ÄÖ", "äö") + "\t", x + str(d)]) for x in rnd.choices(pool, k=rnd.randrange(0, 12))) for d in docs}


@pytest.mark.parametrize("filter_bytes", [op9_lines.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("hot", [False, True])
def test_lines(spark, filter_bytes, hot, monkeypatch):
    monkeypatch.setattr(op9_lines, "max", lambda a, b: b if hot and a == 1000 else max(a, b), raising=False)
    monkeypatch.setattr(op9_lines, "HOT", 40)
    texts = line_texts(4, range(80))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("line", F.lit("x"))
    got = {r["doc_id"]: r["text"] for r in op9_lines.dedup(frame, filter_bytes).collect()}
    assert got == kept_lines(texts)


@pytest.mark.parametrize("broadcast_bytes", [op9_lines.BROADCAST_BYTES, 0])
def test_lines_of_repeated_ids(spark, broadcast_bytes):
    """Rows of one doc_id are one document for the counts; each keeps the lines that only it loses nothing of."""
    rows = [(2, "a long shared line\nmine"), (2, "precious first line\nsecond thing here"), (1, "A LONG shared line "), (3, "precious first line"), (2, "a long shared line\nmine"), (None, "second thing here"), (None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["text"], r["n_lines"], r["n_dropped"]) for r in op9_lines.dedup(frame, broadcast_bytes).collect())
    assert got == sorted([(2, "mine", 2, 1), (2, "precious first line", 2, 1), (1, "A LONG shared line ", 1, 0), (3, "", 1, 1), (2, "mine", 2, 1), (0, "second thing here", 1, 0), (0, "x", 1, 0)])


def test_long_lines(spark):
    long = "word " * 50_000
    frame = spark.createDataFrame([(1, long + "\n" + "\n" * 3000), (2, "  " + long.upper() + "\nshort"), (3, long + "x")], "doc_id long, text string")
    got = {r["doc_id"]: (len(r["text"]), r["n_lines"], r["n_dropped"]) for r in op9_lines.dedup(frame).collect()}
    assert got == {1: (253_001, 3002, 0), 2: (5, 2, 1), 3: (250_001, 1, 0)}


def test_store_is_reversible(spark, monkeypatch):
    monkeypatch.setattr(op9_lines, "SEGMENTS", 2)
    texts, more = line_texts(5, range(40)), line_texts(6, range(40, 70))
    frame = lambda t: spark.createDataFrame(list(t.items()), "doc_id long, text string")
    store = op9_lines.LineStore(spark, shards=3, shard_keys=25)
    store.insert(frame(texts))
    before = sorted(map(tuple, store.references().collect()))
    for some in (range(40, 50), range(50, 60), range(60, 70)):
        store.insert(frame({d: more[d] for d in some}))
    assert len(store.segments) <= 3 and store.shards > 3
    assert {r["doc_id"]: r["text"] for r in store.resolve(frame(texts | more)).collect()} == kept_lines(texts | more)
    store.delete(frame(more).select("doc_id"))
    assert sorted(map(tuple, store.references().collect())) == before
    store.delete(frame({d: texts[d] for d in range(0, 40, 2)}).select("doc_id"))
    left = {d: t for d, t in texts.items() if d % 2}
    assert {r["doc_id"]: r["text"] for r in store.resolve(frame(left)).collect()} == kept_lines(left)


def test_line_edge_cases(spark, docs, nothing):
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in op9_lines.dedup(docs).collect()}
    assert (9, 1, 0) in got and (7, 1, 0) in got and (8, 3, 0) in got and (5, 1, 1) in got and (3, 1, 0) in got
    assert op9_lines.dedup(nothing).count() == 0
    digest = hashlib.sha256(b"").hexdigest()
    assert op9_lines.dedup(docs).where("doc_id = 9").select(F.sha2("text", 256)).first()[0] == digest
