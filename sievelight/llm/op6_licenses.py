"""Licence scans: normalised sentences are mapped to known licence-sentence ids, and id sequences are matched with ordered rules.

A text is cut behind `.`, `!`, `?`, `:` and `;` before white space, and also at line breaks (as a notice on lines of its own) or at
empty lines (as a notice that wraps): two ways of cutting, each matched on its own. A piece is normalised to lower-case ASCII letters and
digits with single spaces, and words that notices fill in (`this library is free software`, the holder's name) are evened out.
The known sentences are cut and normalised by the same rules, so one that holds a mark inside (`free software: you can`) is a
sequence of pieces, which has to stand in the text directly one after the other; longer sequences are tried first. Known
sentences give their ids, in order of the text; other pieces give nothing. Rules are tried from the longest to the shortest (equal ones in
the order below): each occurrence of a rule's ids, one after the other, is a find, and its sentences serve no later rule. The finds of a licence
are the larger number of the two ways of cutting.

All of it is built-in functions in the scan's stage: no Python, no shuffle. Every known sentence has one of the words in CUES; texts
without any of them can't have a find and are not cut at all.

Nulls and ties: a null or empty text has no finds; repeated rows are scanned each; texts of any length are scanned whole; columns beside
doc_id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_GNU = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version."
_GNU_ONLY = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} version {2} as published by the Free Software Foundation."
_GNU_KINDS = {
    "gpl2": ("General Public License", "2"), "gpl3": ("General Public License", "3"), "lgpl2": ("Library General Public License", "2"),
    "lgpl21": ("Lesser General Public License", "2.1"), "lgpl3": ("Lesser General Public License", "3"), "agpl3": ("Affero General Public License", "3"),
}
# Ids and sentences of licence notices.
SENTENCES = {
    "reserved": "All rights reserved.",
    "mit-ref": "Released under the MIT license.",
    "mit-ref2": "Licensed under the MIT license.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    "mit-no-event": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    "x11-names": "Except as contained in this notice, the name of the copyright holders shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the copyright holders.",
    "json-good": "The Software shall be used for Good, not Evil.",
    "apache-ref": "Licensed under the Apache License, Version 2.0.",
    "apache-ref2": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-only": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "apache-you-may": "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions:",
    "gpl3-ref": "This work is licensed under the GNU General Public License version 3.",
    "gpl2-ref": "This work is licensed under the GNU General Public License version 2.",
    **{f"{k}-free": _GNU.format(":", name, ",", v) for k, (name, v) in _GNU_KINDS.items()},
    **{f"{k}-free2": _GNU.format(";", name, ";", v) for k, (name, v) in _GNU_KINDS.items()},
    **{f"{k}-only": _GNU_ONLY.format(";", name, v) for k, (name, v) in _GNU_KINDS.items()},
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-copy": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "gpl3-preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "gpl2-preamble": "The licenses for most software are designed to take away your freedom to share and change it.",
    "agpl3-preamble": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "gfdl-grant": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation;",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-ads": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    "bsd0-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-as-is": "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
    "postgres-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "ncsa-names": "Neither the names of the copyright holders, nor the names of its contributors may be used to endorse or promote products derived from this Software without specific prior written permission.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-origin": "The origin of this software must not be misrepresented;",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "zlib-notice": "This notice may not be removed or altered from any source distribution.",
    "bsl-ref": "Distributed under the Boost Software License, Version 1.0.",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "mpl-ref": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-copy2": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl11-ref": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\");",
    "epl1-ref": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at",
    "epl2-ref": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "cddl-ref": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").",
    "eupl-ref": "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\");",
    "artistic-ref": "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    "ofl-ref": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "wtfpl-do": "You just DO WHAT THE FUCK YOU WANT TO.",
    "wtfpl-ref": "This program is free software. It comes without any warranty, to the extent permitted by applicable law.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-ref": "Licensed under CC0 1.0.",
    "cc0-waive": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc-by-ref": "Licensed under CC BY 4.0.",
    "cc-by-sa-ref": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-ref": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-ref": "Licensed under CC BY-ND 4.0.",
    **{f"cc-{k}-work{v}": f"This work is licensed under a Creative Commons {name} {v}.0 International License."
       for v in ("4",) for k, name in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"))},
    "openssl-product": "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit.",
    "php-ref": "This source file is subject to version 3.01 of the PHP license, that is bundled with this package in the file LICENSE, and is available through the world-wide-web at the following url:",
    "psf-ref": "Licensed to PSF under a Contributor Agreement.",
    "mspl-ref": "This license governs use of the accompanying software.",
    "mspl-accept": "If you use the software, you accept this license.",
    "busl-ref": "Use of this software is governed by the Business Source License included in the LICENSE file.",
    "sspl-ref": "This program is free software: you can redistribute it and/or modify it under the terms of the Server Side Public License, version 1, as published by MongoDB, Inc.",
    "elastic-ref": "Licensed under the Elastic License 2.0;",
    "beer": "If we meet some day, and you think this stuff is worth it, you can buy me a beer in return.",
    "odbl-ref": "This data is made available under the Open Database License:",
}
# Identifiers of licences in SPDX tags, and what a find of one is called if that is not the identifier itself.
SPDX = (
    "MIT", "MIT-0", "X11", "JSON", "Apache-1.1", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "0BSD", "ISC", "Zlib", "libpng-2.0", "BSL-1.0", "MPL-1.1", "MPL-2.0",
    "EPL-1.0", "EPL-2.0", "CDDL-1.0", "EUPL-1.2", "Artistic-2.0", "OFL-1.1", "WTFPL", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0",
    "OpenSSL", "PHP-3.01", "PSF-2.0", "PostgreSQL", "NCSA", "MS-PL", "BUSL-1.1", "SSPL-1.0", "Elastic-2.0", "Beerware", "ODbL-1.0", "GFDL-1.3", "Ruby", "AFL-3.0", "UPL-1.0", "BlueOak-1.0.0",
)
_GNU_SPDX = ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
_TAGS = {**{x: x for x in SPDX}, **{f"{x}{form}": x for x in _GNU_SPDX for form in ("", "-only", "-or-later")}}
SENTENCES |= {f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}" for x in _TAGS}
_MIT, _BSD = ("mit-grant", "mit-keep", "mit-as-is"), ("bsd-grant", "bsd-source", "bsd-binary")
_GNU_NAMES = {"gpl2": "GPL-2.0", "gpl3": "GPL-3.0", "lgpl2": "LGPL-2.0", "lgpl21": "LGPL-2.1", "lgpl3": "LGPL-3.0", "agpl3": "AGPL-3.0"}
# Licences and the sentence ids that make one find of them.
RULES = (
    ("JSON", ("mit-grant", "mit-keep", "json-good", "mit-as-is", "mit-no-event")),
    ("JSON", ("mit-grant", "mit-keep", "json-good")),
    ("X11", (*_MIT, "mit-no-event", "x11-names")),
    ("X11", (*_MIT, "x11-names")),
    ("MIT", (*_MIT, "mit-no-event")),
    ("MIT", _MIT),
    ("MIT", ("mit-grant", "mit-keep")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref2",)),
    ("MIT-0", ("mit0-grant", "mit-as-is", "mit-no-event")),
    ("MIT-0", ("mit0-grant", "mit-as-is")),
    ("MIT-0", ("mit0-grant",)),
    ("Apache-2.0", ("apache-ref2", "apache-only", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-ref2", "apache-only", "apache-copy", "apache-as-is")),
    ("Apache-2.0", ("apache-ref2", "apache-only", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-ref2", "apache-only", "apache-as-is")),
    ("Apache-2.0", ("apache-ref2", "apache-only")),
    ("Apache-2.0", ("apache-ref2",)),
    ("Apache-2.0", ("apache-ref",)),
    ("Apache-2.0", ("apache-grant", "apache-you-may")),
    *((_GNU_NAMES[k], (f"{k}-{form}", "gpl-hope")) for k in _GNU_KINDS for form in ("free", "free2", "only")),
    *((_GNU_NAMES[k], (f"{k}-{form}",)) for k in _GNU_KINDS for form in ("free", "free2", "only")),
    ("GPL-3.0", ("gpl3-ref",)),
    ("GPL-2.0", ("gpl2-ref",)),
    ("GPL-3.0", ("gpl-copy", "gpl3-preamble")),
    ("GPL-2.0", ("gpl-copy", "gpl2-preamble")),
    ("AGPL-3.0", ("gpl-copy", "agpl3-preamble")),
    ("GFDL-1.3", ("gfdl-grant",)),
    ("BSD-4-Clause", (*_BSD, "bsd-ads", "bsd-names", "bsd-as-is")),
    ("BSD-4-Clause", (*_BSD, "bsd-ads", "bsd-names")),
    ("BSD-4-Clause", (*_BSD, "bsd-ads")),
    ("BSD-3-Clause", (*_BSD, "bsd-names", "bsd-as-is")),
    ("BSD-3-Clause", (*_BSD, "bsd-names")),
    ("BSD-2-Clause", (*_BSD, "bsd-as-is")),
    ("BSD-2-Clause", _BSD),
    ("NCSA", ("mit-grant", "bsd-source", "bsd-binary", "ncsa-names")),
    ("0BSD", ("bsd0-grant", "isc-as-is")),
    ("0BSD", ("bsd0-grant",)),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant2", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant2",)),
    ("PostgreSQL", ("postgres-grant",)),
    ("Zlib", ("zlib-as-is", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("bsl-ref",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("MPL-2.0", ("mpl-ref", "mpl-copy")),
    ("MPL-2.0", ("mpl-ref", "mpl-copy2")),
    ("MPL-2.0", ("mpl-ref",)),
    ("MPL-1.1", ("mpl11-ref", "apache-only")),
    ("MPL-1.1", ("mpl11-ref",)),
    ("EPL-1.0", ("epl1-ref",)),
    ("EPL-2.0", ("epl2-ref",)),
    ("CDDL-1.0", ("cddl-ref",)),
    ("EUPL-1.2", ("eupl-ref",)),
    ("Artistic-2.0", ("artistic-ref",)),
    ("OFL-1.1", ("ofl-ref",)),
    ("WTFPL", ("gpl-copy", "wtfpl-do")),
    ("WTFPL", ("wtfpl-do",)),
    ("WTFPL", ("wtfpl-ref",)),
    ("Unlicense", ("unlicense", "unlicense-free")),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0-waive",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-ref",)),
    *((f"CC-{k.upper()}-4.0", (f"cc-{k}-work4",)) for k in ("by", "by-sa", "by-nc", "by-nd")),
    ("OpenSSL", (*_BSD, "bsd-ads", "openssl-product")),
    ("OpenSSL", ("openssl-product",)),
    ("PHP-3.01", ("php-ref",)),
    ("PSF-2.0", ("psf-ref",)),
    ("MS-PL", ("mspl-ref", "mspl-accept")),
    ("BUSL-1.1", ("busl-ref",)),
    ("SSPL-1.0", ("sspl-ref", "gpl-hope")),
    ("SSPL-1.0", ("sspl-ref",)),
    ("Elastic-2.0", ("elastic-ref", "apache-only")),
    ("Elastic-2.0", ("elastic-ref",)),
    ("Beerware", ("beer",)),
    ("ODbL-1.0", ("odbl-ref",)),
    *((licence, (f"spdx-{x.lower()}",)) for x, licence in _TAGS.items()),
    ("proprietary", ("reserved",)),
)
#: Each known sentence has one of these words; a fixed value.
CUES = ("licen[cs]e", "eupl", "cc0", "reserved", "permission", "warrant", "redistribution", "software", "copyright", "conditions", "domain", "copy", "beer", "misrepresented", "distribution", "permitted", "fuck")
_CUT = r"(?<=[.!?:;])\s+"
#: Pieces that hold the first are evened out by the pattern. A name with a mark inside is cut: its last piece counts.
_FILLED = (
    ("this ", r"^this (?:library|software|file|package|module|work|font|project|code|script) is (free software|distributed in the hope)", "this program is $1"),
    (" nor the names of ", r"^(?!neither the names ).*nor the names of (?:its |their )?contributors may", "neither the name of the copyright holder nor the names of its contributors may"),
)


def pieces(sentence: str) -> list[str]:
    """The normalised pieces of a known sentence."""
    found = [re.sub("[^a-z0-9]+", " ", piece.lower()).strip() for piece in re.split(_CUT, sentence)]
    for _, pattern, plain in _FILLED:
        found = [re.sub(pattern, plain.replace("$1", r"\1"), piece) for piece in found]
    return [piece for piece in found if piece]


_PIECES = {piece: f"p{k}" for k, piece in enumerate(dict.fromkeys(p for s in SENTENCES.values() for p in pieces(s)))}
#: Sequences of piece ids and the sentence they make, the longest first; the same of sentence ids and licences.
_STEPS = sorted((("".join(f",{_PIECES[p]}," for p in pieces(s)), f"<{name}>") for name, s in SENTENCES.items()), key=lambda x: -x[0].count(",p"))
_FINDS = [("".join(f"<{i}>" for i in ids), f"({licence})") for licence, ids in sorted(RULES, key=lambda r: -len(r[1]))]


def _replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    for wanted, made in steps:
        text = F.replace(text, F.lit(wanted), F.lit(made))
    return text


def _evened(piece: Column) -> Column:
    for head, pattern, plain in _FILLED:  # only pieces that begin as the pattern does go to the regular expression
        piece = F.when(F.contains(piece, F.lit(head)), F.regexp_replace(piece, pattern, plain)).otherwise(piece)
    return piece


def _known(text: Column, cut: str) -> Column:
    """The ids of the known sentences of a text, in order, each between < and >."""
    found = F.transform(F.split(text, cut), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    found = F.transform(found, _evened)
    ids = F.create_map(*[F.lit(x) for pair in _PIECES.items() for x in pair])
    found = F.filter(found, lambda s: s != "")
    found = F.transform(found, lambda s: F.when(s.isin(*_PIECES), F.concat(F.lit(","), F.element_at(ids, s), F.lit(","))).otherwise("|"))
    joined = F.regexp_replace(F.array_join(found, ""), "\\|{2,}", "|")
    made = F.when(F.contains(joined, F.lit(",")), _replaced(joined, _STEPS)).otherwise("")
    return F.regexp_replace(made, ",p[0-9]+,|\\|", "")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_known (known sentences by lines), sentence_ids, n_finds, licences (sorted, each once)."""
    text = F.coalesce("text", F.lit(""))
    text = F.when(F.rlike(text, F.lit(f"(?iu){'|'.join(CUES)}")), text).otherwise("")
    cut = docs.select("doc_id", text.alias("text"))
    cut = cut.select("doc_id", _known(F.col("text"), rf"{_CUT}|\n").alias("lines"), _known(F.col("text"), rf"{_CUT}|\n\s*\n").alias("paragraphs"))
    finds = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(_replaced(F.col(c), _FINDS), F.lit(r"\(([^)]*)\)")))
    cut = cut.select("doc_id", F.regexp_extract_all("lines", F.lit("<([^>]*)>")).alias("ids"), finds("lines").alias("a"), finds("paragraphs").alias("b"))
    cut = cut.withColumn("names", F.array_sort(F.array_distinct(F.concat("a", "b"))))
    often = lambda side, name: F.size(F.filter(side, lambda x: x == name))
    total = F.aggregate("names", F.lit(0).cast("long"), lambda n, name: n + F.greatest(often("a", name), often("b", name)))
    return cut.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), total.alias("n_finds"), F.array_join("names", ",").alias("licences"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op6_licenses": op6_licenses}


def _sql() -> str:
    """The same in SQL, from the sentences and rules above as they stand: SQL cuts and normalises texts and sentences itself, and
    folds over the steps."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    sentences = ", ".join(f"({k}, {quoted(i)}, {quoted(s)})" for k, (i, s) in enumerate(SENTENCES.items()))
    rules = ", ".join(f"({k}, {quoted(licence)}, [{', '.join(map(quoted, ids))}])" for k, (licence, ids) in enumerate(RULES))
    gnu = lambda x: rf"regexp_replace({x}, '^this (library|software|file|package|module|work|font|project|code|script) is (free software|distributed in the hope)', 'this program is \2')"
    even = lambda x: rf"CASE WHEN starts_with({x}, 'neither the names ') THEN {x} ELSE regexp_replace({gnu(x)}, '^.* nor the names of (its |their )?contributors may', 'neither the name of the copyright holder nor the names of its contributors may') END"
    plain = lambda x: even(rf"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))")
    marked = lambda x: rf"regexp_replace({x}, '([.!?:;])\s+', '\1' || chr(1), 'g')"
    return rf"""
WITH known AS (SELECT * FROM (VALUES {sentences}) AS k(n, id, sentence)),
rules AS (SELECT * FROM (VALUES {rules}) AS r(n, licence, ids)),
parts AS (SELECT n, id, k, {plain("part")} AS piece FROM (SELECT n, id, unnest(string_split({marked("sentence")}, chr(1))) AS part, generate_subscripts(string_split({marked("sentence")}, chr(1)), 1) AS k FROM known)),
pieces AS MATERIALIZED (SELECT piece, '{{' || row_number() OVER (ORDER BY piece) || '}}' AS p FROM (SELECT DISTINCT piece FROM parts WHERE piece <> '')),
steps AS (
  SELECT list(s || '~<' || id || '>' ORDER BY len DESC, n) AS steps
  FROM (SELECT n, id, count(*) AS len, string_agg(p, '' ORDER BY k) AS s FROM parts JOIN pieces USING (piece) GROUP BY n, id)),
finds AS (SELECT list('<' || array_to_string(ids, '><') || '>~(' || licence || ')' ORDER BY len(ids) DESC, n) AS finds FROM rules),
cut AS (
  SELECT doc_id, 1 AS way, string_split_regex({marked("coalesce(text, '')")}, '\x01|\n') AS cuts FROM documents
  UNION ALL SELECT doc_id, 2, string_split_regex({marked("coalesce(text, '')")}, '\x01|\n\s*\n') FROM documents),
tokens AS (SELECT doc_id, way, k, {plain("part")} AS piece FROM (SELECT doc_id, way, unnest(cuts) AS part, generate_subscripts(cuts, 1) AS k FROM cut)),
marks AS (SELECT doc_id, way, string_agg(coalesce(p, '|'), '' ORDER BY k) AS s FROM tokens LEFT JOIN pieces USING (piece) WHERE piece <> '' GROUP BY doc_id, way HAVING count(p) > 0),
seqs AS (SELECT doc_id, way, array_to_string(regexp_extract_all(list_reduce(list_prepend(s, steps), lambda a, b: replace(a, split_part(b, '~', 1), split_part(b, '~', 2))), '<[^>]*>'), '') AS s FROM marks, steps),
found AS (
  SELECT doc_id, way, regexp_extract_all(s, '<([^>]*)>', 1) AS ids,
    regexp_extract_all(list_reduce(list_prepend(s, finds), lambda a, b: replace(a, split_part(b, '~', 1), split_part(b, '~', 2))), '\(([^)]*)\)', 1) AS licences FROM seqs, finds),
counts AS (SELECT doc_id, licence, max(n) AS n FROM (SELECT doc_id, way, licence, count(*) AS n FROM (SELECT doc_id, way, unnest(licences) AS licence FROM found) GROUP BY ALL) GROUP BY ALL),
per AS (SELECT doc_id, sum(n) AS n, string_agg(licence, ',' ORDER BY licence) AS licences FROM counts GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(f.ids), 0) AS BIGINT) AS n_known, coalesce(array_to_string(f.ids, ','), '') AS sentence_ids,
  CAST(coalesce(p.n, 0) AS BIGINT) AS n_finds, coalesce(p.licences, '') AS licences
FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id AND f.way = 1 LEFT JOIN per p ON p.doc_id = d.doc_id
"""


ORACLE_SQL = {"op6_licenses": _sql()}
