"""Operator 8: licence scans by sentences: known sentences first, then rules over the sequence of their identifiers."""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text

# Sentences of public licences and notices, by identifier. A number stands for itself.
SENTENCES = {
    "apache-2.0-grant": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License")'],
    "apache-2.0-use": ["you may not use this file except in compliance with the License."],
    "apache-2.0-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-2.0-asis": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "apache-2.0-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "apache-2.0-title": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004"],
    "apache-2.0-copyright": ["Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-asis": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "bsd-redistribute": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-advertise": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "bsd-asis": ['THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'],
    "bsd-liability": ["IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "isc-asis": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "zlib-asis": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "bsl-1.0-title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "bsl-1.0-notice": ["Distributed under the Boost Software License, Version 1.0."],
    "gpl-2.0-title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl-3.0-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl-2.1-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl-3.0-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "agpl-3.0-title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-details": ["See the GNU General Public License for more details.", "See the GNU Lesser General Public License for more details.", "See the GNU Affero General Public License for more details."],
    "mpl-2.0-terms": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl-2.0-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "mpl-2.0-title": ["Mozilla Public License Version 2.0"],
    "epl-1.0-terms": ["All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "epl-2.0-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"],
    "cc0-1.0-waive": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "unlicense-free": ["This is free and unencumbered software released into the public domain."],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "wtfpl-title": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "ofl-1.1-terms": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "all-rights": ["All rights reserved."],
}

#: Names by which licences are spoken of, by their identifier; Creative Commons' follow from kinds and versions.
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache License 2.0", "Apache-2.0"],
    "MIT": ["the MIT License", "MIT License", "MIT"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the Simplified BSD License", "the 2-Clause BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the New BSD License", "the Modified BSD License", "the 3-Clause BSD License"],
    "ISC": ["the ISC License"],
    "Zlib": ["the zlib License", "the zlib/libpng License"],
    "BSL-1.0": ["the Boost Software License 1.0"],
    "GPL-2.0-only": ["the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL v2", "GPL v2", "GPLv2"],
    "GPL-3.0-only": ["the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL v3", "GPL v3", "GPLv3"],
    "GPL-2.0-or-later": ["the GNU General Public License, version 2 or later", "GPL v2 or later", "GPLv2+"],
    "GPL-3.0-or-later": ["the GNU General Public License, version 3 or later", "GPL v3 or later", "GPLv3+"],
    "LGPL-2.1-only": ["the GNU Lesser General Public License, version 2.1", "the GNU LGPL v2.1", "LGPL v2.1"],
    "LGPL-3.0-only": ["the GNU Lesser General Public License, version 3", "the GNU LGPL v3", "LGPL v3"],
    "AGPL-3.0-only": ["the GNU Affero General Public License, version 3", "the GNU AGPL v3", "AGPL v3"],
    "MPL-2.0": ["the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0", "the MPL 2.0"],
    "EPL-1.0": ["the Eclipse Public License 1.0", "the Eclipse Public License v1.0"],
    "EPL-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License v2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0"],
    "Unlicense": ["the Unlicense"],
    "WTFPL": ["the WTFPL"],
    "OFL-1.1": ["the SIL Open Font License 1.1"],
}
KINDS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
VERSIONS = ("2.0", "2.5", "3.0", "4.0")
for _kind, _long in KINDS.items():
    for _v in VERSIONS:
        NAMES[f"CC-{_kind}-{_v}"] = [f"CC {_kind} {_v}", f"CC-{_kind}-{_v}", *(f"{the}Creative Commons {_long} {_v} {where}License" for the in ("a ", "the ") for where in ("", "International ", "Unported ", "Generic "))]
#: What is said of a licence by its name.
SAYINGS = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "Available under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is licensed under {}.", "This project is released under {}.", "This code is released under {}.", "License: {}")
SENTENCES |= {f"{k.lower()}-name": [s.format(n) for s in SAYINGS for n in names] for k, names in NAMES.items() if k != "Apache-2.0"}
SENTENCES["mit-name"] += ["MIT License", "The MIT License", "The MIT License (MIT)"]
SENTENCES["apache-2.0-grant"] += [s.format(n) for s in SAYINGS for n in NAMES["Apache-2.0"]]
#: Notices of the GNU licences: for each, its name in them, and its version.
GNU = {"gpl": ("GNU General Public License", ("2", "3")), "lgpl": ("GNU Lesser General Public License", ("2.1", "3")), "agpl": ("GNU Affero General Public License", ("3",))}
for _short, (_name, _versions) in GNU.items():
    for _v in _versions:
        _begin = [f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the {_name} as published by the Free Software Foundation" for what in ("program", "library", "software", "file") for mark in (":", ";")]
        _full = _v if "." in _v else f"{_v}.0"
        SENTENCES[f"{_short}-{_full}-later"] = [f"{x}{e} version {_v} of the License, or (at your option) any later version." for x in _begin for e in (", either", "; either")]
        SENTENCES[f"{_short}-{_full}-only"] = [x + e for x in _begin for e in (f", version {_v}.", f"; version {_v}.", f", version {_v} of the License.", f"; version {_v} of the License.")]
#: The line that names a licence by its identifier.
SENTENCES |= {f"spdx-{k.lower()}": [f"SPDX-License-Identifier: {k}"] for k in (*NAMES, "0BSD", "AGPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later")}

#: Rules in the order in which they are tried at each sentence: the licence, and the identifiers that must follow each other.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("apache-2.0-grant", "apache-2.0-use", "apache-2.0-copy", "apache-2.0-asis", "apache-2.0-see")),
    ("Apache-2.0", ("apache-2.0-grant", "apache-2.0-use", "apache-2.0-copy")),
    ("Apache-2.0", ("apache-2.0-grant",)),
    ("Apache-2.0", ("apache-2.0-title", "apache-2.0-copyright")),
    ("Apache-2.0", ("apache-2.0-title",)),
    ("MIT", ("mit-name", "mit-grant", "mit-notice", "mit-asis", "mit-liability")),
    ("MIT", ("mit-name", "mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-4-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse")),
    ("BSD-4-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-advertise")),
    *((name, (*begin, *end)) for end in (("bsd-asis", "bsd-liability"), ("bsd-asis",), ()) for name, begin in (("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse")), ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")))),
    ("ISC", ("isc-grant", "isc-asis")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("Zlib", ("zlib-asis", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl-1.0-title",)),
    ("BSL-1.0", ("bsl-1.0-notice",)),
    *((f"{short.upper()}-{v if '.' in v else v + '.0'}-{which}", (f"{short}-{v if '.' in v else v + '.0'}-{mark}", *more)) for short, (_, versions) in GNU.items() for v in versions for which, mark in (("or-later", "later"), ("only", "only")) for more in (("gpl-warranty", "gpl-details"), ("gpl-warranty",), ())),
    *((f"{k.upper()}-only", (f"{k}-title",)) for k in ("gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0")),
    ("MPL-2.0", ("mpl-2.0-terms", "mpl-2.0-copy")),
    ("MPL-2.0", ("mpl-2.0-terms",)),
    ("MPL-2.0", ("mpl-2.0-title",)),
    ("EPL-1.0", ("epl-1.0-terms",)),
    ("EPL-2.0", ("epl-2.0-terms",)),
    ("CC0-1.0", ("cc0-1.0-waive",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
    ("WTFPL", ("wtfpl-title",)),
    ("OFL-1.1", ("ofl-1.1-terms",)),
    *((k, (f"{k.lower()}-name",)) for k in NAMES if k != "Apache-2.0"),
    *((k, (f"spdx-{k.lower()}",)) for k in (*NAMES, "0BSD", "AGPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later")),
    ("Proprietary", ("all-rights",)),
]

ENDS = re.compile(rb"\n\s*\n|[.!?:;](?=\s|$)|\n")
NOT_WORD = re.compile(rb"[^a-z0-9\x80-\xff]+")


def normal(sentence: bytes) -> bytes:
    """Lower case (A-Z), words of letters and digits with one space between."""
    return NOT_WORD.sub(b" ", sentence.lower()).strip()


KNOWN = {normal(s.encode()): k for k, many in SENTENCES.items() for s in many}
LONGEST = max(len(k.split()) for k in KNOWN)
#: A text without any of these words holds no known sentence.
ANCHORS = (b"licens", b"permission", b"copyright", b"redistribut", b"warrant", b"reserved", b"public domain", b" under ", b"endorse", b"liable", b"anyone is free", b"advertising", b"if a copy of the mpl")
assert all(any(a.strip() in k.split() if a.startswith(b" ") else a in k for a in ANCHORS) for k in KNOWN)


#: The anchors without the blanks around them, as a text may break lines there.
FIRST = tuple(a.strip() for a in ANCHORS)


def sentences(text: bytes) -> list[tuple[int, str]]:
    """(place, identifier) of each known sentence. A text is cut at ends of sentences and of lines; a known sentence may run
    over several pieces, as long as they are whole: at each piece the longest run that is known wins."""
    parts, at = [], 0
    for m in ENDS.finditer(text):
        parts.append((at, normal(text[at : m.start()])))
        at = m.end()
    parts.append((at, normal(text[at:])))
    parts = [p for p in parts if p[1]]
    found, k = [], 0
    while k < len(parts):
        run, best = b"", None
        for j in range(k, len(parts)):
            run = run + b" " + parts[j][1] if run else parts[j][1]
            if run in KNOWN:
                best = (j, KNOWN[run])
            if run.count(b" ") >= LONGEST or not begins(run):
                break
        if best:
            found.append((parts[k][0], best[1]))
        k = best[0] + 1 if best else k + 1
    return found


SORTED = sorted(KNOWN)


def begins(run: bytes) -> bool:
    """Whether a known sentence begins like this."""
    at = bisect.bisect_left(SORTED, run)
    return at < len(SORTED) and SORTED[at].startswith(run)


#: The rules by their first identifier, in order.
BY_FIRST = {k: [r for r in RULES if r[1][0] == k] for k in SENTENCES}


def licences(ids: list[str]) -> list[tuple[str, int, int]]:
    """(licence, first, count) of the rules that match the sequence of identifiers, from the left; the first rule in order wins."""
    out, k = [], 0
    while k < len(ids):
        hit = next(((name, len(seq)) for name, seq in BY_FIRST.get(ids[k], ()) if tuple(ids[k : k + len(seq)]) == seq), None)
        if hit:
            out.append((hit[0], k, hit[1]))
        k += hit[1] if hit else 1
    return out


def scan(text: bytes) -> tuple[list[int], list[str], list[tuple[str, int, int]]]:
    low = text.lower()
    if not any(a in low for a in FIRST):
        return [], [], []
    found = sentences(text)
    ids = [k for _, k in found]
    return [p for p, _ in found], ids, licences(ids)


def scan_licences(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Append sentence_ids, sentence_places (byte offsets) and matches [(licence, first sentence, sentences)] to docs, and licences,
    the distinct names in code point order.

    A null or empty text has none. Rows are independent of each other: repeated rows get equal results, an empty table gives
    none. Columns of docs with the names of new ones are replaced.
    """
    match = T.StructType([T.StructField("licence", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("count", T.IntegerType())])
    fields = [T.StructField("sentence_ids", T.ArrayType(T.StringType())), T.StructField("sentence_places", T.ArrayType(T.LongType())), T.StructField("matches", T.ArrayType(match))]
    kind = pa.list_(pa.struct([("licence", pa.string()), ("first", pa.int32()), ("count", pa.int32())]))

    def start():
        def made(batch: list[bytes]) -> list:
            done = [scan(t) for t in batch]
            rows = [[dict(zip(("licence", "first", "count"), m, strict=True)) for m in x[2]] for x in done]
            return [pa.array([x[1] for x in done], pa.list_(pa.string())), pa.array([x[0] for x in done], pa.list_(pa.int64())), pa.array(rows, kind)]

        return made

    out = map_text(docs.drop("licences"), text_col, fields, start, keep_text)
    return out.withColumn("licences", F.array_sort(F.array_distinct("matches.licence")))
