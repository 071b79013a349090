import re

from lexigrid.llm import license_scan as ls
from lexigrid.llm.decontam import normal_texts

SCHEMA = "doc_id long, text string, licences string, status int, row int"
MIT = "\n".join(
    [
        "MIT License",
        "",
        "Copyright (c) 2021 Ada Example",
        "",
        "Permission is hereby granted, free " "of charge, to any person " "obtaining a copy",
        "of this software and associated " 'documentation files (the "Software"), to ' "deal",
        "in the Software without restriction, " "including without limitation the rights",
        "to use, copy, modify, merge, " "publish, distribute, sublicense, and/or sell",
        "copies of the Software, and " "to permit persons to whom " "the Software is",
        "furnished to do so, subject " "to the following conditions:",
        "",
        "The above copyright notice and " "this permission notice shall be " "included in all",
        "copies or substantial portions of " "the Software.",
        "",
        'THE SOFTWARE IS PROVIDED "AS ' 'IS", WITHOUT WARRANTY OF ANY ' "KIND, EXPRESS OR",
        "IMPLIED, INCLUDING BUT NOT LIMITED " "TO THE WARRANTIES OF MERCHANTABILITY,",
        "FITNESS FOR A PARTICULAR PURPOSE " "AND NONINFRINGEMENT. IN NO EVENT " "SHALL THE",
        "AUTHORS OR COPYRIGHT HOLDERS BE " "LIABLE FOR ANY CLAIM, DAMAGES " "OR OTHER",
        "LIABILITY, WHETHER IN AN ACTION " "OF CONTRACT, TORT OR OTHERWISE, " "ARISING FROM,",
        "OUT OF OR IN CONNECTION " "WITH THE SOFTWARE OR THE " "USE OR OTHER DEALINGS IN " "THE",
        "SOFTWARE.",
        "",
    ]
)
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU General Public License for more details."""
CASES = {
    1: (MIT, ["MIT"]), 2: ("code here\n\n" + APACHE + "\n\nmore", ["Apache-2.0"]), 3: (GPL, ["GPL-3.0-or-later"]),
    4: ("Some prose\nReleased under the MIT License.\nmore prose", ["MIT"]), 5: ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    6: ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
    7: ("Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.", ["Apache-2.0", "CC-BY-NC-4.0"]),
    8: ("We talked about the MIT License and its terms at length.", []), 9: ("Copyright 2019 Somebody. Nothing else.", []),
    10: ("SPDX-License-Identifier: BSD-3-Clause\nint main;", ["BSD-3-Clause"]), 11: (None, []), 12: ("", []),
    13: ("word " * 300_000 + "\nReleased under the MIT License.", ["MIT"]),
}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def test_known_licences(spark):
    rows = [(i, t) for i, (t, _) in CASES.items()]
    got = {r.doc_id: r for r in ls.scan(frame(spark, rows + [(None, "Released under the MIT License."), (5, CASES[5][0])])).collect()}
    for i, (_, want) in CASES.items():
        assert got[i].licences == want, i
        assert got[i].status == ("licensed" if want else "unclear" if i == 9 else "none")
    assert got[None].licences == ["MIT"] and got[9].left_over == ["copyright"]
    assert ls.scan(frame(spark, [])).count() == 0


def test_report(spark):
    got = {r.licence: r.docs for r in ls.licence_report(frame(spark, [(1, MIT), (2, "x"), (3, MIT + "\n\n" + APACHE)])).collect()}
    assert got == {"MIT": 2, "Apache-2.0": 1, None: 1}


def test_every_pattern_has_a_cue():
    """A pattern's alternatives each hold a cue word, so no known sentence is passed over."""
    for name, pattern in ls.SENTENCES:
        assert any(re.search(rf"\b{c}\b", pattern) for c in ls.CUES), name


def plain_scan(text):
    """Every sentence and line, without cues."""
    spans = {}
    for cut in (r"[.!?;](?=\s|$)|\n(?=\r?\n)|\n(?=$)", r"[.!?;](?=\s|$)|\n"):
        at = 0
        for m in [*re.finditer(cut, text), None]:
            end = m.start() if m else len(text)
            name = ls.identifier(normal_texts([text[at:end]])[0].decode())
            found = [w for w in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text[at:end])]
            if name and found:
                spans[at + found[0].start(), at + found[-1].end()] = name
            at = m.end() if m else end
    sequence, until = [], -1
    for (a, b), name in sorted(spans.items(), key=lambda s: (s[0][0], -s[0][1])):
        if a >= until:
            sequence.append(name)
            until = b
    return ls.match_rules(sequence)


def test_equals_brute_force_on_the_tables(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    got = {r.doc_id: r for r in ls.scan(docs).collect()}
    found = 0
    for r in docs.collect():
        licences, rest = plain_scan(r.text)
        assert got[r.doc_id].licences == list(dict.fromkeys(licences)) and got[r.doc_id].left_over == rest
        found += bool(licences)
    assert found > 10


def test_rules_in_order():
    assert ls.match_rules([("gnu-free-{0}", "2"), ("gnu-or-later", "")]) == (["GPL-2.0-or-later"], [])
    assert ls.match_rules([("copyright", ""), ("bsd-grant", ""), ("bsd-source", ""), ("bsd-binary", ""), ("bsd-endorse", "")]) == (["BSD-3-Clause"], [])
    assert ls.match_rules([("bsd-grant", ""), ("mit-name", "")]) == (["MIT"], ["bsd-grant"])


def test_everyday_notices(spark):
    want = {
        "SPDX-License-Identifier: MIT OR Apache-2.0": ["MIT", "Apache-2.0"],
        "// SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause) AND ISC */": ["GPL-2.0-only", "BSD-3-Clause", "ISC"],
        "SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception": ["Apache-2.0 WITH LLVM-exception"],
        "SPDX-License-Identifier: GPL-2.0+": ["GPL-2.0-or-later"],
        "SPDX-License-Identifier: MPL-2.0+\nint x;": ["MPL-2.0+"],
        "SPDX-License-Identifier: LicenseRef-Secret": [],
        "Licensed under the GNU Lesser General Public License version 2.1 or later.": ["LGPL-2.1-or-later"],
        "This library is licensed under the GNU Lesser General Public License v3.": ["LGPL-3.0-only"],
        "This program is distributed under the terms of the GNU Affero General Public License version 3 or any later version.": ["AGPL-3.0-or-later"],
        "This code is licensed under the MIT license, see LICENSE.": ["MIT"],
        "Released under the BSD license.": ["LicenseRef-BSD"],
        "This project is licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
        "The license of my dog has expired.": [],
    }
    rows = list(enumerate(want))
    got = {r.doc_id: r.licences for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[i] for i, t in rows} == want
