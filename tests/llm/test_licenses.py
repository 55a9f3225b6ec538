"""License scan: full texts and usual notices, on copies that don't come from the operator's own list."""
import os

import pytest
from pyspark.sql import functions as F

from fleetstate.llm import license_scan
from tests.llm.conftest import SCHEMA, doc

COMMON = "/usr/share/common-licenses"
FULL = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only OR GPL-2.0-or-later", "GPL-3": "GPL-3.0-only OR GPL-3.0-or-later", "LGPL-2.1": "LGPL-2.1-only OR LGPL-2.1-or-later",
        "LGPL-3": "LGPL-3.0-only OR LGPL-3.0-or-later", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
NOTICES = {
    "Licensed under the MIT License": "MIT", "This project is licensed under the MIT license.": "MIT", "// SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later",
    "/* Licensed under the GNU General Public License, version 2. */": "GPL-2.0-only", "Distributed under the GPL v2 or later.": "GPL-2.0-or-later", "Released under the GNU Lesser General Public License v2.1": "LGPL-2.1-only",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0", "License: Apache-2.0": "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")": "Apache-2.0",
    "This software is released under the BSD 3-Clause License": "BSD-3-Clause", "This file is licensed under the GNU Affero General Public License v3.0": "AGPL-3.0-only",
}


def scan(spark, texts):
    out = license_scan.scan(spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], SCHEMA).repartition(2))
    return [tuple(r) for r in out.orderBy("doc_id").select("license_id", F.array_join("notices", ","), "n_notice_lines").collect()]


def test_full_texts(spark):
    if not os.path.isdir(COMMON):
        pytest.skip(f"no {COMMON}")
    texts = [open(f"{COMMON}/{f}").read() for f in FULL]
    assert [r[0] for r in scan(spark, texts)] == list(FULL.values())
    # indented, and with a word changed
    assert [r[0] for r in scan(spark, [t.replace("\n", "\r\n    ") for t in texts])] == list(FULL.values())
    assert {r[0] for r in scan(spark, [t.replace(" of ", " off ") for t in texts])} == {None}


def test_usual_notices(spark):
    texts = [f"some words\n{n}\nmore words" for n in NOTICES]
    assert scan(spark, texts) == [(None, i, 1) for i in NOTICES.values()]
    assert scan(spark, ["the license of this text is not named", "MIT is in Boston", "GPL"]) == [(None, "", 0)] * 3


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above
copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE.
"""
LINES = ["Copyright Joyent, Inc. and other Node contributors.", "Copyright The Authors 2020", "Copyright: 2020 A", "Portions Copyright (c) 2001 B", "(C) Copyright 2003 A", "Copyright (c) 2020 A\nCopyright Lawrence Lab", "Copyright 2020 A. All rights reserved."]
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
{} Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
{} Redistributions in binary form must reproduce the above
   copyright notice, this list of conditions and the following disclaimer
   in the documentation and/or other materials provided with the
   distribution.
{} Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


def test_variants_of_short_licenses(spark):
    mit = [MIT, "The MIT License (MIT)\n\n" + MIT, "MIT License\n" + MIT, *(f"MIT License\n\n{c}\n\n{MIT}" for c in LINES), *(f"{c}\n\n{MIT}" for c in LINES)]
    bsd = [BSD.format(*m) for m in (("1.", "2.", "3."), ("*", "*", "*"), ("-", "-", "-"), ("(a)", "(b)", "(c)"), ("  1)", "  2)", "  3)"))] + ["BSD 3-Clause License\n\nCopyright The Authors\n\n" + BSD.format("*", "*", "*")]
    other = [MIT.replace("merge, ", ""), BSD.format("*", "*", "*").replace("prior ", ""), "MIT License", "Copyright A"]
    got = [r[0] for r in scan(spark, mit + bsd + other)]
    assert got == ["MIT"] * len(mit) + ["BSD-3-Clause"] * len(bsd) + [None] * len(other)


def test_forms_keep_what_tells_texts_apart(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["under GPL, version 2.", "under GPL, version 3.", "under GPL v. 2. It", "under GPL v. 3. It", "see Section\n4. below", "see Section\n5. below", "the\ncopyright notice", "the"])], "i long, text string")
    forms = [r[0] for r in df.orderBy("i").select(license_scan.one_line(license_scan.canonical_lines(F.col("text")))).collect()]
    assert len(set(forms)) == len(forms)


def test_long_runs_of_the_patterns_words(spark):
    """Every pattern on texts made of what it looks for, over and over."""
    parts = ["mit ", "licence ", "the ", "1 ", "or one ", "copyright ", "copyright (c) ", "portions copyright ", "a. ", "(a) ", "\n", " \n\t", "* ", "v2.", "non ", "is", "ised ", "colour", "our", "and ", ";\n1. ", "spdx-license-identifier: mit "]
    texts = [p * (n // len(p)) + end for p in parts for n in (8_000, 200_000) for end in ("", "\nx")]
    got = scan(spark, texts)
    assert len(got) == len(texts)
    assert {r[0] for r in got} == {None}
