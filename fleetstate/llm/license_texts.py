"""Known licence texts and notices.

Full texts are the files of ``licenses/`` (named by licence id) and the short texts below; notices are
sentences made of a licence's usual names. A text that stands for two ids (the GNU licences' "only" and
"or later") is listed under both. Not held: full texts of AGPL and Creative Commons but CC0, of which
only notices are known; ``license_scan.scan(known=)`` takes more.
"""

from pathlib import Path

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""

# (license_id, text); several texts may stand for one licence
_SHORT = [
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AS_IS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
"""),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
""" + _BSD_TAIL),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AS_IS),
    ("MIT", "Released under the MIT License."),
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
"""),
]

# how a text goes on after its terms; many copies end before
_AFTERWORDS = ("\n   APPENDIX: How to apply", "\n            How to Apply These Terms", "\n           How to Apply These Terms", "\n        Appendix: How to Apply These Terms", "\nADDENDUM: How to use this License", "\nExhibit A - Source Code Form License Notice")
_GNU = ("GPL-", "LGPL-", "AGPL-", "GFDL-")


def _full() -> list[tuple[str, str]]:
    out = []
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = path.read_text()
        names = [f"{path.stem}-only", f"{path.stem}-or-later"] if path.stem.startswith(_GNU) else [path.stem]
        texts = [text, *(text[: text.index(a)] for a in _AFTERWORDS if a in text)]
        out += [(name, t) for name in names for t in texts]
    return out


def _gnu(short: str, long: str, version: str) -> dict[str, list[str]]:
    """Names of a GNU licence of one version, and of that version or a later one."""
    plain = version.removesuffix(".0")
    numbers = dict.fromkeys([plain, version])
    one = [f"the {x}{mid}{n}" for x in (f"GNU {long}", f"GNU {short}", short) for mid in (" version ", " v", " ") for n in numbers] + [f"{short}v{n}" for n in numbers] + [f"the {short}v{n}" for n in numbers]
    later = [x + end for x in one for end in (" or later", " or (at your option) any later version")]
    return {f"{short}-{version}-only": [*one, f"{short}-{version}"], f"{short}-{version}-or-later": later}


# names that a notice calls a licence by
_NAMES = {
    "0BSD": ["the Zero-Clause BSD License", "the BSD Zero Clause License"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache License v2.0", "the Apache License, Version 2", "the Apache 2.0 License", "the Apache 2 License", "Apache 2.0", "Apache 2", "Apache v2", "Apache License, Version 2.0 (the \"License\")", "the Apache License, Version 2.0 (the \"License\")"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License", "the two-clause BSD license", "the Simplified BSD License", "the FreeBSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License", "the three-clause BSD license", "the New BSD License", "the Revised BSD License", "the Modified BSD License", "the BSD 3-Clause \"New\" or \"Revised\" License"],
    "BSL-1.0": ["the Boost Software License, Version 1.0", "the Boost Software License 1.0"],
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "the CC0 1.0 Universal License", "Creative Commons Zero v1.0 Universal", "the Creative Commons CC0 1.0 Universal"],
    **{f"CC-{code}-{v}": [f"CC {code} {v}", f"CC-{code} {v}", f"the CC {code} {v} License", f"Creative Commons {name} {v}", f"the Creative Commons {name} {v} License", f"a Creative Commons {name} {v} License",
                          f"the Creative Commons {name} {v} {kind} License", f"a Creative Commons {name} {v} {kind} License", f"Creative Commons {name} {v} {kind}"]
       for v, kind in (("3.0", "Unported"), ("4.0", "International"))
       for code, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
    "ISC": ["the ISC License", "ISC"],
    "MIT": ["the MIT License", "the MIT License (MIT)", "MIT", "the Expat License"],
    "MPL-1.1": ["the Mozilla Public License, Version 1.1", "the Mozilla Public License 1.1", "the MPL 1.1"],
    "MPL-2.0": ["the Mozilla Public License, Version 2.0", "the Mozilla Public License, v. 2.0", "the Mozilla Public License 2.0", "the MPL 2.0", "the MPL, version 2.0"],
    "Unlicense": ["the Unlicense"],
    "Zlib": ["the zlib License", "the zlib/libpng License"],
    **_gnu("GPL", "General Public License", "2.0"), **_gnu("GPL", "General Public License", "3.0"),
    **_gnu("LGPL", "Lesser General Public License", "2.1"), **_gnu("LGPL", "Lesser General Public License", "3.0"), **_gnu("AGPL", "Affero General Public License", "3.0"),
}
_SUBJECTS = ("", *(f"{x} is " for x in ("this work", "this software", "this project", "this file")))
_VERBS = ("licensed under", "released under", "distributed under", "licensed under the terms of")


def _notices() -> list[tuple[str, str]]:
    out = [(i, f"{label} {i}") for i in _NAMES for label in ("SPDX-License-Identifier:", "License:")]
    for i, names in _NAMES.items():
        every = dict.fromkeys(y for x in names for y in (x, x.removeprefix("the ")))
        out += [(i, f"License: {x}") for x in every]
        out += [(i, f"{subject}{verb} {x}") for x in every for subject in _SUBJECTS for verb in _VERBS]
    return out


KNOWN = _SHORT + _full() + _notices()
