"""Known license texts and one-line notices by their public identifiers.

Whole texts are the files of ``license_texts`` (those of Debian's common licenses), each with and without its title
lines and its appendix, and with both addresses of the Free Software Foundation, and the short licenses below with and
without their usual titles. A text does not tell "only" from "or later": GNU texts are named by the ``-only`` identifier.
Signs are no part of a canonical form, so identifiers that differ by a plus alone are left out.
"""

from __future__ import annotations

import re
from pathlib import Path

TEXTS = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2-only",
    "GFDL-1.3": "GFDL-1.3-only", "GPL-1": "GPL-1.0-only", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2": "LGPL-2.0-only",
    "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
FRANKLIN = r"51 Franklin St(?:reet)?, Fifth Floor,\s+Boston,\s+MA\s+02110-1301,?\s+USA"
TEMPLE = "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA"

_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_CONDITIONS = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "BSD License"],
}

_GNU = {"GPL": ("GNU General Public License", ["1.0", "2.0", "3.0"]), "LGPL": ("GNU Lesser General Public License", ["2.1", "3.0"]), "AGPL": ("GNU Affero General Public License", ["3.0"])}
#: Names that notices use, by identifier; what follows "licensed under", with and without "the".
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0"],
    "MIT": ["MIT License", "MIT"], "ISC": ["ISC License"], "Zlib": ["zlib License"], "Unlicense": ["Unlicense"], "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License 2.0"], "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
}
for _kind, _long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _v, _end in (("4.0", " International"), ("3.0", " Unported")):
        NAMES[f"CC-{_kind}-{_v}"] = [f"CC {_kind} {_v}", f"Creative Commons {_long} {_v}{_end} License", f"Creative Commons {_long} {_v} License"]
for _short, (_long, _versions) in _GNU.items():
    for _v in _versions:
        _n = _v.removesuffix(".0")
        _only = [f"{_long}, version {_n}", f"{_long} v{_n}", f"{_short} version {_n}", f"{_short}v{_n}"]
        NAMES[f"{_short}-{_v}-only"] = [*_only, f"{_long}, version {_n} only"]
        NAMES[f"{_short}-{_v}-or-later"] = [*[f"{x} or later" for x in _only], f"{_long}, version {_n} or any later version", f"{_long}, version {_n} or (at your option) any later version"]
PHRASES = ["Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is licensed under {}."]
#: Further identifiers of SPDX lines.
IDENTIFIERS = """0BSD AFL-3.0 APSL-2.0 Apache-1.1 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 BSD-1-Clause BSD-4-Clause BlueOak-1.0.0 CC-BY-2.0 CC-BY-2.5
CC-BY-SA-2.0 CC-BY-SA-2.5 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EUPL-1.1 EUPL-1.2 FTL GFDL-1.1-only GFDL-1.1-or-later GFDL-1.2-only
GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later HPND ICU IPL-1.0 LGPL-2.0-only LGPL-2.0-or-later LPPL-1.3c MIT-0 MPL-1.0 MPL-1.1 MS-PL MS-RL
MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.0 OFL-1.1 OSL-3.0 OpenSSL PHP-3.01 PostgreSQL Python-2.0 QPL-1.0 Ruby SSPL-1.0 Sleepycat UPL-1.0 Unicode-DFS-2016 Vim W3C WTFPL
X11 ZPL-2.1 curl libpng-2.0""".split()


def _forms(text: str) -> list[str]:
    """A text with and without title lines (up to the first blank line) and what follows its last condition."""
    forms = [text]
    for mark in (r"END OF TERMS AND CONDITIONS", r"(?m)^[ \t]*(?:Exhibit A|EXHIBIT A) -"):
        if found := re.search(mark, text):
            forms += [text[: found.start()], text[: found.end()]] if mark[0] == "E" else [text[: found.start()]]
    forms += [x.lstrip().split("\n\n", 1)[1] for x in forms]
    return forms + [y for x in forms if (y := re.sub(FRANKLIN, TEMPLE, x)) != x]


def texts() -> list[tuple[str, str]]:
    """Identifier and body of the whole texts that are files."""
    folder = Path(__file__).parent / "license_texts"
    return [(name, form) for file, name in TEXTS.items() for form in _forms((folder / f"{file}.txt").read_text("utf-8"))]


def short(bodies: dict[str, str]) -> list[tuple[str, str]]:
    """The short licenses: BSD by number and by sign, and those given, with their titles."""
    out = []
    for n in (2, 3):
        for conditions in (_CONDITIONS[:n], [f"{i + 1}. {x}" for i, x in enumerate(_CONDITIONS[:n])]):
            for holder in ("HOLDER", "OWNER", "HOLDERS"):
                body = " ".join([_REDISTRIBUTION, *conditions, _DISCLAIMER.format(holder)])
                out += [(f"BSD-{n}-Clause", body), *[(f"BSD-{n}-Clause", f"{t}\n{body}") for t in TITLES[f"BSD-{n}-Clause"]]]
    return out + [(name, f"{title}\n{body}") for name, body in bodies.items() for title in TITLES[name]]


def notices() -> list[tuple[str, str]]:
    """One-line notices: SPDX lines, and names after the usual words."""
    names = sorted({*NAMES, *IDENTIFIERS})
    out = [(name, f"SPDX-License-Identifier: {name}") for name in names]
    for name, called in NAMES.items():
        out += [(name, phrase.format(the + x)) for x in called for the in ("", "the ") for phrase in PHRASES]
    for short_name, (long, versions) in _GNU.items():
        for v in versions:
            terms = f"you can redistribute it and/or modify it under the terms of the {long} as published by the Free Software Foundation"
            n = v.removesuffix(".0")
            for thing in ("program", "library", "software"):
                out.append((f"{short_name}-{v}-or-later", f"This {thing} is free software; {terms}, either version {n} of the License, or (at your option) any later version."))
                out.append((f"{short_name}-{v}-or-later", f"This {thing} is free software; {terms}; either version {n} of the License, or (at your option) any later version."))
                out.append((f"{short_name}-{v}-only", f"This {thing} is free software; {terms}, version {n}."))
    return out
