"""Licence texts by canonical digest.

A text is reduced to its canonical form (ASCII letters in lower case, copyright lines dropped, punctuation and white space as
one space, equivalent spellings made equal), and the digest of the whole is joined with those of known licences. Short notices are
looked up line by line in the same way. Known are the short texts here, the long ones in ``licence_texts`` (a file per identifier), each
under its usual titles or none, and the notices of ``NOTICES``; callers may pass their own of both.

Rows: one per input row. A null text, or one without letters or digits, has no digest and no licence. Texts are digested whole. Repeated
rows are judged alike, doc_id is passed through, other columns are not read. Known texts with one canonical form are one
licence, the first by name.
"""
from __future__ import annotations

import hashlib
import re
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from codecairn.llm.tables import fields, map_rows, table, typed

COPYRIGHT_LINE = re.compile(rb"(?:^|\n)[ \t#*/;-]*(?:copyright[ \t]*(?:\(c\)|\xc2\xa9|[0-9]{4})|\(c\)|\xc2\xa9|all rights reserved)[^\n]*")
_LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BREAKS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))

#: Equivalent spellings, as the public matching guidelines for licence texts list them.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "catalogue": "catalog", "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor",
    "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize",
    "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licences": "licenses",
    "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense", "utilisation": "utilization",
    "whilst": "while", "wilful": "wilfull",
}
_SPELLINGS = {k.encode(): v.encode() for k, v in SPELLINGS.items()}

#: Texts of licences, to be matched as wholes.
WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
TEXTS = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies.

""" + WARRANTY,
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

""" + WARRANTY,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
#: Further short texts, matched like those above.
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.

"""
BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
MORE_TEXTS = {
    "BSD-2-Clause": BSD_CONDITIONS + BSD_WARRANTY,
    "BSD-3-Clause": BSD_CONDITIONS + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.

""" + BSD_WARRANTY,
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
}
#: Titles under which short texts stand; all of them also stand without a title.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD", "BSD Zero Clause License (0BSD)"],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License", "zlib"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD-2-Clause", "BSD License", "Simplified BSD License", "The 2-Clause BSD License",
                     "BSD 2-Clause \"Simplified\" License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD-3-Clause", "BSD License", "New BSD License", "The 3-Clause BSD License",
                     "Modified BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
#: Street addresses that copies of one licence text differ in.
ADDRESSES = ["51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA",
             "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA.",
             "675 Mass Ave, Cambridge, MA 02139, USA", ""]
#: How one-line notices begin, and the names they use.
OPENINGS = ["Licensed under", "Released under", "Distributed under", "Published under", "Made available under", "License:",
            *(f"This {x} is licensed under" for x in ("work", "project", "software", "file", "program"))]
NAMES = {
    "MIT": ["MIT License", "MIT", "terms of the MIT License"],
    "ISC": ["ISC License", "ISC"],
    "0BSD": ["0BSD", "BSD Zero Clause License"],
    "Zlib": ["zlib License"],
    "Unlicense": ["Unlicense"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause", "New BSD License", "Modified BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0", "Apache 2.0 License", "Apache License v2.0"],
    "MPL-1.1": ["Mozilla Public License, version 1.1", "Mozilla Public License 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL 2.0"],
}
for _short, _long, _versions in (("GPL", "GNU General Public License", ("1.0", "2.0", "3.0")), ("AGPL", "GNU Affero General Public License", ("3.0",)),
                                 ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")), ("GFDL", "GNU Free Documentation License", ("1.2", "1.3"))):
    for _v in _versions:
        _n = {_v, _v.removesuffix(".0")}
        _forms = [f"{_a}{_b}{_x}" for _a in (_long, f"{_long} ({_short})", _short, f"GNU {_short}") for _b in (" version ", " v", " ") for _x in sorted(_n)]
        _forms += [f"{_short}v{_x}" for _x in sorted(_n)]
        NAMES[f"{_short}-{_v}-only"] = [*_forms, *(f"{_f} only" for _f in _forms)]
        NAMES[f"{_short}-{_v}-or-later"] = [f"{_f} {_t}" for _f in _forms for _t in ("or later", "or any later version", "or (at your option) any later version")]
for _code, _long in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
                     "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items():
    for _v, _port in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        _forms = [f"CC {_code} {_v}", f"Creative Commons {_code} {_v}", f"Creative Commons {_long} {_v}", f"Creative Commons {_long} {_v} {_port}"]
        NAMES[f"CC-{_code}-{_v}"] = [*_forms, *(f"{_f} License" for _f in _forms)]
#: One-line notices and what they stand for.
NOTICES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the Apache License 2.0.": "Apache-2.0",
    "Licensed under the Apache License, Version 2.0 (the \"License\");": "Apache-2.0",
    "SPDX-License-Identifier: MIT": "MIT",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0-only",
    "This work is licensed under CC BY 4.0.": "CC-BY-4.0",
    **{f"{o} {the}{n}": i for i, names in NAMES.items() for n in names for o in OPENINGS for the in ("", "the ")},
    **{f"SPDX-License-Identifier: {i}": i for i in NAMES},
}


def canonical(text: bytes) -> bytes:
    low = COPYRIGHT_LINE.sub(b"\n", text.translate(_LETTERS))
    return b" ".join([_SPELLINGS.get(w, w) for w in low.translate(_BREAKS).split(b" ") if w])


def digest(text: str | None) -> str | None:
    form = canonical((text or "").encode())
    return hashlib.sha256(form).hexdigest() if form else None


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text) of every known text in each of its spellings."""
    out = []
    for name, text in [*TEXTS.items(), *MORE_TEXTS.items()]:
        titles = TITLES.get(name, [])
        head, _, rest = text.partition("\n\n")
        body = rest if head in titles else text
        out += [(name, text), (name, body), *((name, f"{t}\n\n{body}") for t in titles)]
    for f in sorted(resources.files("codecairn.llm").joinpath("licence_texts").iterdir(), key=lambda f: f.name):
        name, text = f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")
        bodies = [text]
        for end in ("APPENDIX: How to apply", "How to Apply These Terms"):  # the licence ends before its instructions
            if end in text:
                bodies.append(text[:text.rindex(end)].rstrip())
        if "END OF TERMS AND CONDITIONS" in text:
            bodies += [x.replace("END OF TERMS AND CONDITIONS", "") for x in bodies]
        known = re.search(r"51 Franklin St[^\n]*", text)
        bodies = [x.replace(known.group(), a) for x in bodies for a in ADDRESSES] + bodies if known else bodies
        out += [(name, x.replace("https://", p)) for x in bodies for p in ("https://", "http://")]
        out += [(name, x.replace("http://", "https://")) for x in bodies]
    return out


def known_licences(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license_id, digest), one row per digest."""
    by_digest: dict[str, str] = {}
    for name, text in sorted(known_texts() if texts is None else texts.items()):
        if d := digest(text):
            by_digest.setdefault(d, name)
    return spark.createDataFrame([(n, d) for d, n in by_digest.items()], "license_id string, digest string")


def digests(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id, digest of the whole text, and the licences that its notice lines name (sorted, comma-joined)."""
    forms = {canonical(line.encode()): name for line, name in (NOTICES if notices is None else notices).items()}
    schema = T.StructType([*fields(docs, "doc_id"), *typed("digest string, notices string")])

    def lines(text: str | None) -> str:
        found = {forms[f] for line in (text or "").encode().split(b"\n") if (f := canonical(line)) in forms}
        return ",".join(sorted(found))

    def task(rows):
        for b in rows:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(digest, texts), pa.string()), pa.array(map(lines, texts), pa.string())],
                                             schema.names)

    return map_rows(docs, ["doc_id", "text"], schema, task)


def scan(docs: DataFrame, known: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id, digest, license_id (null where the whole text is no known licence), notices."""
    k = known.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    return digests(docs, notices).join(k, "digest", "left").select("doc_id", "digest", "license_id", "notices")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_licences(spark))


def _sql() -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    line = r"(?:^|\n)[ \t#*/;-]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4})|\(c\)|©|all rights reserved)[^\n]*"
    spellings = "MAP {" + ", ".join(f"{quote(a)}: {quote(b)}" for a, b in SPELLINGS.items()) + "}"

    def form(text: str) -> str:
        low = f"regexp_replace(translate({text}, '{upper}', '{lower}'), {quote(line)}, chr(10), 'g')"
        words = rf"list_filter(string_split(regexp_replace({low}, '[^a-z0-9\x{{80}}-\x{{10FFFF}}]', ' ', 'g'), ' '), lambda w: w <> '')"
        return f"array_to_string(list_transform({words}, lambda w: coalesce({spellings}[w], w)), ' ')"

    first: dict[str, str] = {}
    for name, text in sorted(known_texts()):
        first.setdefault(digest(text), name)
    known = ", ".join(f"({quote(d)}, {quote(n)})" for d, n in first.items())
    notices = ", ".join(f"({quote(canonical(k.encode()).decode())}, {quote(v)})" for k, v in NOTICES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, {form("coalesce(text, '')")} AS form FROM documents),
known(digest, license_id) AS (VALUES {known}), notices(form, name) AS (VALUES {notices}),
named AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM (SELECT r, {form("l")} AS form FROM
  (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)) JOIN notices USING (form) GROUP BY r),
h AS (SELECT *, CASE WHEN form <> '' THEN sha256(form) END AS digest FROM d)
SELECT doc_id, h.digest, license_id, coalesce(names, '') AS notices FROM h LEFT JOIN known ON h.digest = known.digest LEFT JOIN named USING (r)
"""


SQL = _sql()
