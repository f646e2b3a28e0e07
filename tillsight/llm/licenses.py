"""License scans by canonical digests.

A text is made canonical (lower case; equivalent spellings joined; copyright lines, quotes,
punctuation and white space removed or joined) and its SHA-256 is looked up among the digests of
known licence texts: one hash join of whole texts. Lines are looked up the same way against
known notices, so "Released under the MIT License." in a document is found as a whole line.

The table of known texts has a row for each usual form of a licence (with and without its heading,
template line or appendix); it is made on the driver from this file and ``license_texts`` and read by
Spark like any table. Only digests of documents are joined, and only lines with the canonical length
and beginning of some known notice leave their document.

Defined results: null and empty texts and texts that are empty once canonical match nothing and
have the digest of the empty text; two known texts with one digest give the first licence by name;
repeated rows give repeated results; an empty table gives an empty result. Columns named like
those made here are replaced.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm.common import stage

#: Canonical rewriting, applied in this order (pattern, replacement).
COPYRIGHT_LINE = (r"(?m)^[^\p{L}\n(©]*(?:copyright\b|\(c\)|©)[^\n]*(?:[0-9]{4}|<year>|all rights reserved)[^\n]*$"
                  r"|^[^\p{L}\n]*all rights reserved[^\p{L}\n]*$")
SPELLINGS = (
    (r"licence", "license"), (r"sub-license", "sublicense"), (r"non-commercial", "noncommercial"),
    (r"favour", "favor"), (r"organis", "organiz"), (r"utilis", "utiliz"), (r"authoris", "authoriz"),
    (r"https://", "http://"), (r"&", " and "), (r"version ([0-9])", "v$1"), (r"v([0-9])\.0\b", "v$1"),
)
JOINERS = r"[^\p{L}\p{N}]+"

#: Notices by licence (whole lines as authors write them, and the lines of the standard
#: headers that name the licence, as they are usually wrapped).
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "This project is licensed under the Apache License 2.0.",
                   "SPDX-License-Identifier: Apache-2.0",
                   'Licensed under the Apache License, Version 2.0 (the "License");',
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not',
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may',
                   'Licensed under the Apache License, Version 2.0 (the "License"); you',
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except',
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file',
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
                   "compliance with the License.",
                   'The ASF licenses this file to You under the Apache License, Version 2.0',
                   'under the Apache License, Version 2.0 (the "License");',
                   "http://www.apache.org/licenses/LICENSE-2.0",
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "Released under the Apache License, Version 2.0.", "Released under the Apache License 2.0.",
                   "Licensed under the Apache License 2.0.", "Licensed under Apache-2.0.",
                   "This project is licensed under the Apache License, Version 2.0."),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause",
                     "Licensed under the BSD 2-Clause License.", "This project is licensed under the BSD 2-Clause License."),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
                     "Licensed under the BSD 3-Clause License.", "This project is licensed under the BSD 3-Clause License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.",
                  "SPDX-License-Identifier: CC-BY-4.0",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License.",
                  "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.",
                     "SPDX-License-Identifier: CC-BY-NC-4.0",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                     "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.",
                     "SPDX-License-Identifier: CC-BY-SA-4.0",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                     "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0-only": ("This work is licensed under the GNU General Public License, version 2.",
                     "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0",
                     "it under the terms of the GNU General Public License version 2 as",
                     "it under the terms of the GNU General Public License, version 2, as",
                     "under the terms of the GNU General Public License version 2 as published by"),
    "GPL-3.0-only": ("This work is licensed under the GNU General Public License, version 3.",
                     "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0",
                     "it under the terms of the GNU General Public License version 3 as",
                     "it under the terms of the GNU General Public License, version 3, as",
                     "under the terms of the GNU General Public License version 3 as published by"),
    "ISC": ("Released under the ISC License.", "SPDX-License-Identifier: ISC", "Licensed under the ISC License.",
            "This project is licensed under the ISC License."),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.",
            "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
                "License, v. 2.0. If a copy of the MPL was not distributed with this",
                "License, v. 2.0. If a copy of the MPL was not distributed with this file,",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
                "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
                "You can obtain one at http://mozilla.org/MPL/2.0/."),
}

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE.")
#: Short public licence texts (one paragraph a line, copyright lines left out).
TEXTS = {
    "MIT": "MIT License\n\n"
           "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
           "to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
           "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
           "of the Software.\n\n" + _WARRANTY,
    "ISC": "ISC License\n\n"
           "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
           'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
           "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
           "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
           "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
           "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
            "held liable for any damages arising from the use of this software.\n\n"
            "Permission is granted to anyone to use this software for any purpose, including commercial applications, and "
            "to alter it and redistribute it freely, subject to the following restrictions:\n\n"
            "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
            "software. If you use this software in a product, an acknowledgment in the product documentation would be "
            "appreciated but is not required.\n"
            "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
            "original software.\n"
            "3. This notice may not be removed or altered from any source distribution.",
}

#: Headings that stand before the short texts (none is a form of its own).
HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License",
                     'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License",
                     'BSD 3-Clause "New" or "Revised" License', "New BSD License", "BSD License"),
}
#: Copyright lines of templates that nobody filled in (filled ones are removed).
TEMPLATES = ("Copyright (c) [year] [fullname]",)
#: Who provides, who is liable and whose name is protected in the BSD licences.
BSD_PARTIES = (
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER OR CONTRIBUTORS", "copyright holder nor the names of its"),
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS", "copyright holder nor the names of its"),
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS", "copyright holders nor the names of its"),
    ("REGENTS AND CONTRIBUTORS", "REGENTS OR CONTRIBUTORS", "University nor the names of its"),
    ("AUTHOR AND CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS", "author nor the names of its"),
)


def _file(name: str) -> str:
    return (resources.files("tillsight.llm") / "license_texts" / f"{name}.txt").read_text("utf-8")


def _from(text: str, start: str) -> str:
    return text[text.index(start):]


def _until(text: str, end: str, with_end: bool = True) -> str:
    return text[:text.index(end) + len(end) * with_end]


def _bsd() -> dict[str, list[str]]:
    three = _file("BSD-3-Clause")
    two = "\n\n".join(p for p in three.split("\n\n") if not p.startswith("3. "))
    out = {}
    for name, text in (("BSD-2-Clause", two), ("BSD-3-Clause", three)):
        by = dict.fromkeys(text.replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", provider)
                           .replace("COPYRIGHT HOLDER OR CONTRIBUTORS", liable)
                           .replace("copyright holder nor the names of its", named)
                           for provider, liable, named in BSD_PARTIES)
        out[name] = [t for b in by for t in (b, b.replace("\n\n1. ", "\n\n* ").replace("\n\n2. ", "\n\n* ")
                                             .replace("\n\n3. ", "\n\n* "))]
    return out


def _known_texts() -> dict[str, tuple[str, ...]]:
    """Every form of the known texts: ``TEXTS``, ``license_texts`` and what their licences are often printed with."""
    mit, isc = _from(TEXTS["MIT"], "Permission"), _from(TEXTS["ISC"], "Permission")
    authors = isc.replace("THE AUTHOR DISCLAIMS", "THE AUTHORS DISCLAIM").replace("SHALL THE AUTHOR BE", "SHALL THE AUTHORS BE")
    short = {"MIT": [mit, mit.replace("permission notice shall", "permission notice (including the next paragraph) shall")],
             "ISC": [t for b in (isc, authors) for t in (b, b.replace("and/or distribute", "and distribute"))],
             "Zlib": [TEXTS["Zlib"]], **_bsd()}
    out = {name: [f"{heading}\n\n{line}\n\n{body}" for body in bodies for heading in ("", *HEADINGS[name])
                  for line in ("", *TEMPLATES)] for name, bodies in short.items()}

    apache = _file("Apache-2.0")
    unfilled = "Copyright [yyyy] [name of copyright owner]"
    forms = (apache, apache.replace(unfilled, ""), _until(apache, "END OF TERMS AND CONDITIONS"),
             _until(apache, "END OF TERMS AND CONDITIONS", False))
    out["Apache-2.0"] = [t for f in forms for t in (f, _from(f, "TERMS AND CONDITIONS FOR USE"))]
    for name, heading in (("GPL-2.0-only", "Preamble"), ("GPL-3.0-only", "Preamble")):
        gpl = _file(name)
        forms = [gpl, _until(gpl, "END OF TERMS AND CONDITIONS"), _until(gpl, "END OF TERMS AND CONDITIONS", False)]
        if name == "GPL-2.0-only":
            street = "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
            forms += [f.replace(street, other) for f in forms for other in (
                "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "<https://fsf.org/>")]
        else:
            forms.append(gpl.replace("licenses/why-not-lgpl", "philosophy/why-not-lgpl"))
        out[name] = [t for f in forms for t in (f, _from(f, heading))]
    mpl = _file("MPL-2.0")
    out["MPL-2.0"] = [t for f in (mpl, _until(mpl, "Exhibit A", False)) for t in (f, _from(f, "1. Definitions"))]
    out["CC-BY-SA-4.0"] = []
    title, party = "Attribution-ShareAlike 4.0 International", "Creative Commons is not a party"
    for cc in (_file("CC-BY-SA-4.0"), _file("CC-BY-SA-4.0_2")):
        body = _from(cc, "Creative Commons Corporation")
        proper = _from(cc, "Creative Commons Attribution-ShareAlike 4.0 International Public")
        out["CC-BY-SA-4.0"] += [f for whole in (body, f"{title}\n\n{body}", f"Creative Commons {title}\n\n{body}", proper,
                                                _from(proper, "By exercising"))
                                for f in (whole, _until(whole, party, False))]
    return {name: tuple(dict.fromkeys([*([TEXTS[name]] if name in TEXTS else []), *many])) for name, many in out.items()}


#: Known texts by licence, every form of each (no whole text here: CC-BY-4.0, CC-BY-NC-4.0).
KNOWN_TEXTS = _known_texts()
#: Letters of a canonical line that must begin like a known notice before the line leaves its document.
HEAD = 16


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, one spelling, words joined by single blanks."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " ")
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.regexp_replace(out, JOINERS, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, texts: dict[str, str | tuple[str, ...]]) -> DataFrame:
    """``license``, ``digest``, ``size`` and ``head`` (first letters) of each known text (one row a digest)."""
    rows = [(name, t) for name, many in texts.items() for t in ((many,) if isinstance(many, str) else many)]
    plain = spark.createDataFrame(rows, "license string, body string")
    return (plain.select("license", canonical(F.col("body")).alias("canon"))
            .groupBy(F.sha2("canon", 256).alias("digest"))
            .agg(F.min("license").alias("license"), F.max(F.length("canon")).alias("size"),
                 F.min(F.substring("canon", 1, HEAD)).alias("head")))


def scan_licenses(docs: DataFrame, *, texts: dict = KNOWN_TEXTS, notices: dict = NOTICES, text: str = "text",
                  doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, text_digest, license (of the whole text), notices (sorted, of its lines)."""
    spark = docs.sparkSession
    whole, lines = known_digests(spark, texts), stage(known_digests(spark, notices), "notices")
    begins = [f"{r['size']} {r['head']}" for r in lines.select("size", "head").distinct().collect()]   # as many as notices
    body = F.coalesce(F.col(text), F.lit(""))
    # a line's canonical form is as long as a known notice's and begins like it, or the line stays in its document
    cut = F.filter(F.transform(F.filter(F.split(body, "\n"), lambda x: F.length(F.trim(x)) > 0), canonical),
                   lambda c: F.concat(F.length(c).cast("string"), F.lit(" "), F.substring(c, 1, HEAD)).isin(begins or [""]))
    rows = stage(docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                             digest(F.col(text)).alias("text_digest"),
                             F.array_distinct(F.transform(cut, lambda c: F.sha2(c, 256))).alias("line_digests")),
                 "license-rows")
    found = (rows.select("row", F.explode("line_digests").alias("digest"))
             .join(lines.select("digest", "license"), "digest")
             .groupBy("row").agg(F.array_sort(F.collect_set("license")).alias("notices")))
    return (rows.join(whole.select(F.col("digest").alias("text_digest"), "license"), "text_digest", "left")
            .join(found, "row", "left")
            .select("doc_id", "text_digest", "license", F.coalesce(
                F.array_join("notices", ","), F.lit("")).alias("notices")))
