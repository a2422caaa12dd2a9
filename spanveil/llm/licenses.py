"""Licence scan by canonical digest: a whole text, normalised, is looked up by its SHA-256 (DataFrame functions only).

Normalising: lower case, copyright lines removed, everything but letters and digits (quotes, dashes, comment marks) made
one blank, equivalent spellings unified.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm.runtime import materialize

# Known texts, as published.
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}",
    "0BSD": f"{_GRANT}.\n{_ISC_END}",
    "BSD-2-Clause": f"{_BSD}\n{_BSD_END}",
    "BSD-3-Clause": f"{_BSD}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_END}",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"], "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"], "Unlicense": ["The Unlicense"], "Zlib": ["zlib License", "The zlib License"], "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
}
#: Names of licences, and wordings of one-line notices with them; every name goes into every wording.
NAMES = {
    "MIT": ["MIT License", "MIT"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"], "GPL-2.0": ["GNU General Public License, version 2", "GPL-2.0", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL-3.0", "GPLv3"], "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL-2.1"], "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"], "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL-2.0"], "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause"], "ISC": ["ISC License", "ISC"], "Unlicense": ["Unlicense"], "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0"], "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"], "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"],
}
WORDINGS = ["Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "This work is licensed under the {}", "This work is licensed under a {}", "This project is licensed under the {}", "This software is licensed under the {}", "License: {}", "SPDX-License-Identifier: {}"]
#: Digests of the canonical form of texts too long to stand here, made from the published texts.
DIGESTS = {
    "Apache-2.0": "7f01b5c5a6f1313d84dcc69200fddb49761bc32697840688f3efa623778bf175",
    "Artistic-1.0-Perl": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    "CC0-1.0": "891968ade68c0a40cc2b1974e64ce18e87b058a90c18b0d9449bbd898d172b1d",
    "GFDL-1.2": "a517d99474cdce0dc36edd098b29823ba32d031a948181a206d9144f52e5b0f7",
    "GFDL-1.3": "b477d81ae3b69f7ce0ac3989d655d99f0540442cf76df16a6d5b5abff8e1eef3",
    "GPL-1.0": "714cb1b4d974d453c093b9dc20bb357ea3bdc52e54ca4499e4156c23e110d029",
    "GPL-2.0": "e390c1dfd2eb05d6031d675ce5eea9d124887764f58c73216b5cc536bfb9f451",
    "GPL-3.0": "5a281f634db6b415a4491779bb7121c752940f250ef622ab9ab829920e8cfbb6",
    "LGPL-2.0": "c76b4873e6b3cac1b9bd64b1bfc53fd0d45f19077cd10583549d96f864105e81",
    "LGPL-2.1": "beebb7d0f5ba0a4a1dea2ce270edee98c9ec8508ff67599a990066f5942a9d18",
    "LGPL-3.0": "dd538d15d532339d4a394323937d54825be6b2224b8e1985cf9c9e707c966d9c",
    "MPL-1.1": "3e09f15d32dbcedcd46539cb8083a1a3c4ecbff60fea0310228072dbe6a57866",
    "MPL-2.0": "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d",
}


#: Spellings that count as one, on normalised text between blanks.
SPELLINGS = [
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"), (" fulfil ", " fulfill "), ("favour", "favor"),
    (" whilst ", " while "), (" and or ", " or "), ("https", "http"),
]
#: Lines that name who holds the copyright; they differ between copies of one licence.
NOTICE = r"^[^\p{L}\p{N}\n©(]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]).*|(?:\(c\)|©)[ \t]*(?:copyright|[0-9]).*|all rights reserved\.?[ \t]*)$"


def canonical(text: Column) -> Column:
    """Canonical form of a licence text; null stays null, a text of marks only becomes empty."""
    low = F.lower(text)
    marked = F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("©")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("all rights"))
    out = F.when(marked, F.regexp_replace(low, f"(?md){NOTICE}", "")).otherwise(low)
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for spelling, plain in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(plain))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text): the texts as they are and under each title, and the notices by name and wording."""
    rows = [(k, f"{t}\n{v}".lstrip("\n")) for k, v in KNOWN.items() for t in ["", *TITLES.get(k, [])]]
    return rows + [(f"{k}-notice", w.format(n)) for k, names in NAMES.items() for n in names for w in WORDINGS]


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None, digests: dict[str, str] | None = None) -> DataFrame:
    """(license_id, license_sha256) of known texts and given digests; a digest that several licences share goes to the least id.

    Pass own rows, or to scan() any table of these two columns, to know more licences.
    """
    texts, digests = known_texts() if texts is None else texts, DIGESTS if digests is None else digests
    # One literal, so that planning doesn't grow with the rows.
    rows = [{"license_id": k, "body": v} for k, v in texts] + [{"license_id": k, "given": v} for k, v in digests.items()]
    listed = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<license_id:string,body:string,given:string>>")).alias("x"))
    listed = listed.select("x.license_id", F.coalesce("x.given", digest(F.col("x.body"))).alias("license_sha256"))
    return listed.groupBy("license_sha256").agg(F.min("license_id").alias("license_id")).select("license_id", "license_sha256")


def scan(docs: DataFrame, known: DataFrame | None = None, unit: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of docs (doc_id, text) with canonical digest and the licence whose digest it is, null if none.

    unit "line" splits texts into lines first and returns a row for each line that is a known text (line: its number from
    1), so that notices inside longer texts are found. Null and empty texts have no licence. Repeated rows repeat, ids
    may be null and of any type, an empty table gives no rows; `keep` names the columns that stay. The join is by digest:
    the planner broadcasts the known side when it is small, and shuffles both when it isn't.
    """
    known = (known_digests(docs.sparkSession) if known is None else known).select("license_id", F.col("license_sha256").alias("sha256"))
    if unit == "text":
        return docs.select(*keep, digest(F.col("text")).alias("sha256")).join(known, "sha256", "left").select(*keep, "sha256", "license_id")
    lines = docs.select(*keep, F.posexplode(F.split("text", r"\n")).alias("line", "text"))
    return lines.select(*keep, (F.col("line") + 1).alias("line"), digest(F.col("text")).alias("sha256")).join(known, "sha256").select(*keep, "line", "sha256", "license_id")


def scan_all(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows of docs (doc_id, text) with text_sha256, license_id, n_notices (lines that are known texts) and the first of them by name.

    Lines are counted by id and text, so that null ids have theirs and repeated rows share theirs.
    """
    known = materialize(known_digests(docs.sparkSession) if known is None else known)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    lines = scan(rows, known, "line", ("doc_id", "text_hash")).groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.countDistinct("line").alias("n_notices"), F.min("license_id").alias("first_notice"))
    found = scan(rows, known, keep=("doc_id", "text_hash")).join(lines, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return found.select("doc_id", F.col("sha256").alias("text_sha256"), "license_id", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), "first_notice")
