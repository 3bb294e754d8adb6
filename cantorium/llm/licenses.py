"""License scan by canonical digests: entire texts against known licences; entire lines against them as an extra.

A canonical form drops what licence copies differ in: letter case, copyright statements, punctuation, white space and line
wraps, and equivalent spellings. Its SHA-256 is joined to the digests of known licences, each with and without its
heading and its closing instructions; a text is never matched by a part of it. Short notices that stand for licences
("Released under the MIT License.") are known texts too; a document that holds one as a line of its own has it among its
notices, which are looked up in the row itself. Documents are read once and never shuffled.

Known are the texts below and the digests of longer licences; known_from_texts() makes a table from any other texts.

Defined results: a text that is null, empty or without letters and digits has no licence; null doc_ids and repeated
rows are scanned like others; an empty table gives no rows; further columns of any name are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, as in the SPDX matching guidelines; the right form replaces the left one.
SPELLINGS = (
    ("acknowledgment", "acknowledgement"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("centre", "center"),
    ("fulfil ", "fulfill "),
    ("judgment", "judgement"),
    ("labour", "labor"),
    ("licence", "license"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("recognise", "recognize"),
    ("sub license", "sublicense"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_OWN_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, "
    "OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
# Headings that copies of a licence begin with or leave out.
HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"),
    "Zlib": ("zlib License", "The zlib License"),
}
# Licence texts and the short notices that stand for licences, by SPDX identifier.
KNOWN = (
    ("BSD-2-Clause", _BSD_TWO + _BSD_WARRANTY),
    (
        "BSD-3-Clause",
        _BSD_TWO + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.\n" + _BSD_WARRANTY,
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software.\n" + _WARRANTY,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _OWN_WARRANTY,
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _OWN_WARRANTY,
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software.\n3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)
# Canonical digests of longer licences, whole and without the instructions that follow their terms, by SPDX identifier.
KNOWN_DIGESTS = (
    ("Apache-2.0", "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a"),
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.2", "8d636e2e2f248f9b102e9d9f78337901ec8bca3bfe91434cdcf261a01bf305b1"),
    ("GFDL-1.3", "8b8b57bd195ed50d50edb5da1dd173b409fb9b075910c69726be7d0363c40008"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "101efdbe029f4f70be02f9eb403d866d861b87f1bfdfb676da7f664e1cff8a25"),
    ("GPL-2.0", "6fcf97e3df5c1156c040b055ccfc9546a195b873cf3c7b800146ae15002100fb"),
    ("GPL-2.0", "fd8bb7ffaebedd23a6d289b778a0eccbc7df9d771773e40a1349fb0a76d4562a"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "0911dfb03f2647ccafe5b76b5e6d92f241b8fd36e90c10de1b66fa9b11232df6"),
    ("LGPL-2.0", "bc9d420bc02b68e7267ff86621caf0c41e6bfa42156a90900fb753cdf537d767"),
    ("LGPL-2.0", "ed4f0abe91389c1bc7edcc93a48d28c0a6e67f69c688548a26ab093dc5e56b4d"),
    ("LGPL-2.1", "36742c1eb66993bd1356d9d90c137bd6ae92910a0d44e0093b99e421595ce03f"),
    ("LGPL-2.1", "446c21a03ef2a7bf84827ba3f0d7010657ad875eebd282c7b0c236f1cd60c2c1"),
    ("LGPL-2.1", "f9036d772cb0d671bb1ac550a612a9fb60ab8d2800b9dadcff438b95ca3d64b6"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "74d53d3f519e5a9a798c4ca150f73846481a6d5b108fdc7e3e0bdff603cf2f5d"),
    ("MPL-2.0", "fed30cace846a13ba04565551e526a8de00de8f2938c37a0cfb4d9f9430d70e9"),
)
#: Most known digests that rows are looked up in by themselves.
MOST_KNOWN = 10_000

#: RE2's syntax, which SQL engines share. A copyright statement ends with its line, or where a licence's own words begin.
COPYRIGHT = (
    r"^[^\p{L}\p{N}\n]*(?:copyright (?:\(c\)|©|[0-9]|[\[{<])|\(c\) *(?:copyright|[0-9])|©|all rights reserved)[^\n]*?"
    r"(?:[.,; ] *((?:permission is|permission to|licen[cs]ed under|released under|redistribution and use|this (?:software|work|file|program)) [^\n]*)|$)"
)
_WORDS = tuple(x for x in SPELLINGS if " " not in x[0])
_PHRASES = tuple(x for x in SPELLINGS if " " in x[0])


def canonical(text: Column) -> Column:
    """Lines of letters and digits, kept apart by line feeds; empty lines go."""
    plain = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    plain = F.regexp_replace(plain, "(?dm)" + COPYRIGHT, "$1")
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}\n]+", " ")
    for left, right in _WORDS:
        plain = F.replace(plain, F.lit(left), F.lit(right))
    return F.trim(F.regexp_replace(plain, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def digest(plain: Column) -> Column:
    """SHA-256 of a canonical form with its lines run together, so that wraps don't count; null where nothing is left."""
    flat = F.replace(plain, F.lit("\n"), F.lit(" "))
    for left, right in _PHRASES:
        flat = F.replace(flat, F.lit(left), F.lit(right))
    return F.when(plain != "", F.sha2(flat, 256))


def variants(known: tuple[tuple[str, str], ...] = KNOWN) -> list[tuple[str, str]]:
    """The known texts, and those with each of their headings."""
    long = [(name, text) for name, text in known if "\n" in text]
    return list(known) + [(name, f"{heading}\n{text}") for name, text in long for heading in HEADINGS.get(name, ())]


def known_from_texts(spark: SparkSession, texts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(licence, digest) of each (licence, text)."""
    frame = spark.createDataFrame(texts, "licence string, known_text string")
    rows = frame.select("licence", digest(canonical(F.col("known_text"))).alias("d")).filter("d is not null").collect()
    return [(r.licence, r.d) for r in rows]


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = KNOWN_DIGESTS) -> dict[str, str]:
    """Digest to licence, the first name in code point order where several share a text."""
    found: dict[str, str] = {}
    for licence, d in [*known_from_texts(spark, variants(known)), *digests]:
        found[d] = min(found.get(d, licence), licence)
    return found


def scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = KNOWN_DIGESTS) -> DataFrame:
    """A row for each document: doc_id, text_digest, licence (of the entire text), notices (licences of its lines, sorted), n_notices."""
    found = known_digests(docs.sparkSession, known, digests)
    if len(found) > MOST_KNOWN:
        raise ValueError(f"{len(found)} known digests; rows are looked up in at most {MOST_KNOWN}")
    table = docs.sparkSession.createDataFrame(sorted(found.items()), "known_digest string, licence string")
    names = F.create_map(*[F.lit(v) for item in sorted(found.items()) for v in item]) if found else F.lit(None).cast("map<string,string>")
    plain = docs.select("doc_id", canonical(F.col("text")).alias("plain"))
    lines = F.transform(F.split("plain", "\n"), lambda line: F.try_element_at(names, digest(line)))
    rows = plain.select("doc_id", digest(F.col("plain")).alias("text_digest"), F.array_sort(F.array_distinct(F.filter(lines, lambda x: x.isNotNull()))).alias("listed"))
    whole = rows.join(F.broadcast(table), F.col("text_digest") == F.col("known_digest"), "left")  # at most MOST_KNOWN rows
    return whole.select("doc_id", "text_digest", "licence", F.array_join("listed", ",").alias("notices"), F.size("listed").cast("long").alias("n_notices"))
