"""Licence scan by canonical digest lookup, in DataFrame operations only.

A text is brought to a canonical form (case, copyright lines, equivalent spellings, punctuation)
and the digest of the whole form is looked up among the digests of known licences.
"""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.llm.common import A_Z, a_z, ascii_lower

# Equivalent spellings, as in public licence matching guidelines.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"),
    ("favourite", "favorite"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
#: Typographic quotes, dashes, blanks, bullets and the ellipsis: punctuation beyond ASCII.
PUNCTUATION = "\u00a0\u00ab\u00b7\u00bb" + "".join(map(chr, [*range(0x2000, 0x200C), *range(0x2010, 0x2016), *range(0x2018, 0x2020), 0x2022, 0x2026, 0x202F, 0x2212, 0x3000, 0xFEFF]))
#: A copyright line: comment marks, then the word or sign with a year, a sign or a name; or the reservation of rights.
COPYRIGHT_LINE = r"(?:^|\n)[ \t*#/;%-]*(?:copyright[ \t]*(?:\(c\)|©|[0-9])|\(c\)[ \t]|©|copyright <|all rights reserved)[^\n]*"

# Texts of public licences.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
    "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.\n"
)
_BSD_THREE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.\n"
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
    "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
LICENSES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_WARRANTY,
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the "
        "License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": _BSD_HEAD + _BSD_TWO + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD_HEAD + _BSD_TWO + _BSD_THREE + _BSD_WARRANTY,
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY
    ),
    "MIT": "MIT License\n\n" + _MIT_GRANT + ", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _MIT_WARRANTY,
    "MIT-0": "MIT No Attribution\n\n" + _MIT_GRANT + ".\n\n" + _MIT_WARRANTY,
    "MIT-line": "Released under the MIT License.",
}
#: A copyright line of a name alone: it starts with the word, and no licence's own sentence goes on like this.
NAMED_LINE = r"(?:^|\n)[ \t*#/;%-]*copyright[ \t:]+(?!(?:notice|holder|owner|law|licen[sc]e|statement|disclaimer|interest|permission|protection|right|treat|and|or|in|on|is|to|of|the|as|for)(?:s|ies|y)?\b)[^\n]*"

#: Titles that the short licences go by; each is known without a title too.
TITLES = {
    "0BSD": ("Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License", "The Zero-Clause BSD License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "BSD-2-Clause", "Simplified BSD License", "The BSD License", "BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD-3-Clause", "New BSD License", "Modified BSD License", "The BSD License", "BSD License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "Expat License"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License", "MIT-0", "MIT-0 License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
_FSF = ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301, USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA")
_FSF_LINE = r"\n[ \t]*(?:51 Franklin|59 Temple|675 Mass)[^\n]*(?:\n[ \t]*Boston[^\n]*)?"


@lru_cache(maxsize=1)
def forms() -> tuple[tuple[str, str], ...]:
    """(license_id, text) of every known form: LICENSES, the full texts beside this file, and their
    usual variants of title, bullets, wording, publisher's address and appendix."""
    out = set(LICENSES.items())
    bare = {k: LICENSES[k].removeprefix("MIT License\n").removeprefix("MIT No Attribution\n") for k in TITLES if k in LICENSES}
    full = {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
    bare["Unlicense"] = full["Unlicense"]
    for name, body in bare.items():
        bodies = {body, body.replace("and/or distribute", "and distribute"), body.replace("modify, and/or", "modify, and")} if name in ("ISC", "0BSD") else {body}
        if name.startswith("BSD"):
            bodies |= {b.replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "AUTHOR AND CONTRIBUTORS").replace("COPYRIGHT HOLDER OR", "AUTHOR OR") for b in bodies}
            bodies |= {b.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR") for b in bodies}
            bodies |= {re.sub(r"(?m)^[123]\. ", "* ", b) for b in bodies} | {re.sub(r"(?m)^([123])\. ", lambda m: "abc"[int(m[1]) - 1] + ") ", b) for b in bodies}
        out |= {(name, f"{title}\n\n{b}") for b in bodies for title in ("", *TITLES[name])}
    for name, body in full.items():
        bodies = {body}
        for end in ("END OF TERMS AND CONDITIONS", "ADDENDUM: How to use this License"):
            head, found, _ = body.partition(end)
            if found:
                bodies |= {head + end, head}
        if re.search(_FSF_LINE, body):
            bodies |= {re.sub(_FSF_LINE, "\n" + a, b) for b in bodies for a in _FSF} | {re.sub(_FSF_LINE, "", b) for b in bodies}
        out |= {(name, b) for b in bodies}
    return tuple(sorted(out))


def canonical(text: Column) -> Column:
    """Lower-cased (A-Z), without copyright lines, punctuation as single spaces, spellings unified.
    White space and punctuation are all ASCII that is not a letter or digit, and PUNCTUATION; all else
    beyond ASCII counts as a letter. Null gives the empty form."""
    out = ascii_lower(F.coalesce(text, F.lit("")), PUNCTUATION)
    out = F.regexp_replace(out, COPYRIGHT_LINE, "\n")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[\x00-\x2F\x3A-\x60\x7B-\x7F©]+", " "), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, " +", " "))


def known_digests(spark: SparkSession, licenses: dict[str, str] | None = None) -> DataFrame:
    """(digest, license_id), one row a digest: the least name of licences that have one form; of
    all forms() if no licences are given."""
    rows = spark.createDataFrame(sorted(licenses.items()) if licenses else list(forms()), "license_id string, body string")
    return rows.select(F.sha2(canonical(F.col("body")), 256).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, canonical_chars, license_id (null if the whole text is no known licence).

    Every row is returned, repeated rows too. A null or empty text, or one of copyright lines only,
    has the empty form and no licence. Where the form itself is unknown, that without copyright
    lines of a name alone is looked up too. The digest joins move no text; the side of the known
    licences is broadcast if adaptive execution finds it small. Other columns are ignored.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    form, low = canonical(F.col(text)), ascii_lower(F.col(text), PUNCTUATION)
    named = F.when(low.rlike(NAMED_LINE), F.sha2(canonical(F.regexp_replace(low, NAMED_LINE, "\n")), 256))
    rows = docs.select(F.col(ident).alias("doc_id"), form.alias("form"), named.alias("named"))
    digest = F.sha2("form", 256)
    rows = rows.select("doc_id", digest.alias("digest"), F.coalesce("named", digest).alias("named"), F.char_length("form").cast("long").alias("canonical_chars"))
    hit = known.where(F.col("digest") != F.sha2(F.lit(""), 256))
    other = hit.select(F.col("digest").alias("named"), F.col("license_id").alias("_named_id"))
    return rows.join(hit, "digest", "left").join(other, "named", "left").select("doc_id", "digest", "canonical_chars", F.coalesce("license_id", "_named_id").alias("license_id"))


def scan_sql(licenses: dict[str, str] | None = None) -> str:
    """DuckDB SQL for scan() of documents, with LICENSES alone; it knows none of the other forms()."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(text: str) -> str:
        out = f"translate(coalesce({text}, ''), '{A_Z}{PUNCTUATION}', '{a_z}{' ' * len(PUNCTUATION)}')"
        out = f"regexp_replace({out}, {quote(COPYRIGHT_LINE)}, chr(10), 'g')"
        out = f"' ' || regexp_replace({out}, {quote(r'[\x00-\x2F\x3A-\x60\x7B-\x7F©]+')}, ' ', 'g') || ' '"
        for old, new in SPELLINGS:
            out = f"replace({out}, {quote(old)}, {quote(new)})"
        return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"

    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted((licenses or LICENSES).items()))
    return f"""WITH known AS (SELECT sha256({form('body')}) AS digest, min(license_id) AS license_id FROM (VALUES {rows}) t(license_id, body) GROUP BY 1),
forms AS (SELECT doc_id, {form('text')} AS form FROM documents)
SELECT doc_id, sha256(form) AS digest, CAST(length(form) AS BIGINT) AS canonical_chars, CASE WHEN form <> '' THEN license_id END AS license_id
FROM forms LEFT JOIN known ON sha256(form) = digest"""
