"""License scans: canonical digest lookup.

A text is made canonical line by line: A-Z in lower case, copyright lines dropped, punctuation and blanks made
single blanks, equivalent spellings made one. The whole text's canonical form is that of its lines joined, however it is
wrapped; its SHA-256 is hash-joined to a table of known licence digests: fixed ones, short texts made canonical by the
same functions, and any table that is passed in. Each line is looked up likewise as a text of its own, as short notices
are whole lines.

A copyright line begins with the sign, with (c) before a year, or with the word before (c), a year or, in a line of five
words at most, a name; one that goes on with notice, holder, owner and the like is a licence's own sentence and stays.

Defined results: null and empty texts have the digest of nothing and no licence; repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spellings that licence matching treats as equal, as whole words after punctuation is gone.
EQUIVALENT = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("organisation", "organization"), ("organisations", "organizations"), ("favour", "favor"), ("favourable", "favorable"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("recognised", "recognized"), ("behaviour", "behavior"),
    ("merchantibility", "merchantability"), ("noninfringement", "non infringement"), ("https", "http"), ("v", "version"),
]
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
#: Known licences and notices.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
]


#: Digests of the canonical full texts of common licences.
DIGESTS = [
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-3-Clause", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
    ("CC0-1.0", "0c3e4ca5ed7ced6289d3f5d9a83e4100f9f34d87983b17dc5865376a8a0a98f3"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "9672a697b80e59f5b1b0201e64d65dee8762b193cdd934dc5bcf2b57350a2ead"),
]

_NAMED = "^copyright (c |c$|[0-9]{4}|years? )|^copyright( [^ ]+){1,4}$"
#: Words behind "copyright" that make it part of a sentence.
_SENTENCE = "^copyright (notices?|holders?|owners?|licenses?|laws?|disclaimer|statements?|interest|and|as|by|for|from|in|is|may|of|on|or|permission|protection|status|that|the|to|treaty|you)( |$)"
_MARK = "^[ \\t]*(©|[(]c[)][ \\t]*[0-9]{4})"


def canonical_line(line: Column) -> Column:
    low = F.translate(line, _UPPER, _LOWER)
    words = F.concat(F.lit(" "), F.regexp_replace(low, "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", "  "), F.lit(" "))
    for a, b in EQUIVALENT:
        words = F.replace(words, F.lit(f" {a} "), F.lit(f" {b} "))
    tidy = F.trim(F.regexp_replace(words, " +", " "))
    named = tidy.startswith("copyright ") & tidy.rlike(_NAMED) & ~tidy.rlike(_SENTENCE)
    return F.when(named | low.rlike(_MARK), "").otherwise(tidy)


def canonical_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line), lambda x: x != "")


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license) of the built-in texts and digests: fixed, and so small enough to broadcast at any corpus size."""
    known = spark.createDataFrame(KNOWN, "license string, text string")
    short = known.select(F.sha2(F.array_join(canonical_lines(F.col("text")), " "), 256).alias("digest"), "license")
    return short.union(spark.createDataFrame([(d, n) for n, d in DIGESTS], "digest string, license string")).distinct()


def digests_of(texts: DataFrame) -> DataFrame:
    """(digest, license) of a table of licence texts (license, text), to pass in."""
    return texts.select(F.sha2(F.array_join(canonical_lines(F.col("text")), " "), 256).alias("digest"), "license")


def license_scan(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """doc_id, digest (of the canonical text), license (of the whole text, or null), notices (licences of whole lines, by name).

    more: further (digest, license) rows, of any size; of several licences with one digest the first name counts.
    """
    known = known_digests(docs.sparkSession)
    lookup = known.collect()
    names = F.create_map(*(F.lit(x) for r in lookup for x in (r.digest, r.license)))
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("_lines"))
    digests = lines.select(
        "doc_id",
        F.sha2(F.array_join("_lines", " "), 256).alias("digest"),
        F.array_intersect(F.transform("_lines", lambda x: F.sha2(x, 256)), F.array(*(F.lit(r.digest) for r in lookup))).alias("_hits"),
    )
    notices = F.array_join(F.array_sort(F.array_distinct(F.transform("_hits", lambda d: names[d]))), ",")
    table = F.broadcast(known) if more is None else known.unionByName(more.select("digest", "license")).groupBy("digest").agg(F.min("license").alias("license"))
    return digests.join(table, "digest", "left").select("doc_id", "digest", "license", notices.alias("notices"))


def oracle_sql() -> str:
    """The same query in DuckDB SQL."""

    def canonical(x: str) -> str:
        words = f"' ' || regexp_replace(translate({x}, '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', '  ', 'g') || ' '"
        for a, b in EQUIVALENT:
            words = f"replace({words}, ' {a} ', ' {b} ')"
        tidy = f"trim(regexp_replace({words}, ' +', ' ', 'g'), ' ')"
        low = f"translate({x}, '{_UPPER}', '{_LOWER}')"
        return f"case when (regexp_matches({tidy}, '{_NAMED}') and not regexp_matches({tidy}, '{_SENTENCE}')) or regexp_matches({low}, '{_MARK}') then '' else {tidy} end"

    def lines(text: str) -> str:
        return f"list_filter(list_transform(string_split(coalesce({text}, ''), chr(10)), lambda x: {canonical('x')}), lambda x: x <> '')"

    known = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    fixed = ", ".join(f"('{n}', '{d}')" for n, d in DIGESTS)
    return (
        f"with k as (select distinct sha256(array_to_string({lines('t')}, ' ')) as digest, n as license from (values {known}) v(n, t) union select d, n from (values {fixed}) w(n, d)), "
        f"d as (select doc_id, {lines('text')} as ls from documents), "
        "s as (select doc_id, sha256(array_to_string(ls, ' ')) as digest, list_transform(ls, lambda x: sha256(x)) as hs from d), "
        "h as (select doc_id, string_agg(distinct license, ',' order by license) as notices from (select doc_id, unnest(hs) as digest from s) join k using (digest) group by doc_id) "
        "select doc_id, s.digest as digest, license, coalesce(notices, '') as notices from s left join k using (digest) left join h using (doc_id)"
    )
