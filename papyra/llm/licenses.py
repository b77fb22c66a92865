"""License scans: whole texts in canonical form are looked up by digest among known licence texts.

Canonical form: lower case, copyright notices gone, runs of anything but letters
and digits a single space, and one spelling of each word that licences spell
in several ways. Two texts that differ in no more than that have one digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import text_or_empty

#: Spellings that count as equal (fixed values): what is written, what it is taken for.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)
#: Further ones, of one or two words.
MORE_SPELLINGS = (("sub  license", "sublicense"), ("copyright  owner", "copyright  holder"), ("copyright  owners", "copyright  holders"))

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Known texts (fixed values) by identifier: several texts of one licence are several rows.
KNOWN = (
    ("MIT", f"MIT License\n\n{_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_WARRANTY}"),
    ("MIT", f"{_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_WARRANTY}"),
    ("MIT-0", f"MIT No Attribution\n\n{_GRANT}.\n\n{_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}1. {_BSD_1}2. {_BSD_2}{_BSD_TAIL}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_HEAD}1. {_BSD_1}2. {_BSD_2}{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}1. {_BSD_1}2. {_BSD_2}3. {_BSD_3}{_BSD_TAIL}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_HEAD}1. {_BSD_1}2. {_BSD_2}3. {_BSD_3}{_BSD_TAIL}"),
    ("ISC", f"ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC}"),
    ("0BSD", f"BSD Zero Clause License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC}"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
)
_MIT, _BSD2, _BSD3, _ISC_TEXT, _0BSD = (KNOWN[i][1] for i in (1, 3, 5, 7, 8))
#: Further known texts: other titles, or none.
MORE_KNOWN = (
    *(("MIT", f"{title}\n\n{_MIT}") for title in ("The MIT License", "The MIT License (MIT)", "MIT License (MIT)")),
    *(("BSD-2-Clause", f"{title}\n\n{_BSD2}") for title in ("The 2-Clause BSD License", "The BSD 2-Clause License", "Simplified BSD License")),
    *(("BSD-3-Clause", f"{title}\n\n{_BSD3}") for title in ("The 3-Clause BSD License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License")),
    ("ISC", _ISC_TEXT.removeprefix("ISC License\n\n")), ("ISC", f"The {_ISC_TEXT}"),
    ("0BSD", _0BSD.removeprefix("BSD Zero Clause License\n\n")),
)
#: Digests of whole texts as they are handed out (fixed values); they hold for this canonical form, and change with it.
DIGESTS = (
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3-only", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0-only", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0-only", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "7225b0001bd95a632194e617575add06ce2e69da0b6dac31dc9a4943dda300eb"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("Unlicense", "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd"),
)

#: What follows "copyright" or "(c)" in the wording of licences, so that a line that begins so is no notice (fixed values).
WORDING = ("also", "and", "are", "disclaimer", "doctrines?", "for", "holders?", "if", "interests?", "laws?", "licen[cs]e[ds]?", "like", "line", "notices?", "of", "on", "or", "owner(?:s|ship)?", "patents?", "permissions?", "representations", "resulting", "statements?", "the (?:software|library|program|work)", "those", "treat(?:y|ies)", "under", "you")
#: Words of clauses, which no notice has (fixed values): a line with one of them stays, so that a condition beside a name, a year or a sign is part of the text.
CLAUSE = ("agree[sd]?", "allowed", "any", "appl(?:y|ies)", "are", "assign(?:s|ed|ment)?", "be", "becomes?", "belongs?", "cannot", "charges?", "consent", "doll?ars?", "euros?", "everyone", "except", "fees?", "forbidden", "goes", "granted", "ha[sd]", "have", "if", "is", "lasts?", "liable", "licen[cs]ees?", "licen[cs]ors?", "licen[cs]ed", "may not", "means?", "month", "must", "not", "nothing", "only", "owes?", "paid", "pays?", "payments?", "permi(?:ssion|tted)", "prohibited", "provided", "remains?", "require[sd]?", "reverts?", "royalt(?:y|ies)", "shall", "should", "subject", "sued?", "terminates?", "terms", "to", "transfer(?:s|red)?", "unless", "upon", "us", "use[sd]?", "vests?", "void", "waives?", "we", "when", "who", "will", "without", "you", "yours?")
_NONE = r"[^\p{L}\p{N}]"
#: Of a notice, after comment marks if there are any: "copyright", its sign, (c), in any order.
_HEAD = rf"^(?:\(c\)|&copy;|©|copyrights?|{_NONE})*"
_GLUED = r"copyrights?$"
_DATED = r"^(?:(?:19|20)[0-9]{2}(?:[^0-9]|$)|(?:yyyy|years?)(?:[^\p{L}\p{N}]|$))"
_SIGNED = r"©|&copy;|copyright"
#: A name has so many words at most, "all rights reserved" aside.
_NAME = r"^[\p{L}\p{N}]+(?:" + _NONE + r"+[\p{L}\p{N}]+){0,7}" + _NONE + "*$"
_WORDED = rf"^(?:{'|'.join(('the$', *WORDING))})(?:{_NONE}|$)"
_CLAUSED = rf"(?:^|{_NONE})(?:{'|'.join(CLAUSE)})(?:{_NONE}|$)"
_MARKED = r"copyright|©|&copy;|\(c\)"
_RESERVED = r"all rights reserved(?:\.|[^\p{L}\p{N}\n]*(?:\n|$))"
_OTHER = r"[^\p{L}\p{N}]+"


def _notice(line: Column) -> Column:
    """Whether a lower-cased line is a copyright notice: after "copyright" or its signs a year, a place for one, or a name, which does not follow (c) alone; and no word of a clause."""
    head = F.regexp_extract(line, _HEAD, 0)
    rest = F.substring(line, F.length(head) + 1, F.length(line))
    glued = head.rlike(_GLUED) & rest.rlike(r"^\p{L}")
    dated = rest.rlike(_DATED) | head.contains("__")
    named = head.rlike(_SIGNED) & F.regexp_replace(rest, _RESERVED, "").rlike(_NAME) & ~rest.rlike(_WORDED)
    return head.rlike(_MARKED) & ~glued & (dated | named) & ~line.rlike(_CLAUSED)


def canonical(text: Column) -> Column:
    """Canonical form; empty for null and for texts of copyright notices only. "All rights reserved" goes where it is a sentence or ends a line."""
    low = F.lower(F.coalesce(text, F.lit("")))
    kept = F.array_join(F.filter(F.split(low, "\n"), lambda line: ~(line.rlike(_MARKED) & _notice(line))), "\n")
    bare = F.regexp_replace(F.regexp_replace(F.when(low.rlike(_MARKED), kept).otherwise(low), _RESERVED, "\n"), _OTHER, "  ")
    spelled = F.concat(F.lit(" "), bare, F.lit(" "))
    for written, taken in (*SPELLINGS, *MORE_SPELLINGS):
        spelled = F.replace(spelled, F.lit(f" {written} "), F.lit(f" {taken} "))
    return F.regexp_replace(F.trim(spelled), " +", " ")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", known=(*KNOWN, *MORE_KNOWN), digests=DIGESTS) -> DataFrame:
    """One row per row of df: key, digest, license (null where the whole text is no known one).

    Null texts count as empty, whose digest no licence has. Equal digests in
    known and digests with different identifiers give the alphabetically first. Repeated
    rows stay, an empty table gives an empty one, further columns are not read.
    The known digests, as many as both have entries, are broadcast.
    """
    spark = df.sparkSession
    names = spark.createDataFrame([*known], "license string, __known string").select("license", digest(F.col("__known")).alias("digest"))
    if digests:
        names = names.unionByName(spark.createDataFrame([*digests], "license string, digest string"))
    names = names.groupBy("digest").agg(F.min("license").alias("license"))
    own = df.select(key, digest(text_or_empty(text)).alias("digest"))
    return own.join(F.broadcast(names), "digest", "left").select(key, "digest", "license")


def sql(known=(*KNOWN, *MORE_KNOWN), digests=DIGESTS) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    head = f"regexp_extract(l, {quote(_HEAD)})"
    rest = f"substr(l, length({head}) + 1)"
    has = lambda x, pattern: f"regexp_matches({x}, {quote(pattern)})"
    notice = f"""{has(head, _MARKED)} AND NOT ({has(head, _GLUED)} AND {has(rest, r'^\p{L}')}) AND NOT {has('l', _CLAUSED)}
      AND ({has(rest, _DATED)} OR contains({head}, '__') OR ({has(head, _SIGNED)} AND {has(f"regexp_replace({rest}, {quote(_RESERVED)}, '', 'g')", _NAME)} AND NOT {has(rest, _WORDED)}))"""

    def form(column: str) -> str:
        lines = f"list_filter(string_split(lower(coalesce({column}, '')), chr(10)), lambda l: NOT ({notice}))"
        x = f"' ' || regexp_replace(regexp_replace(array_to_string({lines}, chr(10)), {quote(_RESERVED)}, chr(10), 'g'), {quote(_OTHER)}, '  ', 'g') || ' '"
        for written, taken in (*SPELLINGS, *MORE_SPELLINGS):
            x = f"replace({x}, ' {written} ', ' {taken} ')"
        return f"sha256(regexp_replace(trim({x}), ' +', ' ', 'g'))"

    rows = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in known)
    whole = ", ".join(f"({quote(name)}, {quote(digest)})" for name, digest in digests)
    return f"""
WITH known AS (SELECT digest, min(license) AS license FROM (
  SELECT license, {form('body')} AS digest FROM (VALUES {rows}) AS t(license, body) UNION ALL SELECT * FROM (VALUES {whole}) AS u(license, digest)) GROUP BY digest),
own AS (SELECT doc_id, {form('text')} AS digest FROM documents)
SELECT doc_id, own.digest AS digest, license FROM own LEFT JOIN known ON own.digest = known.digest"""
