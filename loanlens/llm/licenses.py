"""License scans: ordered signature rules, in DataFrame functions only.

Two kinds of evidence are looked for in every whole text:

* *phrases* (label, words): every place where the words stand consecutively in
  the text's word sequence, whatever separates them;
* *rules* (label, priority, keywords, regular expression): license names,
  identifiers, addresses and notice wording. A rule runs only on texts that
  contain all its keywords (plain substring searches on the lower-cased text;
  no keyword has white space, so layout cannot hide one), so most texts run
  none.

Overlapping detections of rules are resolved by priority and containment: a
detection goes if its interval lies inside one of higher priority, or of equal
priority and greater length (or the same interval and an earlier rule), or if
it contains one of higher priority. Detections that overlap only in part both
stay. Phrases are never suppressed.

Letters A-Z are compared without case; no other letter is folded. Words are
runs of ASCII letters and digits and non-ASCII characters.

Edge cases: a null text counts as empty: no words, no places, no labels,
score 0; repeated rows get equal results; null ids pass; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[0-9A-Za-z\u0080-\U0010ffff]"
GAP = "[^0-9A-Za-z\u0080-\U0010ffff]"

#: fixed phrases and labels
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
PHRASE_SCORE = 0.8
#: how sure a detection of each priority is
SCORES = {1: 0.4, 2: 0.7, 3: 0.9, 4: 1.0}


def _name(text: str) -> str:
    """Words with any layout between them, comment marks included."""
    return r"(?<![A-Za-z0-9])" + r"[\s*#/;>\"'-]{1,20}".join(text.split())


def _version(number: str) -> str:
    """'version 2', 'v2.0', '2.0', ', Version 2' right after a name."""
    whole = number.removesuffix(".0")
    digits = re.escape(whole) + (r"(?:\.0)?" if whole != number else "")
    return r"[\s,(-]{0,4}(?:version|ver\.?|v\.?)?\s{0,3}" + digits + r"(?![0-9]|\.[0-9])"


def _spdx(name: str) -> str:
    return r"spdx-license-identifier:\s{0,8}\(?" + re.escape(name) + r"(?![A-Za-z0-9.+-])"


END = r"(?![A-Za-z0-9])"

# ---- license names: (label, keyword, wording, versions) ---------------------
_VERSIONED = [
    ("gpl", "general public", r"general public licen[sc]e", ["1.0", "2.0", "3.0"]),
    ("lgpl", "lesser general", r"lesser general public licen[sc]e", ["2.1", "3.0"]),
    ("lgpl", "library general", r"library general public licen[sc]e", ["2.0"]),
    ("agpl", "affero", r"affero general public licen[sc]e", ["1.0", "3.0"]),
    ("gfdl", "free documentation", r"free documentation licen[sc]e", ["1.1", "1.2", "1.3"]),
    ("apache", "apache", r"apache (?:software )?licen[sc]e", ["1.0", "1.1", "2.0"]),
    ("mpl", "mozilla public", r"mozilla public licen[sc]e", ["1.0", "1.1", "2.0"]),
    ("epl", "eclipse public", r"eclipse public licen[sc]e", ["1.0", "2.0"]),
    ("cpl", "common public", r"common public licen[sc]e", ["1.0"]),
    ("cddl", "common development", r"common development and distribution licen[sc]e", ["1.0", "1.1"]),
    ("eupl", "european union public", r"european union public licen[sc]e", ["1.0", "1.1", "1.2"]),
    ("osl", "open software", r"open software licen[sc]e", ["1.0", "2.0", "2.1", "3.0"]),
    ("afl", "academic free", r"academic free licen[sc]e", ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("artistic", "artistic", r"artistic licen[sc]e", ["1.0", "2.0"]),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e", ["1.0", "1.1"]),
    ("lppl", "project public", r"latex project public licen[sc]e", ["1.0", "1.2", "1.3"]),
    ("php", "php", r"php licen[sc]e", ["3.0", "3.01"]),
    ("bsl", "boost", r"boost software licen[sc]e", ["1.0"]),
    ("cecill", "cecill", r"cecill(?: free software)? licen[sc]e(?: agreement)?", ["1.0", "2.0", "2.1"]),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e", []),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e", []),
    ("mulan", "mulan", r"mulan permissive software licen[sc]e", ["1", "2"]),
    ("odbl", "open database", r"open (?:data commons open )?database licen[sc]e", ["1.0"]),
    ("odc-by", "open data commons", r"open data commons attribution licen[sc]e", ["1.0"]),
    ("pddl", "public domain dedication", r"public domain dedication (?:and|&) licen[sc]e", ["1.0"]),
    ("ogl", "open government", r"open government licen[sc]e", ["1.0", "2.0", "3.0"]),
    ("rpl", "reciprocal public", r"reciprocal public licen[sc]e", ["1.1", "1.5"]),
    ("qpl", "q public", r"q public licen[sc]e", ["1.0"]),
    ("zpl", "zope public", r"zope public licen[sc]e", ["1.1", "2.0", "2.1"]),
    ("npl", "netscape public", r"netscape public licen[sc]e", ["1.0", "1.1"]),
    ("ipl", "ibm public", r"ibm public licen[sc]e", ["1.0"]),
    ("spl", "sun public", r"sun public licen[sc]e", ["1.0"]),
    ("apsl", "apple public", r"apple public source licen[sc]e", ["1.0", "1.1", "2.0"]),
    ("ecl", "educational community", r"educational community licen[sc]e", ["1.0", "2.0"]),
    ("sspl", "server side", r"server side public licen[sc]e", ["1"]),
    ("busl", "business source", r"business source licen[sc]e", ["1.1"]),
    ("elastic", "elastic", r"elastic licen[sc]e", ["2.0"]),
    ("python", "python", r"python software foundation licen[sc]e", ["2"]),
    ("openrail", "openrail", r"(?:bigscience |creativeml )?(?:open ?rail)(?:-m)? licen[sc]e", []),
    ("free-art", "free art", r"free art licen[sc]e", ["1.2", "1.3"]),
]
# ---- licenses told by one wording: (label, keyword, wording) ----------------
_NAMED = [
    ("mit", "mit", r"mit(?:/x11| \(expat\))? licen[sc]e"),
    ("mit", "expat", r"expat licen[sc]e"),
    ("mit-0", "mit attribution", r"mit no attribution(?: licen[sc]e)?"),
    ("x11", "x11", r"x11 licen[sc]e"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("0bsd", "zero-clause", r"(?:bsd zero-clause|zero-clause bsd) licen[sc]e"),
    ("bsd-1-clause", "1-clause", r"(?:bsd 1-clause|1-clause bsd)(?: licen[sc]e)?"),
    ("bsd-2-clause", "2-clause", r"(?:bsd 2-clause|2-clause bsd)(?: licen[sc]e)?"),
    ("bsd-2-clause", "two-clause", r"(?:bsd two-clause|two-clause bsd)(?: licen[sc]e)?"),
    ("bsd-2-clause", "simplified bsd", r"simplified bsd(?: licen[sc]e)?"),
    ("bsd-2-clause", "freebsd", r"freebsd licen[sc]e"),
    ("bsd-3-clause", "3-clause", r"(?:bsd 3-clause|3-clause bsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", "three-clause", r"(?:bsd three-clause|three-clause bsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", "new bsd", r"new bsd licen[sc]e"),
    ("bsd-3-clause", "modified bsd", r"modified bsd licen[sc]e"),
    ("bsd-4-clause", "4-clause", r"(?:bsd 4-clause|4-clause bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", "original bsd", r"original bsd licen[sc]e"),
    ("bsd", "bsd", r"bsd(?:-style| style)? licen[sc]e"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e"),
    ("libpng", "libpng", r"libpng licen[sc]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public licen[sc]e"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("beerware", "beer", r"(?:the )?beer-?ware licen[sc]e"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa open source licen[sc]e"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("perl", "terms", r"same terms as perl(?: itself)?"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("curl", "curl", r"curl licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("vim", "vim", r"vim licen[sc]e"),
    ("tcl", "tcl", r"tcl/tk licen[sc]e"),
    ("sleepycat", "sleepycat", r"sleepycat (?:software )?licen[sc]e"),
    ("fair", "fair", r"fair licen[sc]e"),
    ("json", "evil", r"shall be used for good, not evil"),
    ("cc0", "cc0", r"cc0(?:[\s-]1\.0)?(?: universal)?"),
    ("cc-pdm", "public domain mark", r"public domain mark(?: 1\.0)?"),
    ("public-domain", "public domain", r"(?:dedicated|released|placed|committed) (?:in|in ?to) the public domain"),
    ("public-domain", "public domain", r"(?:is|are) (?:hereby )?in the public domain"),
    ("public-domain", "gemeinfrei", r"gemeinfrei"),
    ("public-domain", "domaine public", r"(?:dans le|du) domaine public"),
    ("public-domain", "dominio p", "de dominio público"),
]
# ---- Creative Commons: element codes and their names ------------------------
_CC = [
    ("cc-by-nc-nd", r"by-nc-nd", r"attribution[\s,-]+non-?commercial[\s,-]+no-?deriv(?:ative)?s(?: works)?"),
    ("cc-by-nc-sa", r"by-nc-sa", r"attribution[\s,-]+non-?commercial[\s,-]+share-? ?alike"),
    ("cc-by-nd", r"by-nd", r"attribution[\s,-]+no-?deriv(?:ative)?s(?: works)?"),
    ("cc-by-nc", r"by-nc", r"attribution[\s,-]+non-?commercial"),
    ("cc-by-sa", r"by-sa", r"attribution[\s,-]+share-? ?alike"),
    ("cc-by", r"by", r"attribution"),
]
_CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
# ---- addresses: (label, keyword, address) -----------------------------------
_ADDRESSES = [
    ("apache-2.0", "apache.org", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", "apache.org", r"apache\.org/licenses/license-1\.1"),
    ("gpl-2.0", "gnu.org", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "gnu.org", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl", "gnu.org", r"gnu\.org/licenses/gpl(?:\.html|\.txt)?"),
    ("lgpl-2.1", "gnu.org", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "gnu.org", r"gnu\.org/licenses/lgpl-3\.0"),
    ("agpl-3.0", "gnu.org", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl", "gnu.org", r"gnu\.org/licenses/fdl"),
    ("gnu", "gnu.org", r"gnu\.org/licenses"),
    ("mpl-2.0", "mozilla.org", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("mpl-1.1", "mozilla.org", r"mozilla\.org/mpl/mpl-1\.1"),
    ("epl-2.0", "eclipse.org", r"eclipse\.org/legal/epl-2\.0"),
    ("epl-1.0", "eclipse.org", r"eclipse\.org/legal/epl-v10"),
    ("mit", "opensource.org", r"opensource\.org/licenses?/mit"),
    ("bsd-2-clause", "opensource.org", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "opensource.org", r"opensource\.org/licenses?/bsd-3-clause"),
    ("bsd", "opensource.org", r"opensource\.org/licenses?/bsd-license"),
    ("isc", "opensource.org", r"opensource\.org/licenses?/isc"),
    ("osl-3.0", "opensource.org", r"opensource\.org/licenses?/osl-3\.0"),
    ("bsl-1.0", "boost.org", r"boost\.org/license_1_0"),
    ("unlicense", "unlicense.org", r"unlicense\.org"),
    ("wtfpl", "wtfpl.net", r"wtfpl\.net"),
    ("ofl-1.1", "scripts.sil.org", r"scripts\.sil\.org/ofl"),
    ("odbl-1.0", "opendatacommons", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", "opendatacommons", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", "opendatacommons", r"opendatacommons\.org/licenses/pddl"),
    ("cc0", "creativecommons", r"creativecommons\.org/publicdomain/zero"),
    ("cc-pdm", "creativecommons", r"creativecommons\.org/publicdomain/mark"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nd", "creativecommons", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-nc", "creativecommons", r"creativecommons\.org/licenses/by-nc"),
    ("cc-by-sa", "creativecommons", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by", "creativecommons", r"creativecommons\.org/licenses/by"),
    ("creative-commons", "creativecommons", r"creativecommons\.org"),
]
# ---- license texts and notices: (label, priority, keyword, wording) ---------
_NOTICES = [
    ("mit", 3, "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", 2, "warranty", r"the software is provided \"as is\", without warranty of any kind"),
    ("bsd", 2, "redistribution and use", r"redistribution and use in source and binary forms, with or without modification"),
    ("bsd-3-clause", 3, "endorse or promote", r"may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 3, "advertising materials", r"all advertising materials mentioning features or use of this software"),
    ("isc", 3, "distribute", r"permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("zlib", 3, "express or implied", r"provided 'as-is', without any express or implied warranty"),
    ("apache-2.0", 3, "apache", r"licensed under the apache licen[sc]e, version 2\.0"),
    ("apache", 3, "apache", r"licensed to the apache software foundation"),
    ("gpl", 3, "free software", r"this program is free software[;:,] you can redistribute it"),
    ("lgpl", 3, "free software", r"this library is free software[;:,] you can redistribute it"),
    ("gpl", 2, "free software foundation", r"published by the free software foundation"),
    ("gnu", 2, "copying", r"see the file copying for (?:more )?details"),
    ("mpl-2.0", 3, "source code form", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("epl", 3, "accompanying materials", r"this program and the accompanying materials are made available"),
    ("unlicense", 3, "unencumbered", r"free and unencumbered software released into the public domain"),
    ("bsl-1.0", 3, "license_1_0", r"accompanying file license_1_0\.txt"),
    ("beerware", 3, "beer", r"you can buy me a beer in return"),
    ("proprietary", 2, "proprietary", r"(?:proprietary|confidential) and (?:confidential|proprietary)"),
    ("proprietary", 2, "unauthori", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)"),
    ("proprietary", 2, "permission", r"may not be (?:reproduced|copied|distributed|republished)[a-z, ]{0,60}without permission"),
    ("proprietary", 2, "written", r"without the prior written (?:permission|consent)"),
    ("proprietary", 2, "strictly prohibited", r"(?:reproduction|copying|distribution|use) is strictly prohibited"),
    ("reserved", 2, "all rights reserved", r"all rights reserved"),
    ("reserved", 2, "some rights reserved", r"some rights reserved"),
    ("reserved", 2, "alle rechte", r"alle rechte vorbehalten"),
    ("reserved", 2, "tous droits", "tous droits réservés"),
    ("reserved", 2, "todos los derechos", r"todos los derechos reservados"),
    ("copyright", 1, "copyright", r"copyright(?:\s{1,3}(?:\(c\)|©))?\s{1,3}(?:19|20)[0-9]{2}(?:\s?[-,]\s?(?:19|20)[0-9]{2}){0,8}"),
    ("copyright", 1, "©", "©\\s{0,3}(?:19|20)[0-9]{2}"),
    ("copyright", 1, "(c)", r"\(c\)\s{0,3}(?:19|20)[0-9]{2}"),
    ("notice", 1, "licensed under", r"licensed under (?:the )?(?:[a-z0-9.+-]{1,30}[ ,]{1,2}){1,6}licen[sc]e"),
    ("notice", 1, "released under", r"released under (?:the )?(?:[a-z0-9.+-]{1,30}[ ,]{1,2}){1,6}licen[sc]e"),
    ("notice", 1, "distributed under", r"distributed under (?:the )?(?:[a-z0-9.+-]{1,30}[ ,]{1,2}){1,6}licen[sc]e"),
    ("notice", 1, "available under", r"available under (?:the )?(?:[a-z0-9.+-]{1,30}[ ,]{1,2}){1,6}licen[sc]e"),
    ("notice", 1, "terms of the", r"under the terms of the (?:[a-z0-9.+-]{1,30}[ ,]{1,2}){1,6}licen[sc]e"),
    ("notice", 1, "lizenz", r"(?:unter|gemäß) der (?:[a-z0-9.+-]{1,30}[ -]){0,4}lizenz"),
    ("notice", 1, "licence", r"sous (?:la )?licence [a-z0-9.+-]{1,30}"),
    ("notice", 1, "licencia", r"bajo (?:la )?licencia [a-z0-9.+-]{1,30}"),
]
# ---- identifiers that may follow "SPDX-License-Identifier:" -----------------
_SPDX = """0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-1-Clause
BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0
CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1
CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only
GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later GPL-2.0 GPL-2.0+ GPL-3.0 GPL-3.0+ ISC LGPL-2.0-only
LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0
MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OSL-3.0 OpenSSL PHP-3.01 PSF-2.0 PostgreSQL QPL-1.0 Ruby SSPL-1.0
Unlicense Vim WTFPL X11 ZPL-2.1 Zlib curl libpng-2.0""".split()


def rules() -> list[tuple[str, int, tuple[str, ...], str]]:
    """(label, priority, keywords, regular expression), in order."""
    out = []
    for name in _SPDX:
        out.append((name.lower(), 4, "spdx-license-identifier", _spdx(name)))
    for label, keyword, address in _ADDRESSES:
        out.append((label, 4 if label not in ("gnu", "creative-commons") else 1, keyword, address))
    for code, short, long in _CC:
        for v in _CC_VERSIONS:
            out.append((f"{code}-{v}", 3, "cc", r"(?<![A-Za-z0-9])cc[\s-]" + short.replace("-", r"[\s-]") + _version(v)))
            out.append((f"{code}-{v}", 3, "attribution", _name("(?:creative commons )?") .removesuffix(" ")
                        + long + r"(?: (?:international|unported|generic))?" + r"[\s,-]{0,3}" + _version(v)))
        out.append((code, 2, "cc", r"(?<![A-Za-z0-9])cc[\s-]" + short.replace("-", r"[\s-]") + END))
        out.append((code, 2, "creative commons", r"(?<![A-Za-z0-9])creative commons[\s:,-]+" + long))
    out.append(("creative-commons", 1, "creative commons", _name("creative commons") + r"(?:[\s-]+licen[sc]e)?" + END))
    for label, keyword, wording, versions in _VERSIONED:
        for v in versions:
            out.append((f"{label}-{v}", 3, keyword, _name(wording) + _version(v)))
            out.append((f"{label}-{v}-or-later", 3, keyword, _name(wording) + _version(v)
                        + r"[\s,]{0,6}(?:of the license,?\s{0,3})?\(?(?:or )?\(?(?:at your option\)? )?any later(?: version)?"))
        out.append((label, 2, keyword, _name(wording) + END))
    for label, keyword, wording in _NAMED:
        out.append((label, 2, keyword, _name(wording) + END))
    for label, priority, keyword, wording in _NOTICES:
        out.append((label, priority, keyword, wording if "{" in wording or "(" in wording else _name(wording)))
    return [(label, priority, _keywords(keyword, pattern), pattern) for label, priority, keyword, pattern in out]


#: the keyword most rules share: looked for first, the others of its rules only where it stands
SHARED = "licen"


def _keywords(keyword: str, pattern: str) -> tuple[str, ...]:
    """The longest word of a keyword, and SHARED where the pattern cannot do without."""
    need = pattern.replace("(?: licen[sc]e)?", "").replace(r"(?:[\s-]+licen[sc]e)?", "")
    need = need.replace(r"[\s*#/;>\"'-]{1,20}licen[sc]e)?", "")
    return tuple(sorted({max(keyword.split(), key=len), *([SHARED] if SHARED in need else [])}))


RULES = rules()


def phrase_pattern(phrase: str) -> str:
    """Finds the first word of every place of a phrase."""
    first, *more = [re.escape(w) for w in phrase.split()]
    ahead = "".join(f"{GAP}+{w}" for w in more) + f"(?!{WORD})"
    return f"(?i)(?<!{WORD}){first}(?={ahead})" if more else f"(?i)(?<!{WORD}){first}(?!{WORD})"


def count_words(text: Column) -> Column:
    """Words of a text: every word with what separates it from the next becomes
    one character."""
    body = F.regexp_replace(text, f"^{GAP}++", "")
    return F.length(F.regexp_replace(body, f"{WORD}++{GAP}*+", "x")).cast("bigint")


def _places(text: Column, label: str, phrase: str) -> Column:
    """array of (label, word): every place of a phrase, in order."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"),
                     F.expr("cast(array() as array<struct<label:string,word:bigint>>)").alias("out"))

    def step(acc, piece):
        at = acc["at"] + count_words(piece)
        place = F.struct(F.lit(label).alias("label"), at.alias("word"))
        return F.struct((at + 1).alias("at"), F.concat(acc["out"], F.array(place)).alias("out"))

    parts = F.split(text, phrase_pattern(phrase), -1)
    return F.aggregate(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), start, step, lambda acc: acc["out"])


SPAN = "struct<s:int,back:int,rank:int,rule:int,label:string,priority:int,e:int>"


def _spans(text: Column, rule: Column) -> Column:
    """Intervals of a rule's matches, sortable: start, longest first, priority,
    rule order."""
    pattern = F.concat(F.lit("(?i)"), rule["pattern"])
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out"))

    def step(acc, x):
        s = acc["at"] + F.length(x["before"])
        e = s + F.length(x["found"])
        span = F.struct(s.alias("s"), (-e).alias("back"), (-rule["priority"]).alias("rank"), rule["rule"].alias("rule"),
                        rule["label"].alias("label"), rule["priority"].alias("priority"), e.alias("e"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    before = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(before, F.lit(1), F.greatest(F.size(found), F.lit(0))),
                       lambda m, b: F.struct(m.alias("found"), b.alias("before")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def suppress(spans: Column, levels: int = 4) -> Column:
    """Sorted spans without the contained and outranked ones: two sweeps that
    remember, per priority, how far the spans seen so far reach."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def sweep(order, edge, key, beats, better):
        start = F.struct(F.array(*[F.lit(edge) for _ in range(levels)]).alias("reach"), none.alias("out"))

        def step(acc, x):
            held = F.get(acc["reach"], x["priority"] - 1)
            # the remembered edge counts for every level the span outranks (or equals)
            reach = F.transform(acc["reach"], lambda r, i: F.when(better(x["priority"], i + 1), key(r, x["e"])).otherwise(r))
            out = F.when(beats(held, x["e"]), acc["out"]).otherwise(F.concat(acc["out"], F.array(x)))
            return F.struct(reach.alias("reach"), out.alias("out"))

        return F.aggregate(order, start, step, lambda acc: acc["out"])

    # inside one of at least equal priority that begins before it (or is sorted before it)
    outer = sweep(F.array_sort(spans), -1, F.greatest, lambda held, e: held >= e, lambda p, level: p >= level)
    # around one of higher priority
    big = 2**31 - 1
    inner = sweep(F.reverse(outer), big, F.least, lambda held, e: held <= e, lambda p, level: p > level)
    return F.reverse(inner)


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _table(signatures) -> Column:
    """The rules as one array, from one literal."""
    kind = "array<struct<rule:int,label:string,priority:int,keywords:array<string>,pattern:string>>"
    rows = [{"rule": i, "label": label, "priority": priority, "keywords": list(keys), "pattern": pattern}
            for i, (label, priority, keys, pattern) in enumerate(signatures)]
    return F.from_json(F.lit(json.dumps(rows)), kind)


def scan(docs: DataFrame, phrases=PHRASES, signatures=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places (label, word), detections (label, s, e: character
    interval, found), base_labels, labels (sorted arrays), score: one row per
    row of ``docs``, in one narrow pass."""
    signatures = RULES if signatures is None else signatures
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    early = {w for _, p in phrases for w in p.split()} | {k for _, _, keys, _ in signatures if SHARED not in keys for k in keys}
    late = {k for _, _, keys, _ in signatures for k in keys} - early
    # a lambda variable holds the lower-cased text, so that it is made once and not per keyword
    held = F.transform(F.array(F.lower("text")), lambda low: F.concat(
        F.filter(_strings(sorted(early)), lambda k: F.contains(low, k)),
        F.when(F.contains(low, F.lit(SHARED)), F.filter(_strings(sorted(late)), lambda k: F.contains(low, k)))
        .otherwise(_strings([]))))[0]
    rows = rows.select("doc_id", "text", held.alias("held"), count_words(F.col("text")).alias("n_words"))
    no_places = F.expr("cast(array() as array<struct<label:string,word:bigint>>)")
    places = F.concat(no_places, *[
        F.when(F.size(F.array_except(_strings(p.split()), F.col("held"))) == 0, _places(F.col("text"), label, p))
        .otherwise(no_places) for label, p in phrases])
    able = F.filter(_table(signatures), lambda r: F.forall(r["keywords"], lambda k: F.array_contains(F.col("held"), k)))
    spans = F.flatten(F.transform(able, lambda r: _spans(F.col("text"), r)))
    some = F.size("held") > 0
    rows = rows.select("doc_id", "text", "n_words", F.when(some, places).otherwise(no_places).alias("places"),
                       F.when(some, spans).otherwise(F.expr(f"cast(array() as array<{SPAN}>)")).alias("spans"))
    rows = rows.withColumn("kept", F.when(F.size("spans") > 1, suppress(F.col("spans"))).otherwise(F.col("spans")))
    base = F.transform("places", lambda p: p["label"])
    sure = F.coalesce(F.array_max(F.transform("kept", lambda d: F.element_at(
        F.create_map(*[F.lit(x) for pair in SCORES.items() for x in pair]), d["priority"]))), F.lit(0.0))
    detections = F.transform("kept", lambda d: F.struct(
        d["label"].alias("label"), d["s"].alias("s"), d["e"].alias("e"),
        F.substring(F.col("text"), d["s"] + 1, d["e"] - d["s"]).alias("found")))
    return rows.select(
        "doc_id", "n_words", "places", detections.alias("detections"),
        F.array_sort(F.array_distinct(base)).alias("base_labels"),
        F.array_sort(F.array_union(base, F.transform("kept", lambda d: d["label"]))).alias("labels"),
        F.greatest(sure, F.when(F.size("places") > 0, PHRASE_SCORE).otherwise(0.0)).alias("score"))


def op13_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scan(docs)
    words = F.transform("places", lambda p: p["word"])
    return out.select("doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
                      F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
                      F.array_join("base_labels", ",").alias("base_labels"),
                      F.array_join("labels", ",").alias("labels"), "score")
