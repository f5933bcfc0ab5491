"""Licence scan: normalised sentences to identifiers of known licence sentences, identifier sequences to licences by ordered rules."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_text_batches, table

#: Sentences as they stand in the licences' public texts, normalised (letters and digits, lower case, single blanks), by identifier.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit-title": ("mit license", "the mit license", "the mit license mit"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit-notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    "mit-warranty": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "mit-liability": ("in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",),
    "bsd-title": ("bsd 2 clause license", "bsd 3 clause license", "the bsd license", "bsd license", "the 2 clause bsd license", "the 3 clause bsd license", "new bsd license", "simplified bsd license"),
    "bsd-grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd-source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd-binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd-advert": ("all advertising materials mentioning features or use of this software must display the following acknowledgement",),
    "bsd-endorse": tuple(
        f"neither the name of {owner} nor the names of {its} contributors may be used to endorse or promote products derived from this software without specific prior written permission"
        for owner in ("the copyright holder", "the copyright holders", "the copyright owner", "the author", "the company", "the organization", "the university", "the project", "the foundation")
        for its in ("its", "their", "any")
    ),
    "bsd-warranty": tuple(
        f"this software is provided by the {who} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
        for who in ("copyright holders and contributors", "copyright holder and contributors", "author and contributors", "authors and contributors", "regents and contributors", "author", "authors")
    ),
    "bsd-liability": tuple(
        f"in no event shall the {who} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"
        for who in ("copyright holder or contributors", "copyright holders or contributors", "copyright owner or contributors", "author or contributors", "authors or contributors", "regents or contributors", "author", "authors")
    ),
    "isc-title": ("isc license", "the isc license"),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    "isc-warranty": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "isc-liability": ("in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",),
    "0bsd-grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "apache-title": ("apache license version 2 0 january 2004",),
    "apache-use": ("you may not use this file except in compliance with the license", "you may not use these files except in compliance with the license"),
    "apache-copy": ("you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    "apache-warranty": tuple(f"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind {e} express or implied" for e in ("either",)),
    "apache-limits": ("see the license for the specific language governing permissions and limitations under the license",),
    "gpl-free": ("this program is free software", "this library is free software", "this file is free software", "this software is free software"),
    "gpl-warranty": ("this program is distributed in the hope that it will be useful but without any warranty", "this library is distributed in the hope that it will be useful but without any warranty"),
    "gpl-implied": ("without even the implied warranty of merchantability or fitness for a particular purpose",),
    "gpl-details": tuple(f"see the gnu {kind}general public license for more details" for kind in ("", "lesser ", "affero ")),
    "gpl-copy": tuple(f"you should have received a copy of the gnu {kind}general public license along with this {what}" for kind in ("", "lesser ", "affero ") for what in ("program", "library", "file")),
    "gpl-verbatim": ("everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",),
    "gpl3-title": ("gnu general public license version 3 29 june 2007",),
    "gpl2-title": ("gnu general public license version 2 june 1991",),
    "lgpl3-title": ("gnu lesser general public license version 3 29 june 2007",),
    "lgpl21-title": ("gnu lesser general public license version 2 1 february 1999",),
    "agpl3-title": ("gnu affero general public license version 3 19 november 2007",),
    "mpl-title": ("mozilla public license version 2 0", "mozilla public license version 2 0 1 definitions"),
    "mpl-header": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "mpl-copy": ("if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    "epl-title": ("eclipse public license v 2 0",),
    "epl-header": tuple(f"this program and the accompanying materials are made available under the terms of the eclipse public license {v}2 0{at}" for v in ("", "v ") for at in ("", " which is available at", " which is available at http www eclipse org legal epl 2 0", " which is available at https www eclipse org legal epl 2 0", " which accompanies this distribution")),
    "bsl-title": ("boost software license version 1 0 august 17th 2003",),
    "bsl-grant": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",),
    "zlib-warranty": ("this software is provided as is without any express or implied warranty",),
    "zlib-liability": ("in no event will the authors be held liable for any damages arising from the use of this software",),
    "zlib-grant": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "zlib-origin": ("the origin of this software must not be misrepresented",),
    "zlib-altered": ("altered source versions must be plainly marked as such and must not be misrepresented as being the original software",),
    "zlib-notice": ("this notice may not be removed or altered from any source distribution",),
    "unlicense-free": ("this is free and unencumbered software released into the public domain",),
    "unlicense-grant": ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",),
    "unlicense-more": ("for more information please refer to http unlicense org", "for more information please refer to https unlicense org"),
    "cc0-title": ("cc0 1 0 universal", "creative commons legal code cc0 1 0 universal"),
    "cc0-waiver": ("to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "to the extent possible under law the author s has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    "wtfpl-title": ("do what the fuck you want to public license version 2 december 2004", "do what the fuck you want to public license"),
    "rights": ("all rights reserved",),
}
#: The licences' public short names, each with the names by which a statement calls it.
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0 license", "apache 2 0", "apache software license version 2 0"),
    "MIT": ("mit license", "mit licence", "mit open source license", "terms of the mit license"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"),
    "ISC": ("isc license",),
    "GPL-2.0-only": ("gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gplv2", "gpl v2", "gpl version 2", "gnu general public license v2 0"),
    "GPL-2.0-or-later": ("gnu general public license version 2 or later", "gnu general public license v2 or later", "gplv2 or later", "gnu general public license version 2 or any later version"),
    "GPL-3.0-only": ("gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gplv3", "gpl v3", "gpl version 3", "gnu general public license v3 0"),
    "GPL-3.0-or-later": ("gnu general public license version 3 or later", "gnu general public license v3 or later", "gplv3 or later", "gnu general public license version 3 or any later version"),
    "LGPL-2.1-only": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl version 2 1", "lgplv2 1"),
    "LGPL-3.0-only": ("gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lgpl version 3", "lgplv3"),
    "AGPL-3.0-only": ("gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl version 3", "agplv3"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0", "mpl 2 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v 2 0"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "Zlib": ("zlib license",),
    "Unlicense": ("unlicense",),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal license", "creative commons cc0 1 0 universal license"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 license", "cc by 4 0 license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 license", "cc by sa 4 0 license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0 license", "cc by nc 4 0 license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license", "cc by nd 4 0 license"),
}
#: A statement of a licence by its name, which is the only group.
STATEMENT = (
    r"^(?:(?:this (?:work|project|software|program|library|package|file|code|document|dataset|repository)|the code|it) is )?(?:licensed|released|distributed|available|published|made available|provided)"
    r" under (?:the terms of the |the |a )?(.+?)(?: the license)?$|^spdx license identifier (.+)$"
)
#: Ordered rules: (licence, identifiers); ``?`` and ``*`` as in patterns, ``|`` between alternatives. At each place of a document's sequence the first that fits is taken.
RULES: list[tuple[str, str]] = [
    ("Apache-2.0", "apache-title copyright|is-apache-2.0|apache-use|apache-copy|apache-warranty|apache-limits*"),
    ("Apache-2.0", "copyright|rights* is-apache-2.0 apache-use? apache-copy? apache-warranty? apache-limits?"),
    ("MIT", "mit-title? copyright|rights* mit-grant mit-notice? mit-warranty? mit-liability?"), ("MIT", "copyright|rights* is-mit"), ("MIT", "mit-title"),
    ("AGPL-3.0-only", "agpl3-title copyright|gpl-verbatim|gpl-free|agpl-3-later|gpl-warranty|gpl-implied|gpl-details|gpl-copy*"),
    ("LGPL-3.0-only", "lgpl3-title copyright|gpl-verbatim*"),
    ("LGPL-2.1-only", "lgpl21-title copyright|gpl-verbatim|gpl-free|lgpl-base|later-2.1|gpl-warranty|gpl-implied|gpl-details|gpl-copy*"),
    ("GPL-3.0-only", "gpl3-title copyright|gpl-verbatim|gpl-free|gpl-3-later|gpl-warranty|gpl-implied|gpl-details|gpl-copy*"),
    ("GPL-2.0-only", "gpl2-title copyright|gpl-verbatim|gpl-free|gpl-base|later-2|gpl-warranty|gpl-implied|gpl-details|gpl-copy*"),
    *[
        (f"{family}-{full}-or-later", f"copyright|rights* gpl-free? {way} gpl-warranty? gpl-implied? gpl-details? gpl-copy?")
        for family, full, ways in (
            ("AGPL", "3.0", ("agpl-3-later", "agpl-base later-3")), ("LGPL", "3.0", ("lgpl-3-later", "lgpl-base later-3")), ("LGPL", "2.1", ("lgpl-2.1-later", "lgpl-base later-2.1")),
            ("GPL", "3.0", ("gpl-3-later", "gpl-base later-3")), ("GPL", "2.0", ("gpl-2-later", "gpl-base later-2")),
        )
        for way in ways
    ],
    *[
        (f"{family}-{full}-only", f"copyright|rights* gpl-free? {key} gpl-warranty? gpl-implied? gpl-details? gpl-copy?")
        for family, full, key in (("AGPL", "3.0", "agpl-3-only"), ("LGPL", "3.0", "lgpl-3-only"), ("LGPL", "2.1", "lgpl-2.1-only"), ("GPL", "3.0", "gpl-3-only"), ("GPL", "2.0", "gpl-2-only"))
    ],
    ("BSD-4-Clause", "bsd-title? copyright|rights* bsd-grant bsd-source bsd-binary bsd-advert bsd-endorse? bsd-warranty? bsd-liability?"),
    ("BSD-3-Clause", "bsd-title? copyright|rights* bsd-grant bsd-source bsd-binary bsd-endorse bsd-warranty? bsd-liability?"),
    ("BSD-2-Clause", "bsd-title? copyright|rights* bsd-grant bsd-source bsd-binary bsd-warranty? bsd-liability?"),
    ("ISC", "isc-title? copyright|rights* isc-grant isc-warranty? isc-liability?"), ("0BSD", "copyright|rights* 0bsd-grant isc-warranty? isc-liability?"),
    ("MPL-2.0", "mpl-title mpl-header* mpl-copy*"), ("MPL-2.0", "copyright|rights* mpl-header mpl-copy?"), ("EPL-2.0", "copyright|rights* epl-title|epl-header"),
    ("BSL-1.0", "bsl-title? copyright|rights* bsl-grant"), ("BSL-1.0", "bsl-title"),
    ("Zlib", "copyright|rights* zlib-warranty? zlib-liability? zlib-grant zlib-origin? zlib-altered? zlib-notice?"),
    ("Unlicense", "unlicense-free unlicense-grant? mit-warranty? mit-liability? unlicense-more?"), ("CC0-1.0", "cc0-title|cc0-waiver"), ("WTFPL", "wtfpl-title copyright|gpl-verbatim|wtfpl-title*"),
    *[(name, f"copyright|rights* is-{name.lower()}") for name in NAMES if name not in ("MIT", "Apache-2.0")],
    ("Proprietary", "copyright? rights"),
]
#: Texts without any of these letters have no known sentence.
ANCHORS = r"(?i)licen[sc]e|copyright|permission|software|redistribution|rights|under|cc0|liable|warranty|mpl|notice|spdx"
#: A copyright line's normalised words begin so, whatever names follow.
COPYRIGHT = r"^copyright (?:c (?:\d{4}|year|\S+ \d{4})|\d{4})\b|^copyright c "
#: What opens a comment's line and says nothing.
LEADER = r"^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|%+|--+|<!--|dnl|rem|REM)(?:[ \t]+|$)"
#: Marks end a sentence before a blank or a line's end, but not in a version's ``v. 2`` or after the key of an identifier line.
MARK, VERSION, KEY = r"[.!?;:]+(?:[ \t]|$)", r"\b([vV])\.([ \t]+[0-9])", r"(?i)(spdx-license-identifier):"


def _known() -> dict[str, str]:
    known = {s: key for key, some in SENTENCES.items() for s in some}
    for kind, family in (("", "gpl"), ("lesser ", "lgpl"), ("affero ", "agpl")):
        base = f"you can redistribute it and or modify it under the terms of the gnu {kind}general public license"
        known[f"{base} as published by the free software foundation"] = f"{family}-base"
        for number, words in {"gpl": (("2", "2"), ("3", "3")), "lgpl": (("2.1", "2 1"), ("3", "3")), "agpl": (("3", "3"),)}[family]:
            later = f"either version {words} of the license or at your option any later version"
            known[later] = f"later-{number}"
            known[f"{base} as published by the free software foundation {later}"] = f"{family}-{number}-later"
            for only in (f"{base} version {words} as published by the free software foundation", f"{base} as published by the free software foundation version {words} of the license", f"{base} as published by the free software foundation version {words}"):
                known[only] = f"{family}-{number}-only"
    return known


KNOWN = _known()
NAMED = {name: f"is-{licence.lower()}" for licence, names in NAMES.items() for name in (*names, re.sub("[^a-z0-9]+", " ", licence.lower()))}
_FIRST = {s.partition(" ")[0] for s in KNOWN} | {"copyright", "spdx", "this", "the", "it", "licensed", "released", "distributed", "available", "published", "made", "provided"}
_MOST = max(s.count(" ") + 1 for s in KNOWN)


def _pattern(rule: str) -> str:
    """A rule over identifiers in angle brackets."""
    out = ""
    for token in rule.split(" "):
        times = token[-1] if token[-1] in "?*" else ""
        out += "(?:" + "|".join(f"<{x}>" for x in token.removesuffix(times).split("|")).replace(".", "[.]") + ")" + times
    return out


PATTERNS = [(name, _pattern(rule)) for name, rule in RULES]
_ANY = re.compile("|".join(f"(?P<r{i}>{p})" for i, (_, p) in enumerate(PATTERNS)))
_MARK, _LEADER, _VERSION, _KEY, _COPYRIGHT, _STATEMENT, _OTHER = (re.compile(x) for x in (MARK, LEADER, VERSION, KEY, COPYRIGHT, STATEMENT, r"[^a-z0-9]+"))
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fragments(text: str) -> list[list[str]]:
    """The text's stretches between marks and blank lines, each as the normalised parts of its lines."""
    out: list[list[str]] = [[]]
    for line in re.split("\r\n|\r|\n", text):
        line = _KEY.sub(r"\1", _VERSION.sub(r"\1\2", _LEADER.sub("", line)))
        parts = [_OTHER.sub(" ", p.translate(_ASCII_LOWER)).strip() for p in _MARK.split(line)]
        if not any(parts):
            out.append([])
            continue
        for i, part in enumerate(parts):
            if i:
                out.append([])
            if part:
                out[-1].append(part)
    return [stretch for stretch in out if stretch]


def _stated(sentence: str) -> str | None:
    m = _STATEMENT.match(sentence)
    return NAMED.get(m[1] or m[2]) if m else None


def sentence_ids(text: str) -> list[str]:
    """Identifiers of the known sentences, in order: runs of line parts within a stretch that equal one, the longest at the first place; parts taken are not looked at again."""
    found = []
    for parts in fragments(text):
        i = 0
        while i < len(parts):
            best = None
            if parts[i].partition(" ")[0] in _FIRST:
                joined, j = "", i
                while j < len(parts) and joined.count(" ") < _MOST:
                    joined = f"{joined} {parts[j]}" if joined else parts[j]
                    j += 1
                    key = KNOWN.get(joined) or _stated(joined)
                    if key:
                        best = key, j
                if best is None and _COPYRIGHT.search(parts[i]):
                    best = "copyright", i + 1
            if best:
                found.append(best[0])
            i = best[1] if best else i + 1
    return found


def licences_of(ids: str) -> list[str]:
    """Licences by the rules, in order of their places, from identifiers in angle brackets."""
    return [PATTERNS[int(m.lastgroup[1:])][0] for m in _ANY.finditer(ids)]


def scanned(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``sentence_ids`` (identifiers in angle brackets, in the text's order), ``licenses`` (comma-joined, in order of their places, repeats kept) and ``n_licenses``.

    A sentence may be wrapped over lines and stand in a comment; it begins and ends at a mark, a line's end or a blank line. Null, empty and unlicensed texts
    give empty strings and 0; texts are scanned whole; repeated rows and null ids are kept; an empty table gives no rows. Letters beyond
    ASCII count as blanks. Columns that are not kept are ignored, whatever their names.
    """
    typed = dict(docs.dtypes)

    def scan(batches):
        for b in batches:
            ids = ["".join(f"<{x}>" for x in sentence_ids(t)) if t is not None else "" for t in b["__text"]]
            names = [licences_of(x) for x in ids]
            yield pd.DataFrame({c: b[c].array for c in keep} | {"sentence_ids": ids, "licenses": [",".join(x) for x in names], "n_licenses": [len(x) for x in names]})

    text = F.col("text").cast("string")
    worth = docs.select(*keep, F.when(text.rlike(ANCHORS), text).alias("__text"))
    return in_text_batches(worth).mapInPandas(scan, ", ".join(f"`{c}` {typed[c]}" for c in keep) + ", sentence_ids string, licenses string, n_licenses long")


def scanned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every document."""
    return scanned(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """Parts of lines are numbered by stretches; runs of parts are joined with the known sentences, and those within a longer one go."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    pairs = lambda some: ", ".join(f"({quote(s)}, {quote(k)})" for s, k in some.items())
    rules = ", ".join(f"({i}, {quote(name)}, {quote('^(?:' + p + ')$')})" for i, (name, p) in enumerate(PATTERNS))
    return f"""
WITH known(s, k) AS (VALUES {pairs(KNOWN)}), named(name, k) AS (VALUES {pairs(NAMED)}), rules(r, name, p) AS (VALUES {rules}),
lines AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS ln FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS ls FROM documents WHERE text IS NOT NULL)),
cleaned AS (SELECT doc_id, ln, regexp_replace(regexp_replace(regexp_replace(raw, '{LEADER}', ''), '{VERSION}', '\\1\\2', 'g'), '{KEY}', '\\1', 'g') AS l FROM lines),
parted AS (SELECT doc_id, ln, list_transform(string_split_regex(l, '{MARK}'), lambda x: trim(regexp_replace(lower(regexp_replace(x, '[^A-Za-z0-9]+', ' ', 'g')), ' +', ' ', 'g'))) AS ps FROM cleaned),
parts AS (SELECT doc_id, ln, unnest(ps) AS s, generate_subscripts(ps, 1) AS i, len(list_filter(ps, lambda x: x <> '')) = 0 AS blank FROM parted),
numbered AS (SELECT doc_id, ln, i, s, sum(CASE WHEN i > 1 OR blank THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln, i) AS stretch FROM parts),
frags AS (SELECT doc_id, stretch, s, row_number() OVER (PARTITION BY doc_id, stretch ORDER BY ln, i) AS f FROM numbered WHERE s <> ''),
heads AS (SELECT DISTINCT string_split(s, ' ')[1] AS w FROM known UNION SELECT unnest(['spdx', 'this', 'the', 'it', 'licensed', 'released', 'distributed', 'available', 'published', 'made', 'provided'])),
stretches AS (SELECT doc_id, stretch, list(s ORDER BY f) AS ss FROM frags GROUP BY ALL),
opened AS (SELECT doc_id, stretch, f, ss FROM frags JOIN stretches USING (doc_id, stretch) WHERE string_split(s, ' ')[1] IN (SELECT w FROM heads)),
runs AS (SELECT doc_id, stretch, f, g, array_to_string(ss[f:g], ' ') AS s FROM (SELECT *, unnest(range(f, least(len(ss), f + {_MOST}) + 1)) AS g FROM opened)),
stated AS (SELECT doc_id, stretch, f, g, coalesce(nullif(regexp_extract(s, '{STATEMENT}', 1), ''), regexp_extract(s, '{STATEMENT}', 2)) AS name FROM runs),
either AS (SELECT doc_id, stretch, f, g, k FROM runs JOIN known USING (s) UNION ALL SELECT doc_id, stretch, f, g, k FROM stated JOIN named USING (name)),
hits AS (SELECT doc_id, stretch, f, max(g) AS g, max_by(k, g) AS k FROM either GROUP BY ALL),
marks AS (SELECT doc_id, stretch, f, f AS g, 'copyright' AS k FROM frags ANTI JOIN hits USING (doc_id, stretch, f) WHERE regexp_matches(s, '{COPYRIGHT}')),
every AS (SELECT * FROM hits UNION ALL SELECT * FROM marks),
kept AS (SELECT * FROM every a WHERE NOT EXISTS (SELECT 1 FROM every b WHERE a.doc_id = b.doc_id AND a.stretch = b.stretch AND b.f < a.f AND b.g >= a.f)),
ids AS (SELECT doc_id, string_agg('<' || k || '>', '' ORDER BY stretch, f) AS ids FROM kept GROUP BY doc_id),
said AS (SELECT doc_id, coalesce(ids, '') AS ids, CASE WHEN ids IS NULL THEN [] ELSE regexp_extract_all(ids, '{"|".join(f"(?:{p})" for _, p in PATTERNS)}') END AS found FROM documents LEFT JOIN ids USING (doc_id)),
single AS (SELECT doc_id, n, (SELECT arg_min(name, r) FROM rules WHERE regexp_matches(h, p)) AS name FROM (SELECT doc_id, unnest(found) AS h, generate_subscripts(found, 1) AS n FROM said)),
result AS (SELECT doc_id, string_agg(name, ',' ORDER BY n) AS licenses, count(*) AS n_licenses FROM single GROUP BY doc_id)
SELECT doc_id, ids AS sentence_ids, coalesce(licenses, '') AS licenses, coalesce(n_licenses, 0) AS n_licenses FROM said LEFT JOIN result USING (doc_id)
"""


SCANNED_SQL = _sql()
