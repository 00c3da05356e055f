"""Operator 8: licences by known sentences and ordered rules, in DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Licences of the GNU family: name, full name, version, date in the title. Fixed values.
GNU = [
    ("GPL-2.0", "GNU General Public License", "2", "June 1991"),
    ("GPL-3.0", "GNU General Public License", "3", "29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License", "3", "19 November 2007"),
]
#: Creative Commons licences: name, full name. Fixed values.
CREATIVE_COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

#: Identifiers of licence sentences and their wordings, as published with the licences. Fixed values.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit-permission": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',),
    "mit0-permission": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',),
    "mit-condition": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"),
    "mit-warranty": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',),
    "mit-liability": ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",),
    "x11-liability": ("IN NO EVENT SHALL THE X CONSORTIUM BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",),
    "x11-names": ("Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium",),
    "json-good": ("The Software shall be used for Good, not Evil",),
    "isc-permission": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    "0bsd-permission": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "isc-warranty": ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',),
    "bsd-permission": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "bsd-advertising": ("All advertising materials mentioning features or use of this software must display the following acknowledgement",),
    "bsd-names": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    "ncsa-permission": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',),
    "ncsa-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers",),
    "apache-notice": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',),
    "apache-copy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    "apache-warranty": ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',),
    "apache-title": ("Apache License Version 2.0, January 2004",),
    "gnu-warranty": tuple(f"This {x} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE" for x in ("program", "library", "software")),
    "mpl-notice": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "mpl-copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    "mpl-title": ("Mozilla Public License Version 2.0",),
    "mpl11-notice": ('The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License',),
    "epl1-notice": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    "epl2-notice": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"),
    "cddl-notice": ('The contents of this file are subject to the terms of the Common Development and Distribution License (the "License")',),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
    "cc0-dedication": ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",),
    "cc0-title": ("CC0 1.0 Universal",),
    "wtfpl-title": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004",),
    "wtfpl-terms": ("You just DO WHAT THE FUCK YOU WANT TO",),
    "zlib-warranty": ("This software is provided 'as-is', without any express or implied warranty",),
    "zlib-permission": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
    "boost-permission": ('Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',),
    "boost-title": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "artistic-title": ("The Artistic License 2.0",),
    "mspl-title": ("Microsoft Public License (Ms-PL)",),
    "ofl-notice": ("This Font Software is licensed under the SIL Open Font License, Version 1.1",),
    "psf-basis": ('PSF is making Python available to Licensee on an "AS IS" basis',),
    "postgresql-permission": ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",),
    "reserved": ("All rights reserved",),
}
for _name, _full, _version, _date in GNU:
    _part = "This {} is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, {}version {} of the License{}"
    SENTENCES[f"{_name}-or-later-freedom"] = tuple(_part.format(x, _full, "either ", _version, ", or (at your option) any later version") for x in ("program", "library", "software"))
    SENTENCES[f"{_name}-only-freedom"] = tuple(_part.format(x, _full, e, _version, "") for x in ("program", "library", "software") for e in ("", "either "))
    SENTENCES[f"{_name}-title"] = (f"{_full} Version {_version}, {_date}",)

#: Names of licences in notices, beside the identifier itself. Fixed values.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT", "Expat"),
    "MIT-0": ("MIT No Attribution",),
    "ISC": ("ISC",),
    "0BSD": ("Zero-Clause BSD", "BSD Zero Clause"),
    "BSD-2-Clause": ("2-Clause BSD", "BSD 2-Clause", "Simplified BSD", "FreeBSD"),
    "BSD-3-Clause": ("3-Clause BSD", "BSD 3-Clause", "New BSD", "Modified BSD", "Revised BSD"),
    "BSD-4-Clause": ("4-Clause BSD", "BSD 4-Clause", "Original BSD"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache License v2.0", "Apache 2"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "MPL-1.1": ("Mozilla Public License 1.1", "Mozilla Public License, version 1.1"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License v1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "CDDL-1.0": ("Common Development and Distribution License 1.0", "Common Development and Distribution License"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    "WTFPL": ("Do What The Fuck You Want To Public License",),
    "Zlib": ("zlib", "zlib/libpng"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "MS-PL": ("Microsoft Public License", "Microsoft Public License (Ms-PL)"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "SIL Open Font License"),
    "PSF-2.0": ("Python Software Foundation License Version 2", "PSF License"),
    "PostgreSQL": ("PostgreSQL",),
    "NCSA": ("University of Illinois/NCSA Open Source", "NCSA Open Source"),
    "X11": ("X11",),
}
for _name, _full, _version, _date in GNU:
    _short, _versions = _name.split("-")[0], (_version, f"version {_version}", f"v{_version}", f"version {_version}.0", f"v{_version}.0")
    NAMES[f"{_name}-only"] = tuple(f"{x} {v}" for x in (_full, _short) for v in _versions)
    NAMES[f"{_name}-or-later"] = tuple(f"{x} {v} {later}" for x in (_full, _short) for v in _versions for later in ("or later", "or any later version", "or (at your option) any later version"))
for _kind, _full in CREATIVE_COMMONS.items():
    for _version, _port in (("2.0", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        NAMES[f"CC-{_kind}-{_version}"] = (f"Creative Commons {_full} {_version} {_port}", f"Creative Commons {_full} {_version}")

#: Licence rules, the more specific first: a licence and the sentences that make it, one after the other among the known ones.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("X11", ("mit-permission", "mit-condition", "mit-warranty", "x11-liability", "x11-names")),
    ("JSON", ("mit-permission", "mit-condition", "json-good", "mit-warranty")),
    ("BSD-4-Clause", ("bsd-permission", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names")),
    ("BSD-3-Clause", ("bsd-permission", "bsd-source", "bsd-binary", "bsd-names")),
    ("NCSA", ("ncsa-permission", "ncsa-source")),
    ("MIT", ("mit-permission", "mit-condition", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-permission", "mit-condition", "mit-warranty")),
    ("MIT-0", ("mit0-permission", "mit-warranty")),
    ("0BSD", ("0bsd-permission", "isc-warranty")),
    ("ISC", ("isc-permission", "isc-warranty")),
    ("BSD-2-Clause", ("bsd-permission", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-notice", "apache-copy", "apache-warranty")),
    *((f"{name}-{kind}", (f"{name}-{kind}-freedom", "gnu-warranty")) for name, *_ in GNU for kind in ("or-later", "only")),
    ("MPL-2.0", ("mpl-notice", "mpl-copy")),
    ("Zlib", ("zlib-warranty", "zlib-permission")),
    ("WTFPL", ("wtfpl-title", "wtfpl-terms")),
    *((f"{name}-{kind}", (f"{name}-{kind}-freedom",)) for name, *_ in GNU for kind in ("or-later", "only")),
    *((f"{name}-only", (f"{name}-title",)) for name, *_ in GNU),
    *((name, (k,)) for k, name in {"isc-permission": "ISC", "apache-notice": "Apache-2.0", "apache-title": "Apache-2.0", "mpl-notice": "MPL-2.0", "mpl-title": "MPL-2.0", "mpl11-notice": "MPL-1.1", "epl1-notice": "EPL-1.0", "epl2-notice": "EPL-2.0", "cddl-notice": "CDDL-1.0", "unlicense": "Unlicense", "cc0-dedication": "CC0-1.0", "cc0-title": "CC0-1.0", "wtfpl-title": "WTFPL", "wtfpl-terms": "WTFPL", "zlib-permission": "Zlib", "boost-permission": "BSL-1.0", "boost-title": "BSL-1.0", "artistic-title": "Artistic-2.0", "mspl-title": "MS-PL", "ofl-notice": "OFL-1.1", "psf-basis": "PSF-2.0", "postgresql-permission": "PostgreSQL"}.items()),
    *((name, (f"notice:{name}",)) for name in NAMES),
    ("All-rights-reserved", ("reserved",)),
]

#: How a notice begins, in normal form; the name of a licence follows, and may be followed by the word licence.
_LEAD = r"spdx license identifier |(?:this (?:work|software|project|program|code|library|package|file|document|material) is )?(?:licensed|released|distributed|published|provided|(?:made )?available) under (?:the terms (?:and conditions )?of )?(?:the |an? )?"
#: A sentence ends at a mark before white space, at a line break, or at an end of the text.
_BREAK = r"(?<=[.:;!?])\s+|\n\s*\n"
#: Every known sentence has one of these in lower case; texts without any are not searched.
_TELLS = r"licen|permi|redistribu|warrant|copyright|software|rights|universal|mozilla|you\W+want|as\W+is|(?:released|distributed|published|provided|available)\W+under"


def _plain(sentence: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in sentence.lower()).split())


def _known(sentences: dict[str, tuple[str, ...]], names: dict[str, tuple[str, ...]]) -> tuple[dict[str, str], dict[str, str]]:
    """Identifiers by wording, and of notices by name."""
    named = {_plain(x): f"notice:{k}" for k, own in names.items() for x in (k, *own)}
    return {_plain(x): k for k, own in sentences.items() for x in own}, named | {f"{x} license": k for x, k in named.items()}


def _any(plain: dict[str, str], named: dict[str, str], gap: str) -> str:
    """A pattern of all known sentences, the longer first."""
    longest = lambda x: "|".join(sorted(x, key=lambda s: (-len(s), s)))
    return f"(?:{longest(plain)}|(?:{_LEAD})(?:{longest(named)}))".replace(" ", gap)


def _sequences(rules: list[tuple[str, tuple[str, ...]]], gap: str) -> str:
    return "|".join(re.escape(gap.join(seq)).replace("\\ ", " ") for _, seq in sorted(rules, key=lambda r: -len(r[1])))


def _map(pairs: dict) -> Column:
    return F.create_map(*(x if isinstance(x, Column) else F.lit(x) for pair in pairs.items() for x in pair))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, tuple[str, ...]] = SENTENCES, names: dict[str, tuple[str, ...]] = NAMES, rules: list[tuple[str, tuple[str, ...]]] = RULES) -> DataFrame:
    """doc_id, n_sentences, sentence_ids (known sentences in their order), licenses and license (the first of them).

    A known sentence is found where it begins and ends at a mark before white space, at a line break, or at an end of
    the text; marks, line breaks and empty lines within it count as spaces. Notices ("Released under the MIT License")
    are sentences made of a beginning and the name of a licence. Of known sentences that begin at one place the longest
    is taken, and the search goes on after it. Sentences are compared in normal form: letters and digits in lower case,
    any run of other characters as one space. A rule is met where its sentences follow each other among the known ones;
    of rules that begin at one sentence the longest is taken, and those within its sentences are not met. licenses has
    each licence once, in the order of the rules. Null, empty and very long texts, repeated rows and ids are fine: each
    row is scanned alone.
    """
    plain, named = _known(sentences, names)
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = F.regexp_replace(F.lower(text), r"(?<=[.:;!?])\s+", "\n")
    cut = F.regexp_replace(cut, r"[^\p{L}\p{N}\n]+", " ")
    cut = F.regexp_replace(F.concat(F.lit("\n"), cut, F.lit("\n")), r" ?\n[ \n]*", "\n")
    found = F.regexp_extract_all(cut, F.lit(rf"(?<=\n){_any(plain, named, '[ \\n]')}(?=\n)"), F.lit(0))
    found = F.transform(F.coalesce(F.when(F.lower(text).rlike(_TELLS), found), F.array().cast("array<string>")), lambda s: F.translate(s, "\n", " "))
    known, notices = _map(plain), _map(named)
    ids = F.transform(found, lambda s: F.coalesce(F.try_element_at(known, s), F.try_element_at(notices, F.regexp_replace(s, f"^(?:{_LEAD})", ""))))
    n_sentences = F.size(F.filter(F.split(text, _BREAK), lambda s: s.rlike(r"[\p{L}\p{N}]"))).cast("bigint")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), n_sentences.alias("n_sentences"), ids.alias("sentence_ids"))
    line = F.concat(F.lit(" "), F.array_join("sentence_ids", " "), F.lit(" "))
    order = {" ".join(seq): F.struct(F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, seq) in reversed(list(enumerate(rules)))}
    met = F.transform(F.regexp_extract_all(line, F.lit(f"(?<= )(?:{_sequences(rules, ' ')})(?= )"), F.lit(0)), lambda s: F.try_element_at(_map(order), s))
    rows = rows.withColumn("licenses", F.array_distinct(F.transform(F.array_sort(met), lambda m: m["name"])))
    return rows.withColumn("license", F.get("licenses", F.lit(0)))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentence_ids").cast("bigint").alias("n_known"), F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licenses", " ").alias("licenses"), "license")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same scan of documents for DuckDB, which looks neither ahead nor back: breaks and blanks are doubled for it."""
    plain, named = _known(SENTENCES, NAMES)
    known = ", ".join(f"({_sql(s)}, {_sql(k)})" for s, k in (plain | {f"under {s}": k for s, k in named.items()}).items())
    rules = ", ".join(f"({i}, {_sql(name)}, {_sql('  '.join(seq))})" for i, (name, seq) in enumerate(RULES))
    return f"""
WITH known(s, k) AS (VALUES {known}), rules(i, name, seq) AS (VALUES {rules}),
marked AS (SELECT doc_id, row_number() OVER () AS r, regexp_replace(lower(coalesce(text, '')), '([.:;!?])\\s+', '\\1\n', 'g') AS t FROM documents),
flat AS (SELECT doc_id, r, regexp_replace('\n' || regexp_replace(t, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') || '\n', ' ?\\n[ \\n]*', '\n\n', 'g') AS t FROM marked),
parts AS (SELECT doc_id, r, regexp_extract_all(t, '\\n({_any(plain, named, '(?: |\\n\\n)')})\\n', 1) AS p FROM flat),
cut AS (SELECT r, regexp_replace(replace(unnest(p), '\n\n', ' '), '^(?:{_LEAD})', 'under ') AS s, replace(unnest(p), '\n\n', ' ') AS whole, generate_subscripts(p, 1) AS place FROM parts),
hits AS (SELECT r, place, coalesce(a.k, b.k) AS k FROM cut LEFT JOIN known a ON whole = a.s LEFT JOIN known b ON cut.s = b.s),
lines AS (SELECT r, count(*) AS n, string_agg(k, ' ' ORDER BY place) AS ids, regexp_extract_all(' ' || string_agg(k, '  ' ORDER BY place) || ' ', ' ({_sequences(RULES, '  ')}) ', 1) AS seqs FROM hits GROUP BY r),
met AS (SELECT r, name, min(i) AS i FROM (SELECT r, unnest(seqs) AS seq FROM lines) JOIN rules USING (seq) GROUP BY r, name),
names AS (SELECT r, string_agg(name, ' ' ORDER BY i) AS licenses, arg_min(name, i) AS license FROM met GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_known, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses, license
FROM marked LEFT JOIN lines USING (r) LEFT JOIN names USING (r)"""
