import re

import pytest

from lumenframe.llm import licenses
from lumenframe.llm.licenses import NAMES, RULES, SENTENCES, op8_license_scan, scan

from .fixtures import documents, odd_texts

SF = "/root/testdata/sf0.001"


def found(spark, texts):
    rows = scan(documents(spark, list(enumerate(texts)))).collect()
    return [r for r in sorted(rows, key=lambda r: r.doc_id)]


def test_every_known_sentence_has_a_tell_and_every_rule_is_made_of_known_ones():
    for own in SENTENCES.values():
        for s in own:
            assert re.search(licenses._TELLS, s.lower())
    assert {k for _, seq in RULES for k in seq} <= set(SENTENCES) | {f"notice:{n}" for n in NAMES}
    assert len({name for name, _ in RULES}) >= 50


def test_every_sentence_alone(spark):
    known = [(k, s) for k, own in SENTENCES.items() for s in own]
    wrapped = [re.sub("((?:\\S+ ){7})", "\\1\n * ", s) for _, s in known]
    for texts in ([s for _, s in known], [f"Intro\n{s}.\nEnd" for s in wrapped]):
        assert [r.sentence_ids for r in found(spark, texts)] == [[k] for k, _ in known]


def test_rules_are_ordered_and_the_longest_wins(spark):
    one = lambda *keys: "\n\n".join(SENTENCES[k][0] + "." for k in keys)
    mit, bsd3 = one("mit-permission", "mit-condition", "mit-warranty"), one("bsd-permission", "bsd-source", "bsd-binary", "bsd-names")
    rows = ["Intro.\n" + mit.replace(" the ", "\n the "), one("mit-warranty", "mit-condition", "mit-permission"), "Text here.\nLicensed under CC BY-NC 4.0.\nMore. Released under the MIT  License.", "licensed under nothing at all.", bsd3, one("bsd-permission", "bsd-source", "bsd-binary"), bsd3 + "\n" + one("bsd-permission", "bsd-source", "bsd-binary"), "All rights reserved.\n" + bsd3]
    want = [["MIT"], [], ["MIT", "CC-BY-NC-4.0"], [], ["BSD-3-Clause"], ["BSD-2-Clause"], ["BSD-3-Clause", "BSD-2-Clause"], ["BSD-3-Clause", "All-rights-reserved"]]
    got = found(spark, rows)
    assert [r.licenses for r in got] == want
    assert [r.license for r in got] == [x[0] if x else None for x in want]
    assert all(r.licenses == [] and r.license is None for r in scan(documents(spark, odd_texts())).collect())
    assert scan(documents(spark, [])).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


NOTICES = [
    ("Released under the MIT License", "MIT"),
    ("This project is licensed under the terms of the MIT license.", "MIT"),
    ("# SPDX-License-Identifier: MIT", "MIT"),
    ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("Licensed under the Apache License, Version 2.0", "Apache-2.0"),
    ("This software is distributed under the Apache License 2.0.", "Apache-2.0"),
    ("/* SPDX-License-Identifier: GPL-2.0-only */", "GPL-2.0-only"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
    ("This work is licensed under the GNU General Public License, version 3", "GPL-3.0-only"),
    ("Released under the GNU General Public License v3.0 or later", "GPL-3.0-or-later"),
    ("This program is distributed under the terms of the GNU General Public License version 2 or any later version.", "GPL-2.0-or-later"),
    ("Licensed under the GNU Lesser General Public License v2.1", "LGPL-2.1-only"),
    ("Licensed under LGPL 2.1 or later", "LGPL-2.1-or-later"),
    ("This library is licensed under the GNU Lesser General Public License, version 3 (or (at your option) any later version)", "LGPL-3.0-or-later"),
    ("SPDX-License-Identifier: LGPL-3.0-only", "LGPL-3.0-only"),
    ("Licensed under the AGPL v3", "AGPL-3.0-only"),
    ("Available under the GNU Affero General Public License version 3 or later", "AGPL-3.0-or-later"),
    ("Released under the Mozilla Public License 2.0", "MPL-2.0"),
    ("Licensed under the Mozilla Public License, version 1.1", "MPL-1.1"),
    ("Made available under the Eclipse Public License v1.0", "EPL-1.0"),
    ("Licensed under the Eclipse Public License 2.0.", "EPL-2.0"),
    ("Licensed under the Common Development and Distribution License", "CDDL-1.0"),
    ("This code is released under the Unlicense", "Unlicense"),
    ("Released under CC0 1.0 Universal", "CC0-1.0"),
    ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", "BSL-1.0"),
    ("Licensed under the 2-Clause BSD License", "BSD-2-Clause"),
    ("Licensed under the Simplified BSD license", "BSD-2-Clause"),
    ("This project is licensed under the BSD 3-Clause License", "BSD-3-Clause"),
    ("Released under the New BSD License", "BSD-3-Clause"),
    ("SPDX-License-Identifier: BSD-4-Clause", "BSD-4-Clause"),
    ("SPDX-License-Identifier: 0BSD", "0BSD"),
    ("Licensed under the ISC License", "ISC"),
    ("This library is distributed under the zlib license", "Zlib"),
    ("Licensed under the Artistic License 2.0", "Artistic-2.0"),
    ("Licensed under the Microsoft Public License (Ms-PL)", "MS-PL"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "OFL-1.1"),
    ("Released under the PostgreSQL License", "PostgreSQL"),
    ("SPDX-License-Identifier: NCSA", "NCSA"),
    ("Licensed under the WTFPL", "WTFPL"),
    ("Licensed under CC BY 4.0", "CC-BY-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("Licensed under CC BY-SA 3.0", "CC-BY-SA-3.0"),
    ("This document is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"),
    ("SPDX-License-Identifier: CC-BY-NC-SA-4.0", "CC-BY-NC-SA-4.0"),
    ("Licensed under CC BY-ND 4.0", "CC-BY-ND-4.0"),
    ("Published under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International license", "CC-BY-NC-ND-4.0"),
    ("Copyright 2020. All rights reserved.", "All-rights-reserved"),
    ("Not released under the MIT License.", None),
    ("Released under the MIT License of sorts", None),
    ("Released under pressure", None),
    ("", None),
]


def test_notices(spark):
    got = found(spark, [f"Some words before\n{t}\nand after." for t, _ in NOTICES])
    assert [(t, r.license) for (t, _), r in zip(NOTICES, got)] == NOTICES
    assert all(len(r.licenses) == (want is not None) for r, (_, want) in zip(got, NOTICES))


def test_published_headers_and_notices_on_their_own_line(spark):
    want = ["Apache-2.0", "GPL-3.0-or-later", "GPL-2.0-or-later", "MPL-2.0", "Apache-2.0", "MIT", None, "LGPL-2.1-or-later", "AGPL-3.0-or-later"]
    own_line = "A title without a mark\nReleased under the MIT License\nMore text"
    lgpl = GPL2.replace("This program", "This library").replace("General", "Lesser General").replace("version 2", "version 2.1")
    texts = [APACHE, GPL3, GPL2, MPL, "\n".join("# " + x for x in APACHE.split("\n")), own_line, "Not released under the MIT License.", lgpl, GPL3.replace("GNU General", "GNU Affero General")]
    got = found(spark, texts)
    assert [r.license for r in got] == want
    assert [len(r.licenses) for r in got] == [int(w is not None) for w in want]
    assert got[0].sentence_ids == got[4].sentence_ids == ["apache-notice", "apache-copy", "apache-warranty"]


def test_every_rule_by_its_sentences(spark):
    by_name = lambda k: f"Licensed under {NAMES[k.removeprefix('notice:')][0]}" if k.startswith("notice:") else SENTENCES[k][0]
    got = found(spark, ["Intro\n" + ".\n".join(map(by_name, seq)) + ".\nEnd" for _, seq in RULES])
    for r, (name, seq) in zip(got, RULES):
        assert r.sentence_ids == list(seq) and r.license == name


@pytest.fixture(scope="module")
def duck():
    import duckdb

    return duckdb.connect()


def test_op8_equals_its_sql(spark, duck, tmp_path):
    extra = [f"Words before\n{t}\nafter" for t, _ in NOTICES] + [APACHE, GPL3, GPL2, MPL] + [s + ".\n" + s for own in SENTENCES.values() for s in own]
    documents(spark, list(enumerate(extra)) + odd_texts()).write.parquet(f"{tmp_path}/documents.parquet")
    for folder, files in ((SF, f"{SF}/documents.parquet"), (tmp_path, f"{tmp_path}/documents.parquet/*.parquet")):
        duck.execute(f"create or replace view documents as select * from read_parquet('{files}')")
        want = duck.execute(licenses.oracle_sql()).fetchall()
        got = [tuple(r) for r in op8_license_scan(spark, str(folder)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert any(r[4] for r in got)
