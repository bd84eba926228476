import re

from chatlens.llm import license_scan as X
from tests.conftest import SF_MID

CASES = [
    ("Released under the MIT License.", "MIT_REF", "MIT"),
    ("some text\n  Licensed  under the APACHE License, Version 2.0!! more", "APACHE2_REF", "Apache-2.0"),
    ("Licensed*** under*** CC*** BY-NC*** 4.0.***", "CCBYNC_REF", "CC-BY-NC-4.0"),
    ("This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.",
     "GPL3_REF,MIT_REF", "GPL-3.0"),
    ("The license of poets. No warranty. All rights reserved.", "ARR", "all-rights-reserved"),
    ("The software is provided \"as is\", without warranty of any kind, express or implied.", "AS_IS", "unclear"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in "
     "compliance with the License.\nYou may obtain a copy of the License at", "APACHE2_REF,APACHE_COMPLY,APACHE_COPY",
     "Apache-2.0"),
    ("a license that is released under the MIT license plan", "", None),
    (None, "", None), ("", "", None), ("license " * 50000, "", None),
]


def test_cases(make):
    rows = [(k, t) for k, (t, _, _) in enumerate(CASES)]
    got = {r.doc_id: (r.sequence, r.license) for r in X.scan(make(rows + rows[:2])).collect()}
    assert got == {k: (s, lic) for k, (_, s, lic) in enumerate(CASES)}
    assert X.scan(make([])).collect() == []


def test_every_known_sentence_has_a_cue_and_a_normal_form():
    for s in X.SENTENCES:
        assert re.search(X.CUE, s) and re.fullmatch(r"[a-z0-9]+([. ][a-z0-9]+)*", s)
    assert {i for need, _, _ in X.RULES for i in need} <= set(X.SENTENCES.values())


def test_odd_rows_and_plan(make, odd):
    df = X.scan(make(odd))
    assert len(df.collect()) == len(odd)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_planted_lines(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    bare = lambda t: re.sub(r"[^a-z]+", " ", t.lower())
    want = {r.doc_id for r in docs.collect() if re.search(r"\b((licensed|released) under|all rights reserved)\b", bare(r.text))}
    assert {r.doc_id for r in X.scan(docs).filter("license is not null").collect()} == want


MIT = '''MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY.
'''
BSD = '''Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
'''
BSD3 = BSD + '''
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
'''
GPL = '''This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU {1}General Public License as published by
the Free Software Foundation{2} either version {3} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
'''
APACHE = '''Licensed under the Apache License, Version 2.0 (the "License"); you may
not use this file except in compliance with the License. You may obtain
a copy of the License at

     http://www.apache.org/licenses/LICENSE-2.0
'''
ISC = '''Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
'''
MPL = '''This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
'''
CANON = [(MIT, "MIT_GRANT_SHORT,MIT_NOTICE,AS_IS", "MIT"), (BSD, "ARR,BSD_GRANT", "BSD-2-Clause"),
         (BSD3, "ARR,BSD_GRANT,BSD_ENDORSE", "BSD-3-Clause"), (GPL.format(":", "", ",", "3"), "GPL3_REF", "GPL-3.0"),
         (GPL.format(";", "", ";", "2"), "GPL2_REF", "GPL-2.0"),
         (GPL.format(":", "Affero ", ",", "3"), "AGPL3_REF", "AGPL-3.0"),
         (GPL.format(";", "Lesser ", ";", "2.1"), "LGPL21_REF", "LGPL-2.1"),
         (APACHE, "APACHE2_REF,APACHE_COMPLY,APACHE_COPY", "Apache-2.0"), (ISC, "ISC_GRANT", "ISC"),
         (MPL, "MPL2_REF", "MPL-2.0"),
         ("This work is licensed under the GNU General Public\nLicense, version 3.", "GPL3_REF", "GPL-3.0"),
         ("All rights.\nReserved. All rights\n\nreserved. All rights\n*\nreserved", "", None)]


def _wrapped(text, n):
    """Each paragraph wrapped anew, one word a line for n = 1."""
    import textwrap
    return "\n\n".join(textwrap.fill(p, n, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))


def test_wrapped_public_texts(make):
    forms = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: _wrapped(t, 30), lambda t: _wrapped(t, 1),
             lambda t: _wrapped(t, 10**6), lambda t: "/*\n" + re.sub("(?m)^", " * ", t) + "\n */",
             lambda t: re.sub("(?m)^", "# ", t), lambda t: re.sub("(?m)^", "// ", t)]
    cases = [(form(t), s, lic) for t, s, lic in CANON[:-1] for form in forms
             if not (t is BSD or t is BSD3) or "_wrapped" not in form.__code__.co_names]
    cases += [(t, s, lic) for t, s, lic in CANON[-1:]]
    got = {r.doc_id: (r.sequence, r.license) for r in X.scan(make([(k, t) for k, (t, _, _) in enumerate(cases)])).collect()}
    assert got == {k: (s, lic) for k, (_, s, lic) in enumerate(cases)}


SLOTS = [
    ("SPDX-License-Identifier: MIT", "MIT_REF", "MIT"),
    ("// SPDX-License-Identifier: GPL-3.0-or-later", "GPL3_REF", "GPL-3.0"),
    ("/* SPDX-License-Identifier: BSD-3-Clause */\nint x;", "BSD3_REF", "BSD-3-Clause"),
    ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT_REF", "MIT"),
    ("Some Tool 2.1 is distributed under the\nApache License, version 2.0.", "APACHE2_REF", "Apache-2.0"),
    ("Licensed under the MIT License (the \"License\");", "MIT_REF", "MIT"),
    ("a license that is released under the MIT license plan", "", None),
    ("the hotel is available under the bridge", "", None),
    (BSD + """
3. Neither the name of Google Inc. nor the names of its contributors may be used
   to endorse or promote products derived from this software without specific
   prior written permission.
""", "ARR,BSD_GRANT,BSD_ENDORSE", "BSD-3-Clause"),
    (BSD + "\nNeither the names of A. Person and B. Other Ltd. nor the names of their\ncontributors may be used to endorse"
     " or promote products\nderived from this software without specific prior written permission.",
     "ARR,BSD_GRANT,BSD_ENDORSE", "BSD-3-Clause"),
]


def test_open_slots(make):
    got = {r.doc_id: (r.sequence, r.license) for r in X.scan(make([(k, t) for k, (t, _, _) in enumerate(SLOTS)])).collect()}
    assert got == {k: (s, lic) for k, (_, s, lic) in enumerate(SLOTS)}


def test_own_sentences_need_no_built_in_cue(make):
    own = {"this is free and unencumbered software released into the public domain": "FREE"}
    text = "This is free and unencumbered software released into the public domain."
    df = X.scan(make([(1, text), (2, "nothing")]), sentences=own, rules=((("FREE",), "Unlicense", "permissive"),))
    assert {r.doc_id: r.license for r in df.collect()} == {1: "Unlicense", 2: None}
    assert [r.n_known for r in X.scan(make([(1, text)]), sentences={}).collect()] == [0]
