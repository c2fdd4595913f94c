"""Licence texts and file headers as published: wrapped, commented, with their own punctuation."""

from assaylake.llm import license_scan

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """MIT License

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
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
BSD3 = f"""{BSD2}3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
GPL3 = GPL2.replace("software; you", "software: you").replace("Foundation; either version 2", "Foundation, either version 3")
TEXTS = {"Apache-2.0-notice": APACHE, "MIT-text": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "GPL-2.0-or-later": GPL2, "GPL-3.0-or-later": GPL3}
LEADERS = {"plain": ("", "", ""), "c": ("/*\n", " * ", " */\nint x;\n"), "hash": ("#!/bin/sh\n", "# ", "\nexit 0\n"), "slashes": ("", "// ", "\ncode();\n")}


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.licenses for r in license_scan.scan(docs).orderBy("doc_id").collect()]


def test_published_texts(spark):
    cases = [(name, start + "".join(f"{lead}{line}".rstrip() + end for line in text.splitlines()) + stop) for name, text in TEXTS.items() for start, lead, stop in LEADERS.values() for end in ("\n", "\r\n")]
    assert found(spark, [text for _, text in cases]) == [name for name, _ in cases]


def test_ends_of_sentences(spark):
    apart = ["all rights\n\nreserved", "all rights.\nreserved", "no all rights reserved", "all rights reserved here", "all rights: reserved", " * all rights\n *\n * reserved"]
    whole = ["all rights\nreserved", "x;\nall rights reserved", "words\nall rights reserved\nwords", "# All rights\n#   reserved;", "a. all rights reserved; b"]
    assert found(spark, apart + whole) == [""] * len(apart) + ["All-rights-reserved"] * len(whole)


LGPL21 = GPL2.replace("This program", "This library").replace("General Public License as", "Lesser General Public\nLicense as").replace("version 2 of", "version 2.1 of")
AGPL3 = GPL3.replace("General Public License as", "Affero General Public License as")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
"""
UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify,\n"
MORE = {"LGPL-2.1-or-later": LGPL21, "AGPL-3.0-or-later": AGPL3, "MPL-2.0-notice": MPL, "ISC-text": ISC, "Unlicense-text": UNLICENSE}
REFERENCES = {
    "SPDX-License-Identifier: MIT": "MIT",
    "// SPDX-License-Identifier: GPL-2.0-or-later\n#include <a.h>": "GPL-2.0-or-later-ref",
    "/* spdx-license-identifier:Apache-2.0 */": "Apache-2.0",
    "This file is part of X and licensed under the MIT License, see LICENSE.": "MIT",
    "It was released under the terms of the BSD 3-Clause License in 2019.": "BSD-3-Clause-ref",
    "Made available under the terms of the Eclipse Public License 2.0 which is here.": "EPL-2.0",
    "published under CC0 1.0": "CC0-1.0",
    "licensed\n * under the Boost Software License, Version 1.0": "BSL-1.0",
    "licensed under GNU Lesser General Public License version 2.1": "LGPL-2.1",
    "published under the Business Source License 1.1": "BUSL-1.1",
    "the MIT license": "",
    "unlicensed under the mit licenses": "",
    "SPDX-License-Identifier: MITNFA": "",
}


def test_more_families_and_references(spark):
    cases = [(name, start + "".join(f"{lead}{line}".rstrip() + "\n" for line in text.splitlines()) + stop) for name, text in MORE.items() for start, lead, stop in LEADERS.values()]
    assert found(spark, [text for _, text in cases]) == [name for name, _ in cases]
    assert found(spark, list(REFERENCES)) == list(REFERENCES.values())


def test_gaps_inside_a_rule(spark):
    """Other known sentences may stand between those of a rule, at most GAP of them."""
    other = "All rights reserved.\n"
    parts = GPL3.split("\n\n")
    near = f"{parts[0]}\n\n{other * license_scan.GAP}{parts[1]}"
    far = f"{parts[0]}\n\n{other * (license_scan.GAP + 1)}{parts[1]}"
    assert found(spark, [near, far]) == ["GPL-3.0-or-later,All-rights-reserved", "All-rights-reserved"]


def test_texts_equal_sql(spark, tmp_path):
    import duckdb

    texts = [start + "".join(f"{lead}{line}".rstrip() + end for line in text.splitlines()) + stop for text in [*TEXTS.values(), *MORE.values(), *REFERENCES] for start, lead, stop in LEADERS.values() for end in ("\n", "\r\n")]
    docs = spark.createDataFrame(list(enumerate([*texts, None, "", "all rights reserved. all rights reserved\nall rights reserved;\n\nlicensed under mit"])), "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = sorted(db.sql(license_scan.duckdb_sql()).fetchall())
    assert sorted(tuple(r) for r in license_scan.scan(docs).collect()) == want
