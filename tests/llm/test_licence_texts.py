import textwrap

import pytest

from geoweft.llm import licences

MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_3 = BSD_2 + """

3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
GPL = """This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
ISC = """Permission to use, copy, modify, and{} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
LGPL = GPL.replace("This program", "This library").replace("GNU General", "GNU Lesser General")
AGPL = GPL.replace("GNU General", "GNU Affero General")
GPL_2 = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.

""" + GPL.split("\n\n")[1]
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""
ZERO_BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
WTFPL = "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."
BSD_4 = BSD_2 + """

3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.

4. """ + BSD_3.split("\n\n3. ")[1].format("the copyright holder")
TEXTS = [
    (LGPL.format(";", ";", "2.1"), "LGPL-2.1-or-later", "<39><41>"), (LGPL.format(":", ",", 3), "LGPL-3.0-or-later", "<40><41>"), (AGPL.format(":", ",", 3), "AGPL-3.0-or-later", "<38><20>"),
    (GPL_2, "GPL-2.0-only", "<42><20>"), (BOOST, "BSL-1.0", "<43>"), (ZLIB, "Zlib", "<45>"), (ZERO_BSD, "0BSD", "<37>"), (BSD_4, "BSD-4-Clause", "<10><11><12><48><13>"), (WTFPL, "WTFPL", "<46>"),
    (MIT.split("\n\n")[2].replace(", subject to the following conditions:", "."), "MIT-0", "<49>"), ("(Distributed under the Boost Software License, Version 1.0.)", "BSL-1.0", "<44>"),
    (MIT, "MIT", "<7><8><9>"), (BSD_2, "BSD-2-Clause", "<10><11><12>"), (APACHE, "Apache-2.0", "<2><3><4>"), (MPL, "MPL-2.0", "<33>"), (UNLICENSE, "Unlicense", "<36>"),
    (BSD_3.format("the copyright holder"), "BSD-3-Clause", "<10><11><12><13>"), (BSD_3.format("the psutil authors"), "BSD-3-Clause", "<10><11><12><13>"),
    (GPL.format(":", ",", 3), "GPL-3.0-or-later", "<18><20>"), (GPL.format(";", ";", 2), "GPL-2.0-or-later", "<19><20>"), (ISC.format("/or"), "ISC", "<35>"), (ISC.format(""), "ISC", "<35>"),
]


def wrapped(text, width, prefix):
    return "\n".join(x for p in text.split("\n\n") for x in [*(prefix + y for y in textwrap.wrap(p, width)), prefix.rstrip()])


@pytest.mark.parametrize(("width", "prefix"), [(None, ""), (79, ""), (60, "   "), (72, "# "), (40, " * ")])
def test_full_texts(spark, width, prefix):
    rows = [(i, t if width is None else wrapped(t, width, prefix)) for i, (t, _, _) in enumerate(TEXTS)]
    rows += [(100 + i, t.replace("\n", "\r\n")) for i, t in rows]
    got = {r.doc_id: (r.licences, r.sentence_ids) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k + i: (name, ids) for k in (0, 100) for i, (_, name, ids) in enumerate(TEXTS)}


def test_sql_on_full_texts(spark):
    """The SQL, which compares runs of fragments, against the operator on wrapped texts and odd sequences."""
    import duckdb
    import pandas as pd

    texts = [t if w is None else wrapped(t, w, x) for w, x in ((None, ""), (79, ""), (40, " * ")) for t, _, _ in TEXTS]
    texts += ["\n\n".join(t for t, _, _ in TEXTS), "Released under the\n\nMIT License", "S Released under the\nMIT License", None, ""]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    want = {d: (i, x) for d, i, x in con.sql(f"SELECT doc_id, sentence_ids, licences FROM ({licences.oracle()})").fetchall()}
    got = licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.sentence_ids, r.licences) for r in got} == want


def test_rules_do_not_match_across_what_is_used_up(spark):
    """7, 8 and 9 are one licence; 10 before and 11, 12 behind it are not another."""
    text = ".\n".join(licences.SENTENCES[i] for i in (10, 7, 8, 9, 11, 12))
    row = licences.scan_licences(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.sentence_ids, row.licences) == ("<10><7><8><9><11><12>", "MIT")


def test_breaks(spark):
    texts = ["Notes\nReleased under the MIT License\nmore", "Released under\n\nthe MIT License", "We were released under the\nMIT License.", "Released under the MIT\nLicense or not", "S Released under the\nMIT License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.licences for r in licences.scan_licences(docs).orderBy("doc_id").collect()] == ["MIT", "", "", "", ""]


def test_forms():
    assert all(any(a in s for a in licences.ANCHORS) for _, s in licences.FORMS)
    assert {k for k, _ in licences.FORMS} <= set(licences.SENTENCES)
