"""Licence sentences wrapped over many lines."""

import textwrap

from tessella.llm import licences


def test_sentences_in_narrow_columns():
    for width in (26, 24, 15):
        lines = textwrap.wrap(licences.SENTENCES[13], width) + ["and:"]
        text = "\n".join(lines[:-1]) + ":\n***\n" + licences.SENTENCES[14] + "."
        assert len(lines) > 17 and licences.match_rules(licences.identifiers(text.encode())) == ["MIT"]
    assert licences.identifiers(b"***\n" * 50_000 + b"all rights reserved") == [2]


def test_wraps_of_any_number_of_lines():
    words = licences.SENTENCES[14].split()
    for lines in range(1, len(words) + 1):
        cut = [words[len(words) * k // lines : len(words) * (k + 1) // lines] for k in range(lines)]
        for mark in ("", "# ", "// ", " * ", "-- ", "; "):
            text = "\n".join(mark + " ".join(part) for part in cut) + "."
            assert licences.identifiers(text.encode()) == [14], (lines, mark)


def test_marks_of_comments():
    for line in ("-- {}", "<!-- {} -->", "// {}", "/* {} */", "; {}", "# {}", "* {}", "1. {}", "a. {}", "({})"):
        assert licences.match_rules(licences.identifiers(line.format("Licensed under the MIT License").encode())) == ["MIT"], line


def test_notices_as_they_are_printed():
    gpl2 = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    gpl3 = "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed."
    for text, want in ((gpl2, "GPL-2.0-or-later"), (mpl, "MPL-2.0"), (gpl3, "GPL-3.0-only"), ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "MIT OR Apache-2.0"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1-or-later")):
        assert licences.match_rules(licences.identifiers(text.encode())) == [want]


def test_tables_are_sound():
    assert len(set(licences.SENTENCES.values())) == len(licences.SENTENCES) and len({ids for _, ids in licences.RULES}) == len(licences.RULES)
    assert all(licences.normalise(t.encode()) == t and not licences._BULLET.fullmatch(t.split()[0]) for t in licences.SENTENCES.values())
    assert {1, 2, 15, 25} <= licences.NEUTRAL and all(i in licences.SENTENCES for _, ids in licences.RULES for i in ids)


def test_odd_tables(spark):
    schema = "doc_id long, text string, licences int, sentences string"
    long = "Nothing here. " * 100_000 + "Licensed under the MIT License."
    rows = [(None, "Released under the MIT License", 1, "x"), (1, None, 1, "x"), (1, None, 1, "x"), (2, long, None, None), (3, "", 1, "x")]
    got = licences.scan_licences(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r["doc_id"] or 0), r["licences"]) for r in got) == [(0, ["MIT"]), (1, []), (1, []), (2, ["MIT"]), (3, [])]
    assert licences.scan_licences(spark.createDataFrame([], schema)).count() == 0
