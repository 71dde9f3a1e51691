"""Licence scan by sentence rules.

A text is cut into sentences, which are normalised and looked up among known licence sentences; what is left of the
text is the sequence of their identifiers, with a break where more than MAX_GAP other sentences stand between two. A
rule is an ordered list of identifiers that names a licence; it matches where its identifiers follow one another.
Sentences that are in no rule (copyright lines, disclaimers) may stand between. At each place the longest rule wins, and
the search goes on after it.

Sentences end at a line feed, or after `.`, `!`, `?` or `;` before white space. A known sentence that is wrapped over any
number of lines is found too: its words are followed in a trie of all known sentences, which goes on from a piece without
an end to the next; the longest that ends with a piece counts. Pieces without letters and digits, such as the marks of comments, are passed over.

Normal form: A-Z lower-cased, each run of other characters than a-z, 0-9, `.`, `+` and `-` a blank, blanks, `.` and `-` cut
off at both ends, as are numbers and letters of lists at the start. A sentence that begins with "copyright" is known by that word.

Defined results: null, empty and unlicensed texts give empty lists; texts of any length are scanned whole; of rules that
match at one place the longest wins, and no two have the same identifiers, so there are no ties; repeated rows are each
scanned; extra columns are ignored; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import as_bytes

MAX_GAP = 3
COPYRIGHT = 1

# Sentences of public licences and notices, in their normal form, by identifier.
SENTENCES: dict[int, str] = {
    1: "copyright",
    2: "all rights reserved",
    10: "released under the mit license",
    11: "licensed under the mit license",
    13: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    14: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    15: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    16: "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    17: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    20: "licensed under the apache license version 2.0",
    21: "licensed under the apache license version 2.0 the license",
    22: "you may not use this file except in compliance with the license",
    23: "you may obtain a copy of the license at http www.apache.org licenses license-2.0",
    25: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    26: "see the license for the specific language governing permissions and limitations under the license",
    27: "apache license version 2.0 january 2004 http www.apache.org licenses",
    28: "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non-exclusive no-charge royalty-free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    30: "this work is licensed under the gnu general public license version 3",
    31: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    32: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    33: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    36: "this program is free software",
    37: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    38: "either version 2 of the license or at your option any later version",
    39: "either version 3 of the license or at your option any later version",
    50: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    51: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    52: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    53: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    55: "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    56: "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    60: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    61: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    62: "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    70: "this is free and unencumbered software released into the public domain",
    71: "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means",
    80: "this source code form is subject to the terms of the mozilla public license v. 2.0",
    81: "this source code form is subject to the terms of the mozilla public license v",
    82: "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
    83: "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    84: "mozilla public license version 2.0",
    90: "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third-parties to whom the software is furnished to do so all subject to the following",
    91: "boost software license - version 1.0 - august 17th 2003",
    95: "this software is provided as-is without any express or implied warranty",
    96: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    100: "gnu general public license version 3 29 june 2007",
    101: "gnu general public license version 2 june 1991",
    102: "gnu lesser general public license version 3 29 june 2007",
    103: "gnu lesser general public license version 2.1 february 1999",
    104: "gnu affero general public license version 3 19 november 2007",
    105: "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    106: "this library is free software",
    107: "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    108: "either version 2.1 of the license or at your option any later version",
    109: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    110: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    111: "this program is distributed in the hope that it will be useful but without any warranty",
    112: "this library is distributed in the hope that it will be useful but without any warranty",
    113: "without even the implied warranty of merchantability or fitness for a particular purpose",
    114: "you should have received a copy of the gnu general public license along with this program",
    115: "as a special exception the copyright holders of this library give you permission to link this library with independent modules to produce an executable regardless of the license terms of these independent modules",
    116: "cc0 1.0 universal",
}

# Ordered rules, each the licence's SPDX identifier and the identifiers of its sentences.
RULES: tuple[tuple[str, tuple[int, ...]], ...] = (
    ("MIT", (10,)),
    ("MIT", (11,)),
    ("MIT", (13, 14)),
    ("MIT-0", (17,)),
    ("Apache-2.0", (20,)),
    ("Apache-2.0", (21, 22)),
    ("Apache-2.0", (27, 28)),
    ("Apache-2.0", (27,)),
    ("GPL-3.0-only", (30,)),
    ("GPL-3.0-or-later", (31,)),
    ("GPL-2.0-or-later", (32,)),
    ("GPL-2.0-or-later", (36, 37, 38)),
    ("GPL-3.0-or-later", (36, 37, 39)),
    ("GPL-3.0-only", (100, 105)),
    ("GPL-2.0-only", (101, 105)),
    ("LGPL-3.0-only", (102, 105)),
    ("LGPL-2.1-only", (103, 105)),
    ("AGPL-3.0-only", (104, 105)),
    ("LGPL-2.1-or-later", (106, 107, 108)),
    ("LGPL-3.0-or-later", (106, 107, 39)),
    ("LGPL-3.0-or-later", (110,)),
    ("AGPL-3.0-or-later", (109,)),
    ("GPL-3.0-or-later WITH GCC-exception-3.1", (31, 115)),
    ("BSD-2-Clause", (50, 51, 52)),
    ("BSD-3-Clause", (50, 51, 52, 53)),
    ("BSD-4-Clause", (50, 51, 52, 55, 53)),
    ("ISC", (60,)),
    ("0BSD", (61,)),
    ("Unlicense", (70,)),
    ("MPL-2.0", (80,)),
    ("MPL-2.0", (81, 82)),
    ("MPL-2.0", (81, 83)),
    ("MPL-2.0", (84,)),
    ("BSL-1.0", (90,)),
    ("BSL-1.0", (91, 90)),
    ("Zlib", (96,)),
    ("CC0-1.0", (116,)),
)

# Names of licences in notices, and what may stand before them.
_NAMED = {
    "mit license": "MIT", "apache license version 2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0", "gnu general public license version 2": "GPL-2.0-only",
    "gnu general public license version 3": "GPL-3.0-only", "gnu lesser general public license version 3": "LGPL-3.0-only", "gnu affero general public license version 3": "AGPL-3.0-only",
    "bsd 2-clause license": "BSD-2-Clause", "bsd 3-clause license": "BSD-3-Clause", "isc license": "ISC", "mozilla public license version 2.0": "MPL-2.0", "boost software license version 1.0": "BSL-1.0",
    "zlib license": "Zlib", "unlicense": "Unlicense",
}
_GRANTS = ("released under the", "licensed under the", "distributed under the", "this project is licensed under the", "this work is licensed under the")
_CREATIVE = {"BY": "attribution", "BY-SA": "attribution-sharealike", "BY-NC": "attribution-noncommercial", "BY-ND": "attribution-noderivatives", "BY-NC-SA": "attribution-noncommercial-sharealike", "BY-NC-ND": "attribution-noncommercial-noderivatives"}
_EITHER = (("MIT", "Apache-2.0"), ("Apache-2.0", "MIT"), ("MIT", "GPL-2.0-only"), ("GPL-2.0-only", "MIT"))


def _generated() -> dict[str, str]:
    """Sentences that are a licence's name in a pattern, with the name each stands for."""
    out = {f"{grant} {name}": spdx for grant in _GRANTS for name, spdx in _NAMED.items()}
    for code, words in _CREATIVE.items():
        for start in ("licensed under", "this work is licensed under"):
            out[f"{start} cc {code.lower()} 4.0"] = out[f"{start} a creative commons {words} 4.0 international license"] = f"CC-{code}-4.0"
    for spdx in sorted({name for name, _ in RULES if " " not in name} | set(out.values())):
        out[f"spdx-license-identifier {spdx.lower()}"] = spdx
    for a, b in _EITHER:
        out[f"spdx-license-identifier {a.lower()} or {b.lower()}"] = f"{a} OR {b}"
    return out


_fixed = set(SENTENCES.values())
for _i, (_text, _name) in enumerate(sorted((t, n) for t, n in _generated().items() if t not in _fixed), 1000):
    SENTENCES[_i] = _text
    RULES += ((_name, (_i,)),)

#: Sentences that may stand between those of a rule.
NEUTRAL = frozenset(SENTENCES) - {i for _, ids in RULES for i in ids}
_PIECE = re.compile(rb"\n+|(?<=[.!?;])[\t\x0b\x0c\r ]+")
_OTHER = re.compile(rb"[^a-z0-9.+-]+")
_BULLET = re.compile(r"[0-9]+\.?|-|[a-z]\.")


def _trie() -> dict:
    root: dict = {}
    for i, text in SENTENCES.items():
        node = root
        for word in text.split():
            node = node.setdefault(word, {})
        node[""] = i
    return root


_TRIE = _trie()
_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[1]))


def normalise(sentence: bytes) -> str:
    return _OTHER.sub(b" ", sentence.lower()).decode("ascii").strip(" .-")


def _known(pieces: list[tuple[list[str], bool]], at: int) -> tuple[int, int]:
    """Identifier of the longest known sentence that begins at a piece and ends with one, and its number of pieces."""
    node, begun, found = _TRIE, False, (0, 0)
    first = next((w for w in pieces[at][0] if not _BULLET.fullmatch(w)), "")
    if first == "copyright":
        found = COPYRIGHT, 1
    for size in range(1, len(pieces) - at + 1):
        words, ended = pieces[at + size - 1]
        for word in words:
            if not begun and _BULLET.fullmatch(word):
                continue
            begun = True
            node = node.get(word)
            if node is None:
                return found
        if "" in node:
            found = node[""], size
        if ended:
            break
    return found


def identifiers(text: bytes) -> list[int]:
    """Identifiers of the known sentences in order; 0 marks a break."""
    normal = ((normalise(p), p[-1:] in b".!?;") for p in _PIECE.split(text) if p)
    pieces = [(words.split(), ended) for words, ended in normal if words]
    found, gap, i = [], 0, 0
    while i < len(pieces):
        known, size = _known(pieces, i)
        if known:
            if found and gap > MAX_GAP:
                found.append(0)
            found.append(known)
            gap, i = 0, i + size
        else:
            gap, i = gap + 1, i + 1
    return found


def match_rules(ids: list[int], rules: tuple[tuple[str, tuple[int, ...]], ...] | None = None) -> list[str]:
    """Licences of the rules that match, in order of place."""
    longest = _BY_LENGTH if rules is None else sorted(rules, key=lambda r: -len(r[1]))
    ids = [i for i in ids if i not in NEUTRAL]
    found, i = [], 0
    while i < len(ids):
        hit = next(((name, rule) for name, rule in longest if tuple(ids[i : i + len(rule)]) == rule), None)
        if hit:
            found.append(hit[0])
        i += len(hit[1]) if hit else 1
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [identifiers(t.as_py()) for t in batch.column("text")]
        names = [match_rules(i) for i in ids]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(ids, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], names=["id", "sentences", "licences"]
        )


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, sentences (identifiers, 0 for a break), licences (in order of place)."""
    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text"))
        .mapInArrow(_scan, f"id {kind}, sentences array<int>, licences array<string>")
        .withColumnRenamed("id", id_col)
    )
