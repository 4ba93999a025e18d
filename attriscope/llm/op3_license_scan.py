"""Licence scan by sentence rules (DataFrame functions only).

A text is cut into sentences twice: at sentence ends and blank lines, and at every line
end (a licence line need not end a sentence).  Sentences are normalised (lower
case, runs of other characters than a-z and 0-9 to one space, so comment marks go; the holder's
name in "neither the name of ..." becomes one fixed word) and mapped to the
identifiers of known licence sentences.  A third sequence holds the terms of SPDX identifier lines:
each is cut at its operators and brackets, and every term is a sentence of its own.
The sequences of identifiers, in text order, are matched
against ordered rules: a rule holds if its sentences occur in its order inside one sequence, others
between them allowed.

Sentences, SPDX terms and rules are arguments of ``scan``: any table of the same form can take the
place of the given one, which knows the notices, headers and title lines of ``len(LICENSES)`` licences.

Everything happens inside a row: no join, no shuffle, no hot key.  Known
sentences are a constant list.  Each of them holds one of the words in ``CUES``
(checked when a table is made), so a text without any of these needs no sentence split.

Edge cases: null and empty texts have no licence, nor has a text whose licence is outside the rules; a text may match several rules
(all are returned, in rule order) or one rule several times (returned once); a text under a choice of licences
gets all of them; SPDX terms outside the list are passed over; repeated
rows get equal results; an empty table gives no row.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attriscope.llm.common import table

# Sentences of public licence texts and notices, in their own wording.
SENTENCES = {
    1: "Licensed under the Apache License, Version 2.0",
    2: "you may not use this file except in compliance with the License",
    3: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    4: "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    5: "See the License for the specific language governing permissions and limitations under the License",
    6: "Licensed under the Apache License, Version 2.0 (the \"License\")",
    7: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    8: "Released under the MIT License",
    9: "MIT License",
    10: "The MIT License (MIT)",
    11: "Licensed under the MIT License",
    12: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
        " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    13: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    14: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    15: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    20: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    21: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    22: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    23: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    24: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    30: "This work is licensed under the GNU General Public License, version 3",
    31: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    32: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    33: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    34: "either version 2 of the License, or (at your option) any later version",
    35: "This work is licensed under the GNU General Public License, version 2",
    36: "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    40: "Licensed under CC BY-NC 4.0",
    41: "Licensed under CC BY 4.0",
    42: "Licensed under CC BY-SA 4.0",
    43: "This work is licensed under a Creative Commons Attribution 4.0 International License",
    44: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    45: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    50: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    51: "This is free and unencumbered software released into the public domain; no license restricts it",
    70: "Apache License Version 2.0, January 2004",
    71: "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    72: "Apache License, Version 2.0",
    73: "Licensed under the Apache-2.0 License",
    74: "This project is licensed under the Apache License 2.0",
    75: "This project is licensed under the MIT License",
    76: "This software is released under the MIT License",
    77: "Distributed under the MIT License",
    78: "Licensed under the MIT license",
    80: "Licensed under either of Apache License, Version 2.0 or MIT license at your option",
    81: "Licensed under either the Apache License, Version 2.0 or the MIT license, at your option",
    82: "Licensed under the MIT License or the Apache License, Version 2.0",
    83: "Licensed under the Apache License, Version 2.0 or the MIT License",
    84: "Dual-licensed under MIT and Apache 2.0",
    85: "Dual-licensed under the MIT License and the Apache License, Version 2.0",
    86: "Dual licensed under the MIT and GPL licenses",
    87: "Licensed under the Apache License, Version 2.0 <LICENSE-APACHE or http://www.apache.org/licenses/LICENSE-2.0> or the MIT license <LICENSE-MIT or http://opensource.org/licenses/MIT>, at your option",
    88: "Licensed under the Apache License, Version 2.0 <LICENSE-APACHE or https://www.apache.org/licenses/LICENSE-2.0> or the MIT license <LICENSE-MIT or https://opensource.org/licenses/MIT>, at your option",
    90: "Redistributions of source code must retain the above copyright notice, this list of conditions, and the following disclaimer",
    91: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions, and the following disclaimer in the documentation and/or other materials provided with the distribution",
    92: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    93: "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    94: "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    95: "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    96: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    98: "Licensed under the BSD 3-Clause License",
    99: "Licensed under the BSD 2-Clause License",
    100: "BSD 3-Clause License",
    101: "BSD 2-Clause License",
    102: "BSD Zero Clause License",
    110: "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    111: "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    112: "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    113: "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    114: "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
    115: "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    116: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    117: "either version 2.1 of the License, or (at your option) any later version",
    118: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    119: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    120: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    121: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    122: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    123: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2",
    124: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3",
    125: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    126: "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    127: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    128: "either version 3 of the License, or (at your option) any later version",
    129: "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    141: "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    142: "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    143: "Mozilla Public License Version 2.0",
    144: "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")",
    145: "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    146: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    147: "Eclipse Public License - v 1.0",
    148: "Eclipse Public License - v 2.0",
    149: "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0",
    150: "Boost Software License - Version 1.0 - August 17th, 2003",
    151: "Distributed under the Boost Software License, Version 1.0",
    152: "This software is provided 'as-is', without any express or implied warranty",
    153: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    154: "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004",
    155: "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    156: "Licensed under CC0 1.0",
    157: "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    158: "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    159: "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    160: "This work is licensed under a Creative Commons Attribution 3.0 Unported License",
    161: "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License",
    162: "Licensed under CC BY-ND 4.0",
    163: "Licensed under CC BY-NC-SA 4.0",
    164: "Licensed under CC BY-NC-ND 4.0",
    165: "Licensed under CC BY 3.0",
    166: "Licensed under CC BY-SA 3.0",
    167: "Licensed under the EUPL, Version 1.2",
    168: "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\")",
    169: "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    170: "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007",
    171: "The Artistic License 2.0",
    172: "PostgreSQL License",
    173: "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2",
    174: "Academic Free License version 3.0",
    175: "Microsoft Public License (Ms-PL)",
    176: "The Universal Permissive License (UPL), Version 1.0",
    177: "Open Software License version 3.0",
    178: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
}

# SPDX identifiers; each is the sentence 1000 + its place here.
FIRST_TERM = 1000
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 "
    "CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 "
    "GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only "
    "LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OSL-3.0 PostgreSQL PSF-2.0 UPL-1.0 Unlicense WTFPL Zlib"
).split()

# Licence, ordered sentence identifiers (a group of alternatives in one place).
TEXT_RULES = [
    ("Apache-2.0", [(1, 6, 70, 71, 72, 73, 74, 80, 81, 82, 83, 84, 85, 87, 88)]),
    ("Apache-2.0", [(2,), (3,), (4, 7), (5,)]),
    ("MIT", [(8, 9, 10, 11, 75, 76, 77, 78, 80, 81, 82, 83, 84, 85, 86, 87, 88)]),
    ("MIT", [(12, 15), (14,)]),
    ("BSD-2-Clause", [(20, 92), (21, 90), (22, 91)]),
    ("BSD-2-Clause", [(99, 101)]),
    ("BSD-3-Clause", [(20, 92), (21, 90), (22, 91), (23, 93)]),
    ("BSD-3-Clause", [(98, 100)]),
    ("BSD-4-Clause", [(20, 92), (21, 90), (94,), (23, 93)]),
    ("0BSD", [(96, 102)]),
    ("ISC", [(24, 95)]),
    ("GPL-3.0", [(30, 31, 110, 124)]),
    ("GPL-3.0", [(33, 127), (128,)]),
    ("GPL-2.0", [(32, 35, 111, 121, 122, 123)]),
    ("GPL-2.0", [(33, 127), (34,)]),
    ("LGPL-3.0", [(36, 112, 120)]),
    ("LGPL-3.0", [(116, 125), (128,)]),
    ("LGPL-2.1", [(113,)]),
    ("LGPL-2.1", [(116, 125), (117,)]),
    ("LGPL-2.0", [(114,)]),
    ("LGPL-2.0", [(118, 126), (34,)]),
    ("AGPL-3.0", [(115, 119)]),
    ("AGPL-3.0", [(129,), (128,)]),
    ("CC-BY-NC-4.0", [(40, 44)]),
    ("CC-BY-4.0", [(41, 43)]),
    ("CC-BY-SA-4.0", [(42, 45)]),
    ("CC-BY-ND-4.0", [(157, 162)]),
    ("CC-BY-NC-SA-4.0", [(158, 163)]),
    ("CC-BY-NC-ND-4.0", [(159, 164)]),
    ("CC-BY-3.0", [(160, 165)]),
    ("CC-BY-SA-3.0", [(161, 166)]),
    ("CC0-1.0", [(155, 156)]),
    ("MPL-2.0", [(50, 141, 142, 143)]),
    ("MPL-1.1", [(144,)]),
    ("EPL-1.0", [(145, 147)]),
    ("EPL-2.0", [(146, 148)]),
    ("CDDL-1.0", [(149,)]),
    ("BSL-1.0", [(150, 151)]),
    ("Zlib", [(152,), (153,)]),
    ("WTFPL", [(154,)]),
    ("EUPL-1.2", [(167, 168)]),
    ("OFL-1.1", [(169, 170)]),
    ("Artistic-2.0", [(171,)]),
    ("PostgreSQL", [(172,)]),
    ("PSF-2.0", [(173,)]),
    ("AFL-3.0", [(174,)]),
    ("MS-PL", [(175,)]),
    ("UPL-1.0", [(176,)]),
    ("OSL-3.0", [(177,)]),
    ("Unlicense", [(51, 178)]),
]

SPDX_RULES = [(re.sub("-(only|or-later)$", "", term), [(FIRST_TERM + i,)]) for i, term in enumerate(SPDX)]
RULES = TEXT_RULES + SPDX_RULES
LICENSES = list(dict.fromkeys(name for name, _ in RULES))

CUES = ("licens", "copyright", "permi", "warrant", "distribut", "advertising")
SENTENCE_END = r"[.;!?]+\s+|:[ \t\r]*\n|\n\s*\n"
SPDX_LINE = r"spdx-license-identifier:([^\n]*)"
SPDX_CUT = r"[ \t]+(?:or|and|with)[ \t]+|[()]"
OTHER = "[^a-z0-9]+"
HOLDER = "^neither the name of .* nor the names of "
ANY_HOLDER = "neither the name of holder nor the names of "


def normal(sentence: str) -> str:
    return re.sub(HOLDER, ANY_HOLDER, re.sub(OTHER, " ", sentence.lower()).strip())


class Known(NamedTuple):
    """A licence table: normalised sentences and SPDX terms with their identifiers, and the pattern of each rule."""

    sentences: list[tuple[str, int]]
    terms: list[tuple[str, int]]
    rules: list[tuple[str, str]]


def known(sentences: dict[int, str], terms: list[str], rules: list[tuple[str, list[tuple[int, ...]]]]) -> Known:
    """The table of ``sentences`` (by identifier), SPDX ``terms`` and ordered ``rules``.

    A listed text that holds a sentence end inside counts as it stands on one line.
    """
    listed = {}
    for k, s in sentences.items():
        parts = [p for p in map(normal, re.split(SENTENCE_END, s)) if p]
        listed[parts[0] if len(parts) == 1 else normal(s)] = k
    without = [s for s in listed if not any(c in s for c in CUES)]
    if without:
        raise ValueError(f"no sentence without one of {CUES}: {without}")
    ordered = sorted(listed.items(), key=lambda x: x[1])
    return Known(ordered, [(normal(t), FIRST_TERM + i) for i, t in enumerate(terms)], [(n, rule_pattern(p)) for n, p in rules])


def rule_pattern(places: list[tuple[int, ...]]) -> str:
    """Pattern over ",1,2,3," that holds if the places occur in order."""
    return "," + "([0-9]+,)*".join("(" + "|".join(f"{i}" for i in p) + ")," for p in places)


GIVEN = known(SENTENCES, SPDX, RULES)


def _ids(parts: Column, listed: list[tuple[str, int]]) -> Column:
    """",id,id," of the listed sentences among ``parts``, in order."""
    names = F.array(*[F.lit(s) for s, _ in listed])
    ids = F.array(*[F.lit(k) for _, k in listed])

    def place(s: Column) -> Column:
        return F.array_position(names, F.regexp_replace(F.trim(F.regexp_replace(s, OTHER, " ")), HOLDER, ANY_HOLDER))

    found = F.transform(F.filter(F.transform(parts, place), lambda k: k > 0), lambda k: F.element_at(ids, k.cast("int")).cast("string"))
    return F.concat(F.lit(","), F.array_join(found, ","), F.lit(","))


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, using: Known = GIVEN) -> DataFrame:
    """Columns ``keep`` (default all) with licenses array<string>, n_licenses and sentence_ids (of the three sequences, as text)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("licenses", "n_licenses", "sentence_ids")]
    low = F.lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    cue = F.lit(False)
    for c in CUES:
        cue = cue | low.contains(c)
    terms = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(SPDX_LINE), F.lit(1)), lambda s: F.split(s, SPDX_CUT)))
    sequences = [_ids(F.split(low, SENTENCE_END), using.sentences), _ids(F.split(low, r"\n"), using.sentences), _ids(terms, using.terms)]
    seq = F.when(cue, F.concat_ws("|", *sequences)).otherwise(F.lit(",,|,,|,,"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), seq.alias("sentence_ids"))
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern")) for n, p in using.rules])
    hits = F.transform(F.filter(rules, lambda r: F.rlike(F.col("sentence_ids"), r["pattern"])), lambda r: r["name"])
    none = F.array().cast("array<string>")
    licenses = F.when(F.col("sentence_ids").rlike("[0-9]"), F.array_distinct(hits)).otherwise(none)
    return row.select("row.*", licenses.alias("licenses"), F.size(licenses).cast("long").alias("n_licenses"), "sentence_ids")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """All documents; the licences as one comma-separated text."""
    out = scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_licenses", "sentence_ids")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_ids(cut: str, listed: list[tuple[str, int]]) -> str:
    names = "[" + ", ".join(_quoted(s) for s, _ in listed) + "]"
    ids = "[" + ", ".join(str(k) for _, k in listed) + "]"
    clean = f"regexp_replace(trim(regexp_replace(s, '{OTHER}', ' ', 'g'), ' '), '{HOLDER}', '{ANY_HOLDER}')"
    pos = f"list_transform({cut}, lambda s: coalesce(list_position({names}, {clean}), 0))"
    found = f"list_transform(list_filter({pos}, lambda k: k > 0), lambda k: {ids}[k])"
    return f"concat(',', coalesce(array_to_string({found}, ','), ''), ',')"


def _sql(using: Known) -> str:
    ends = _sql_ids(f"string_split_regex(low, '{SENTENCE_END}')", using.sentences)
    lines = _sql_ids(r"string_split_regex(low, '\n')", using.sentences)
    terms = _sql_ids(f"flatten(list_transform(regexp_extract_all(low, '{SPDX_LINE}', 1), lambda x: string_split_regex(x, '{SPDX_CUT}')))", using.terms)
    rules = ", ".join(f"{{'name': {_quoted(n)}, 'pattern': {_quoted(p)}}}" for n, p in using.rules)
    return f"""
WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents),
s AS (SELECT doc_id, concat({ends}, '|', {lines}, '|', {terms}) AS sentence_ids FROM t),
h AS (SELECT doc_id, sentence_ids, list_transform(list_filter([{rules}], lambda r: regexp_matches(sentence_ids, r.pattern)), lambda r: r.name) AS hits FROM s),
d AS (SELECT doc_id, sentence_ids, list_filter(hits, lambda x, i: list_position(hits, x) = i) AS licenses FROM h)
SELECT doc_id, coalesce(array_to_string(licenses, ','), '') AS licenses, len(licenses)::BIGINT AS n_licenses, sentence_ids FROM d
"""


OP3_SQL = _sql(GIVEN)
