"""Licence scans by sentence rules.

A text is split into sentences, each is normalised (lower case, letters, digits and dots within numbers, single spaces), and
a sentence known from a licence gets that sentence's identifier. A rule is an ordered sequence of identifiers; it matches
where its identifiers follow each other among the text's identified sentences (other sentences may lie between).
Each licence reports the greatest share of a rule that matched, at least its rule's least share.

Defined results: a null or empty text has no licences; texts are read whole; repeated rows get the same result; further
columns are ignored; a sentence found twice counts where the order of the rule needs it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from partwise.llm.common import column, slices, with_columns

# Licences by their SPDX identifiers, with the names by which notices call them.
NAMES = {
    "MIT": ["the MIT License", "MIT License", "MIT"],
    "ISC": ["the ISC License", "ISC License", "ISC"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache License 2.0", "Apache 2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "BSD 2-Clause License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "BSD 3-Clause License", "the New BSD License"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU General Public License version 2", "the GNU GPL v2", "GPLv2", "GPL-2.0-only", "GPL-2.0-or-later"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU General Public License version 3", "the GNU GPL v3", "GPLv3", "GPL-3.0-only", "GPL-3.0-or-later"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "the GNU LGPL v2.1", "LGPLv2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "the GNU LGPL v3", "LGPLv3", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "the GNU AGPL v3", "AGPLv3", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "MPL-2.0": ["the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0", "MPL 2.0"],
    "EPL-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License, version 2.0", "EPL 2.0"],
    "BSL-1.0": ["the Boost Software License, Version 1.0", "the Boost Software License 1.0"],
    "Zlib": ["the zlib License", "zlib License"],
    "Unlicense": ["the Unlicense", "The Unlicense"],
    "WTFPL": ["the Do What The Fuck You Want To Public License, Version 2", "WTFPL"],
    "CC0-1.0": ["CC0 1.0", "CC0", "the Creative Commons Zero v1.0 Universal", "the CC0 1.0 Universal Public Domain Dedication"],
}
# The elements of Creative Commons licences and their versions.
CC_NAMES = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = ["2.0", "2.5", "3.0", "4.0"]
for _k, _name in CC_NAMES.items():
    for _v in CC_VERSIONS:
        _long = f"Creative Commons {_name} {_v}"
        _port = "International" if _v == "4.0" else "Unported"
        NAMES[f"CC-{_k}-{_v}"] = [f"CC {_k} {_v}", f"CC-{_k} {_v}", _long, f"a {_long} License", f"a {_long} {_port} License", f"the {_long} {_port} License"]
# How notices name a licence.
NOTICES = ["Licensed under {}", "Released under {}", "Distributed under {}", "Available under {}", "License: {}", "SPDX-License-Identifier: {}"]
NOTICES += [f"This {x} is {y} under {{}}" for x in ("work", "project", "program", "software", "file", "code", "document", "library") for y in ("licensed", "released", "distributed")]
NOTICES += [f"{x} {y} under the terms of {{}}" for x in ("This software is", "This program is", "This project is", "This work is") for y in ("licensed", "released", "distributed")]

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"
_GPL = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
_HOPE = "This {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"
# Sentences of public licences.
SENTENCES = {
    "mit.grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit.condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit.warranty": [_AS_IS],
    "mit.liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "isc.grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "isc.warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "apache2.notice": ["Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "apache2.comply": ["you may not use this file except in compliance with the License"],
    "apache2.copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "apache2.as_is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache2.limits": ["See the License for the specific language governing permissions and limitations under the License"],
    "gpl2.free": [_GPL.format("program", x, "", "2") for x in (";", ":")],
    "gpl3.free": [_GPL.format("program", x, "", "3") for x in (":", ";")],
    "lgpl21.free": [_GPL.format("library", x, "Lesser ", "2.1") for x in (";", ":")],
    "lgpl3.free": [_GPL.format(y, x, "Lesser ", "3") for x in (":", ";") for y in ("program", "library")],
    "agpl3.free": [_GPL.format("program", x, "Affero ", "3") for x in (":", ";")],
    "gpl.hope": [_HOPE.format(x) for x in ("program", "library")],
    "gpl.details": ["See the GNU General Public License for more details", "See the GNU Lesser General Public License for more details", "See the GNU Affero General Public License for more details"],
    "bsd.redistribution": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd.source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd.binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd.endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "cc0.waived": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "mpl2.form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "mpl2.copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "epl2.form": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "bsl.grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "zlib.as_is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib.grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "unlicense.domain": ["This is free and unencumbered software released into the public domain"],
    "unlicense.anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "reserved": ["All rights reserved"],
}
for _id, _each in NAMES.items():
    SENTENCES.setdefault(f"{_id}.notice", []).extend(dict.fromkeys([x.format(n) for x in NOTICES for n in _each] + [f"SPDX-License-Identifier: {_id}"]))
# Licence, sentence identifiers in order, the least share of them.
RULES = [
    *((_id, [f"{_id}.notice"], 1.0) for _id in NAMES),
    ("MIT", ["mit.grant", "mit.condition", "mit.warranty", "mit.liability"], 0.5),
    ("ISC", ["isc.grant", "isc.warranty"], 0.5),
    ("Apache-2.0", ["apache2.notice"], 1.0),
    ("Apache-2.0", ["apache2.comply", "apache2.copy", "apache2.as_is", "apache2.limits"], 0.5),
    ("GPL-2.0", ["gpl2.free", "gpl.hope", "gpl.details"], 1.0),
    ("GPL-2.0", ["gpl2.free"], 1.0),
    ("GPL-3.0", ["gpl3.free", "gpl.hope", "gpl.details"], 1.0),
    ("GPL-3.0", ["gpl3.free"], 1.0),
    ("LGPL-2.1", ["lgpl21.free"], 1.0),
    ("LGPL-3.0", ["lgpl3.free"], 1.0),
    ("AGPL-3.0", ["agpl3.free"], 1.0),
    ("BSD-3-Clause", ["bsd.redistribution", "bsd.source", "bsd.binary", "bsd.endorse"], 1.0),
    ("BSD-2-Clause", ["bsd.redistribution", "bsd.source", "bsd.binary"], 1.0),
    ("CC0-1.0", ["cc0.waived"], 1.0),
    ("MPL-2.0", ["mpl2.form"], 1.0),
    ("MPL-2.0", ["mpl2.copy"], 1.0),
    ("EPL-2.0", ["epl2.form"], 1.0),
    ("BSL-1.0", ["bsl.grant"], 1.0),
    ("Zlib", ["zlib.as_is", "zlib.grant"], 1.0),
    ("Unlicense", ["unlicense.domain", "unlicense.anyone"], 0.5),
    ("Proprietary", ["reserved"], 1.0),
]
#: A licence whose full rule holds another's full rule stands instead of it.
INSTEAD = {"BSD-3-Clause": "BSD-2-Clause"}

_SPLIT = re.compile(r"\n+|(?<=[.!?;:])\s+(?=\S)")
_SIGNS = re.compile(r"[^\w.]+")
_DOTS = re.compile(r"\.(?!\d)|(?<!\d)\.")


def normal(sentence: str) -> str:
    return " ".join(_DOTS.sub(" ", _SIGNS.sub(" ", sentence.lower())).split())


KNOWN = {normal(s): k for k, each in SENTENCES.items() for s in each}
#: The rules that have a sentence.
RULES_OF = {k: [(name, tuple(rule), least) for name, rule, least in RULES if k in rule] for k in SENTENCES}
FIRST = {k.split(" ", 1)[0] for k in KNOWN}
_WORD = re.compile(r"\w+")
TREE: dict = {}  # word -> tree of the words after it; "" -> the identifier of a sentence that ends there
for _k, _id in KNOWN.items():
    _at = TREE
    for _w in _k.split():
        _at = _at.setdefault(_w, {})
    _at[""] = _id


def begins(part: str) -> bool:
    """Whether the part may begin a known sentence."""
    word = _WORD.search(part)
    return word is not None and word[0].lower() in FIRST


def known(parts: list[str]) -> list[str]:
    """The identifiers of the known sentences that are runs of whole parts, in order; of those that begin at a part, the longest."""
    ids, i = [], 0
    while i < len(parts):
        at, last, j = TREE if begins(parts[i]) else None, None, i
        while at is not None and j < len(parts):
            for w in normal(parts[j]).split():
                at = at.get(w)
                if at is None:
                    break
            j += 1
            if at is not None and "" in at:
                last = at[""], j
        if last:
            ids.append(last[0])
        i = last[1] if last else i + 1
    return ids


def identifiers(text: str | None) -> list[str]:
    """The identifiers of the known sentences, in order. A sentence may be of several lines of a paragraph."""
    return [k for paragraph in re.split(r"\n\s*\n", text or "") for k in known(_SPLIT.split(paragraph))]


def matched(ids: list[str], rule: tuple[str, ...]) -> float:
    """The share of the rule in the longest sequence that it and the identifiers have in common, in order."""
    best = [0] * (len(rule) + 1)
    for x in ids:
        before = best[:]
        for j, r in enumerate(rule, 1):
            best[j] = before[j - 1] + 1 if x == r else max(before[j], best[j - 1])
    return best[-1] / len(rule)


def licences(text: str | None) -> tuple[list[str], list[tuple[str, float]]]:
    ids = identifiers(text)
    found: dict[str, float] = {}
    if ids:
        for name, rule, least in dict.fromkeys(r for i in ids for r in RULES_OF[i]):
            if (share := matched(ids, rule)) >= least - 0.01:
                found[name] = max(share, found.get(name, 0.0))
        for name, other in INSTEAD.items():
            if name in found:
                found.pop(other, None)
    return ids, sorted(found.items())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licences (array of names, sorted), coverage (of the best rule, for each), n_sentences (identified)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            each = [licences(t) for t in column(batch, "text")]
            yield with_columns(batch, ["doc_id"], {
                "licences": pa.array([[n for n, _ in f] for _, f in each], pa.list_(pa.string())),
                "coverage": pa.array([[s for _, s in f] for _, f in each], pa.list_(pa.float64())),
                "n_sentences": pa.array([len(i) for i, _ in each], pa.int64()),
            })

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, licences array<string>, coverage array<double>, n_sentences long")
