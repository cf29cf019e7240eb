"""License scans by conditional compression.

A block around words that licenses use is compressed alone and with each template as a raw zstandard dictionary. The
templates that reduce its size are ranked by how much, and confirmed in that order by the exact words in which block and
template differ: what a better one has confirmed is not given to a lower one, and what saves nothing is not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import prepare

# Public license texts, headers and statements.
_WARRANTY_MIT = "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
_WARRANTY_BSD = "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
_WARRANTY_ISC = "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def _gnu(kind: str, version: str, program: str = "This program") -> tuple[str, ...]:
    """The statement of a license of the GNU family, and its usual header with and without later versions."""
    return (
        f"This work is licensed under the GNU {kind}, version {version}.", f"Licensed under the GNU {kind} v{version}.",
        f"{program} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"{program} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}, version {version}, as published by the Free Software Foundation.",
    )


def _creative_commons(parts: str, names: str, version: str) -> tuple[str, ...]:
    port = "International" if version == "4.0" else "Unported"
    return (f"Licensed under CC {parts} {version}.", f"This work is licensed under a Creative Commons {names} {version} {port} License.")


#: License id -> the statements, headers and whole texts by which it is given.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.", "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY_MIT,
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-1.0": _gnu("General Public License", "1"),
    "GPL-2.0": _gnu("General Public License", "2"),
    "GPL-3.0": _gnu("General Public License", "3"),
    "LGPL-2.0": _gnu("Library General Public License", "2", "This library"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "This library"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "This library"),
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
    "GFDL-1.3": ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation.",),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", f"{_BSD} {_WARRANTY_BSD}"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", f"{_BSD} {_BSD_NAME} {_WARRANTY_BSD}"),
    "ISC": ("Released under the ISC License.", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_WARRANTY_ISC}"),
    "0BSD": (f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_WARRANTY_ISC}",),
    "Zlib": (
        "Released under the zlib License.",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "MPL-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License 2.0."),
    "EPL-1.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "EUPL-1.2": ("Licensed under the European Union Public Licence, version 1.2.", "Licensed under the EUPL, Version 1.2."),
    "CDDL-1.0": ("The contents of this file are subject to the terms of the Common Development and Distribution License, Version 1.0.",),
    "Artistic-2.0": ("Released under the Artistic License 2.0.",),
    "OFL-1.1": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.",),
    "WTFPL": ("Do What The Fuck You Want To Public License",),
    "ODbL-1.0": ("This database is made available under the Open Database License, version 1.0.",),
    "PostgreSQL": ("Released under the PostgreSQL License.",),
    **{
        f"CC-{parts}-{version}": _creative_commons(parts, names, version)
        for version in ("2.0", "2.5", "3.0", "4.0")
        for parts, names in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
    },
    "CC0-1.0": ("Released under CC0 1.0.", "The author has dedicated the work to the public domain."),
    "ARR": ("All rights reserved.",),
}
#: Words that name a license: one more or less of them is another license. Words before a notice that deny it.
NAMES = "mit apache gnu affero lesser library bsd clause mozilla eclipse european eupl isc zlib boost artistic cc cc0 unlicense postgresql sil nc sa nd noncommercial sharealike noderivatives noncommercial-sharealike attribution documentation".split()
DENIALS = "not no never non isn cannot without neither unlike".split()
#: The tag by which a source file names its license, what an id looks like, and what may follow a template's name.
TAG, TAG_ID, TAG_ENDS = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()\- \t]+)"), re.compile(r"[A-Za-z0-9.\-]+\+?"), ("-only", "-or-later", "+")
_CANDIDATE = re.compile(r"(?i)licen[sc]|permission\W+(?:is|to)|redistribution|public\W+domain|rights\W+reserved|free\W+to\W+copy|provided\W+as|\bCC0\b|\bCC\W+BY")
#: A word may be broken after its hyphen.
_WORD = re.compile(r"[a-z0-9]+(?:(?:-[ \t\r]*\n[\s*#/]*|[.\-])[a-z0-9]+)*")
_BROKEN = re.compile(r"-\s[\s*#/]*")
#: The name is one word, so that the by of an author is another.
_CC_BY = re.compile(r"\bcc[\s*#/-]+by\b")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: The share of its words that a notice must hold; words that may be missing or added in one place.
CONFIRMED, RUN = 0.8, 8
#: A phrase nearer than NEAR words to the last is in its block. Words of a whole text, in which figures are numbers of clauses. Level of compression.
NEAR, WHOLE_TEXT, LEVEL = 60, 100, 3


def words_of(text: str) -> list[str]:
    return [_BROKEN.sub("-", w) for w in _WORD.findall(_CC_BY.sub("cc-by", text.lower()))]


#: Words before and after a candidate phrase that are looked at: the longest notice, wherever in it the phrase stands.
BLOCK_WORDS = NEAR + max(len(words_of(n)) for notices in TEMPLATES.values() for n in notices)
_FIGURES = {w for notices in TEMPLATES.values() for n in notices if len(words_of(n)) < WHOLE_TEXT for w in words_of(n) if any(c.isdigit() for c in w)}
_NAMING = set(NAMES) | {w for notices in TEMPLATES.values() for n in notices for w in words_of(n) if w.startswith(("cc-by", "attribution"))}


def blocks(text: str | None) -> Iterator[tuple[int, str]]:
    """(number of the phrase's line, block): the words around each phrase of the kind that licenses use, across line breaks."""
    for line, _, words, _ in _windows(text):
        yield line, " ".join(words)


def _windows(text: str | None) -> Iterator[tuple[int, int, list[str], list[int]]]:
    """Line of the phrase, number of the first word, words, their lines. A phrase near the last one that gave a window is in that window."""
    text = text or ""
    found = [m.start() for m in _CANDIDATE.finditer(text)]
    if not found:
        return
    breaks = [m.start() for m in re.finditer("\n", text)]
    text = _CC_BY.sub(lambda m: "cc-by".rjust(len(m[0])), text.translate(_LOWER))  # places stay
    spans = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts, at = [a for a, _ in spans], -BLOCK_WORDS
    for phrase in found:
        word = max(0, bisect_right(starts, phrase) - 1)
        if word - at >= NEAR:
            at = word
            here = spans[max(0, word - BLOCK_WORDS) : word + BLOCK_WORDS]
            yield bisect_left(breaks, phrase), max(0, word - BLOCK_WORDS), [_BROKEN.sub("-", text[a:b]) for a, b in here], [bisect_left(breaks, a) for a, _ in here]


def _normal(text: str) -> bytes:
    return " ".join(words_of(text)).encode()


class Scanner:
    """Judges blocks; of blocks that come again it remembers the verdict."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> None:
        self.plain, self.templates = zstandard.ZstdCompressor(level=LEVEL), templates
        self.notices = [(name, words_of(n), zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(_normal(n), dict_type=zstandard.DICT_TYPE_RAWCONTENT))) for name in sorted(templates) for n in templates[name]]
        self.known: dict[str, list] = {}

    def judge(self, block: str) -> tuple[str | None, float, float, str]:
        """The best of judge_all: license (None: none confirmed), saving, share of the notice's words found, and the wording differences."""
        all_of = self.judge_all(block)
        return all_of[0][:4] if all_of else (None, 0.0, 0.0, "")

    def ranked(self, block: str) -> list[tuple[float, str, list[str]]]:
        """Saving, license and words of every notice that makes the block smaller, the largest saving first; equal ones by name."""
        data = _normal(block)
        alone = len(self.plain.compress(data))
        found = [((alone - len(c.compress(data))) / max(1, alone), name, notice) for name, notice, c in self.notices]
        return sorted((x for x in found if x[0] > 0), key=lambda x: (-x[0], x[1], x[2]))

    def judge_all(self, block: str) -> list[tuple[str, float, float, str, int]]:
        """License, saving, share, differences and first word of every notice confirmed, in the order of the savings; words that one has are not another's."""
        if block in self.known:
            return self.known[block]
        own = words_of(block)
        held, out, taken = set(own), [], []
        for saving, name, notice in self.ranked(block):
            if sum(w in held for w in notice) < CONFIRMED * len(notice):
                continue
            for share, diff, first, last in _stated(notice, own):
                if all(last <= a or b <= first for a, b in taken):
                    taken.append((first, last))
                    out.append((name, saving, share, diff, first))
        if len(self.known) < 20_000:
            self.known[block] = out
        return out

    def tagged(self, text: str) -> Iterator[tuple[str, int]]:
        """License and place of every id of the tags' expressions that is a template's, with what may follow a name."""
        for tag in TAG.finditer(text):
            for m in TAG_ID.finditer(tag[1]):
                name = m[0]
                for end in TAG_ENDS:
                    name = name.removesuffix(end)
                if name in self.templates:
                    yield name, tag.start()


def _stated(notice: list[str], own: list[str]) -> Iterator[tuple[float, str, int, int]]:
    """Share, differences, first and last word of each place in own that states notice: around each long common run, then on either side of it."""
    runs, places = SequenceMatcher(None, notice, own, autojunk=False), [(0, len(own))]
    telling = _NAMING if len(notice) >= WHOLE_TEXT else _NAMING | _FIGURES
    while places:
        lo, hi = places.pop()
        held = set(own[lo:hi])
        if hi - lo < CONFIRMED * len(notice) or sum(w in held for w in notice) < CONFIRMED * len(notice):
            continue
        a, b, size = runs.find_longest_match(0, len(notice), lo, hi)
        for slack in (len(notice) // 2 + 3, 2):
            start, end = max(lo, b - a - slack), min(hi, b + len(notice) - a + slack)
            match = SequenceMatcher(None, notice, own[start:end], autojunk=False)
            equal = [m for m in match.get_matching_blocks() if m.size]
            same = sum(m.size for m in equal)
            if same < CONFIRMED * len(notice):
                continue
            first, last = start + equal[0].b, start + equal[-1].b + equal[-1].size
            spans = [(notice[i:j], own[max(first, start + k) : min(last, start + n)] if start + k < last and start + n > first else []) for op, i, j, k, n in match.get_opcodes() if op != "equal"]
            if not _other(notice, spans, telling) and not set(own[max(0, first - 3) : first]) & set(DENIALS):
                yield same / len(notice), "; ".join(f"-{' '.join(gone)} +{' '.join(more)}" for gone, more in spans if gone or more), first, last
                places += [(lo, first), (last, hi)]
                break
        else:
            places += [(lo, b), (b + size, hi)]


def _other(notice: list[str], spans: list[tuple[list[str], list[str]]], telling: set[str]) -> bool:
    """Whether the differences make it another text: a naming word more or less, a denial more, or a passage of its own missing or added."""
    whole = len(notice) >= WHOLE_TEXT
    return any(set(gone) & telling or set(more) & telling or set(more) & set(DENIALS[:3]) or (whole and max(len(gone), len(more)) >= RUN) for gone, more in spans)


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """doc_id, n_blocks, licenses (sorted, distinct) and findings (line, license, saving, share, differences) of every document.

    Null and empty texts have none; whole texts are scanned, however long; repeated rows are scanned each; an empty
    table gives an empty result; other columns are ignored. Of notices that overlap, that with the larger saving counts,
    then the earlier name. A notice right after a denial, or with another license's name in it, is refused. Every id of
    an SPDX-License-Identifier's expression that is a template's is a finding too, with a saving of 0: a name is compared, not compressed.
    """
    prepare(docs.sparkSession)
    finding = "array<struct<line:int,license:string,saving:double,share:double,differences:string>>"
    schema = docs.select("doc_id", F.lit(0).cast("long").alias("n_blocks"), F.array(F.lit("")).alias("licenses"), F.lit(None).cast(finding).alias("findings")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        scanner, target = Scanner(templates), to_arrow_schema(schema)
        for b in batches:
            counts, names, found = [], [], []
            for t in b.column("text").to_pylist():
                hits, n, seen = [], 0, set()
                for _, at, words, lines in _windows(t):
                    n += 1
                    for name, saving, share, diff, first in scanner.judge_all(" ".join(words)):
                        if (name, at + first) in seen:  # blocks overlap
                            continue
                        seen.add((name, at + first))
                        hits.append({"line": lines[first], "license": name, "saving": saving, "share": share, "differences": diff})
                for name, at in scanner.tagged(t or ""):
                    hits.append({"line": (t or "").count("\n", 0, at), "license": name, "saving": 0.0, "share": 1.0, "differences": ""})
                counts.append(n)
                names.append(sorted({h["license"] for h in hits}))
                found.append(hits)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(found, target.field("findings").type)], names=target.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
