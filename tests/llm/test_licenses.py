"""Notices as they stand in real texts."""

import textwrap

from lectern.llm import licenses


def found(text):
    scanner = licenses.Scanner()
    return {x[0] for _, block in licenses.blocks(text) for x in scanner.judge_all(block)}


def test_notices_that_name_an_author():
    assert found("Released by Jane under the MIT License.") == {"MIT"}
    assert found("This work by Jane Doe is licensed under the GNU General Public License, version 3.") == {"GPL-3.0"}
    assert found("Licensed by Jane under CC BY 4.0.") == found("Licensed under CC-BY 4.0.") == {"CC-BY-4.0"}
    assert found("Licensed by Jane under CC BY-NC 4.0.") == {"CC-BY-NC-4.0"} and not found("Licensed by Jane under CC 4.0.")


def test_every_notice_of_a_block_is_confirmed():
    assert found("Licensed under CC BY 4.0. Code: Released under the MIT License. All rights reserved.") == {"CC-BY-4.0", "MIT", "ARR"}
    assert found("This work is licensed under the GNU General Public License, version 2. This work by Jo is licensed under the GNU General Public License, version 3.") == {"GPL-2.0", "GPL-3.0"}
    prose = "the work of the author is a source of the free text to be used in this form with or without the following files as published by any person ".split()
    for name, notices in licenses.TEMPLATES.items():
        for notice in notices:
            assert found(" ".join(prose * 4) + " " + notice + " " + " ".join(prose * 4)) == {name}


def test_wrapped_and_indented_notices():
    for name, notices in licenses.TEMPLATES.items():
        for notice in notices:
            for width, mark in ((80, ""), (40, "    "), (30, " * ")):
                wrapped = textwrap.indent(textwrap.fill(notice, width), mark)
                assert found("A first line.\n\n" + wrapped + "\nA last line.") == {name}, wrapped


def test_findings_name_their_line_once(spark):
    text = "one\nReleased under the\nMIT License.\n" + "a b c\n" * 12 + "Licensed under CC\n BY 4.0.\n"
    row = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(f.license, f.line) for f in row.findings] == [("MIT", 1), ("CC-BY-4.0", 15)]


def test_tags_name_licenses(spark):
    texts = {
        "// SPDX-License-Identifier: MIT": ["MIT"], "# SPDX-License-Identifier: GPL-3.0-only": ["GPL-3.0"], "SPDX-License-Identifier: LGPL-3.0-or-later\nx": ["LGPL-3.0"],
        "SPDX-License-Identifier: Unknown-1.0": [], "/* SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0+ WITH Classpath-exception-2.0 */": ["Apache-2.0", "GPL-2.0", "MIT"],
    }
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r.licenses for r in rows] == list(texts.values())


def test_names_near_a_license_are_told_apart():
    bsd = licenses.TEMPLATES["BSD-2-Clause"][1], licenses.TEMPLATES["BSD-3-Clause"][1]
    numbered = bsd[1].replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in").replace("Neither", "3. Neither")
    assert found(bsd[0]) == {"BSD-2-Clause"} and found(bsd[1]) == found("Copyright 2019 Some One\n\n" + numbered) == {"BSD-3-Clause"}
    assert found("This program is licensed under the GNU Affero General Public License, version 3.") == {"AGPL-3.0"}
    assert not found("This is not released under the MIT License.") and not found("It was never released under the MIT License.")
    header = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    assert found(header) == {"GPL-2.0"} and found(header.replace("version 2 ", "version 3 ")) == {"GPL-3.0"}
    assert found(header.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 2 ", "version 2.1 ")) == {"LGPL-2.1"}
    assert found("This work is licensed under a Creative Commons Attribution 3.0 Unported License.") == {"CC-BY-3.0"} and found("Licensed under CC BY-NC-ND 4.0.") == {"CC-BY-NC-ND-4.0"}


def plain(block):
    """The same ranking and confirmation with every notice against every place, by saving; overlaps go to the earlier."""
    scanner, own, taken, out = licenses.Scanner(), licenses.words_of(block), [], set()
    data = " ".join(own).encode()
    alone = len(scanner.plain.compress(data))
    ranked = sorted(((alone - len(c.compress(data))) / alone, name, notice) for name, notice, c in scanner.notices)
    for saving, name, notice in sorted(ranked, key=lambda x: (-x[0], x[1], x[2])):
        for _, _, first, last in licenses._stated(notice, own) if saving > 0 else ():
            if all(last <= a or b <= first for a, b in taken):
                taken.append((first, last))
                out.add(name)
    return out


def test_ranking_equals_every_notice_against_every_block():
    import random

    draw = random.Random(2)
    prose = "the work of the author is a source of the free text to be used in this form with or without the files under license as published".split()
    everything = [n for notices in licenses.TEMPLATES.values() for n in notices]
    for _ in range(25):
        parts = [" ".join(draw.choices(prose, k=draw.randrange(25))) if draw.random() < 0.6 else draw.choice(everything) for _ in range(draw.randrange(1, 5))]
        text = " ".join(parts)
        for _, block in licenses.blocks(text):
            assert {x[0] for x in licenses.Scanner().judge_all(block)} == plain(block)
