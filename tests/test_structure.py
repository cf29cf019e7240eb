import pytest

from lectern.operators import structure as S

HEADERS = """front matter
Chapter 1: First Steps
Opening words of the chapter.

Setting Out
Text of setting out.
Setting Out
|
3
Chapter 1: First Steps
More of it.
Looking Back
Text of looking back,
on two lines.
Looking Back

|

7
Chapter 2: Second Wind
Only body here.
Index
apple, 3
"""


def parsed(spark, text, profile):
    rows = S.parse(spark.createDataFrame([("b", text)], "external_id string, text string"), S.profile(profile)).collect()
    return {r.path: r for r in rows}


def test_running_headers_footers_and_back_matter(spark):
    got = parsed(spark, HEADERS, "ddia")
    assert sorted(got) == ["1", "1.0", "1.1", "1.2", "2"]
    assert (got["1"].heading, got["1"].is_leaf, got["1"].ordinal, tuple(got["1"].page_range)) == ("First Steps", False, 1, (3, 7))
    assert (got["1.0"].heading, got["1.0"].text) == ("(preamble)", "Opening words of the chapter.")
    assert (got["1.1"].heading, got["1.1"].text, tuple(got["1.1"].page_range), got["1.1"].parent_path) == ("Setting Out", "Text of setting out.\nMore of it.", (3, 3), "1")
    assert got["1.2"].text == "Text of looking back,\non two lines." and got["1.2"].token_count == 7
    assert got["2"].text == "Only body here." and got["2"].is_leaf and got["2"].page_range is None
    assert "front" not in got["1"].text and "|" not in got["1"].text


def test_openers_come_before_headers(spark):
    text = "CHAPTER 1\n\nShown Title\nIntro.\nChapter 1: Real Title\nBody.\nCHAPTER 2\nOnly Shown\nEnd.\nCHAPTER 1\nagain\nstill two"
    got = parsed(spark, text, "ddia")
    assert (got["1"].heading, got["1"].text) == ("Real Title", "Intro.\nBody.")
    assert (got["2"].heading, got["2"].text) == ("Only Shown", "End.\nstill two")


def test_name_found_only_after_back_matter_is_no_section(spark):
    text = "Chapter 1: One\nbody\nGlossary\nLate Name\nLate Name\n|\n9\n"
    got = parsed(spark, text, "ddia")
    assert sorted(got) == ["1"] and got["1"].text == "body"


def test_numbered_headings(spark):
    text = "chapter 1  Start\npreface\n1.1  Alpha\ntext a\n1.1.2  Deeper\ntext d\n1.5 million is no heading\n1.2  Beta\n1.1  Alpha\nend"
    got = parsed(spark, text, "manning")
    assert {p: r.heading for p, r in got.items()} == {"1": "Start", "1.0": "(preamble)", "1.1": "1.1  Alpha", "1.2": "1.1.2  Deeper", "1.3": "1.2  Beta"}
    assert got["1.2"].text == "text d\n1.5 million is no heading" and got["1.3"].text == "1.1  Alpha\nend"


def test_form_feed_titles(spark):
    text = "cover\n\f Git Basics\r\nbasics\nGit Tools\n 12 \n\fplain page\n\fGit Basics\nmore\n\fAppendix A\nlost\n\fGit Tools\ntools\n\fIndex\nlost too"
    got = parsed(spark, text, "progit")
    assert [(p, r.heading, r.text) for p, r in sorted(got.items())] == [("1", "Git Basics", "basics\nGit Tools\nplain page\nmore"), ("2", "Git Tools", "tools")]
    assert all(r.is_leaf and r.page_range is None for r in got.values())


def test_many_books_at_once_and_errors(spark):
    books = spark.createDataFrame([("a", HEADERS), ("b", HEADERS.replace("First", "Other")), ("c", "nothing")], "external_id string, text string")
    rows = S.parse(books, S.PROFILES["ddia"]).collect()
    assert {(r.external_id, r.heading) for r in rows if r.depth == 1} == {("a", "First Steps"), ("a", "Second Wind"), ("b", "Other Steps"), ("b", "Second Wind")}
    with pytest.raises(S.StructureError):
        S.parse_strict(books, S.PROFILES["ddia"])
    with pytest.raises(ValueError):
        S.profile("unknown")
    with pytest.raises(ValueError):
        S.Profile("x", "odd")


def test_all_line_breaks_count(spark):
    books = spark.createDataFrame([("a", "1\r\n2\r3\x0b4\f5\x1c6\x857 8\n")], "external_id string, text string")
    assert [r.raw for r in S.book_lines(books).orderBy("n").collect()] == list("12345678")


@pytest.mark.parametrize("ranges", [1, 7])
def test_books_in_parts_are_those_in_one_row(spark, ranges):
    """A part ends anywhere between lines: in a footer, after an opener, in the back matter; ranges of rows too."""
    opened = "CHAPTER 1\n\n\nShown Title\nIntro.\nChapter 1: Real Title\n Body. \n\nCHAPTER 2\n\nonly shown, a plain line\nEnd.\nCHAPTER 1\nagain\nstill two\nName Here\nx\nName Here\n|\n12\nIndex\nNames\n"
    numbered = "chapter 1  Start\npreface\n1.1  Alpha\ntext a\n1.1.2  Deeper\n\ntext d\n1.2  Beta\n1.1  Alpha\nend\nchapter 2  Next\n\n"
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for text, profile in ((HEADERS, "ddia"), (opened, "ddia"), (numbered, "manning")):
            lines = text.splitlines(keepends=True)
            whole = S.parse(spark.createDataFrame([("b", text), ("c", text.replace("1", "3"))], "external_id string, text string"), S.profile(profile))
            parts = [("b", n, x) for n, x in enumerate(lines)] + [("c", n, "".join(lines[n * 3 : n * 3 + 3]).replace("1", "3")) for n in range(len(lines) // 3 + 1)]
            apart = S.parse(spark.createDataFrame(parts, "external_id string, part long, text string"), S.profile(profile))
            want, got = (sorted((r.asDict(True) for r in x.collect()), key=lambda r: (r["external_id"], r["path"])) for x in (whole, apart))
            assert want and got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_footers_query_takes_a_whole_source_as_a_book(spark, tmp_path):
    from lectern import catalogue_structure as C

    spark.createDataFrame([(i, f"words of {i}.", "a" if i else None) for i in range(0, 1000, 90)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [r for r in C.footers_to_sections(spark, str(tmp_path)).collect() if r.depth == 1]
    assert sorted((r.external_id or "", r.ordinal) for r in rows) == [("", 1)] + [("a", n) for n in range(1, 12)]
