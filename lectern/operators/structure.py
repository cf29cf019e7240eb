"""Flat book text to a section tree, for many books at once; a book's lines are cut where they stand, and only what they mean is ordered."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import BACK_MATTER, SPACE, count_words, is_numbered_heading, is_page_number, looks_like_heading, strip, strip_right
from lectern.session import materialize

LINE_BREAKS = "\\r\\n|[\\n\\r\\x0B\\f\\x1c-\\x1e\\x85\\u2028\\u2029]"
#: How books of three kinds mark chapters (number and title; or a title after a form feed), openers and sections.
TITLES = ("Getting Started", "Git Basics", "Git Branching", "Git on the Server", "Distributed Git", "GitHub", "Git Tools", "Customizing Git", "Git and Other Systems", "Git Internals")
_FORM_FEED_END = r"^\f[ \t]*(?:Appendix\b|Index[ \t]*$|Glossary[ \t]*$|Bibliography[ \t]*$)"
PREAMBLE = "(preamble)"


class StructureError(RuntimeError):
    """A book without chapters, or a setting that isn't known."""


@dataclass(frozen=True)
class Profile:
    """chapter: pattern of a chapter line; subsections: footers, numbered or none; opener: pattern of a chapter's opening line, if books have one."""

    chapter: str
    subsections: str
    opener: str | None = None
    back_matter: tuple[str, ...] = field(default=BACK_MATTER)

    def __post_init__(self) -> None:
        if self.subsections not in ("footers", "numbered", "none"):
            raise ValueError(f"unknown subsections {self.subsections!r}")


PROFILES = {
    "ddia": Profile(r"^Chapter\s+(\d+):\s+(.+)$", "footers", r"^CHAPTER\s+(\d+)$"),
    "manning": Profile(r"^chapter\s+(\d+)\s{2,}(.+)$", "numbered"),
    "progit": Profile(rf"^\f[ \t]*({'|'.join(TITLES)})[ \t]*$", "none"),
}


def profile(name: str) -> Profile:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; known: {', '.join(sorted(PROFILES))}")
    return PROFILES[name]


def book_lines(books: DataFrame, breaks: str = LINE_BREAKS) -> DataFrame:
    """external_id, n, raw of each line of books (external_id, text); what follows the last break counts only if it isn't empty."""
    return books.select("external_id", F.posexplode(_ended(F.split("text", breaks, -1))).alias("n", "raw"))


def _ended(parts: Column) -> Column:
    return F.when((F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _trimmed(raw: Column) -> Column:
    """strip_right, without looking through lines that don't end in white space."""
    return F.when(F.right(raw, F.lit(1)).rlike(SPACE), strip_right(raw)).otherwise(raw)


def _stripped_left(line: Column) -> Column:
    return F.when(F.left(line, F.lit(1)).rlike(SPACE), F.regexp_replace(line, r"(?U)^[\s\x1c-\x1f]+", "")).otherwise(line)


def _in_book() -> Window:
    return Window.partitionBy("external_id").orderBy("n")


def _pieces(books: DataFrame, p: Profile) -> DataFrame:
    """external_id, part, i, s, words (how many), blank, lead, text of books (external_id, part, text): lines that may mean something, a row
    each, with their words in s; and runs of other lines, a row each, s null. lead: the first words of a run that may follow an opener.

    Nothing is exchanged: a row of books is cut where it stands.
    """
    chapter = lambda s: s.rlike(p.chapter)
    opens = (lambda s: s.rlike(p.opener)) if p.opener else (lambda s: F.lit(False))

    def says(s: Column) -> Column:
        found = chapter(s) | opens(s) | s.isin(list(p.back_matter))
        if p.subsections == "numbered":
            return found | is_numbered_heading(s)
        return found | (s == "|") | s.rlike(r"^\d+$") | (~F.substring(s, -1, 1).isin(".", ",", ";") & looks_like_heading(s))

    rows = books.select("external_id", "part", F.split("text", LINE_BREAKS, -1).alias("all"))
    rows = rows.select("external_id", "part", F.transform(_ended(F.col("all")), _trimmed).alias("r"))
    rows = rows.withColumn("l", F.transform("r", lambda r: F.struct(r.alias("r"), _stripped_left(r).alias("s"))))
    rows = rows.withColumn("e", F.filter(F.transform("l", lambda x, i: F.when((x["s"] != "") & says(x["s"]), i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("b", F.concat(F.array(F.lit(-1)), F.col("e"), F.array(F.size("r"))))

    def run(j: Column) -> Column:
        lo, hi = F.get("b", j), F.get("b", j + 1)
        after = (j == 0) | F.coalesce(opens(F.get("l", lo)["s"]), F.lit(False))
        return F.struct((lo + 1).alias("i"), F.lit(None).cast("string").alias("s"), after.alias("after"), F.array_join(F.slice("r", lo + 2, hi - lo - 1), "\n").alias("text"))

    runs = F.transform(F.filter(F.sequence(F.lit(0), F.size("b") - 2), lambda j: F.get("b", j + 1) - F.get("b", j) > 1), run)
    lines = F.transform("e", lambda i: F.struct(i.alias("i"), F.get("l", i)["s"].alias("s"), F.lit(False).alias("after"), F.get("l", i)["r"].alias("text")))
    cut = rows.select("external_id", "part", F.inline(F.concat(lines, runs)))
    lead = F.when(F.col("after"), strip(F.regexp_extract("text", r"^\n*([^\n]+)", 1))) if p.opener else F.lit(None).cast("string")
    return cut.select("external_id", "part", "i", "s", count_words(F.col("text")).alias("words"), (F.col("s").isNull() & ~F.col("text").rlike(r"[^\n]")).alias("blank"), lead.alias("lead"), "text")


def _at() -> Column:
    return F.struct("part", "i")


def _marked(rows: DataFrame, p: Profile) -> tuple[DataFrame, DataFrame]:
    """Rows without their text, each with what the rows before it say, and chapters (external_id, num, opened, title).

    Rows are dealt by ranges of (external_id, part, i), so a book of any size is spread over tasks: windows run within a
    book's rows of one range, and what comes before them is carried over from a summary of the ranges, a row each.
    """
    key, block = ["external_id", "num"], ["external_id", "block"]
    found = F.regexp_extract("s", p.chapter, 1)
    rows = rows.withColumn("header", F.when(found != "", found.try_cast("int")))
    shown = F.regexp_extract("s", p.opener, 1) if p.opener else F.lit("")
    rows = rows.withColumn("opener", F.when(shown != "", shown.try_cast("int")))
    says = rows.filter("header is not null or opener is not null")
    both = says.select("external_id", "part", "i", F.explode(F.array(F.struct(F.lit(True).alias("is_opener"), F.col("opener").alias("num")), F.struct(F.lit(False).alias("is_opener"), F.col("header").alias("num")))).alias("x"))
    firsts = both.select("external_id", "part", "i", "x.*").filter("num is not null").groupBy(*key, "is_opener").agg(F.min(_at()).alias("opened"))
    by = firsts.groupBy("external_id").agg(F.max("is_opener").alias("is_opener"))  # openers mark the chapters of a book that has any
    fresh = firsts.join(by, ["external_id", "is_opener"]).select("external_id", "opened.*", F.col("num").alias("fresh"))
    dealt = rows.join(fresh, ["external_id", "part", "i"], "left").repartitionByRange("external_id", "part", "i").withColumn("block", F.spark_partition_id())
    dealt = materialize(dealt, "structure-dealt")

    w = Window.partitionBy(*block).orderBy("part", "i")
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    me = F.struct("part", "i", "s", F.col("header").isNotNull().alias("headed"), F.col("opener").isNotNull().alias("opens"))
    here = dealt.withColumn("h", F.last("header", True).over(ahead)).withColumn("c", F.last("fresh", True).over(w)).withColumn("o", F.count("fresh").over(w)).withColumn("one", F.last(F.when(~F.col("blank"), me), True).over(ahead))
    full = ~F.col("blank")
    ends = here.groupBy(*block).agg(
        F.max_by("header", F.when(F.col("header").isNotNull(), _at())).alias("h"), F.max_by("c", _at()).alias("c"), F.max("o").alias("o"),
        F.max(F.when(full, me)).alias("one"), F.max_by("one", F.when(full, _at())).alias("two"))
    wb = Window.partitionBy("external_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*block, "one", "two", F.last("h", True).over(wb).alias("h0"), F.last("c", True).over(wb).alias("c0"), F.coalesce(F.sum("o").over(wb), F.lit(0)).alias("o0"), F.last("one", True).over(wb).alias("one0"))
    pair = F.when(F.col("one").isNotNull(), F.struct(F.coalesce("two", "one0").alias("two")))
    carried = carried.withColumn("two0", F.last(pair, True).over(wb)["two"]).drop("one", "two")
    whole = here.join(carried, block).withColumn("first_here", F.col("one").isNull()).withColumn("one", F.coalesce("one", "one0"))
    whole = whole.withColumn("two", F.when(F.col("first_here"), F.col("two0")).otherwise(F.last(F.when(full, F.struct(F.col("one").alias("one"))), True).over(ahead)["one"]))
    whole = whole.withColumn("num", F.coalesce("c", "c0")).withColumn("ordinal", (F.col("o") + F.col("o0")).cast("int")).withColumn("running", F.coalesce("h", "h0", F.lit(0)))
    # three lines end a page: a name, a bar and the page's number
    bar = F.col("s").rlike(r"^\d+$") & (F.col("one.s") == "|") & ~F.col("two.headed") & looks_like_heading(F.col("two.s"))
    page = F.when(F.coalesce(bar, F.lit(False)), F.col("s").try_cast("int")) if p.subsections == "footers" else F.lit(None).cast("int")
    # the line after an opener, blank ones aside, repeats the title
    after = F.coalesce(F.col("one.opens"), F.lit(False)) & F.col("opener").isNull()
    whole = whole.withColumn("page", page).withColumn("swallowed", after & full).withColumn("gap", after & F.col("blank"))
    kept = ["external_id", "part", "i", "s", "lead", "header", "opener", "fresh", "num", "ordinal", "running", "page", "swallowed", "gap"]
    whole = materialize(whole.select(*kept, *(F.when(F.col("page").isNotNull(), F.col(c)).alias(c) for c in ("one", "two"))), "structure-marked")

    headers = whole.filter("header is not null").select("external_id", F.col("header").alias("num"), "part", "i", strip(F.regexp_extract("s", p.chapter, 2)).alias("run_title"))
    headers = headers.groupBy(*key).agg(F.min_by("run_title", _at()).alias("run_title"))
    lead = whole.filter("swallowed and num is not null").groupBy(*key).agg(F.min_by(F.coalesce("s", "lead"), _at()).alias("lead_title"))
    chapters = whole.filter("fresh is not null").select(*key, "ordinal", _at().alias("opened")).join(headers, key, "left").join(lead, key, "left")
    return whole, chapters.select(*key, "ordinal", "opened", F.coalesce("run_title", "lead_title", F.lit("")).alias("title"))


def _joined(lines: Column) -> Column:
    return strip(F.array_join(F.transform(F.array_sort(lines), lambda x: strip_right(x["raw"])), "\n"))


def parse(books: DataFrame, p: Profile) -> DataFrame:
    """The sections of books (external_id, text). Books without chapters give no rows; parse_strict raises instead.

    A book may come in several rows, each of whole lines, in the order of a column part; then no row or task holds it whole.
    A name found only after the back matter begins is no section, and a footer belongs to the chapter whose header ran last.
    """
    if p.subsections == "none":
        return _by_form_feed(books, p)
    key, place = ["external_id", "num"], ["external_id", "part", "i"]
    books = books.withColumn("part", F.col("part").cast("long") if "part" in books.columns else F.lit(0).cast("long"))
    pieces = materialize(_pieces(books, p), "structure-pieces")
    rows, chapters = _marked(pieces.drop("text", "words"), p)
    body = rows.filter("num is not null and header is null and opener is null and not gap and not (swallowed and s is not null)")
    pages = rows.filter("page is not null")
    if p.subsections == "footers":
        noise = pages.select("external_id", F.inline(F.array(_at(), *(F.struct(F.col(f"{c}.part").alias("part"), F.col(f"{c}.i").alias("i")) for c in ("one", "two")))))
        body = body.join(noise, place, "left_anti")
    last = chapters.groupBy("external_id").agg(F.max_by("num", "opened").alias("num"))
    ends = body.filter(F.col("s").isin(list(p.back_matter))).join(last, key).groupBy(*key).agg(F.min(_at()).alias("end"))
    body = body.join(ends, key, "left").filter(F.col("end").isNull() | (_at() < F.col("end"))).select(*place, "num", "s", "swallowed")
    footers = pages.groupBy("external_id", F.col("running").alias("num"), F.col("two.s").alias("name")).agg(F.max_by("page", _at()).alias("page"))
    named = body.filter("s is not null")
    named = named.join(footers.select(*key, F.col("name").alias("s")), [*key, "s"], "left_semi") if p.subsections == "footers" else named.filter(is_numbered_heading(F.col("s")))
    cuts = named.groupBy(*key, F.col("s").alias("name")).agg(F.min(_at()).alias("at")).select("external_id", "at.*", "name")
    body = body.join(cuts, place, "left").select(*place, "num", "swallowed", "name")
    rest = F.when(F.col("text").rlike(r"^\n*[^\n]+\n"), F.regexp_replace("text", r"^\n*[^\n]+\n", ""))
    texts = pieces.select(*place, "text", "words").join(body, place).withColumn("text", F.when(F.col("swallowed"), rest).otherwise(F.col("text"))).filter("text is not null")
    texts = texts.withColumn("words", F.when(F.col("swallowed"), count_words(F.col("text"))).otherwise(F.col("words")))
    held = texts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("part", "i", "name", "words", "text"))).alias("rows"))
    spans = footers.groupBy(*key).agg(F.min("page").alias("lo"), F.max("page").alias("hi"), F.collect_list(F.struct("name", "page")).alias("pages"))
    return _of_chapters(chapters.join(held, key, "left").join(spans, key, "left"))


def _of_chapters(chapters: DataFrame) -> DataFrame:
    """Of each chapter its own row and those of its children: a named row opens a child, which ends before the next; text before the first is the preamble."""
    whole = lambda rows: F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text")
    words = lambda rows: F.aggregate(rows, F.lit(0), lambda n, x: n + x["words"]).alias("token_count")
    none = F.array().cast("array<struct<part:bigint,i:int,name:string,words:int,text:string>>")
    df = chapters.withColumn("rows", F.coalesce("rows", none))
    df = df.withColumn("cuts", F.filter(F.transform("rows", lambda x, j: F.when(x["name"].isNotNull(), j)), lambda j: j.isNotNull()))
    df = df.withColumn("froms", F.concat(F.array(F.lit(-1)), F.col("cuts"))).withColumn("tos", F.concat(F.col("cuts"), F.array(F.size("rows"))))
    number = F.col("num").cast("string")

    def child(start: Column, j: Column) -> Column:
        name = F.get("rows", start)["name"]
        rows = F.slice("rows", start + 2, F.get("tos", j) - start - 1)
        page = F.get(F.filter("pages", lambda x: x["name"] == name), F.lit(0))["page"]
        return F.struct(
            F.concat_ws(".", number, j.cast("string")).alias("path"), F.lit(2).alias("depth"), number.alias("parent_path"), j.alias("ordinal"), F.coalesce(name, F.lit(PREAMBLE)).alias("heading"), F.lit(True).alias("is_leaf"),
            whole(rows), words(rows), F.when(page.isNotNull(), F.struct(page.alias("lo"), page.alias("hi"))).alias("page_range"))

    children = F.filter(F.transform("froms", child), lambda x: (x["ordinal"] > 0) | (x["token_count"] > 0))
    children = F.when(F.size("cuts") > 0, children).otherwise(F.slice(F.transform("froms", child), 1, 0))
    own = F.struct(
        number.alias("path"), F.lit(1).alias("depth"), F.lit(None).cast("string").alias("parent_path"), "ordinal", F.col("title").alias("heading"), (F.size("cuts") == 0).alias("is_leaf"),
        whole(F.col("rows")), words(F.col("rows")), F.when(F.col("lo").isNotNull(), F.struct("lo", "hi")).alias("page_range"))
    out = df.select("external_id", F.inline(F.concat(F.array(own), children)))
    blank_ends = F.left("text", F.lit(1)).rlike(SPACE) | F.right("text", F.lit(1)).rlike(SPACE)
    out = out.withColumn("text", F.when(blank_ends, strip(F.col("text"))).otherwise(F.col("text")))
    return out.select("external_id", "path", "depth", "parent_path", "ordinal", "heading", "is_leaf", "text", "page_range", "token_count").withColumn("metadata", F.create_map().cast("map<string,string>"))


def _by_form_feed(books: DataFrame, p: Profile) -> DataFrame:
    """Chapters only: a form feed and a title from the set open one, the first time; back matter stops it until a new title comes."""
    lines = books.select("external_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).withColumn("raw", F.regexp_replace("line", r"\r+$", ""))
    found = F.regexp_extract("raw", p.chapter, 1)
    rows = lines.withColumn("title", F.when(found != "", strip(found)))
    new = F.col("title").isNotNull() & (F.row_number().over(Window.partitionBy("external_id", "title").orderBy("n")) == 1)
    rows = rows.withColumn("new", new).withColumn("num", F.sum(F.col("new").cast("int")).over(_in_book()))
    event = F.when(F.col("new"), F.lit(True)).when(F.col("title").isNull() & F.col("raw").rlike(_FORM_FEED_END), F.lit(False))
    rows = rows.withColumn("event", event).withColumn("open", F.coalesce(F.last("event", True).over(_in_book()), F.lit(False)))
    kept = rows.filter("open and title is null and event is null").withColumn("raw", F.replace("raw", F.lit("\f"), F.lit(""))).filter(~is_page_number(F.col("raw")))
    chapters = rows.filter("new").select("external_id", F.col("num").cast("int").alias("num"), F.col("n").alias("opened"), "title")
    body = kept.select("external_id", F.col("num").cast("int").alias("num"), "n", "raw")
    texts = body.groupBy("external_id", "num").agg(_joined(F.collect_list(F.struct("n", "raw"))).alias("text"))
    own = chapters.join(texts, ["external_id", "num"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    out = own.select(
        "external_id", F.col("num").cast("string").alias("path"), F.lit(1).alias("depth"), F.lit(None).cast("string").alias("parent_path"), F.col("num").alias("ordinal"), F.col("title").alias("heading"),
        F.lit(True).alias("is_leaf"), "text", F.lit(None).cast("struct<lo:int,hi:int>").alias("page_range"),
    )
    return out.withColumn("token_count", count_words(F.col("text"))).withColumn("metadata", F.create_map().cast("map<string,string>"))


def parse_strict(books: DataFrame, p: Profile) -> DataFrame:
    """parse, or StructureError if a book has no chapter."""
    out = parse(books, p)
    missing = books.select("external_id").distinct().join(out.select("external_id").distinct(), "external_id", "left_anti").limit(1).collect()
    if missing:
        raise StructureError(f"no chapter in {missing[0]['external_id']!r}")
    return out
