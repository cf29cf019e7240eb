"""Column expressions over text, paths and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headings that end like this list sources; headings that end a book; the separator of a source label.
REFERENCES = r"(?i)(references|bibliography|further reading)\s*$"
BACK_MATTER = ("Bibliography", "Colophon", "Glossary", "Index")
LABEL = " › "
WORD_BREAKS = r"[^\p{L}\p{N}]+"
#: White space: what Unicode calls so, and the four separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: What is replaced in extracted text, and by what, in this order.
ARTEFACTS = (
    (r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2"),
    (r"[ \t]+([,.;:!?)\]])", "$1"),
    (r"([(\[])[ \t]+", "$1"),
    (r"[ \t]{2,}", " "),
    (r"(?md)[ \t]+$", ""),
    (r"\n{3,}", "\n\n"),
)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def strip_right(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+$", "")


def clean(c: Column) -> Column:
    """One pass over the artefacts of extracted text: split words, spaces at punctuation, runs of spaces and of blank lines."""
    for pattern, to in ARTEFACTS:
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def count_words(c: Column) -> Column:
    """Runs without white space."""
    return F.size(F.filter(F.split(c, SPACE), lambda w: w != ""))


def terms(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(c), WORD_BREAKS), lambda w: w != "")


def is_references(heading: Column) -> Column:
    return F.coalesce(heading.rlike(REFERENCES), F.lit(False))


def looks_like_heading(s: Column) -> Column:
    """One to ten words, a capital first, no full stop, comma or semicolon last, neither a number nor a pipe."""
    first = F.substring(s, 1, 1)
    return F.coalesce((s != "") & (s != "|") & ~first.rlike(r"\p{N}") & first.rlike(r"\p{Lu}") & count_words(s).between(1, 10) & ~s.rlike(r"[.,;]$"), F.lit(False))


def is_numbered_heading(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^\d+(?:\.\d+)+ {2}[A-Za-z].*$"), F.lit(False))


def is_page_number(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^\s*\d{1,4}\s*$"), F.lit(False))


def source_label(title: Column, path: Column, has_path: Column | None = None) -> Column:
    """Title, separator and path; without a path the title or nothing. A missing title prints as None before a path."""
    has_path = (path.isNotNull() & (path != "")) if has_path is None else has_path
    return F.when(has_path, F.concat(F.coalesce(title, F.lit("None")), F.lit(LABEL), path)).otherwise(F.coalesce(title, F.lit("")))


def document_label(source: Column) -> Column:
    return F.substring_index(source, LABEL, 1)


def chapter_of(path: Column) -> Column:
    return F.split(path, r"\.")[0].try_cast("int")


def chunk_key(external_id: Column, path: Column, seq: Column) -> Column:
    return F.concat_ws(":", external_id, path, seq.cast("string"))


def content_hash(key: Column, text: Column) -> Column:
    return F.sha2(F.concat(key, F.lit("\0"), text), 256)


def snippet(c: Column, limit: int = 300) -> Column:
    """White space collapsed, cut to limit characters with an ellipsis."""
    flat = strip(F.regexp_replace(c, SPACE, " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit("…")))


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Zero where a vector is null, empty or zero."""
    fine = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(b) > 0)
    length = norm(a) * norm(b)
    return F.coalesce(F.when(fine & (length > 0), dot(a, b) / length), F.lit(0.0))


def tidy_queries(queries: Column) -> Column:
    """Trimmed, blanks dropped."""
    return F.filter(F.transform(queries, strip), lambda q: q != "")


def checked_vector(vector: Column, dimension: int) -> Column:
    """The vector, or an error where its length isn't the contract's."""
    return F.when(F.size(vector) == dimension, vector).otherwise(F.raise_error(F.lit(f"a vector must have {dimension} components")).cast("array<double>"))
