"""Recursive chunks: bounds, order, whole words, and a plain version; byte pair counts where the library and a vocabulary are at hand."""

import base64
import random
import re
import time

import pytest

from lectern.operators import chunking, recursive

LONG = " ".join(f"Sentence number {i} tells of thing{i}, and of more." for i in range(60))


def texts():
    draw = random.Random(6)
    for _ in range(60):
        words = [draw.choice(["alpha", "beta,", "gamma.", "delta;", "e", "ζήτα!", "x" * 30]) for _ in range(draw.randrange(0, 120))]
        yield "".join(w + draw.choice([" ", " ", " ", "\n", "\n\n"]) for w in words)


@pytest.mark.parametrize("size", [1, 7, 30])
def test_pieces_keep_all_words_in_order_and_within_size(size):
    for text in [*texts(), LONG, "", " \n "]:
        found = recursive.pieces(text, size)
        assert " ".join(found).split() == text.split()
        assert all(0 < recursive.words(p) <= size and p == p.strip() for p in found)


def test_best_places_come_first():
    text = "One two three.\n\nFour five. Six seven\neight nine ten eleven"
    assert recursive.pieces(text, 5) == ["One two three.", "Four five. Six seven", "eight nine ten eleven"]
    assert recursive.pieces(text, 4) == ["One two three.", "Four five. Six seven", "eight nine ten eleven"]
    assert recursive.pieces(text, 3) == ["One two three.", "Four five.", "Six seven", "eight nine ten", "eleven"]
    assert recursive.pieces(text, 100) == [text]


def plain(text, size, level=0):
    """The same rules, written as a search: the fewest joins from the left at the first kind of place that cuts."""
    text_, out = text.strip(), []
    if not text_:
        return out
    if len(text_.split()) <= size:
        return [text_]
    ends = [m.end() for m in re.finditer(recursive.PLACES[level], text) if m.end() < len(text)]
    parts = [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]
    while parts:
        n = max([k for k in range(1, len(parts) + 1) if sum(len(p.split()) for p in parts[:k]) <= size] or [1])
        out += plain("".join(parts[:n]), size, level + 1)
        parts = parts[n:]
    return out


def test_pieces_equal_a_plain_version():
    for text in [*texts(), LONG]:
        assert recursive.pieces(text, 9) == plain(text, 9)


def test_counters_that_tell_ends_cut_like_plain_ones():
    """A plain function counts every part anew; the words' counter is asked once."""
    for text in [*texts(), LONG, "a\x1cb\u2003c\x85d " * 9]:
        for size in (1, 5, 13):
            none = recursive.pieces(text, size, count=lambda t: len(t.split()))
            assert recursive.pieces(text, size) == none
            assert recursive.led(none, 4, size) == recursive.led(none, 4, size, count=lambda t: len(t.split()))


def test_own_byte_pairs_equal_the_library():
    tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    count = recursive.BpeCounter(path, tokenizers.PATTERN)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in f if x.strip())}
    library = tiktoken.Encoding("file", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(12)
    for text in [*texts(), LONG, "", "漢字🙂é " * 30, "z" * 3000, "".join(draw.choice("ab 漢\n.é🙂'1") for _ in range(4000))]:
        assert count(text) == len(count.ends(text)) == len(library.encode_ordinary(text))
        for size in (3, 20):
            found = recursive.pieces(text, size, count)
            assert "".join("".join(found).split()) == "".join(text.split())
            assert all(count(p) <= size or len(p) == 1 for p in found)


def test_time_is_linear_in_a_text_without_places():
    tokenizers = pytest.importorskip("public_tokenizers")
    count, draw, took = recursive.BpeCounter(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN), random.Random(1), []
    count("warm")
    for n in (20_000, 80_000):
        text = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        began = time.process_time()
        assert "".join(recursive.pieces(text, 50, count)) == text
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.2


def test_overlap_shares_words_within_bounds():
    none, some = recursive.pieces(LONG, 48), recursive.led(recursive.pieces(LONG, 48), 12, 48)
    assert none[1].split()[0] != some[1].split()[0] and some[1].endswith(none[1])
    assert set(none[0].split()) & set(some[1].split()) and all(recursive.words(p) <= 60 for p in some)
    with pytest.raises(ValueError):
        recursive.pieces("a", 0)


def test_text_without_places_is_cut_by_characters():
    found = recursive.pieces("y" * 1000, 10, count=len)
    assert "".join(found) == "y" * 1000 and max(map(len, found)) <= 10


def test_chunks_by_byte_pairs(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    pytest.importorskip("tiktoken")
    count = recursive.BpeCounter(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    rows = spark.createDataFrame([("b", "1.1", "H", True, LONG), ("b", "1", "H", False, LONG), ("b", "1.2", "H", True, None)], "external_id string, path string, heading string, is_leaf boolean, text string").selectExpr("*", "cast(null as struct<lo:int,hi:int>) as page_range", "cast(map() as map<string,string>) as metadata")
    for size, overlap in ((64, 0), (48, 12)):
        found = chunking.chunk(rows, recursive.recursive(size, overlap, count), recursive.counted(count)).orderBy("seq").collect()
        assert len(found) > 5 and {r.section_path for r in found} == {"1.1"}
        assert all(r.token_count == count(r.text) <= size + overlap for r in found) and [r.seq for r in found] == list(range(len(found)))


def test_any_function_may_cut(spark):
    df = spark.createDataFrame([("a|b",), (None,)], "t string").select(recursive.cut_by(lambda t: t.split("|"))("t").alias("x"))
    assert [r.x for r in df.collect()] == [["a", "b"], []]
