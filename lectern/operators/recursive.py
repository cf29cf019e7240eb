"""Cutting texts by meaning and by size: paragraphs, lines, sentences, words, tokens, each only where the one before is too large.

A counter that can tell where tokens end is asked once a text. The tokens up to any place are then a search in those ends,
and the longest run of parts that fits is a search in the sums at the places, so a text is cut in time linear in its
length, however it is cut. A plain function from text to a number counts each part anew, and is for short texts.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Count = Callable[[str], int]

#: Where a text may be cut, the best places first; a cut comes after the match.
PLACES = (r"\n[ \t]*\n\s*", r"\n", r"[.!?…]+[\"'”’)\]]*\s+", r"[;:,]\s+", r"\s+")
_PLACES = tuple(map(re.compile, PLACES))
#: Pieces of text whose tokens a counter remembers, none longer than KNOWN_LENGTH.
KNOWN, KNOWN_LENGTH = 100_000, 64


class WordCounter:
    """Tokens are runs without white space."""

    #: Counts of parts that are cut at white space add up.
    exact = True

    def __call__(self, text: str) -> int:
        return len(text.split())

    def ends(self, text: str) -> np.ndarray:
        """Where tokens end, in characters."""
        return np.fromiter((m.end() for m in re.finditer(r"\S+", text)), dtype=np.int64)


words = WordCounter()


def joined(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Where the tokens of data end: neighbours are joined, the pair of least rank first and of equal ranks the leftmost, while any pair is a token."""
    n = len(data)
    if data in ranks:
        return [n]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # after: where the token that starts here ends, or 0 if none does
    open_pairs = [(ranks[data[i : i + 2]], i, i + 2) for i in range(n - 1) if data[i : i + 2] in ranks]
    heapq.heapify(open_pairs)
    while open_pairs:
        _, at, end = heapq.heappop(open_pairs)
        middle = after[at]
        if not middle or middle >= n or after[middle] != end:
            continue  # one of the two has been joined since
        after[at], after[middle] = end, 0
        if end < n:
            before[end] = at
        for left, right in ((before[at], end), (at, after[end] if end < n else 0)):
            if left >= 0 and right and (rank := ranks.get(data[left:right])) is not None:
                heapq.heappush(open_pairs, (rank, left, right))
    out, at = [], 0
    while at < n:
        at = after[at]
        out.append(at)
    return out


class BpeCounter:
    """Tokens by byte pair ranks from a file (lines of base64 and rank), within the matches of a pattern; the file is read where it is first needed."""

    #: A part alone may have a token more than within its text.
    exact = False

    def __init__(self, path: str, pattern: str) -> None:
        self.path, self.pattern = path, pattern
        self._ranks = self._split = None
        self._known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {"path": self.path, "pattern": self.pattern, "_ranks": None, "_split": None, "_known": {}}

    def _tokens(self, piece: str) -> tuple[int, ...]:
        """Where the tokens of a match end, in characters; a token that ends within a character ends with it."""
        found = self._known.get(piece)
        if found is None:
            data = piece.encode("utf-8", "surrogatepass")
            ends = joined(data, self._ranks)
            if len(data) != len(piece):
                sizes = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in piece])
                ends = (np.searchsorted(sizes, ends, "left") + 1).tolist()
            found = tuple(ends)
            if len(piece) <= KNOWN_LENGTH:
                if len(self._known) >= KNOWN:
                    self._known.clear()
                self._known[piece] = found
        return found

    def _pieces(self, text: str) -> Iterator[tuple[int, tuple[int, ...]]]:
        if self._ranks is None:
            import regex

            with open(self.path, "rb") as f:
                self._ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
            self._split = regex.compile(self.pattern)
        for m in self._split.finditer(text):
            if m.end() > m.start():
                yield m.start(), self._tokens(m.group())

    def __call__(self, text: str) -> int:
        return sum(len(ends) for _, ends in self._pieces(text))

    def ends(self, text: str) -> np.ndarray:
        return np.fromiter((start + e for start, ends in self._pieces(text) for e in ends), dtype=np.int64)


def spans(text: str, ends: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Where the pieces of a text lie, in order, trimmed and not blank, of at most size tokens each; ends: where its tokens end."""
    out: list[tuple[int, int]] = []

    def tokens(at: int) -> int:
        return int(np.searchsorted(ends, at, "right"))

    def trimmed(lo: int, hi: int) -> tuple[int, int]:
        while lo < hi and text[lo].isspace():
            lo += 1
        while lo < hi and text[hi - 1].isspace():
            hi -= 1
        return lo, hi

    def cut(lo: int, hi: int, level: int) -> None:
        lo, hi = trimmed(lo, hi)
        if lo == hi:
            return
        first, last = tokens(lo), tokens(hi)
        if last - first <= size:
            out.append((lo, hi))
            return
        if level == len(_PLACES):
            for n in range(first, last, size):  # where a token ends; one that ends in the middle of a character ends with it
                here = trimmed(lo if n == first else int(ends[n - 1]), hi if n + size >= last else int(ends[n + size - 1]))
                if here[0] < here[1]:
                    out.append(here)
            return
        cuts = np.array([*(m.end() for m in _PLACES[level].finditer(text, lo, hi) if m.end() < hi), hi])
        sums = np.searchsorted(ends, cuts, "right")
        at, base, n = lo, first, 0
        while n < len(cuts):
            n = max(n, int(np.searchsorted(sums, base + size, "right")) - 1)
            cut(at, int(cuts[n]), level + 1)
            at, base, n = int(cuts[n]), int(sums[n]), n + 1

    cut(0, len(text), 0)
    return out


def _parts(text: str, place: str) -> list[str]:
    ends = [m.end() for m in re.finditer(place, text)]
    cuts = [0, *(e for e in ends if e < len(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _halves(text: str, size: int, count: Count) -> Iterator[str]:
    """Runs of characters of at most size tokens, for a text without any other place; one character may hold more."""
    while text:
        n = len(text)
        while n > 1 and count(text[:n]) > size:
            n = max(1, n // 2)
        yield text[:n]
        text = text[n:]


def pieces(text: str | None, size: int, count: Count = words, level: int = 0) -> list[str]:
    """Pieces in order, trimmed and not blank, of at most size tokens each; neighbours are joined again while they fit."""
    if size < 1:
        raise ValueError("size must be positive")
    if not text or not text.strip():
        return []
    if hasattr(count, "ends"):
        found = [text[lo:hi] for lo, hi in spans(text, count.ends(text), size)]
        return found if count.exact else [x for p in found for x in _within(p, size, count)]
    return _counted_pieces(text, size, count, level)


def _within(piece: str, size: int, count: Count) -> list[str]:
    """The piece, or, where it has more tokens alone than it had within its text, smaller ones; a single character may have more."""
    ends, at = count.ends(piece), size
    if len(ends) <= size:
        return [piece]
    while at > 1 and len(parts := [piece[lo:hi] for lo, hi in spans(piece, ends, at)]) > 1:
        if all(count(p) <= size for p in parts):
            return parts
        at -= 1
    return [p for p in _halves(piece, size, count) if p.strip()]


def _counted_pieces(text: str, size: int, count: Count, level: int) -> list[str]:
    if not text.strip():
        return []
    if count(text.strip()) <= size:
        return [text.strip()]
    if level == len(PLACES):
        return [p for p in _halves(text.strip(), size, count) if p.strip()]
    out: list[str] = []
    held, tokens = "", 0
    for part in _parts(text, PLACES[level]):
        n = count(part)
        if held and tokens + n <= size:
            held, tokens = held + part, tokens + n
            continue
        out += _counted_pieces(held, size, count, level + 1)
        held, tokens = part, n
    return out + _counted_pieces(held, size, count, level + 1)


def led(found: list[str], overlap: int, size: int, count: Count = words) -> list[str]:
    """Each piece but the first, led by the last words of the one before: at most overlap tokens, and size + overlap with the piece."""
    if overlap < 1:
        return found
    out = found[:1]
    for before, piece in zip(found, found[1:], strict=False):
        out.append(f"{tail} {piece}" if (tail := _tail(before, piece, overlap, size, count)) else piece)
    return out


def _tail(before: str, piece: str, overlap: int, size: int, count: Count) -> str:
    """The last words of a piece that fit before the next one."""
    starts = [m.start() for m in re.finditer(r"\S+", before)]
    if getattr(count, "exact", False):
        n = min(overlap, size + overlap - count(piece), len(starts))
        return before[starts[-n] :] if n > 0 else ""
    if hasattr(count, "ends"):  # words with more tokens of their own than fit need no trial
        ends = count.ends(before)
        starts = starts[int(np.searchsorted(starts, ends[-overlap - 1] if len(ends) > overlap else 0, "left")) :]
    tail = ""
    for at in reversed(starts):
        if count(before[at:]) > overlap or count(f"{before[at:]} {piece}") > size + overlap:
            break
        tail = before[at:]
    return tail


def recursive(size: int, overlap: int = 0, count: Count = words) -> Callable[[Column], Column]:
    """text -> array of pieces, for chunk(); a null or blank text has none. Runs in Python, in Arrow batches; words and byte pairs are counted once a text."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: led(pieces(t, size, count), overlap, size, count))

    return cut


def counted(count: Count) -> Callable[[Column], Column]:
    """text -> tokens, for chunk() and clean_sections(): any Python counter as a column; a null text has none."""

    @F.pandas_udf("int")
    def number(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: count(t) if t else 0).astype("int32")

    return number


def cut_by(fn: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """text -> array of pieces by any Python function from text to a list of texts."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(fn(t)) if t else [])

    return cut
