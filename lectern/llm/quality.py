"""Quality rules: a learned decision list over plain text statistics.

Sequential covering grows conjunctions of thresholds that pick out documents labelled bad, prunes each on rows kept
aside, and stops where no rule is precise enough. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.labelled import sample_ids, sampled
from lectern.session import prepare

WINDOW = 8
MIN_WORDS = 20
#: At most so many labelled documents of label 0 and of label 1 are learnt from.
SAMPLE_PER_CLASS = (4000, 4000)
MAX_RULES = 24
MAX_TERMS = 4
#: A rule needs this precision on all rows left and on those kept aside for pruning, and so many bad rows in either.
MIN_PRECISION = 0.97
MIN_COVER = 8
MIN_ASIDE = 5

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
_UPPER, _DIGIT, _PUNCT = (bytes(range(65, 91)), bytes(range(48, 58)), b".,;:!?\"'()-")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_distinct", "n_upper", "n_digits", "n_punct", "n_exclaim", "n_short")
FEATURES = {
    "mean_word": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "words_per_line": ("n_words", "n_lines"),
    "distinct_share": ("n_distinct", "n_words"), "upper_share": ("n_upper", "word_chars"), "digit_share": ("n_digits", "word_chars"), "punct_per_word": ("n_punct", "n_words"), "exclaim_per_word": ("n_exclaim", "n_words"), "short_share": ("n_short", "n_words"), "symbols_per_word": ("n_symbols", "n_words"),
}


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """How many words stand in a window of width words that is found twice or more. Hashes find candidates, the windows themselves decide."""
    if len(ids) <= width:
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    n = len(ids) - width + 1
    total = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        total = total * np.uint64(0x100000001B3) + mixed[j : j + n]
    order = np.argsort(total, kind="stable")
    same = total[order][1:] == total[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    _, which, counts = np.unique(np.lib.stride_tricks.sliding_window_view(ids, width)[at], axis=0, return_inverse=True, return_counts=True)
    at = at[counts[which.reshape(-1)] > 1]
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_counts(text: str | None) -> list[int]:
    """COUNTS, then EXTRA, of a whole text; all zero for null and for no words (but symbols, which need none)."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    ids: dict[bytes, int] = {}
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    return [
        len(words), len(text) - sum(text.count(c) for c in SPACES), sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(numbers),
        len(lines), len(ids), len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _DIGIT)), len(raw) - len(raw.translate(None, _PUNCT)), raw.count(b"!"), sum(len(w) < 3 for w in words),
    ]


def with_counts(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """The columns COUNTS and EXTRA (long) of the column text, then docs' columns, whose names must differ from those."""
    prepare(docs.sparkSession)
    names = [*COUNTS, *EXTRA]
    kept = [c for c in docs.columns if keep_text or c != text]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([text_counts(t) for t in b.column(text).to_pylist()], dtype=np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(pa.array(found[:, i]) for i in range(len(names))), *(b.column(c) for c in kept)], names=[*names, *kept])

    return docs.mapInArrow(run, docs.select(*[F.lit(0).cast("long").alias(n) for n in names], *kept).schema)


def feature(name: str) -> Column:
    over, under = FEATURES[name]
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self) -> Column:
        return feature(self.feature) >= self.threshold if self.above else feature(self.feature) < self.threshold


Rule = tuple[Term, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    held = np.ones(n, dtype=bool)
    for term in rule:
        held &= term.holds(x)
    return held


def _best_term(x: dict[str, np.ndarray], bad: np.ndarray, live: np.ndarray) -> Term | None:
    """The term with the largest information gain for bad rows among the live ones."""
    p0, n0 = int(bad[live].sum()), int((~bad[live]).sum())
    if not p0 or not n0:
        return None
    base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
    for name in sorted(x):
        values, is_bad = x[name][live], bad[live]
        order = np.argsort(values, kind="stable")
        v, b = values[order], is_bad[order]
        edges = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(edges):
            continue
        p, n = np.cumsum(b)[edges - 1], np.cumsum(~b)[edges - 1]
        for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
            gain = pp * (np.log2(np.maximum(pp, 1e-9) / (pp + nn)) - base)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), Term(name, above, float((v[edges[i]] + v[edges[i] - 1]) / 2)))
    return best[1]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 1) -> list[Rule]:
    """The decision list for bad rows; empty if nothing is told apart with MIN_PRECISION."""
    n, rules = len(bad), []
    left = np.ones(n, dtype=bool)
    draw = np.random.default_rng(seed)
    misses = 0
    while len(rules) < MAX_RULES and misses < 3 and (left & bad).sum() >= MIN_COVER:
        aside = draw.random(n) < 1 / 3
        grow, prune = left & ~aside, left & aside
        rule: Rule = ()
        while len(rule) < MAX_TERMS:
            live = grow & _covers(rule, x, n)
            term = _best_term(x, bad, live)
            if term is None:
                break
            rule = (*rule, term)

        def worth(r: Rule) -> tuple[float, int]:
            held = prune & _covers(r, x, n)
            p, q = int((held & bad).sum()), int((held & ~bad).sum())
            return ((p - q) / (p + q) if p + q else -1.0), -len(r)

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=())
        held = left & _covers(rule, x, n)
        aside_held = held & aside
        p, q = int((held & bad).sum()), int((held & ~bad).sum())
        pa_, qa = int((aside_held & bad).sum()), int((aside_held & ~bad).sum())
        if not rule or p < MIN_COVER or pa_ < MIN_ASIDE or p / (p + q) < MIN_PRECISION or pa_ < (pa_ + qa) * MIN_PRECISION:
            misses += 1
            continue
        rules.append(rule)
        left &= ~held
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The 1-based number of the first rule that holds, 0 if none: an ordered conditional expression."""
    out = None
    for no, rule in enumerate(rules, 1):
        test = rule[0].column()
        for term in rule[1:]:
            test = test & term.column()
        out = F.when(test, F.lit(no)) if out is None else out.when(test, F.lit(no))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def learn_rules(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = SAMPLE_PER_CLASS) -> list[Rule]:
    """Rules learnt from labels.quality (0: bad) on a bounded sample outside the held-out fold; no labels, no rules."""
    ids = sample_ids(labels, "quality", per_class)
    if not ids:
        return []
    rows = with_counts(sampled(docs.select("doc_id", "text"), ids)).filter(~base_failed())
    got = rows.select("label", *[feature(f).alias(f) for f in FEATURES]).distinct().orderBy(F.xxhash64(*FEATURES), "label").limit(sum(per_class)).collect()
    if not got:
        return []
    return learn({f: np.array([r[f] for r in got], dtype=float) for f in FEATURES}, np.array([r["label"] == 0 for r in got]))


def judge_quality(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = SAMPLE_PER_CLASS) -> DataFrame:
    """The counts, doc_id, base_failed, rule_no and kept of every document; docs' other columns are left out.

    Null and empty texts have no words and fail the base. Without labels only the base decides. Repeated rows are each
    judged alike, very long texts are counted whole, an empty table gives an empty result, clashing columns are not read.
    """
    return _judged(with_counts(docs.select("doc_id", "text")), learn_rules(docs, labels, per_class)).drop(*EXTRA)


def _judged(counted: DataFrame, rules: list[Rule]) -> DataFrame:
    out = counted.withColumns({"base_failed": base_failed(), "rule_no": verdict(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule_no") == 0))


def good_documents(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = SAMPLE_PER_CLASS) -> DataFrame:
    """docs without the rejected ones, with docs' columns, whatever their names."""
    rules = learn_rules(docs, labels, per_class)
    own = [f"_c{i}" for i in range(len(docs.columns))]
    counted = with_counts(docs.toDF(*own), own[docs.columns.index("text")], keep_text=True)
    return _judged(counted, rules).filter("kept").select(*[F.col(c).alias(n) for c, n in zip(own, docs.columns, strict=True)])
