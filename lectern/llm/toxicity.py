"""Toxicity: bags of subword embeddings averaged into a linear softmax, all trained jointly in numpy.

A word is the bag of its character n-grams (its ends marked), so a misspelt or inflected word shares most vectors with
the words learnt from. The bags of SPAN neighbouring words are averaged (those of a whole text, if it is shorter), and
two softmax rows on that average give the span's probability of label 1. A few toxic words make a document toxic,
however long it is: its score is its worst span's, and while training the chance that any span is toxic.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.held import forget, release
from lectern.llm.labelled import held_out, sample_ids, sampled
from lectern.session import prepare

#: At most so many labelled documents of label 0 and of label 1, of at most so many characters each, are learnt from.
SAMPLE_PER_CLASS = (2000, 1000)
SAMPLE_CHARS = 20_000
NGRAMS = (3, 4, 5)
#: At most so many n-grams, those in the most documents, have vectors.
MAX_NGRAMS = 120_000
MIN_DOCS = 3
DIM = 8
#: Words whose bags are averaged.
SPAN = 2
EPOCHS = 50
RATE = 0.15
#: Shrinks vectors that few documents speak for.
DECAY = 1e-5
THRESHOLD = 0.7
#: Margins of so many distinct words are kept while scoring; then the store starts anew.
WORDS_KEPT = 200_000
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def subwords(word: str) -> set[str]:
    """The n-grams of the word with its ends marked, and the whole marked word."""
    w = f"<{word}>"
    return {w[i : i + n] for n in NGRAMS for i in range(len(w) - n + 1)} | {w}


@dataclass
class Model:
    """weight: an n-gram's vector times the difference of the two softmax rows, all that a score needs of them; bias: the difference of their biases.

    Unknown n-grams count as zero vectors."""

    weight: dict[str, float]
    bias: float

    def word(self, word: str) -> float:
        """The word's bag, averaged, times that difference; numbers are no evidence."""
        if word.isdigit():
            return 0.0
        grams = subwords(word)
        get = self.weight.get
        return sum(get(g, 0.0) for g in grams) / len(grams)


def spans(sizes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last-but-one word, and document, of every span of documents with these numbers of words, laid end to end; no words, no span."""
    ends = np.cumsum(sizes)
    n = np.where(sizes > 0, np.maximum(sizes - span + 1, 1), 0)
    doc = np.repeat(np.arange(len(sizes)), n)
    first = (ends - sizes)[doc] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return first, np.minimum(first + span, ends[doc]), doc


def span_means(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return (total[last] - total[first]) / (last - first)


class WordMargins(dict):
    """Margins of the words met so far."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        self[word] = value = self.model.word(word)
        return value


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def score_text(model: Model, text: str | None, known: WordMargins, span: int = SPAN) -> float:
    """The probability of label 1 of the worst span; a text without words is one of zero vectors."""
    if len(known) > WORDS_KEPT:
        known.clear()
    words = words_of(text)
    values = np.fromiter(map(known.__getitem__, words), dtype=float, count=len(words))
    top = span_means(values, *spans(np.array([len(words)]), span)[:2]).max() if words else 0.0
    return float(_sigmoid(top + model.bias))


def train(texts: list[str], labels: list[int], dim: int = DIM, epochs: int = EPOCHS, span: int = SPAN, seed: int = 7) -> Model:
    """Embeddings and softmax by gradient descent (Adam) on documents as bags of spans."""
    if len(set(labels)) < 2:
        return Model({}, 3.0 if labels and labels[0] else -3.0)
    number: dict[str, int] = {}  # words are kept once, texts as numbers of words
    used, lengths, word_docs = array("i"), [], Counter()
    for text in texts:
        own = [number.setdefault(w, len(number)) for w in words_of(text)]
        used.extend(own)
        lengths.append(len(own))
        word_docs.update(set(own))
    gram_docs: Counter[str] = Counter()
    words = sorted(number)
    for w in words:
        if not w.isdigit():
            for g in subwords(w):
                gram_docs[g] += word_docs[number[w]]
    top = sorted((g for g, n in gram_docs.items() if n >= MIN_DOCS), key=lambda g: (-gram_docs[g], g))[:MAX_NGRAMS]
    del gram_docs
    gram_id = {g: i for i, g in enumerate(top)}
    place = np.zeros(len(words), dtype=np.int64)  # of a word in order, by its number
    place[[number[w] for w in words]] = np.arange(len(words))
    share, sizes, ids = np.zeros(len(words)), np.zeros(len(words), dtype=np.int64), array("i")
    for i, w in enumerate(words):
        if not w.isdigit():
            own = subwords(w)
            share[i] = 1 / len(own)
            found = sorted(gram_id[g] for g in own if g in gram_id)
            sizes[i] = len(found)
            ids.extend(found)
    grams = np.frombuffer(ids, dtype=np.int32)
    of_word = np.repeat(np.arange(len(words)), sizes)
    at = place[np.frombuffer(used, dtype=np.int32)]
    del number, used, word_docs
    first, last, doc = spans(np.array(lengths), span)
    length = last - first
    y = np.array(labels, dtype=float)
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    draw = np.random.default_rng(seed)
    embed = draw.normal(0, 0.1, (len(top), dim))
    soft = draw.normal(0, 0.3, (2, dim))
    bias = np.array([0.0, -4.0])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (embed, soft, bias)]

    def bags() -> np.ndarray:
        return np.stack([np.bincount(of_word, embed[grams, k], len(words)) for k in range(dim)], axis=1) * share[:, None]

    for step in range(1, epochs + 1):
        direction, bag = soft[1] - soft[0], bags()
        p = _sigmoid(span_means((bag @ direction)[at], first, last) + bias[1] - bias[0])
        miss = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(lengths))  # log of the chance that no span is toxic
        p_doc = np.maximum(1 - np.exp(miss), 1e-9)
        slope = np.where(y[doc] > 0, -p * (1 - p_doc[doc]) / p_doc[doc], p) * weight[doc] / len(lengths)
        edge = np.bincount(first, slope / length, len(at) + 1) - np.bincount(last, slope / length, len(at) + 1)
        at_word = np.bincount(at, np.cumsum(edge)[:-1], len(words))  # what each use of a word got from its spans
        to_bag = at_word[:, None] * direction[None, :] * share[:, None]
        g_embed = np.stack([np.bincount(grams, to_bag[of_word, k], len(top)) for k in range(dim)], axis=1)
        g_dir = (at_word[:, None] * bag).sum(axis=0)
        grads = (g_embed + DECAY * embed, np.stack([-g_dir, g_dir]) + 1e-4 * soft, np.array([-slope.sum(), slope.sum()]))
        for p_, g_, (m, v) in zip((embed, soft, bias), grads, moments, strict=True):
            m += 0.1 * (g_ - m)
            v += 0.001 * (g_ * g_ - v)
            p_ -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    tops = np.where(np.bincount(doc, minlength=len(lengths)) > 0, -np.inf, 0.0)
    np.maximum.at(tops, doc, span_means((bags() @ (soft[1] - soft[0]))[at], first, last))
    scale, shift = _fitted(tops, y)
    soft *= scale
    value = embed @ (soft[1] - soft[0])
    return Model({g: float(value[i]) for g, i in gram_id.items()}, shift)


def _fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The last fit of the softmax, to worst spans: what its rows are multiplied by (not negative) and its bias, by Newton steps with a little shrinkage."""
    spread = float(x.std()) or 1.0
    z = np.stack([(x - x.mean()) / spread, np.ones_like(x)], axis=1)
    beta, ridge = np.zeros(2), np.array([0.05, 0.0])
    for _ in range(30):
        p = _sigmoid(z @ beta)
        grad = z.T @ (p - y) + ridge * beta
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-6)
        beta -= np.linalg.solve(hess, grad)
    scale = max(beta[0], 0.0) / spread
    return float(scale), float(beta[1] - scale * x.mean())


def learn_toxicity(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = SAMPLE_PER_CLASS, chars: int = SAMPLE_CHARS) -> Model:
    """A model from labels.toxic on a bounded sample outside the held-out fold: so many documents of label 0 and of 1, those of at most chars characters."""
    ids = sample_ids(labels, "toxic", per_class)
    if not ids:
        return train([], [])
    rows = sampled(docs.select("doc_id", "text").filter(F.length("text") <= chars), ids).select("text", "label").distinct()
    got = rows.orderBy(F.xxhash64("text"), "label").limit(sum(per_class)).collect()
    texts, values = [r["text"] for r in got], [r["label"] for r in got]
    del rows, got
    model = train(texts, values)
    del texts
    release()  # the driver's pages too
    return model


def with_score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """score (double), then docs' columns, which must not have that name."""
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if keep_text or c != text]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_NGRAMS entries at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # what the worker keeps of another stage
        known = WordMargins(shared.value)
        for b in batches:
            scores = pa.array([score_text(shared.value, t, known) for t in b.column(text).to_pylist()], type=pa.float64())
            yield pa.RecordBatch.from_arrays([scores, *(b.column(c) for c in kept)], names=["score", *kept])
        known.clear()
        release()

    return docs.mapInArrow(run, docs.select(F.lit(0.0).alias("score"), *kept).schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts get the score of no evidence. Without labels of both kinds every score is low (or high, if
    all labels are 1). Repeated rows score alike, long texts are scored whole, null ids are not held out, an empty
    table gives an empty result, other columns are ignored.
    """
    scored = with_score(docs.select("doc_id", "text"), learn_toxicity(docs, labels, per_class))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = SAMPLE_PER_CLASS) -> DataFrame:
    """docs without those predicted toxic, with docs' columns, whatever their names."""
    model = learn_toxicity(docs, labels, per_class)
    own = [f"_c{i}" for i in range(len(docs.columns))]
    scored = with_score(docs.toDF(*own), model, own[docs.columns.index("text")], keep_text=True)
    return scored.filter(F.col("score") < THRESHOLD).select(*[F.col(c).alias(n) for c, n in zip(own, docs.columns, strict=True)])
