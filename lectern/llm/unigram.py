"""Token counts under a unigram model by dynamic programming over a trie of distinct pre-tokens.

A trie node stands for a prefix; its forward score is the best log-probability of any cut of that prefix into pieces,
and is worked out once for all pre-tokens that share it. A node where a pre-token ends stores that token count.
"""

from __future__ import annotations

import gc
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import prepare

VOCABULARY = "piece_bpe_32k.model"
#: Marks a word's beginning in the vocabulary.
MARK = "▁"
#: Trie nodes kept in a worker; beyond, the trie starts anew.
NODES_KEPT = 1_500_000
_WORDS = re.compile(r"[^ \t-\r]+")


def vocabulary_scores(path: str | None = None) -> dict[str, float]:
    """piece -> log-probability. The file's order is by frequency, so pieces get Zipf's law: 1 / (position + 1), normalised.

    Single bytes and control pieces are left out; text outside the vocabulary falls back to bytes."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (i + 1) for i in range(len(pieces))))
    return {p: -math.log(i + 1) - total for i, p in enumerate(pieces)}


class CountTrie:
    """Nodes are numbers: children by (node, character) in one table, forward score and tokens of the best cut. Pieces stand in a trie read from their ends."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.piece_next: dict[int, int] = {}
        self.piece_score: list[float | None] = [None]
        for piece, score in scores.items():
            node = 0
            for char in reversed(piece):
                key = node << 21 | ord(char)
                to = self.piece_next.get(key)
                if to is None:
                    to = self.piece_next[key] = len(self.piece_score)
                    self.piece_score.append(None)
                node = to
            self.piece_score[node] = score
        #: A byte of a character outside the vocabulary: less likely than any piece.
        self.byte = min(scores.values(), default=0.0) - 10.0
        self.known: dict[str, int] = {}
        self._restart()

    def _restart(self) -> None:
        self.child: dict[int, int] = {}
        self.forward = [0.0]
        self.tokens = [0]
        self.known.clear()

    def count(self, pre_token: str) -> int:
        """Tokens of the best cut; of equally likely cuts the one with the shorter last piece, all the way."""
        stored = self.known.get(pre_token)
        if stored is not None:
            return stored
        if len(self.forward) > NODES_KEPT:
            self._restart()
        child, path, node = self.child, [0], 0
        for end, char in enumerate(pre_token, 1):
            key = node << 21 | ord(char)
            node = child.get(key)
            if node is None:
                node = child[key] = len(self.forward)
                self._score(pre_token, end, path)
            path.append(node)
        self.known[pre_token] = self.tokens[node]
        return self.tokens[node]

    def _score(self, text: str, end: int, path: list[int]) -> None:
        piece_next, piece_score, forward = self.piece_next, self.piece_score, self.forward
        best, at_best, node, at = -math.inf, 0, 0, end
        while at:
            at -= 1
            node = piece_next.get(node << 21 | ord(text[at]))
            if node is None:
                break
            score = piece_score[node]
            if score is not None and forward[path[at]] + score > best:
                best, at_best = forward[path[at]] + score, path[at]
        if best == -math.inf:
            n_bytes = len(text[end - 1].encode("utf-8", "surrogatepass"))
            best, tokens = forward[path[end - 1]] + n_bytes * self.byte, self.tokens[path[end - 1]] + n_bytes
        else:
            tokens = self.tokens[at_best] + 1
        forward.append(best)
        self.tokens.append(tokens)


_TRIES: dict[int, CountTrie] = {}


def _trie(key: int, scores: dict[str, float]) -> CountTrie:
    """One trie a worker and vocabulary: its nodes serve all tasks that the worker runs."""
    if key not in _TRIES:
        _TRIES.clear()
        _TRIES[key] = CountTrie(scores)
    return _TRIES[key]


def count_tokens(docs: DataFrame, vocabulary: str | None = None, scores: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens of every document; a word is a run of `[^\\x20\\x09-\\x0D]`, marked at its beginning.

    scores: piece -> log-probability of a unigram model that the caller has; default: vocabulary_scores of the file.
    Null and empty texts have no tokens. Words of any length are cut whole; of equally likely cuts the one with the
    shorter last piece counts. Repeated rows are counted each, an empty table gives an empty result, other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    scores = vocabulary_scores(vocabulary) if scores is None else scores
    shared, key = spark.sparkContext.broadcast(scores), hash(frozenset(scores.items()))  # a vocabulary: 32,000 entries

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(key, shared.value)
        gc.disable()  # nodes form no cycles
        for b in batches:
            words = [_WORDS.findall(t or "") for t in b.column("text").to_pylist()]
            count_of = {w: trie.count(MARK + w) for w in sorted(set().union(*words))}  # neighbours share prefixes
            counts = [sum(map(count_of.__getitem__, ws)) for ws in words]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(ws) for ws in words], pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_tokens")).schema)
