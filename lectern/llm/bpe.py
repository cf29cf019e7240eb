"""Byte-level BPE as a lazily determinised transducer, and its streaming inverse.

For every prefix of a piece exactly one token can end its encoding, namely the one whose neighbours both hold: a token
may follow another only if the merges, run on just those two, leave them as they are. A state is the set of places where
the token under way may have begun, each a trie node and the token before it; its output is the token that has just
ended, from which a piece's tokens are read backwards. Within a long piece, tokens on which all places agree are emitted
after LOOKAHEAD bytes, so what is held stays bounded. States and moves are built when first met.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.held import held, release
from lectern.session import prepare

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Moves, pieces and answers about neighbours kept in a worker; beyond, each starts anew.
MOVES_KEPT = 250_000
PIECES_KEPT = 150_000
PAIRS_KEPT = 200_000
LONG_PIECE = 64
#: Bytes read ahead, at most, before tokens are emitted that are certain.
LOOKAHEAD = 4096
#: Ids are decoded in runs of this many.
RUN = 4096


def vocabulary_bytes(path: str | None = None) -> bytes:
    """The rank file; by default the public one that is installed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        return f.read()


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.next: list[dict[int, int]] = [{}]  # the trie of all tokens
        self.token: list[int | None] = [None]
        self.depth: list[int] = [0]
        for text, rank in ranks.items():
            node = 0
            for byte in text:
                to = self.next[node].get(byte)
                if to is None:
                    to = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    self.token.append(None)
                    self.depth.append(self.depth[node] + 1)
                node = to
            self.token[node] = rank
        self.size = {rank: len(text) for text, rank in ranks.items()}
        self.text = {rank: text for text, rank in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.stands: dict[int, bool] = {}
        self.edges: dict[int, list[int]] = {}
        self.ordered = True
        self._restart()

    def _restart(self) -> None:
        #: A state: places (node, token before or -1); in the first, a token has just ended, which is that state's token.
        self.states: dict[tuple, int] = {((0, -1),): 0}
        self.places: list[tuple] = [((0, -1),)]
        self.ended: list[int] = [-1]
        self.moves: dict[int, int] = {}

    def merged(self, text: bytes) -> list[bytes]:
        """Merges run by rank on a short text."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins; None for one byte, or if the merges don't make the token."""
        if token not in self.split:
            text = self.text[token]
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
            self.stands[token] = len(text) == 1 or len(parts) == 2
            if self.split[token] and max(self.split[token]) > token:
                self.ordered = False
        return self.split[token]

    def _edge(self, token: int, side: int) -> list[int]:
        """The tokens that stand in turn at the token's right (1) or left (0) end while merges build it, from a byte on."""
        key = token << 1 | side
        if key not in self.edges:
            halves = self._halves(token)
            self.edges[key] = [*self._edge(halves[side], side), token] if halves else [token]
        return self.edges[key]

    def _stands(self, token: int) -> bool:
        if token not in self.stands:
            self._halves(token)
        return self.stands[token]

    def _follows(self, before: int, token: int) -> bool:
        """Whether the merges leave the two tokens as they are. Ranks rise from a token's halves to the token, so the
        ends that meet change in the order of their ranks, and a merge across is made if its rank comes first (left before right)."""
        key = before << 32 | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[key] = self._stands(token) and (before < 0 or self._compatible(before, token))
        return known

    def _compatible(self, before: int, token: int) -> bool:
        left, right, i, j = self._edge(before, 1), self._edge(token, 0), 0, 0
        if not self.ordered:  # halves of higher rank than the whole: no such order, so run the merges
            return self.merged(self.text[before] + self.text[token]) == [self.text[before], self.text[token]]
        text, ranks, none = self.text, self.ranks, 1 << 60
        while True:
            across = ranks.get(text[left[i]] + text[right[j]], none)
            next_left = left[i + 1] if i + 1 < len(left) else none
            next_right = right[j + 1] if j + 1 < len(right) else none
            if across < next_left and across <= next_right:
                return False
            if next_left == next_right == none:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _move(self, state: int, byte: int) -> int:
        trie, tokens, pairs, places = self.next, self.token, self.pairs, [None]
        for node, before in self.places[state]:
            to = trie[node].get(byte)
            if to is None:
                continue
            if trie[to]:  # else no token goes on from here
                places.append((to, before))
            token = tokens[to]
            if token is not None and places[0] is None:
                fits = pairs.get(before << 32 | token)
                if self._follows(before, token) if fits is None else fits:
                    places[0] = (0, token)
        key = tuple(places)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.places)
            self.places.append(key)
            self.ended.append(places[0][1])
        self.moves[state << 8 | byte] = to
        return to

    def _back(self, lasts: list[int], end: int) -> list[int]:
        """The tokens of the first `end` bytes read, given the last token of each prefix."""
        out, size = [], self.size
        while end > 0:
            token = lasts[end - 1]
            out.append(token)
            end -= size[token]
        out.reverse()
        return out

    def _certain(self, lasts: list[int], state: int) -> tuple[int, list[int]]:
        """How many bytes' tokens no further input can change, and those tokens: the part that all places of the state share."""
        shared: list[int] | None = None
        for node, _ in self.places[state]:
            chain = self._back(lasts, len(lasts) - self.depth[node])
            n = next((k for k, (a, b) in enumerate(zip(chain, chain if shared is None else shared)) if a != b), min(len(chain), len(chain if shared is None else shared)))
            shared = chain[:n]
        return sum(self.size[t] for t in shared), shared

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece; a piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.moves) >= MOVES_KEPT:
            self._restart()
        if len(piece) <= LOOKAHEAD:
            lasts, _ = self._read(piece, 0)
            return self._back(lasts, len(lasts))
        out, held, state = [], [], 0
        for at in range(0, len(piece), LOOKAHEAD):
            more, state = self._read(piece[at : at + LOOKAHEAD], state)
            held += more
            n, sure = self._certain(held, state)
            out += sure
            del held[:n]
        return out + self._back(held, len(held))

    def _read(self, data: bytes, state: int) -> tuple[list[int], int]:
        """The last token of each prefix, and the state reached."""
        lasts, get, ended = [], self.moves.get, self.ended
        for byte in data:
            to = get(state << 8 | byte)
            state = self._move(state, byte) if to is None else to
            lasts.append(ended[state])
        return lasts, state


class Encoder:
    """Whole texts: pieces by the pattern, each through the transducer; short pieces met before are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern)
        self.known: dict[str, bytes] = {}  # ids as bytes: lists of numbers would take several times the memory

    def encode(self, text: str | None) -> np.ndarray:
        out: list[bytes] = []
        known, encode = self.known, self.transducer.encode
        for piece in self.split.findall(text or ""):
            ids = known.get(piece)
            if ids is None:
                ids = array("I", encode(piece.encode("utf-8", "surrogatepass"))).tobytes()
                if len(piece) <= LONG_PIECE:
                    if len(known) > PIECES_KEPT:  # also within a text, which may be of any length
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), dtype=np.uint32).astype("<u4", copy=False)


class Utf8Stream:
    """Text of bytes that come in any cuts: a state is how many bytes the character under way still lacks, and the range its next byte must be in.

    Byte runs that are no UTF-8 become U+FFFD, one for each longest start of a character, as decoders commonly do."""

    _FIRST = {**{b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}, 0xE0: (2, 0xA0, 0xBF), **{b: (2, 0x80, 0xBF) for b in (*range(0xE1, 0xED), 0xEE, 0xEF)}, 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), **{b: (3, 0x80, 0xBF) for b in range(0xF1, 0xF4)}, 0xF4: (3, 0x80, 0x8F)}

    def __init__(self) -> None:
        self.open = b""
        self.state: tuple[int, int, int] | None = None

    def feed(self, data: bytes) -> str:
        """The text that is certain by now."""
        out, at = [], 0
        while self.state and at < len(data):  # the character that the last call left open
            lacking, low, high = self.state
            if not low <= data[at] <= high:
                out.append("�")
                self.open, self.state = b"", None
                break
            self.open += data[at : at + 1]
            at += 1
            self.state = (lacking - 1, 0x80, 0xBF) if lacking > 1 else None
            if not self.state:
                out.append(self.open.decode())
                self.open = b""
        if self.state:
            return "".join(out)
        end = len(data)
        for back in range(1, min(3, end - at) + 1):  # an open character can begin at most three bytes before the end
            first = self._FIRST.get(data[end - back])
            if first and first[0] >= back:
                state, tail = first, data[end - back + 1 :]
                for byte in tail:
                    if not state[1] <= byte <= state[2]:
                        break
                    state = (state[0] - 1, 0x80, 0xBF)
                else:
                    self.open, self.state, end = data[end - back :], state, end - back
                break
        out.append(data[at:end].decode("utf-8", "replace"))
        return "".join(out)

    def close(self) -> str:
        left, self.open, self.state = self.open, b"", None
        return "�" if left else ""


def decode_bytes(ids: np.ndarray, text: dict[int, bytes]) -> Iterator[bytes]:
    """The bytes of ids, run by run."""
    for at in range(0, len(ids), RUN):
        yield b"".join(map(text.__getitem__, ids[at : at + RUN].tolist()))


def decode_text(ids: np.ndarray, text: dict[int, bytes]) -> Iterator[str]:
    """The text of ids, run by run; no character is cut."""
    stream = Utf8Stream()
    for run in decode_bytes(ids, text):
        yield stream.feed(run)
    yield stream.close()


def _encoder(data: bytes, pattern: str) -> Encoder:
    """One encoder a worker and vocabulary: its states serve all tasks that the worker runs."""
    return held(("bpe", hashlib.sha256(data).hexdigest(), pattern), lambda: Encoder(parse_ranks(data), pattern))


def encode_documents(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>, if asked for), ids_sha256 and decoded_sha256 of every document.

    A null text is encoded as the empty one: no tokens. Long texts are encoded whole; repeated rows each; an empty table
    gives an empty result; other columns are ignored. Letters and numbers are those of the regex module; the few that
    Unicode added after version 16 may be split unlike the tiktoken library, whose tables are older. vocabulary: path of a rank file that the driver can read.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((vocabulary_bytes(vocabulary), pattern or default_pattern()))  # a vocabulary file: under 1 MB
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*shared.value)
        gc.disable()  # states form no cycles, and there are many: collecting would only walk them again and again
        try:
            yield from encoded(encoder, batches)
        finally:
            gc.enable()  # the worker goes on to other tasks
            release()

    def encoded(encoder: Encoder, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, shas, decoded, kept = [], [], [], []
            for t in b.column("text").to_pylist():
                ids = encoder.encode(t)
                counts.append(len(ids))
                shas.append(hashlib.sha256(ids.tobytes()).hexdigest())
                digest, stream = hashlib.sha256(), Utf8Stream()
                for part in decode_bytes(ids, encoder.transducer.text):
                    digest.update(stream.feed(part).encode("utf-8", "surrogatepass"))
                digest.update(stream.close().encode())
                decoded.append(digest.hexdigest())
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            columns = [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string()), *([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = docs.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256"), *([F.array(F.lit(0)).alias("ids")] if keep_ids else [])).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema)
