"""Jaccard join of word n-gram sets by prefix trees.

All members have one order, and sets of similarity t share one of the first |x| - ceil(t |x|) + 1 of each. Under each
such member the sets that hold it meet: what follows it in each set, in that order, is stored in a trie, and a set walks
the trie with the overlap so far, once for all sets that share a path. A subtree is left as soon as the overlap and what
can still remain of the longest set in it, or of the walking set, are too few. At its ends a sketch of each set, the parity
of its members by hash, bounds from below in how many members two sets differ. What the walk can't rule out is verified on
whole sets. A pair need only meet at the first member it shares, so members whose sets all have the same member before
are passed over. Walks first stop at a few candidates; sets that these join are one component, and only the members with
more candidates are walked again, between components.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.similar import HASH_SEED, SKETCH, _common, _pair_batch, _roots, _small, _verified, prefix, shingle_set, sketch, wide_sketch
from lectern.session import materialize, prepare

#: Of the contract.
SHINGLE, SIMILARITY = 3, 0.9
#: Members after the shared one that a trie holds of a set at most; sets in one trie at most; candidates after which a first walk stops.
TAIL, BLOCK_ROWS, NEXT = 16, 4096, 2
PAIRS = 1 << 18
_EPS = 1e-9


class Trie:
    """Sets by what follows a shared member: (size, left, tail, sketch, root), left = size less the members up to the shared one.

    A node holds the sets whose tail ends there, or one set whose tail goes on alone, or children by member; and of all
    sets beneath it the least size, the most that is left, and the root they have in common (None: several).
    """

    __slots__ = ("sets", "similarity", "apart", "below", "ends", "alone", "least", "most", "root")

    def __init__(self, similarity: float) -> None:
        self.sets: list[tuple] = []
        self.similarity = similarity / (1 + similarity)  # of both sizes: members that similar sets share at least
        self.apart = (1 - similarity) / (1 + similarity)  # and members that only one of them has, at most
        self.below: list[dict | None] = []
        self.ends: list[list[int]] = []
        self.alone: list[int] = []
        self.least: list[int] = []
        self.most: list[int] = []
        self.root: list = []

    def _node(self, size: int, left: int, root) -> int:
        for column, value in ((self.below, None), (self.ends, []), (self.alone, -1), (self.least, size), (self.most, left), (self.root, root)):
            column.append(value)
        return len(self.below) - 1

    def add(self, size: int, left: int, tail: list[int], sketch: int = 0, root=None) -> None:
        no = len(self.sets)
        self.sets.append((size, left, tail, sketch, root))
        if not self.below:
            self.alone[self._node(size, left, root)] = no
            return
        at = depth = 0
        while True:
            self.least[at] = min(self.least[at], size)
            self.most[at] = max(self.most[at], left)
            if self.root[at] != root:
                self.root[at] = None
            other = self.alone[at]
            if other >= 0:  # no longer alone: the set that was goes one down
                self.alone[at] = -1
                was = self.sets[other]
                if depth < len(was[2]):
                    child = self._node(was[0], was[1], was[4])
                    self.alone[child] = other
                    self.below[at] = {was[2][depth]: child}
                else:
                    self.ends[at].append(other)
            if depth == len(tail):
                self.ends[at].append(no)
                return
            if self.below[at] is None:
                self.below[at] = {}
            child = self.below[at].get(tail[depth])
            if child is None:
                child = self.below[at][tail[depth]] = self._node(size, left, root)
                self.alone[child] = no
                return
            at, depth = child, depth + 1

    def walk(self, size: int, left: int, tail: list[int], sketch: int = 0, root=None) -> Iterator[int]:
        """Numbers of the sets that can be similar; those of the same root are left out unless it is None."""
        if not self.below:
            return
        members, last = set(tail), tail[-1] if tail else -1
        stack = [(0, 0, 1, 0)]  # node, members on its path, overlap, own members up to there

        def fits(no: int, depth: int, both: int, own: int) -> bool:
            """Both tails are known up to the lesser last member; from there on all that is left may be shared."""
            its_size, its_left, its_tail, its_sketch, its_root = self.sets[no]
            if root is not None and its_root == root:
                return False
            if (sketch ^ its_sketch).bit_count() > self.apart * (size + its_size) + _EPS:
                return False
            need = self.similarity * (size + its_size) - _EPS
            while both + min(its_left - depth, left - own) >= need:
                if depth >= len(its_tail) or own >= len(tail):
                    return True
                a, b = its_tail[depth], tail[own]
                both += a == b
                depth += a <= b
                own += b <= a
            return False

        while stack:
            at, depth, both, own = stack.pop()
            if root is not None and self.root[at] == root:
                continue
            if both + min(self.most[at] - depth, left - own) < self.similarity * (size + self.least[at]) - _EPS:
                continue
            if self.alone[at] >= 0:
                if fits(self.alone[at], depth, both, own):
                    yield self.alone[at]
                continue
            for no in self.ends[at]:
                if fits(no, depth, both, own):
                    yield no
            for member, child in (self.below[at] or {}).items():
                if member > last:  # of the walking set nothing is known from here on
                    for no in self._under(child):
                        if fits(no, depth, both, len(tail)):
                            yield no
                else:
                    stack.append((child, depth + 1, both + (member in members), bisect_right(tail, member, own)))

    def _under(self, at: int) -> Iterator[int]:
        stack = [at]
        while stack:
            at = stack.pop()
            if self.alone[at] >= 0:
                yield self.alone[at]
            yield from self.ends[at]
            stack.extend((self.below[at] or {}).values())


def _marked(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, text_key, node (hash of the whole set), size, prefix, sketch and, where it is wider, wide sketch of every row."""
    common = _common(docs, shingle)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b.column("text").to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), HASH_SEED) for s in sets], dtype=np.uint64).view(np.int64)
            heads = pa.array([prefix(s, common, similarity).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), heads, pa.array([sketch(s) for s in sets], pa.binary()), pa.array([wide_sketch(s) if len(s) > SKETCH else b"" for s in sets], pa.binary())], names=["doc_id", "text_key", "node", "size", "prefix", "sketch", "wide"])

    zero = F.lit(0).cast("long")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(run, rows.select("doc_id", "text_key", zero.alias("node"), zero.alias("size"), F.array(zero).alias("prefix"), F.lit(b"").alias("sketch"), F.lit(b"").alias("wide")).schema)


def _keyed(nodes: DataFrame) -> DataFrame:
    """node, size, at, key and before of every member of the prefixes; before the first member of a set there is none like another's."""
    before = F.concat(F.array("node"), F.slice("prefix", F.lit(1), F.size("prefix") - 1))
    rows = nodes.filter("size > 0").select("node", "size", F.posexplode(F.arrays_zip(F.col("prefix").alias("key"), before.alias("before"))).alias("at", "x"))
    return rows.select("node", "size", F.col("at").cast("long").alias("at"), "x.key", "x.before")


def _meeting(nodes: DataFrame, similarity: float, block_rows: int) -> DataFrame:
    """key, blocks: members under which sets have to meet. Where two sets hold a member, sizes and places must allow them to be similar; and of several sets not all may have the same member before."""
    rows = _keyed(nodes)
    held = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("sizes"), F.min(F.col("size") - F.col("at")).alias("left")).filter("n > 1")
    held = materialize(held.filter((F.col("n") > 2) | (F.col("left") >= similarity / (1 + similarity) * F.col("sizes") - _EPS)).select("key", "n"), "prefix-keys")
    before = rows.join(_small(held.select("key")), "key").groupBy("key").agg(F.min("before").alias("lo"), F.max("before").alias("hi")).filter("lo < hi")
    return materialize(held.join(before, "key").select("key", F.ceil(F.col("n") / block_rows).alias("blocks")), "prefix-keys")


def _following(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """key, block, blocks, size, left, node, tail and sketch of the sets under each of keys (key, blocks)."""
    rows = _keyed(nodes).drop("before").join(_small(keys), "key").join(nodes.select("node", "prefix", "sketch"), "node")
    tail = F.slice("prefix", (F.col("at") + 2).cast("int"), F.lit(TAIL))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return rows.select("key", block.alias("block"), "blocks", "size", (F.col("size") - F.col("at") - 1).alias("left"), "node", tail.alias("tail"), "sketch")


def _groups(batches: Iterable[pa.RecordBatch], by: list[str], columns: list[str]) -> Iterator[tuple[np.ndarray, list[list[int]], list[int]]]:
    """The rows of each group, by and columns as numbers, with their tails and sketches; rows of a group stand together."""
    held, tails, sketches = np.zeros((0, len(by) + len(columns)), dtype=np.int64), [], []
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in [*by, *columns]], axis=1)
        flat, ends = b.column("tail").flatten().to_numpy().view(np.uint64).tolist(), np.cumsum(b.column("tail").value_lengths().to_numpy())
        held, tails = np.concatenate([held, rows]), tails + [flat[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        sketches += [int.from_bytes(x) for x in b.column("sketch").to_pylist()]
        cuts = [0, *(np.flatnonzero((held[1:, : len(by)] != held[:-1, : len(by)]).any(axis=1)) + 1)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield held[i:j], tails[i:j], sketches[i:j]
        held, tails, sketches = held[cuts[-1] :], tails[cuts[-1] :], sketches[cuts[-1] :]
    if len(held):
        yield held, tails, sketches


def _first_walks(rows: DataFrame, similarity: float) -> DataFrame:
    """a, b: for each set at most NEXT candidates under each of its members; or, with a null a, a key that has or may have more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, more = [], []

        def out() -> pa.RecordBatch:
            pairs = _pair_batch(found)
            nothing = pa.nulls(len(more), pa.int64())
            columns = [pa.concat_arrays([pairs.column(0), nothing]), pa.concat_arrays([pairs.column(1), nothing]), pa.concat_arrays([pa.nulls(pairs.num_rows, pa.int64()), pa.array(more, pa.int64())])]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "key"])

        for held, tails, sketches in _groups(batches, ["key", "block"], ["blocks", "size", "left", "node"]):
            trie, open_still = Trie(similarity), held[0, 2] > 1
            for (size, left, node), tail, bits in zip(held[:, 3:].tolist(), tails, sketches, strict=True):
                for n, other in enumerate(trie.walk(size, left, tail, bits)):
                    if n == NEXT:
                        open_still = True
                        break
                    found.append(np.array([[node, held[other, 5]]]))
                trie.add(size, left, tail, bits)
            if open_still:
                more.append(held[0, 0])
            if len(found) + len(more) >= PAIRS:
                yield out()
                found, more = [], []
        yield out()

    dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block", "size", "node")
    return dealt.mapInArrow(run, "a long, b long, key long")


def _later_walks(rows: DataFrame, similarity: float) -> DataFrame:
    """a, b: all candidates under each key whose ends are in different components (root). Every two blocks of a key meet in a group of their own."""
    mixed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"))))
    met = rows.join(mixed, "key").select("key", "block", "size", "left", "node", "root", "tail", "sketch", other.alias("x")).select("key", "x.i", "x.j", "block", "size", "left", "node", "root", "tail", "sketch")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for held, tails, sketches in _groups(batches, ["key", "i", "j"], ["block", "size", "left", "node", "root"]):
            roots, counts = np.unique(held[:, 7], return_counts=True)
            if len(roots) < 2:
                continue
            alone, main = held[0, 1] == held[0, 2], roots[np.argmax(counts)]
            stored = np.flatnonzero(held[:, 3] == held[0, 1])
            trie = Trie(similarity)
            for i in stored:
                trie.add(int(held[i, 4]), int(held[i, 5]), tails[i], sketches[i], int(held[i, 7]))
            for i in np.flatnonzero(held[:, 7] != main) if alone else np.flatnonzero(held[:, 3] == held[0, 2]):
                size, left, node, root = held[i, 4:].tolist()
                for other in trie.walk(size, left, tails[i], sketches[i], root):
                    found.append(np.array([[node, held[stored[other], 6]]]))
                    if len(found) >= PAIRS:
                        yield _pair_batch(found)
                        found = []
        yield _pair_batch(found)

    dealt = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "size", "node")
    return dealt.mapInArrow(run, "a long, b long")


def components_of(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest doc_id that it reaches over links of that similarity or more.

    Words are cut at ASCII white space with A to Z lower-cased; a text with fewer words than a shingle is one member. Null
    texts and texts without words have no member and no link, and are their own component. Rows with equal sets are linked.
    A row without doc_id is linked like any other; where no row of a component has one, its id is null. Rows that stand
    twice stay twice. An empty table gives no rows, other columns are ignored, texts of any length count whole.
    """
    prepare(docs.sparkSession)
    marked = materialize(_marked(docs.select("doc_id", "text"), shingle, similarity), "prefix-rows")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    nodes = marked.groupBy("node").agg(F.min(first).alias("first"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"))
    nodes = materialize(nodes, "prefix-nodes")
    keys = _meeting(nodes, similarity, block_rows)
    met = materialize(_first_walks(_following(nodes, keys), similarity), "prefix-met")
    pairs = materialize(met.filter("a is not null").select("a", "b").distinct(), "prefix-pairs")
    slim, known = nodes.select("node"), nodes.select("node", "size", "first", F.when(F.length("wide") > 0, F.col("wide")).otherwise(F.col("sketch")).alias("sketch"))
    placed = materialize(_roots(slim, _verified(docs, known, pairs, shingle, similarity)), "prefix-placed")
    again = materialize(keys.join(met.filter("a is null").select("key").distinct(), "key", "left_semi"), "prefix-again")
    later = _later_walks(_following(nodes, again).join(placed, "node"), similarity)
    later = materialize(later.distinct(), "prefix-later")
    if later.limit(1).count():
        stars = placed.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        placed = materialize(_roots(slim, stars.unionAll(_verified(docs, known, later, shingle, similarity))), "prefix-placed")
    rooted = nodes.select("node", F.col("first.doc_id").alias("doc_id")).join(placed, "node")
    least = materialize(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "prefix-least")
    named = materialize(placed.join(least, "root").select("node", "component_id"), "prefix-named")
    found = marked.select("doc_id", "size", "node").join(named, "node")
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
