"""Near copies by Jaccard similarity of word shingles: SimHash and pivot tables first, then an exact set join for what bits miss.

Texts of similarity 0.8 differ in about ten bits of 64 at the median and in far more at worst, so no bit limit of a
fingerprint finds them all. Close fingerprints therefore only give the first candidates. For the rest: sets of similarity
t share a member among the first |x| - ceil(t |x|) + 1 of each, in any order of all members. These members are the keys
under which sets meet; sizes, positions and then parity sketches, of a bit a member at least, discard pairs that cannot
reach t, and survivors are verified on whole sets. A pair carries sketches, never members: its two texts are exchanged
once, when it is verified. Members that a sample finds common come last in the order, so that a passage of many texts is
seldom a key. The sample affects the work, never the result.

A set first meets its next ones by size under each key. What that leaves open goes on in rounds: a set meets, under each
key, only the few of other components whose sketches are closest, the links found join components, and the next round
meets only between what is still apart. When a round joins nothing more, all that can still be similar is verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.llm.simhash import HASH_SEED, fingerprint, links
from lectern.session import materialize, prepare

SHINGLE = 5
SIMILARITY = 0.8
#: One text of so many is sampled; members in COMMON sampled texts come last, at most MOST_COMMON of them.
SAMPLED, COMMON, MOST_COMMON = 32, 4, 1 << 16
#: Neighbours by size within a key that meet first; all others meet only if that has not joined them.
NEXT = 2
#: Bits of a narrow sketch; rounds of closest candidates at most, before all that is left is verified.
SKETCH, ROUNDS = 512, 12
#: A key's rows meet in blocks of so many; two blocks are in one task's memory.
BLOCK_ROWS = 4096
#: Pairs of a batch that is handed on.
PAIRS = 1 << 18
#: Tables of keys are broadcast up to so many rows (of a few numbers each), by count; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Pairs to verify are dealt into so many such tables at most, each a reading of the texts; beyond, texts are joined by a shuffle.
SLICES = 8
_EPS = 1e-9


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle, and one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest, width = xxhash.xxh64_intdigest, min(shingle, len(words))
    hashes = np.fromiter((digest(w, HASH_SEED) for w in words), dtype=np.uint64, count=len(words))
    n = len(words) - width + 1
    mixed = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        mixed = (mixed ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def ordered(members: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The members as numbers whose order is the order of all members: common ones (sorted) have the highest bit."""
    out = members >> np.uint64(1)
    if len(common) and len(members):
        at = np.minimum(np.searchsorted(common, members), len(common) - 1)
        out |= (common[at] == members).astype(np.uint64) << np.uint64(63)
    return np.sort(out)


def prefix(members: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first members in that order, so many that similar sets share one."""
    n = len(members)
    return ordered(members, common)[: n - math.ceil(similarity * n - _EPS) + 1] if n else members


def sketch(members: np.ndarray, bits: int = SKETCH) -> bytes:
    """The parity of how many members fall on each bit: where two sketches differ, a member is in one set only."""
    return np.packbits((np.bincount((members >> np.uint64(7)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide_sketch(members: np.ndarray) -> bytes:
    """A sketch of a power of two bits, as many as members or more."""
    return sketch(members, max(SKETCH, 1 << max(0, len(members) - 1).bit_length()))


def folded(drawn: bytes, bits: int = SKETCH) -> np.ndarray:
    """The sketch of so many bits that members of a wider one have, in words of 64: its parts' bits, added up."""
    return np.bitwise_xor.reduce(np.frombuffer(drawn, dtype=np.uint64).reshape(-1, bits // 64), axis=0)


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def can_be_similar(a: bytes, size_a: int, b: bytes, size_b: int, similarity: float) -> bool:
    """False only where sketches a and b of sets of these sizes rule similarity out; the wider one is folded."""
    if min(size_a, size_b) < similarity * max(size_a, size_b) - _EPS:
        return False
    bits = 8 * min(len(a), len(b))
    apart = int(np.bitwise_count(folded(a, bits) ^ folded(b, bits)).sum(dtype=np.int64))
    return apart <= (1 - similarity) / (1 + similarity) * (size_a + size_b) + _EPS


def _common(docs: DataFrame, shingle: int) -> np.ndarray:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, shingle).view(np.int64))], names=["key"])

    some = docs.select("text", F.xxhash64("text").alias("_key")).filter(F.pmod("_key", F.lit(SAMPLED)) == 0).dropDuplicates(["_key"])
    counted = some.select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    found = counted.orderBy(F.desc("n"), "key").limit(MOST_COMMON).select("key").toArrow()
    return np.sort(found.column("key").to_numpy().astype(np.int64).view(np.uint64))


def _marked(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, text_key, node (hash of the whole set), fp, size, prefix and (wide) sketch of every row.

    A task tells a node's prefix once; that of its other rows is empty."""
    common = _common(docs, shingle)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            texts = b.column("text").to_pylist()
            sets = [shingle_set(t, shingle) for t in texts]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), HASH_SEED) for s in sets], dtype=np.uint64).view(np.int64)
            fps = np.fromiter((fingerprint(t, shingle) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64)
            heads = []
            for node, members in zip(nodes.tolist(), sets, strict=True):
                heads.append(prefix(members[:0] if node in seen else members, common, similarity).view(np.int64))
                seen.add(node)
            arrays = [pa.array(heads, pa.list_(pa.int64())), pa.array([wide_sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(nodes), pa.array(fps), pa.array([len(s) for s in sets], pa.int64()), *arrays], names=["doc_id", "text_key", "node", "fp", "size", "prefix", "sketch"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    zero = F.lit(0).cast("long")
    schema = rows.select("doc_id", "text_key", zero.alias("node"), zero.alias("fp"), zero.alias("size"), F.array(zero).alias("prefix"), F.lit(b"").alias("sketch")).schema
    return rows.mapInArrow(run, schema)


def _numbers(b: pa.RecordBatch, columns: tuple[str, ...]) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], axis=1)


def neighbours(rows: np.ndarray, similarity: float, apart: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of pairs within a key, at most so many rows apart, that can be similar; rows (key, size, node, position) sorted so."""
    key, size, at = rows[:, 0], rows[:, 1], rows[:, 3]
    live = np.arange(len(rows))
    for k in range(1, apart + 1):
        live = live[live + k < len(rows)]
        live = live[(key[live] == key[live + k]) & (size[live] >= similarity * size[live + k] - _EPS)]
        other = live + k
        good = _enough(size[live], at[live], size[other], at[other], similarity)
        yield live[good], other[good]


def _enough(size_a, at_a, size_b, at_b, similarity: float):
    """Whether sets can share enough members from their first common one on."""
    return np.minimum(size_a - at_a, size_b - at_b) >= similarity / (1 + similarity) * (size_a + size_b) - _EPS


def across(rows: np.ndarray, similarity: float, most: int | None = None) -> Iterator[tuple[np.ndarray, bool]]:
    """Pairs of nodes of different components that can be similar, among rows (size, position, node, component, sketch) of one key, sorted by size.

    Rows of the largest component do not meet one another. most: a row meets so many of its closest by sketch at most; with the pairs, whether it had more."""
    size, at, node, root = rows[:, :4].T
    sketches = np.ascontiguousarray(rows[:, 4:]).view(np.uint64)
    values, counts = np.unique(root, return_counts=True)
    main = root == values[np.argmax(counts)]
    for i in np.flatnonzero(~main):
        lo, hi = np.searchsorted(size, similarity * size[i] - _EPS), np.searchsorted(size, size[i] / similarity + _EPS, "right")
        j = np.arange(lo, hi)
        j = j[(main[j] | (j > i)) & (root[j] != root[i])]
        j = j[_enough(size[i], at[i], size[j], at[j], similarity)]
        apart = np.bitwise_count(sketches[j] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        good = apart <= (1 - similarity) / (1 + similarity) * (size[i] + size[j]) + _EPS
        j, apart = j[good], apart[good]
        if cut := most is not None and len(j) > most:
            j = j[np.argpartition(apart, most)[:most]]
        if len(j):
            yield np.stack([np.full(len(j), node[i]), node[j]], axis=1), cut


def _pair_batch(found: list[np.ndarray], more: np.ndarray | None = None) -> pa.RecordBatch:
    pairs = np.unique(np.sort(np.concatenate([np.zeros((0, 2), dtype=np.int64), *found]), axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    if more is None:
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
    empty, nothing = pa.nulls(len(pairs), pa.int64()), pa.nulls(len(more), pa.int64())
    columns = [(pa.array(pairs[:, 0]), pa.array(more[:, 2])), (pa.array(pairs[:, 1]), nothing), *((empty, pa.array(more[:, c])) for c in (0, 1, 3))]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["a", "b", "key", "size", "at"])


def _met(keyed: DataFrame, similarity: float) -> DataFrame:
    """a, b: pairs of neighbours by size within a key; or, with a null b, the rows (a key, size, node, at) of keys that may hold more.

    keyed: (key, place, node), where place is the size, then 32 bits of position; repeated rows count once. Rows are dealt by range, so a frequent key is spread over tasks. Batches are cut anywhere: a key that touches a cut counts as one that may hold more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key, place, node = _numbers(b, ("key", "place", "node")).T
            once = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
            rows = np.stack([key, place >> 32, node, place & 0xFFFFFFFF], axis=1)[once]
            found = [rows[np.stack(p, axis=1), 2] for p in neighbours(rows, similarity, NEXT)]
            key = rows[:, 0]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            counts = np.diff([*starts, len(rows)])
            more = counts > NEXT + 1
            more[[0, -1]] = True
            yield _pair_batch(found, rows[np.repeat(more, counts)])

    dealt = keyed.repartitionByRange("key", "place", "node").sortWithinPartitions("key", "place", "node")
    return dealt.mapInArrow(run, "a long, b long, key long, size long, at long")


def _open(rows: DataFrame, block_rows: int) -> DataFrame:
    """The rows (key, size, node, at, root) of keys that are not in one component, with the blocks that each key has."""
    counted = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    counted = counted.select("key", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    return rows.join(counted, "key").select("key", "size", "node", "at", "root", "blocks")


def _met_later(rows: DataFrame, sketches: DataFrame, similarity: float, most: int | None = None) -> DataFrame:
    """a, b: all pairs of rows (key, size, node, at, root, blocks) of one key whose ends are in different components and can be similar.

    Rows of a long key are dealt into blocks by node, and every two blocks meet in a group of their own.
    most: the closest of a group for each row only; a row with a null b then says that there were more. sketches: (node, sketch)."""
    open_rows = rows.join(sketches, "node").withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"))))
    drawn = [f"s{n}" for n in range(SKETCH // 64)]
    met = open_rows.select("key", "size", "node", "at", "root", "sketch", other.alias("x"))
    met = met.select("key", "x.i", "x.j", "size", "node", "at", "root", *(F.col("sketch")[n].alias(c) for n, c in enumerate(drawn)))
    columns = ("key", "i", "j", "size", "at", "node", "root", *drawn)

    def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held = np.zeros((0, len(columns)), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                held = np.concatenate([held, _numbers(b, columns)])
                cuts = np.flatnonzero((held[1:, :3] != held[:-1, :3]).any(axis=1)) + 1
                *done, held = np.split(held, cuts)
                yield from done
        if len(held):
            yield held

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n, more = [], 0, False
        for rows in groups(batches):
            for pairs, cut in across(rows[:, 3:], similarity, most) if len(rows) > 1 else ():
                found.append(pairs)
                n += len(pairs)
                more |= cut
                if n >= PAIRS:
                    yield _pair_batch(found)
                    found, n = [], 0
        yield _pair_batch(found)
        if more:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.nulls(1, pa.int64())], names=["a", "b"])

    dealt = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "size", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast only if it has few rows, by count."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _row_keys(docs: DataFrame) -> DataFrame:
    """docs with what tells rows apart: _no_id, _id and _key, none of them null."""
    zero = F.lit(0).cast(docs.schema["doc_id"].dataType)
    return docs.withColumns({"_no_id": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", zero), "_key": F.xxhash64("text")})


def _narrow(nodes: DataFrame) -> DataFrame:
    """node and its narrow sketch, as longs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drawn = [folded(x).view(np.int64) for x in b.column("sketch").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(drawn, pa.list_(pa.int64()))], names=["node", "sketch"])

    return nodes.select("node", "sketch").mapInArrow(run, "node long, sketch array<long>")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs whose whole sets are similar; nodes: (node, size, sketch, first). Sketches rule out most; the texts of what they leave are exchanged once a pair."""

    def by_sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [can_be_similar(*x, similarity) for x in zip(*(b.column(c).to_pylist() for c in ("sa", "na", "sb", "nb")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    def by_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, members = None, None
        for b in batches:
            good = []
            for a, x, y in zip(*(b.column(c).to_pylist() for c in ("a", "ta", "tb")), strict=True):
                if a != last:
                    last, members = a, shingle_set(x, shingle)
                good.append(similarity_of(members, shingle_set(y, shingle)) >= similarity - _EPS)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    heads = materialize(nodes.join(_small(materialize(_ends(pairs), "similar-ends")), "node").select("node", "size", "sketch", "first"), "similar-heads")
    met = pairs.join(heads.select(F.col("node").alias("a"), F.col("size").alias("na"), F.col("sketch").alias("sa")), "a")
    met = met.join(heads.select(F.col("node").alias("b"), F.col("size").alias("nb"), F.col("sketch").alias("sb")), "b")
    left = materialize(met.mapInArrow(by_sketches, "a long, b long"), "similar-left")
    slices = max(1, math.ceil(2 * left.count() / BROADCAST_ROWS))
    dealt = F.pmod(F.xxhash64("a", "b"), F.lit(slices)) if slices <= SLICES else F.lit(0)
    ends = left.select("a", "b", dealt.alias("slice"), F.explode(F.array("a", "b")).alias("node"))
    first = heads.select("node", F.col("first.no_id").alias("_no_id"), F.coalesce("first.doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("_id"), F.col("first.text_key").alias("_key"))
    wanted = materialize(ends.join(first, "node").select("_no_id", "_id", "_key", "a", "b", "slice", (F.col("node") == F.col("b")).alias("second")), "similar-wanted")
    rows, found = _row_keys(docs.select("doc_id", "text")).select("text", "_no_id", "_id", "_key"), []
    for no in range(slices if slices <= SLICES else 1):
        some = wanted.filter(F.col("slice") == no).drop("slice")
        texts = rows.join(F.broadcast(some) if slices <= SLICES else some, ["_no_id", "_id", "_key"])
        both = texts.groupBy("a", "b").agg(F.max(F.when(~F.col("second"), F.col("text"))).alias("ta"), F.max(F.when(F.col("second"), F.col("text"))).alias("tb"))
        found.append(materialize(both.mapInArrow(by_sets, "a long, b long"), "similar-links"))
    return reduce(DataFrame.unionAll, found)


def _by_fingerprints(nodes: DataFrame) -> DataFrame:
    """a, b: a candidate for every node whose fingerprint is close to another's: it meets the least node of its fingerprint, and that the least node of the fingerprint it is linked to."""
    least = materialize(nodes.groupBy("fp").agg(F.min("node").alias("least")), "similar-fps")
    same = nodes.join(least, "fp").select(F.col("node").alias("a"), F.col("least").alias("b"))
    close = links(least.select("fp")).toDF("fa", "fb").join(least.toDF("fa", "a"), "fa").join(least.toDF("fb", "b"), "fb").select("a", "b")
    return same.unionAll(close).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _roots(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, text_key, root of every row of docs: rows whose texts are linked, over any number of links of that similarity or more, share a root.

    Equal sets of shingles are one node, texts without words too. No pair is left out unless its texts are joined already.
    """
    prepare(docs.sparkSession)
    marked = materialize(_marked(docs, shingle, similarity), "similar-rows")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    nodes = marked.groupBy("node").agg(F.min(first).alias("first"), F.min("fp").alias("fp"), *(F.first(c).alias(c) for c in ("size", "sketch")))
    nodes = materialize(nodes, "similar-nodes")
    keyed = marked.select("node", "size", F.posexplode("prefix").alias("at", "key")).select("key", (F.shiftleft("size", 32) + F.col("at")).alias("place"), "node")
    met = materialize(_met(keyed, similarity), "similar-met")
    pairs = met.filter("b is not null").select("a", "b").unionAll(_by_fingerprints(nodes.select("node", "fp"))).distinct()
    found = _verified(docs, nodes, materialize(pairs, "similar-pairs"), shingle, similarity)
    slim = nodes.select("node")
    placed = materialize(_roots(slim, found), "similar-placed")
    rest = materialize(met.filter("b is null").select("key", "size", F.col("a").alias("node"), "at"), "similar-rest")
    sketches, most = materialize(_narrow(nodes), "similar-sketches"), NEXT
    for no in range(ROUNDS + 1):
        most = most if no < ROUNDS else None
        rest = materialize(_open(rest.select("key", "size", "node", "at").join(placed, "node"), block_rows), "similar-open")
        later = materialize(_met_later(rest, sketches, similarity, most).distinct(), "similar-later")
        pairs, more = later.filter("b is not null"), later.filter("b is null").limit(1).count()
        if not pairs.limit(1).count():
            break
        found = _verified(docs, nodes, pairs, shingle, similarity)
        if joined := found.limit(1).count():
            stars = placed.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
            placed = materialize(_roots(slim, stars.unionAll(found)), "similar-placed")
        if not more:
            break  # all candidates were verified
        most = most if joined else None
    return marked.select("doc_id", "text_key", "node").join(placed, "node").select("doc_id", "text_key", "root")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with one document of each group of near copies, with docs' columns, whatever their names.

    That with the smallest id stays (null ids last), then the smallest text hash; of rows equal in id and text one.
    Null and empty texts have no words and are one another's copies. An empty table gives an empty result. Rows that go
    are known by id and hash, so the texts of all others are read where they lie unless very many go.
    """
    placed = materialize(near_copies(docs, similarity, shingle, block_rows), "similar-roots")
    identity = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    least = placed.groupBy("root").agg(F.min(identity).alias("least"))
    zero = F.lit(0).cast(docs.schema["doc_id"].dataType)
    marked = placed.select("root", identity.alias("own"), F.col("doc_id").isNull().alias("_no_id"), F.coalesce("doc_id", zero).alias("_id"), F.col("text_key").alias("_key"))
    own, keys = [f"_c{i}" for i in range(len(docs.columns))], ["_no_id", "_id", "_key"]
    doc_id, text = (own[docs.columns.index(c)] for c in ("doc_id", "text"))
    goes = materialize(marked.join(least, "root").filter("not (own <=> least)").select(*keys).distinct(), "similar-goes")
    rows = docs.toDF(*own).withColumns({"_no_id": F.col(doc_id).isNull(), "_id": F.coalesce(doc_id, zero), "_key": F.xxhash64(text)})
    twice = materialize(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys), "similar-twice")
    left = rows.join(_small(goes), keys, "left_anti")
    named = [F.col(c).alias(n) for c, n in zip(own, docs.columns, strict=True)]
    if not twice.limit(1).count():
        return left.select(*named)
    twice = _small(twice)
    once = left.join(twice, keys, "left_anti").unionByName(left.join(twice, keys, "left_semi").dropDuplicates(keys))
    return once.select(*named)
