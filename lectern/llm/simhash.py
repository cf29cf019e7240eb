"""SimHash near-duplicates: pivot distance tables discard pairs, survivors are verified, links become components.

Fingerprints that differ in two bits at most agree in two of four 16-bit parts, so each meets its partners under one of
six keys of 32 bits. Within a key every fingerprint has a row of Hamming distances to reference fingerprints; by the
triangle inequality a pair whose rows differ by more than the limit anywhere is no link, and only the rest is compared.
Keys that hold very many different fingerprints are dealt with in another exact way, whose groups cannot grow.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.session import materialize, prepare

SHINGLE = 3
HASH_SEED = 42
MAX_BITS = 2
N_PIVOTS = 32
#: Keys with more fingerprints than this take the other way.
LARGE_KEY = 512
PARTS = tuple((i, j) for i, j in combinations(range(4), 2))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the XXH64 values of the shingles, repeats included; no words: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, HASH_SEED)], dtype="<u8")
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: -shingle].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), dtype="<u8", count=len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs' columns but text, with fp (the fingerprint as a signed long)."""
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.fromiter((fingerprint(t, shingle) for t in b.column("text").to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(values.view(np.int64))], names=[*kept, "fp"])

    rest = docs.drop("text")
    return docs.select("text", *kept).mapInArrow(run, rest.withColumn("fp", F.lit(0).cast("long")).schema)


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints: half spread at random, half with a single part of 16 bits set to all ones or none, which tell near ones apart."""
    spread = np.random.default_rng(HASH_SEED).integers(0, 1 << 63, n - n // 2, dtype=np.uint64) << np.uint64(1)
    low = [((1 << (4 * (i % 16) + 4)) - (1 << 4 * (i % 16))) & (2**64 - 1) for i in range(n // 2)]
    return np.concatenate([spread, np.array(low, dtype=np.uint64)])


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances (uint8), a row a fingerprint, a column a pivot."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def linked_pairs(keys: np.ndarray, fps: np.ndarray, refs: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with equal key and at most limit differing bits; keys must be sorted."""
    table, left, right = distance_table(fps, refs), [], []
    live, k = np.arange(len(keys)), 0
    while len(live):
        k += 1
        live = live[live + k < len(keys)]
        live = live[keys[live] == keys[live + k]]
        near = live[(np.abs(table[live, :4] - table[live + k, :4]) <= limit).all(axis=1)]
        near = near[(np.abs(table[near] - table[near + k]) <= limit).all(axis=1)]
        near = near[np.bitwise_count(fps[near] ^ fps[near + k]) <= limit]
        left.append(near)
        right.append(near + k)
    return (np.concatenate(left), np.concatenate(right)) if left else (live, live)


def forest(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links (node, root) that join what the pairs join: at most one a node."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
    return ((x, find(x)) for x in list(root) if find(x) != x)


def _by_pivots(keyed: DataFrame, limit: int, n_pivots: int) -> DataFrame:
    """Links within the keys of keyed (part, value, fp); a key's rows stand together and are complete."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots(n_pivots)
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            _, keys = np.unique(rows[:, :2], axis=0, return_inverse=True)
            a, b = linked_pairs(keys.reshape(-1), np.ascontiguousarray(rows[:, 2]).view(np.uint64), refs, limit)
            found = np.array(list(forest(rows[a, 2], rows[b, 2])), dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for b in batches:
            rows = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "value", "fp")], axis=1)
            if len(rows):
                rows = np.concatenate([*held, rows])
                whole = int(np.argmax((rows[:, :2] == rows[-1, :2]).all(axis=1)))  # the last key may go on in the next batch
                held = [rows[whole:]]
                if whole:
                    yield links(rows[:whole])
        if held:
            yield links(held[0])

    dealt = keyed.repartition("part", "value").sortWithinPartitions("part", "value", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def _by_midpoints(fps: DataFrame) -> DataFrame:
    """Links of fingerprints that differ in two bits at most: two such share one of the 65 values at most one bit from each.

    A value is shared by 65 fingerprints at most, however alike the corpus is, so no group grows with the input."""
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long")) for i in range(64)])
    met = fps.select("fp", F.explode(near).alias("mid"))
    least = met.groupBy("mid").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))
    return least.select("a", F.explode("all").alias("b")).filter("a <> b").distinct()


def links(fps: DataFrame, n_pivots: int = N_PIVOTS, large_key: int = LARGE_KEY) -> DataFrame:
    """a, b: links whose components are those of the distinct fingerprints fps (fp) at MAX_BITS differing bits or fewer."""
    part = [F.call_function("shiftrightunsigned", F.col("fp"), F.lit(16 * i)).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = F.array(*[F.struct(F.lit(n).alias("part"), (part[i] * 65536 + part[j]).alias("value")) for n, (i, j) in enumerate(PARTS)])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("k.part", "k.value", "fp")
    counted = materialize(keyed.groupBy("part", "value").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-keys")
    large = counted.filter(F.col("n") > large_key)
    if large.limit(1).count() == 0:
        return _by_pivots(keyed, MAX_BITS, n_pivots)
    # Not the fingerprint rows but the keys are few here; both joins shuffle plain rows, which AQE can split.
    dense = keyed.join(large.select("part", "value"), ["part", "value"], "left_semi").select("fp").distinct()
    return _by_pivots(keyed.join(large.select("part", "value"), ["part", "value"], "left_anti"), MAX_BITS, n_pivots).unionAll(_by_midpoints(dense))


def _placed(marked: DataFrame, n_pivots: int, large_key: int) -> DataFrame:
    """fp, root, first of each distinct fingerprint; first: (no id?, doc_id, text_key) of its first row, null ids last."""
    nodes = materialize(marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), n_pivots, large_key)).withColumnRenamed("node", "fp")
    return materialize(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-placed")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, n_pivots: int = N_PIVOTS, large_key: int = LARGE_KEY) -> DataFrame:
    """doc_id, fingerprint, component_id of every document.

    Texts without words have fingerprint zero and link like any other. component_id is the smallest doc_id reachable;
    null ids get their component's id, which is null only where the component has no other. Repeated rows are returned
    each; an empty table gives an empty result; other columns are ignored. Equal fingerprints are one node, so a group
    of copies of any size costs one row after the first, combining aggregation.
    """
    marked = materialize(fingerprints(docs.select("doc_id", "text").withColumn("text_key", F.xxhash64("text")), shingle), "simhash-docs")
    placed = _placed(marked, n_pivots, large_key)
    ids = placed.groupBy("root").agg(F.min("first").alias("least")).select("root", F.col("least.doc_id").alias("component_id"))
    of_fp = materialize(placed.join(ids, "root").select("fp", "component_id"), "simhash-components")
    return marked.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, n_pivots: int = N_PIVOTS, large_key: int = LARGE_KEY) -> DataFrame:
    """docs with one document of each component: that with the smallest id (null ids last), then the smallest text hash.

    Rows are told apart by id and text; of rows equal in both one stays. The decision is a slim table, and texts are shuffled once, to meet it.
    """
    marked = materialize(fingerprints(docs.select("doc_id", "text").withColumn("text_key", F.xxhash64("text")), shingle), "simhash-docs")
    first = _placed(marked, n_pivots, large_key).groupBy("root").agg(F.min("first").alias("least"))
    return one_each(docs, first)


def one_each(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of docs that first names in least (doc_id, text_key), each once; null ids match null ones."""
    kept = materialize(first.select(F.col("least.doc_id").alias("_id"), F.col("least.text_key").alias("_key")), "simhash-kept")
    met = docs.withColumn("_text_key", F.xxhash64("text")).join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")))
    return met.dropDuplicates(["_id", "_key"]).select(docs.columns)
