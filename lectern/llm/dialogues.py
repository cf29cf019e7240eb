"""A prefix trie of conversations: what turns they share from the start, and how many bytes a shared prefix saves.

Turns become digests before anything is shuffled, so texts stay where they are read. Equal conversations are one path
with a count. Paths are hash-partitioned by the fingerprint of their first turn; a first turn with more than LIMIT rows
beneath it is dealt again by the next turn, and so on. Each group, of many first turns or next turns, is built into tries
of pointer dictionaries in applyInPandas and summed in postorder; the nodes above the groups are summed from what their children returned, deepest first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import materialize, prepare

#: Of the contract: which conversation lends its first turns, and how many at most.
FAMILY, LENT = 5, 9
#: Turns of distinct conversations that stand beneath one first (or next) turn of a group at most; a group holds about as many.
LIMIT = 50_000
#: Ids that one piece of a list of ids holds.
PIECE = 1 << 14
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long, n_ends long"


def slim(conversations: DataFrame) -> DataFrame:
    """conv_id, i (place from 1), digest and bytes of every turn; turns of equal number stand in the order of their digests."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).filter("conv_id is not null")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return rows.select("conv_id", place.cast("long").alias("i"), "digest", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, len) of every conversation, and its rows (conv_id, len, depth, digest, bytes): first turns lent by its family's first, then its own after as many."""
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    h = F.pmod(F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")), F.lit(LENT))
    convs = counts.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    convs = convs.join(counts.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left")
    lent = F.least("h", F.coalesce("there", F.lit(0).cast("long")))
    convs = convs.select("conv_id", "base", "h", lent.alias("lent"), (lent + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long"))).alias("len"))
    convs = materialize(convs, "dialogue-convs")
    first = turns.filter(F.col("i") < LENT).withColumnRenamed("conv_id", "base").join(convs, "base").filter("i <= h").select("conv_id", "len", F.col("i").alias("depth"), "digest", "bytes")
    own = turns.join(convs.select("conv_id", "h", "lent", "len"), "conv_id").filter("i > h").select("conv_id", "len", (F.col("i") - F.col("h") + F.col("lent")).alias("depth"), "digest", "bytes")
    return convs.select("conv_id", "len"), first.unionByName(own)


def _marks() -> dict[str, Column]:
    """Two numbers of a turn at its depth; those of a path are xored, so that a path's fingerprint needs no order."""
    return {f"p{s}": F.xxhash64("depth", "digest", F.lit(s)) for s in (1, 2)}


def grow(pdf: pd.DataFrame) -> pd.DataFrame:
    """The tries of a group's paths (rep, n, depth, digest, bytes, len, b1, b2), a row a node; parents outside the group are null."""
    pdf = pdf.sort_values(["rep", "depth"], kind="stable")
    below: list[dict] = [{}]
    parent, depth, conv, members, own, ends, n_ends = [-1], [0], [0], [0], [0], [None], [0]
    last, at = None, 0
    for rep, n, d, digest, size, length, b1, b2 in zip(*(pdf[c].tolist() for c in ("rep", "n", "depth", "digest", "bytes", "len", "b1", "b2")), strict=True):
        if rep != last:  # the top of a trie goes by its whole path
            at, last, digest = 0, rep, (b1, b2)
        child = below[at].get(digest)
        if child is None:  # paths come by rep, so the first to pass is the smallest member
            child = below[at][digest] = len(below)
            below.append({})
            for column, value in ((parent, at), (depth, d), (conv, rep), (members, 0), (own, size), (ends, None), (n_ends, 0)):
                column.append(value)
        members[child] += n
        if d == length:
            ends[child], n_ends[child] = rep, n
        at = child
    leaves, saved = [0] * len(below), [0] * len(below)
    for node in range(len(below) - 1, 0, -1):  # children have larger numbers than their parents, so this is a postorder
        leaves[node] += not below[node]
        saved[node] += (members[node] - 1) * own[node]
        leaves[parent[node]] += leaves[node]
        saved[parent[node]] += saved[node]
    out = pd.DataFrame({"conv_id": conv, "depth": depth, "parent_conv_id": pd.array([conv[p] if p > 0 else None for p in parent], "Int64"), "n_convs": members, "n_children": [len(x) for x in below], "n_leaves": leaves, "saved_tokens": saved, "ends": pd.array(ends, "Int64"), "n_ends": n_ends})
    return out.iloc[1:]


def _lone(rows: DataFrame) -> DataFrame:
    """Nodes of paths that meet no other and are longer than a group: sums along the path, without a trie."""
    later = Window.partitionBy("rep").orderBy(F.desc("depth"))
    saved = F.sum((F.col("n") - 1) * F.col("bytes")).over(later)
    last, one, zero = F.col("depth") == F.col("len"), F.lit(1).cast("long"), F.lit(0).cast("long")
    return rows.select(
        F.col("rep").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("top"), F.col("rep")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"),
        one.alias("n_leaves"), saved.alias("saved_tokens"), F.when(last, F.col("rep")).alias("ends"), F.when(last, F.col("n")).otherwise(zero).alias("n_ends"),
    )


def tries(paths: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of all paths (rep, n, len, depth, digest, bytes) but the root; parents of depth 1 are null."""
    way = Window.partitionBy("rep").orderBy("depth")
    marked = paths.withColumns(_marks())
    live = marked.withColumns({f"b{s}": F.first(f"p{s}").over(way) for s in (1, 2)} | {f"p{s}": F.bit_xor(f"p{s}").over(way) for s in (1, 2)})
    live = materialize(live, "dialogue-paths")
    built, tops, top = [], [], 1
    least = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        heads = live.filter(F.col("depth") == top)
        large = heads.groupBy("b1", "b2").agg(F.sum(F.col("len") - top + 1).alias("rows"), F.count("*").alias("reps")).filter(F.col("rows") > limit)
        large = materialize(large, "dialogue-large")  # a row for each limit rows at most
        any_large = large.limit(1).count() > 0
        small = live.join(large, ["b1", "b2"], "left_anti") if any_large else live
        groups = max(least, -(-live.count() // limit))
        built.append(small.groupBy(F.pmod(F.xxhash64("b1", "b2"), F.lit(groups)).alias("group")).applyInPandas(grow, NODE))
        if not any_large:
            break
        both = live.join(large.select("b1", "b2", "reps"), ["b1", "b2"])
        built.append(_lone(both.filter("reps = 1").withColumn("top", F.lit(top))))
        split = both.filter("reps > 1").drop("reps")
        tops.append(materialize(split.filter(F.col("depth") == top), "dialogue-tops"))
        rest = split.filter(F.col("depth") > top).drop("b1", "b2")
        following = rest.filter(F.col("depth") == top + 1).select("rep", F.col("p1").alias("b1"), F.col("p2").alias("b2"))
        live = materialize(rest.join(following, "rep"), "dialogue-paths")
        top += 1
    nodes = built[0]
    for more in built[1:]:
        nodes = nodes.unionByName(more)
    if not tops:
        return nodes
    nodes = materialize(nodes, "dialogue-nodes")
    for level in reversed(tops):  # the deepest first: its children are known
        nodes = materialize(_above(nodes, level), "dialogue-nodes")
    return nodes


def _above(nodes: DataFrame, level: DataFrame) -> DataFrame:
    """nodes, with those of a level that was dealt again, summed from their children."""
    depth = F.col("depth")
    at_end = depth == F.col("len")
    own = level.groupBy("b1", "b2").agg(
        F.min("rep").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n").alias("n_convs"), F.first("bytes").alias("bytes"), F.max(F.when(at_end, F.col("rep"))).alias("ends"), F.sum(F.when(at_end, F.col("n")).otherwise(0)).alias("n_ends"))
    place = level.select(F.col("rep").alias("conv_id"), (depth + 1).alias("depth"), "b1", "b2")
    placed = nodes.join(place, ["conv_id", "depth"], "left")  # a node's conv_id is one of the paths that pass it
    sums = placed.filter("b1 is not null").groupBy("b1", "b2").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
    made = own.join(sums, ["b1", "b2"], "left").select(
        "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        (F.coalesce("below", F.lit(0).cast("long")) + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"), "ends", "n_ends",
    )
    linked = placed.join(own.select("b1", "b2", F.col("conv_id").alias("above")), ["b1", "b2"], "left")
    return linked.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(nodes.columns).unionByName(made)


def _hashes(members: DataFrame) -> DataFrame:
    """rep, sha: digest of the ids (rep, conv_id) of each rep, ascending and joined by commas. Ids are sorted and written side by side in pieces; a digest reads its pieces in order, one at a time."""

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pd.DataFrame({"rep": b.column("rep").to_numpy(), "conv_id": b.column("conv_id").to_numpy()})
            rows["part"] = rows.groupby("rep").cumcount() // PIECE
            some = rows.groupby(["rep", "part"], sort=False)["conv_id"].agg(first="min", ids=lambda x: ",".join(map(str, x.tolist()))).reset_index()
            yield pa.RecordBatch.from_arrays([pa.array(some["rep"], pa.int64()), pa.array(some["first"], pa.int64()), pa.array(some["ids"], pa.string())], names=["rep", "first", "ids"])

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, state = None, None
        for b in batches:
            reps, shas = [], []
            for r, ids in zip(b.column("rep").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if r != rep:
                    if state:
                        reps.append(rep)
                        shas.append(state.hexdigest())
                    rep, state = r, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(shas, pa.string())], names=["rep", "sha"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["rep", "sha"])

    dealt = members.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(pieces, "rep long, first long, ids string")
    return dealt.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(digests, "rep long, sha string")


def prefix_tree(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation is its turns in order (null turns first; equal numbers in the order of their turns' digests), its
    first ones lent by its family's first as the contract says. Null role or text is empty; rows of a null conv_id are
    left out; a turn that stands twice is two turns. The root has depth 0, all conversations and a null parent; an empty
    table has no node at all. Other columns are ignored, texts of any length are only digested where they lie.
    """
    prepare(conversations.sparkSession)
    turns = materialize(slim(conversations), "dialogue-turns")
    convs, rows = rebuilt(turns)
    rows = materialize(rows, "dialogue-rows")
    prints = rows.withColumns(_marks()).groupBy("conv_id").agg(F.bit_xor("p1").alias("f1"), F.bit_xor("p2").alias("f2"))
    prints = convs.join(prints, "conv_id", "left").na.fill(0, ["f1", "f2"])
    prints = materialize(prints, "dialogue-prints")
    reps = materialize(prints.groupBy("len", "f1", "f2").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")), "dialogue-reps")
    paths = rows.withColumnRenamed("conv_id", "rep").join(reps.select("rep", "n"), "rep").select("rep", "n", "len", "depth", "digest", "bytes")
    nodes = materialize(tries(paths, limit), "dialogue-tries")

    zero = F.lit(0).cast("long")
    every = reps.agg(F.min("rep").alias("conv_id"), F.sum("n").alias("n_convs"), F.max(F.when(F.col("len") == 0, F.col("rep"))).alias("ends"), F.sum(F.when(F.col("len") == 0, F.col("n")).otherwise(0)).alias("n_ends"))
    sums = nodes.filter("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), zero).alias("saved_tokens"))
    root = every.filter("n_convs > 0").join(F.broadcast(sums), how="cross")  # one row each
    root = root.select("conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), "saved_tokens", "ends", "n_ends")
    least = every.select(F.col("conv_id").alias("least"))  # one row
    nodes = nodes.join(F.broadcast(least), how="cross").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("least")).otherwise(F.col("parent_conv_id"))).drop("least")
    nodes = root.unionByName(nodes)

    shared = prints.join(reps.filter("n > 1").select("len", "f1", "f2", "rep"), ["len", "f1", "f2"]).select("rep", "conv_id")
    hashes = _hashes(materialize(shared, "dialogue-shared"))
    sha = F.when(F.col("n_ends") > 1, F.col("sha")).when(F.col("n_ends") == 1, F.sha2(F.col("ends").cast("string"), 256)).otherwise(hashlib.sha256().hexdigest())
    found = nodes.join(hashes.withColumnRenamed("rep", "ends"), "ends", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))


SQL = """
WITH t AS (
  SELECT conv_id::BIGINT AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
bits(v) AS (SELECT unnest(range(256))),
crc_table AS (SELECT list(x ORDER BY v) AS tab FROM (SELECT v, list_reduce(list_prepend(v::BIGINT, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END) AS x FROM bits)),
convs AS (
  SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(s)::BIGINT FOR s IN string_split(c::VARCHAR, '')]), lambda a, b: xor(a // 256, tab[(xor(a, b) % 256 + 1)::INT])), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT c FROM t), crc_table),
rebuilt AS (
  SELECT v.c, 0 AS part, t.i, t.role, t.text FROM convs v JOIN t ON t.c = v.base AND t.i <= v.h
  UNION ALL SELECT v.c, 1, t.i, t.role, t.text FROM convs v JOIN t ON t.c = v.c AND t.i > v.h),
numbered AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d FROM rebuilt),
steps AS (SELECT c, d, strlen(text) AS bytes, string_agg(sha256(strlen(role) || ':' || role || text), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS path FROM numbered),
member AS (SELECT c, 0::BIGINT AS d, 0::BIGINT AS bytes, '' AS path FROM convs UNION ALL SELECT * FROM steps),
last AS (SELECT c, max(d) AS d FROM member GROUP BY c),
node AS (SELECT path, any_value(m.d) AS depth, min(m.c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (m.d = l.d) AS ends FROM member m JOIN last l USING (c) GROUP BY path),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM node k WHERE k.depth = n.depth + 1 AND starts_with(k.path, n.path)) AS n_children FROM node n LEFT JOIN node p ON p.depth = n.depth - 1 AND starts_with(n.path, p.path))
SELECT a.conv_id, a.depth, any_value(a.parent_conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs, any_value(a.n_children) AS n_children,
       count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes)::BIGINT AS saved_tokens, any_value(sha256(coalesce(a.ends, ''))) AS ends_sha256
FROM linked a JOIN linked b ON b.depth >= a.depth AND starts_with(b.path, a.path) GROUP BY a.conv_id, a.depth
"""
