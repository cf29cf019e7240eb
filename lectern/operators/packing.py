"""Rows dealt in order into runs, each begun where the one before is full: batches for an embedder, frames for a reader.

Where a run ends depends on where it began, so all starts of a group hang on its first row. No group is gathered for that.
Rows are numbered by ranges; prefix sums and a search in them give for each row the start of the next run, were it a start
itself. A group is cut into blocks of BLOCK rows or more, so that a run that starts in a block ends in it or in the next.
A block is then a table from entries, the places in it where a run may start first, to entries of the next block. Tables of
neighbours are joined into tables of pairs of blocks, of four, and so on, each level half as large; back down the levels,
the known first entry gives the entry of every block. Within a block jumps are doubled to mark its starts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.search import small
from lectern.session import materialize, prepare

#: Rows of a block at least; a block has EIGHT times the rows of the longest run, so that tables of entries are short.
BLOCK, EIGHT = 16_384, 8


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with _g (the group, also where it is null) and _n, from 0 in each group: ranges are numbered side by side and put one after the other."""
    dealt = rows.withColumn("_g", F.struct(group)).repartitionByRange("_g", *order).sortWithinPartitions("_g", *order)
    dealt = materialize(dealt.withColumn("_id", F.monotonically_increasing_id()), "packing-rows")
    dealt = dealt.withColumn("_range", F.shiftright("_id", 33))
    counts = dealt.groupBy("_g", "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a group and range
    starts = counts.select("_g", "_range", F.col("_first") - before.cast("long"))
    starts = materialize(starts.toDF("_g", "_range", "_base"), "packing-ranges")
    return dealt.join(small(starts), ["_g", "_range"]).withColumn("_n", F.col("_id") - F.col("_base")).drop("_id", "_range", "_base")


def following(weights: np.ndarray, ends: np.ndarray, limit: int, most: int, after: bool) -> np.ndarray:
    """For each row the start of the next run, were it a start: before the sum would pass limit (after: once it reaches limit) or most rows are in; ends: where the row's own stretch ends."""
    sums, here = np.cumsum(weights), np.arange(len(weights))
    target = sums - weights + limit
    found = np.searchsorted(sums, target, "left") + 1 if after else np.maximum(np.searchsorted(sums, target, "right"), here + 1)
    return np.minimum(np.minimum(found, here + most), ends)


def reached(jump: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which rows are on the ways from the entries, by doubled jumps; a jump past the last row ends a way, and others never leave their stretch but at its end."""
    n = len(jump)
    levels, now = [], np.append(jump, n)
    while True:
        levels.append(now)
        then = now[now]
        if (then == now).all():
            break
        now = then
    mark = np.zeros(n + 1, dtype=bool)
    mark[entries] = True
    for level in reversed(levels):
        mark[level[np.flatnonzero(mark)]] = True
    return mark[:n]


def _stretches(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole stretches (rows of equal keys, which stand together) with the places where they start."""
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        change = np.zeros(max(0, table.num_rows - 1), dtype=bool)
        for k in keys:
            column = table.column(k).to_numpy()
            change |= column[1:] != column[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        table = pa.Table.from_batches(held).combine_chunks()
        at = starts(table)
        if len(at) > 1:
            yield table.slice(0, at[-1]), at[:-1]
            held = table.slice(at[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts(table)


def _exits(rows: DataFrame, width: int, limit: int, most: int, after: bool) -> DataFrame:
    """_s, _b, entry, exit: of each block but a group's last, where in the next block the first run starts, for each place where one may start first in this."""
    both = F.explode(F.when((F.col("_b") > 0) & (F.col("_n") % width < most), F.array(F.col("_b"), F.col("_b") - 1)).otherwise(F.array("_b")))
    dealt = rows.select("_s", "_n", "_w", both.alias("_b")).repartition("_s", "_b").sortWithinPartitions("_s", "_b", "_n")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _stretches(batches, ["_s", "_b"]):
            ends = np.append(starts[1:], table.num_rows)
            out = []
            for lo, hi in zip(starts, ends, strict=True):
                if hi - lo <= width:
                    continue  # the last block
                w = table.column("_w").slice(lo, hi - lo).to_numpy()
                jump = following(w, np.full(hi - lo, hi - lo), limit, most, after)
                while (jump < width).any():
                    jump = np.where(jump < width, jump[np.minimum(jump, hi - lo - 1)], jump)
                entries = np.arange(min(most, width))
                out.append((table.column("_s")[lo].as_py(), table.column("_b")[lo].as_py(), entries, jump[entries] - width))
            for s, b, entry, leaves in out:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), s)), pa.array(np.full(len(entry), b)), pa.array(entry), pa.array(leaves)], names=["_s", "_b", "entry", "exit"])

    return dealt.mapInArrow(run, "_s long, _b long, entry long, exit long")


def _entries(rows: DataFrame, blocks: int, width: int, limit: int, most: int, after: bool) -> DataFrame:
    """_s, _b, entry: where the first run starts in each block of the groups (blocks: most of a group)."""
    levels = [materialize(_exits(rows, width, limit, most, after), "packing-exits")]
    while 2 ** len(levels) < blocks:
        now = levels[-1]
        left = now.filter("_b % 2 = 0").select("_s", (F.col("_b") / 2).cast("long").alias("_b"), "entry", F.col("exit").alias("_at"))
        right = now.filter("_b % 2 = 1").select("_s", ((F.col("_b") - 1) / 2).cast("long").alias("_b"), F.col("entry").alias("_at"), "exit")
        levels.append(materialize(left.join(right, ["_s", "_b", "_at"]).select("_s", "_b", "entry", "exit"), "packing-exits"))
    known = rows.select("_s").distinct().select("_s", F.lit(0).cast("long").alias("_b"), F.lit(0).cast("long").alias("entry"))
    for table in reversed(levels):
        here = known.withColumn("_b", F.col("_b") * 2)
        there = here.join(table, ["_s", "_b", "entry"]).select("_s", (F.col("_b") + 1).alias("_b"), F.col("exit").alias("entry"))
        known = materialize(here.unionByName(there), "packing-entries")
    return known


def runs(rows: DataFrame, group: str, order: list[str], weight: Column, limit: int, most: int, after: bool = False, block: int = BLOCK) -> DataFrame:
    """rows with run, from 0 in each group, in the order of these columns.

    A run is closed before a row would bring its weight over limit (after: once its weight is limit or more), or when it
    has most rows; a row that is too heavy is a run of its own. Weights are whole and not negative, null ones count as 0;
    with `after` none may be 0, and most is no less than limit. A null group is one like any other; rows that tie in the
    order stand in any. No rows give no rows. Linear in the rows; a block, of a group of any size, is what a task holds.
    """
    prepare(rows.sparkSession)
    width = max(block, EIGHT * most)
    slim = F.coalesce(weight.cast("long"), F.lit(0))
    placed = numbered(rows.withColumn("_w", slim), group, order).withColumn("_b", F.floor(F.col("_n") / width))
    sized = placed.groupBy("_g").agg(F.max("_b").alias("_last")).filter("_last > 0")
    sized = materialize(sized.select("_g", "_last", F.xxhash64("_g").alias("_h")), "packing-large")  # groups of more than a block
    told = sized.agg(F.max("_last").alias("last"), F.count("*").alias("n"), F.count_distinct("_h").alias("hashes")).first()
    blocks = (told["last"] or 0) + 1
    if told["hashes"] < told["n"]:
        raise RuntimeError("two large groups share a hash")
    if blocks == 1:
        known = placed.withColumns({"_s": F.xxhash64("_g"), "_entry": F.lit(0).cast("long")})
    else:
        large = placed.select("_g", "_n", "_w", "_b").join(sized.select("_g", F.col("_h").alias("_s")), "_g").drop("_g")
        entries = _entries(large, blocks, width, limit, most, after).withColumnsRenamed({"entry": "_entry"})
        named = placed.withColumn("_s", F.xxhash64("_g"))
        known = named.join(entries.join(sized.select(F.col("_h").alias("_s"), "_g"), "_s").select("_g", "_b", "_entry"), ["_g", "_b"], "left").withColumn("_entry", F.coalesce("_entry", F.lit(0).cast("long")))
    kept = [c for c in rows.columns if c not in ("_g", "_s", "_b", "_n", "_w", "_entry")]
    # a stretch is a block of a group; small groups whose hashes meet are told apart by their rows' numbers, which start anew
    dealt = known.repartition("_s", "_b").sortWithinPartitions("_s", "_g", "_b", "_n")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _stretches(batches, ["_s", "_b", "_first"]):
            ends = np.append(starts[1:], table.num_rows)
            sizes = ends - starts
            jump = following(table.column("_w").to_numpy(), np.repeat(ends, sizes), limit, most, after)
            # a way that comes to the end of its stretch must not go on in the next
            jump = np.where(jump == np.repeat(ends, sizes), table.num_rows, jump)
            first = table.column("_entry").to_numpy()[starts]
            inside = first < sizes
            mark = reached(jump, (starts + first)[inside]).astype(np.int64)
            counts = np.cumsum(mark)
            at = counts - np.repeat(counts[starts] - mark[starts], sizes)
            for b in table.select([*kept, "_g", "_b"]).append_column("_at", pa.array(at)).to_batches():
                yield b

    first = (F.col("_n") - F.monotonically_increasing_id()).alias("_first")  # the same along a stretch
    out = dealt.select(*kept, "_g", "_s", "_b", "_w", "_entry", first)
    schema = out.select(*kept, "_g", "_b", F.lit(0).cast("long").alias("_at")).schema
    marked = out.mapInArrow(run, schema)
    if blocks == 1:
        return marked.select(*kept, (F.col("_at") - 1).alias("run"))
    marked = materialize(marked, "packing-marked")
    counted = marked.join(sized.select("_g"), "_g", "left_semi").groupBy("_g", "_b").agg(F.max("_at").alias("_runs"))
    before = F.sum("_runs").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    earlier = counted.select("_g", "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    return marked.join(earlier, ["_g", "_b"], "left").select(*kept, (F.coalesce("_before", F.lit(0)) + F.col("_at") - 1).alias("run"))


def _joined_batch(table: pa.Table, starts: np.ndarray, limit: int, most: int, group: str) -> Iterator[pa.RecordBatch]:
    """group, run, text of the runs in whole groups (group, text, _w), which begin at starts."""
    n = table.num_rows
    ends = np.append(starts[1:], n)
    jump = following(table.column("_w").to_numpy(), np.repeat(ends, ends - starts), limit, most, True)
    mark = np.zeros(n, dtype=bool)
    mark[starts] = True  # a run ends at its group's end, where the next begins
    first = np.flatnonzero(reached(jump, starts) | mark)
    texts = table.column("text").combine_chunks().cast(pa.large_string())
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, n), pa.int32()), texts)
    no = np.arange(len(first)) - np.searchsorted(first, starts)[np.searchsorted(starts, first, "right") - 1]
    whole = pa.table([table.column(group).take(pa.array(first)), pa.array(no.astype(np.int64)), pc.binary_join(lists, pa.scalar("", pa.large_string())).cast(pa.string())], names=[group, "run", "text"])
    yield from whole.to_batches()


def joined(rows: DataFrame, group: str, order: list[str], limit: int, block: int = BLOCK) -> DataFrame:
    """group, run, text of rows (group, order, text): texts in order, joined until they have limit characters, the rest last.

    Texts without characters change nothing. Groups of block rows or fewer are whole in a task, and their texts are
    exchanged once; those of larger groups are spread over tasks.
    """
    prepare(rows.sparkSession)
    told = rows.select(group, *order, "text").withColumn("_w", F.length("text")).filter("_w > 0")
    large = materialize(told.groupBy(group).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > block).select(F.struct(group).alias("_g")), "packing-large")
    any_large = large.limit(1).count()
    few = told.withColumn("_g", F.struct(group)).join(small(large), "_g", "left_anti").drop("_g") if any_large else told
    placed = few.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).select(group, "text", "_w", "_n")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            begins = np.flatnonzero(b.column("_n").to_numpy() == 1)
            if len(begins):  # what stands before the last group's first row is whole
                table = pa.Table.from_batches([*held, b.slice(0, begins[-1])]).combine_chunks()
                if table.num_rows:
                    yield from _joined_batch(table, np.flatnonzero(table.column("_n").to_numpy() == 1), limit, limit, group)
                held, b = [], b.slice(begins[-1])
            held.append(b)
        if held and (table := pa.Table.from_batches(held).combine_chunks()).num_rows:
            yield from _joined_batch(table, np.flatnonzero(table.column("_n").to_numpy() == 1), limit, limit, group)

    made = placed.mapInArrow(run, placed.select(group, F.lit(0).cast("long").alias("run"), "text").schema)
    if not any_large:
        return made
    spread = told.withColumn("_g", F.struct(group)).join(small(large), "_g", "left_semi").drop("_g", "_w")
    dealt = runs(spread, group, order, F.length("text"), limit, limit, after=True, block=block)
    parts = dealt.groupBy(group, "run").agg(F.array_sort(F.collect_list(F.struct(*order, "text"))).alias("parts"))
    return made.unionByName(parts.select(group, "run", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text")))
