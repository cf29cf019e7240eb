"""A stored inverted index for BM25: postings in blocks with bounds, so that a question reads its own terms, and of these
only the blocks that can hold one of its best chunks.

Chunks are dealt into segments of about SEGMENT_ROWS, and a block holds one term's postings in one segment, with its
peaks: those pairs of term count and chunk length that no other pair has more of at less. One of them has the block's
largest part of a score at any time, whatever the count and the mean length of chunks have become since. Blocks are Parquet rows in folders by a hash of the term, sorted by term. The count of
chunks and of their terms is kept beside them, a row for each time chunks are added. A search first reads the bounds of
its terms' blocks; the sums over a segment tell which segments can hold what. It scores the most promising ones, and the
k-th score then rules out all segments whose bound is lower: those are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import terms
from lectern.operators.search import K1, MAX_TERMS, TOP_K, B, small, top
from lectern.session import materialize, prepare

SEGMENT_ROWS, BUCKETS = 2048, 64
#: Segments of each question that are scored first.
FIRST = 4
#: Scores are sums of doubles in any order; bounds this close to the k-th score are not ruled out.
SLACK = 1e-6
_BLOCK = "term string, added long, segment long, n long, peaks array<struct<tf:long,dl:long>>, chunk_ids array<long>, document_ids array<long>, tfs array<long>, dls array<long>, bucket int"
#: Blocks as a segment's task makes them; so many at most in an Arrow batch. A bucket is written in one part for so many segments.
_MADE_COLUMNS = ["term", "segment", "n", "peaks", "chunk_ids", "document_ids", "tfs", "dls"]
_MADE = "term string, segment long, n long, peaks array<struct<tf:long,dl:long>>, chunk_ids array<long>, document_ids array<long>, tfs array<long>, dls array<long>"
OUT_ROWS, PART_SEGMENTS = 2000, 128
_COUNTS = "added long, chunks long, terms long"


class TextIndex:
    """The index in a folder. One writer at a time; what is added is found by the next search. analyse: text -> array of terms, of chunks and questions alike."""

    def __init__(self, spark: SparkSession, base: str, analyse=terms, buckets: int = BUCKETS) -> None:
        self.spark, self.base, self.analyse, self.buckets = prepare(spark), base.rstrip("/"), analyse, buckets
        spark.createDataFrame([], _COUNTS).write.mode("ignore").parquet(f"{self.base}/counts")
        spark.createDataFrame([], _BLOCK).write.mode("ignore").partitionBy("bucket").parquet(f"{self.base}/blocks")

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def add(self, chunks: DataFrame, segment_rows: int = SEGMENT_ROWS) -> None:
        """Append chunks (chunk_id, document_id, content), which must not be there yet; a null content has no terms. Counts are written last and make the addition known: blocks of one that failed are never read."""
        added = uuid.uuid4().int >> 65
        n = chunks.select("chunk_id").count()  # texts are cut once, below
        segments = max(1, -(-n // segment_rows))
        earlier = self.spark.read.schema(_COUNTS).parquet(f"{self.base}/counts").count()
        segment = F.pmod(F.xxhash64("chunk_id", F.lit(added)), F.lit(segments)) + F.lit(earlier << 32)  # of this addition alone
        cut = chunks.select(F.col("chunk_id").cast("long"), F.col("document_id").cast("long"), segment.alias("segment"), self.analyse(F.coalesce(F.col("content"), F.lit(""))).alias("ts"))
        dealt = cut.repartition("segment").sortWithinPartitions("segment")
        made = dealt.mapInArrow(_segment_blocks, _MADE).select("term", F.lit(added).alias("added"), *_MADE_COLUMNS[1:], self._bucket(F.col("term")).alias("bucket"))
        # a bucket is dealt into parts, so that more segments are more tasks; a term stands together in a part, and a frequent one in several
        parts = F.lit(max(1, segments // PART_SEGMENTS))
        part_no = F.pmod(F.xxhash64("term", F.shiftright("segment", 10)), parts)
        made.repartition("bucket", part_no).sortWithinPartitions("bucket", "term", "segment").write.mode("append").partitionBy("bucket").parquet(f"{self.base}/blocks")
        written = self.spark.read.schema(_BLOCK).parquet(f"{self.base}/blocks").filter(F.col("added") == added).select(F.explode("tfs").alias("tf"))
        terms_ = written.agg(F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("terms")).first()["terms"]
        self.spark.createDataFrame([(added, n, terms_)], _COUNTS).coalesce(1).write.mode("append").parquet(f"{self.base}/counts")

    def blocks(self) -> DataFrame:
        known = self.spark.read.schema(_COUNTS).parquet(f"{self.base}/counts").select(F.col("added").alias("known"))
        return self.spark.read.schema(_BLOCK).parquet(f"{self.base}/blocks").join(small(known), F.col("added") == F.col("known"), "left_semi")

    def counts(self) -> tuple[int, float]:
        """How many chunks there are, and their mean number of terms."""
        got = self.spark.read.schema(_COUNTS).parquet(f"{self.base}/counts").agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("n"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
        return got["n"], got["terms"] / max(1, got["n"])

    def of_terms(self, asked: DataFrame) -> DataFrame:
        """The blocks of the terms of asked (qid, term): few terms are named in the scan, so that it reads their folders and skips other terms by their order."""
        keys = asked.select("term", self._bucket(F.col("term")).alias("bucket")).distinct()
        found = keys.limit(MAX_TERMS + 1).collect()
        if len(found) > MAX_TERMS:
            return self.blocks().join(small(keys), ["term", "bucket"])
        buckets = sorted({r["bucket"] for r in found})
        return self.blocks().filter(F.col("bucket").isin(buckets) & F.col("term").isin([r["term"] for r in found])) if found else self.blocks().limit(0)

    def search(self, questions: DataFrame, k: int = TOP_K, document_ids: list[int] | None = None, first: int = FIRST) -> DataFrame:
        """qid, rank, chunk_id, score of questions (qid, text): the rows of bm25(). Counts come before the document filter."""
        asked = materialize(questions.select("qid", F.explode(F.array_distinct(self.analyse(F.coalesce(F.col("text"), F.lit(""))))).alias("term")), "text-asked")
        blocks, (n, mean) = self.of_terms(asked), self.counts()
        bounds = materialize(self._bounds(blocks, asked, n, mean), "text-bounds")  # a row a question, term and segment: no postings
        total = bounds.groupBy("qid", "segment").agg(F.sum("bound").alias("bound"))
        order = Window.partitionBy("qid").orderBy(F.desc("bound"), "segment")
        total = materialize(total.withColumn("place", F.row_number().over(order)), "text-segments")
        early = materialize(self._scores(blocks, bounds, total.filter(F.col("place") <= first), n, mean, document_ids), "text-early")
        kth = top(early, ["qid"], [F.desc("score"), F.asc("chunk_id")], k).filter(F.col("rank") == k).select("qid", F.col("score").alias("kth"))
        later = total.filter(F.col("place") > first).join(kth, "qid", "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - SLACK))
        late = self._scores(blocks, bounds, later, n, mean, document_ids)
        return top(early.unionByName(late), ["qid"], [F.desc(F.round("score", 9)), F.asc("chunk_id")], k).select("qid", "rank", "chunk_id", "score")

    def _bounds(self, blocks: DataFrame, asked: DataFrame, n: int, mean: float) -> DataFrame:
        """qid, term, segment, idf, bound."""
        slim = blocks.select("term", "segment", "n", "peaks")
        frequency = slim.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighed = slim.join(frequency.select("term", idf.alias("idf")), "term")
        return weighed.select("term", "segment", "idf", F.array_max(F.transform("peaks", lambda p: part(F.col("idf"), p["tf"], p["dl"], mean))).alias("bound")).join(asked, "term")

    def _scores(self, blocks: DataFrame, bounds: DataFrame, segments: DataFrame, n: int, mean: float, document_ids: list[int] | None) -> DataFrame:
        """qid, chunk_id, score of all chunks that hold a term of a question, in these (qid, segment)."""
        wanted = bounds.join(segments.select("qid", "segment"), ["qid", "segment"]).select("qid", "term", "segment", "idf")
        wanted = materialize(wanted, "text-wanted")  # no postings; of known size, so a small one is broadcast to the blocks
        held = blocks.select("term", "segment", "chunk_ids", "document_ids", "tfs", "dls").join(wanted.select("term", "segment").distinct(), ["term", "segment"])
        rows = held.select("term", "segment", F.explode(F.arrays_zip("chunk_ids", "document_ids", "tfs", "dls")).alias("x")).select("term", "segment", "x.*")
        if document_ids:
            rows = rows.filter(F.col("document_ids").isin(list(document_ids)))
        met = rows.join(wanted, ["term", "segment"])
        return met.groupBy("qid", F.col("chunk_ids").alias("chunk_id")).agg(F.sum(part(F.col("idf"), F.col("tfs"), F.col("dls"), mean)).alias("score"))

    def share_read(self, questions: DataFrame, k: int = TOP_K, first: int = FIRST) -> float:
        """The part of the questions' postings whose blocks a search for them reads."""
        asked = questions.select("qid", F.explode(F.array_distinct(self.analyse(F.coalesce(F.col("text"), F.lit(""))))).alias("term"))
        blocks, (n, mean) = self.of_terms(asked), self.counts()
        bounds = self._bounds(blocks, asked, n, mean)
        total = bounds.groupBy("qid", "segment").agg(F.sum("bound").alias("bound")).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "segment")))
        early = self._scores(blocks, bounds, total.filter(F.col("place") <= first), n, mean, None)
        kth = top(early, ["qid"], [F.desc("score"), F.asc("chunk_id")], k).filter(F.col("rank") == k).select("qid", F.col("score").alias("kth"))
        read = total.join(kth, "qid", "left").withColumn("read", (F.col("place") <= first) | F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - SLACK))
        sizes = bounds.join(blocks.select("term", "segment", "n"), ["term", "segment"]).join(read.select("qid", "segment", "read"), ["qid", "segment"])
        got = sizes.agg(F.sum(F.when(F.col("read"), F.col("n")).otherwise(0)).alias("read"), F.sum("n").alias("n")).first()
        return (got["read"] or 0) / max(1, got["n"] or 0)


def peaks(tfs: np.ndarray, dls: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of rows in groups that begin at starts, each by falling tf, then by dl: whether a row is shorter than all before it in its group."""
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(dls))))
    lowered = dls - group * (dls.max(initial=0) + 1)  # every group is below the one before, so one running minimum serves all
    best = np.minimum.accumulate(lowered)
    shorter = np.ones(len(dls), dtype=bool)
    shorter[1:] = lowered[1:] < best[:-1]
    return shorter


def _counted(b: pa.RecordBatch) -> pa.Table:
    """at (the row), term, tf, dl of each term of each row of (ts)."""
    ts = b.column("ts")
    dl = ts.value_lengths().fill_null(0).to_numpy()
    coded = ts.flatten().dictionary_encode()
    width = max(1, len(coded.dictionary))
    keys, tf = np.unique(np.repeat(np.arange(len(dl)), dl) * width + coded.indices.to_numpy(), return_counts=True)
    at = keys // width
    term = pa.DictionaryArray.from_arrays(pa.array(keys % width, pa.int32()), coded.dictionary)
    ids = [b.column(c).take(pa.array(at)) for c in ("chunk_id", "document_id")]
    return pa.table([term, *ids, pa.array(tf.astype(np.int64)), pa.array(dl[at].astype(np.int64))], names=["term", "chunk_id", "document_id", "tf", "dl"])


def _blocks_of(segment: int, held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    """The blocks (_MADE) of one segment's postings."""
    rows = pa.concat_tables(held).unify_dictionaries().combine_chunks()
    if not rows.num_rows:
        return
    column = rows.column("term").chunk(0)
    code, tf, dl = column.indices.to_numpy(), rows.column("tf").to_numpy(), rows.column("dl").to_numpy()
    order = np.lexsort((dl, -tf, code))
    rows, code, tf, dl = rows.take(pa.array(order)).combine_chunks(), code[order], tf[order], dl[order]
    starts = np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1])
    best = np.flatnonzero(peaks(tf, dl, starts))
    ends = pa.array(np.append(starts, len(code)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, rows.column(c).chunk(0)) for c in ("chunk_id", "document_id", "tf", "dl")]
    pairs = pa.StructArray.from_arrays([pa.array(tf[best]), pa.array(dl[best])], names=["tf", "dl"])
    tops = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(best, starts), len(best)), pa.int32()), pairs)
    terms_ = column.dictionary.take(pa.array(code[starts]))
    sizes = pa.array(np.diff(np.append(starts, len(code))).astype(np.int64))
    made = pa.RecordBatch.from_arrays([terms_, pa.array(np.full(len(starts), segment)), sizes, tops, *lists], names=_MADE_COLUMNS)
    for at in range(0, len(starts), OUT_ROWS):
        yield made.slice(at, OUT_ROWS)


def _segment_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (chunk_id, document_id, segment, ts) that stand by segment: what is held is one segment's counted postings."""
    now, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        segment = b.column("segment").to_numpy()
        cuts = [0, *(np.flatnonzero(segment[1:] != segment[:-1]) + 1).tolist(), len(segment)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if held and segment[i] != now:
                yield from _blocks_of(now, held)
                held = []
            now = int(segment[i])
            held.append(_counted(b.slice(i, j - i)))
    if held:
        yield from _blocks_of(now, held)


def part(idf: Column, tf: Column, dl: Column, mean: float) -> Column:
    """What a term adds to a chunk's score: more with its count, less with the chunk's length."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(float(mean))))
