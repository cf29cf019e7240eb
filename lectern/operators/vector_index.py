"""A stored index of vectors: an inverted file of k-means cells with product codes, and exact ranking of what they leave.

A vector of unit length belongs to the cell of its nearest centre; what is left of it is cut into short parts, each named
by the nearest of CODES patterns. Rows are Parquet files in one folder a cell, so a question reads the folders of its
nearest cells only, and of these at first only the codes, a byte a part. A question's best rows by code are then ranked by
their own vectors, with the expression that knn() uses. Each row also stores how far its code is off, which bounds its
cosine; without a number of rows to keep, every row of the probed cells that the bound can't rule out is weighed, so that
probing all cells gives knn()'s rows. Centres and patterns are learnt from a sample of SAMPLE_ROWS rows at most.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import checked_vector, dot, norm
from lectern.operators.search import TOP_K, finite, in_documents, small, top
from lectern.session import materialize, prepare

#: Rows that centres and patterns are learnt from, and bytes of their components, at most; cells at most; components of a part; patterns of a part (a byte).
SAMPLE_ROWS, SAMPLE_BYTES, MAX_CELLS, PART, CODES = 20_000, 256 << 20, 1024, 4, 256
#: Cells that a question probes, rows by code that it ranks by their vectors (times k), questions at a time.
PROBES, KEEP, MAX_QUESTIONS = 16, 20, 4096
#: Questions that a task weighs at a time, and pairs whose vectors it holds at a time.
BLOCK, PAIRS = 256, 32_768
ROUNDS = 12
#: Sums of codes err by far less, and those of vectors.
SLACK, NEARLY = 1e-5, 1e-9
#: Above so many cells a scan names no folders: it reads nearly all of them.
NAMED_CELLS = 2000


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(length > 0, length, 1)


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1)[None, :] - 2 * (vectors @ centres.T), axis=1)


def k_means(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centres (fewer if fewer rows differ): Lloyd's rounds from rows spread over the sample; an empty cell takes the row farthest from its centre."""
    first = np.unique(vectors, axis=0)
    centres = first[np.linspace(0, len(first) - 1, min(k, len(first))).astype(int)] if len(first) else np.zeros((1, vectors.shape[1]))
    for _ in range(rounds if len(first) > len(centres) else 0):
        cell = nearest(vectors, centres)
        counts = np.bincount(cell, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, vectors)
        off = ((vectors - centres[cell]) ** 2).sum(axis=1)
        empty = np.flatnonzero(counts == 0)
        centres = sums / np.maximum(counts, 1)[:, None]
        if len(empty):
            centres[empty] = vectors[np.argsort(-off)[: len(empty)]]
    return centres


def _reach(vectors: np.ndarray, centres: np.ndarray, asking: int = 256, k: int = 10) -> list[float]:
    """Of the k nearest other rows of some rows of the sample, the part in the first cell, the first two, and so on."""
    if len(vectors) < 2:
        return [1.0] * len(centres)
    who = np.unique(np.linspace(0, len(vectors) - 1, min(asking, len(vectors))).astype(int))
    cosine = vectors[who] @ vectors.T
    cosine[np.arange(len(who)), who] = -np.inf
    true = np.argsort(-cosine, axis=1)[:, : min(k, len(vectors) - 1)]
    off = (centres**2).sum(axis=1)[None, :] - 2 * (vectors[who] @ centres.T)
    place = np.argsort(np.argsort(off, axis=1, kind="stable"), axis=1)  # of each cell among a question's
    met = np.take_along_axis(place, nearest(vectors, centres)[true], axis=1)
    return (np.cumsum(np.bincount(met.ravel(), minlength=len(centres))) / met.size).tolist()


class Model:
    """Centres (cells, dims) and patterns: for each part its first component and its (patterns, width). reach: what part of the
    sample's nearest rows lies in a question's nearest cell, its nearest two, and so on."""

    def __init__(self, centres: np.ndarray, parts: list[tuple[int, np.ndarray]], reach: list[float] | None = None) -> None:
        self.centres, self.parts, self.reach = centres, parts, reach or [1.0]

    @property
    def dims(self) -> int:
        return self.centres.shape[1]

    @classmethod
    def learn(cls, sample: np.ndarray, cells: int) -> Model:
        vectors = unit(sample)
        centres = k_means(vectors, cells)
        left = vectors - centres[nearest(vectors, centres)]
        parts = [(at, k_means(left[:, at : at + PART], CODES)) for at in range(0, vectors.shape[1], PART)]
        return cls(centres, parts, _reach(vectors, centres))

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes and how far the code is off, of each vector."""
        vectors = unit(vectors)
        cell = nearest(vectors, self.centres)
        left = vectors - self.centres[cell]
        codes = np.empty((len(vectors), len(self.parts)), dtype=np.uint8)
        for p, (at, patterns) in enumerate(self.parts):
            codes[:, p] = nearest(left[:, at : at + patterns.shape[1]], patterns)
            left[:, at : at + patterns.shape[1]] -= patterns[codes[:, p]]
        return cell, codes, np.sqrt((left * left).sum(axis=1))

    def tables(self, questions: np.ndarray) -> list[np.ndarray]:
        """For each part the products of each question with each pattern."""
        return [(questions[:, at : at + patterns.shape[1]] @ patterns.T).astype(np.float32) for at, patterns in self.parts]

    def to_json(self) -> str:
        return json.dumps({"centres": self.centres.tolist(), "parts": [(at, p.tolist()) for at, p in self.parts], "reach": self.reach})

    @classmethod
    def from_json(cls, text: str) -> Model:
        held = json.loads(text)
        return cls(np.array(held["centres"]), [(at, np.array(p)) for at, p in held["parts"]], held["reach"])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dims)


class VectorIndex:
    """The index in a folder. One writer at a time; what is added is found by the next search."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = prepare(spark), base.rstrip("/")
        self.model = Model.from_json(spark.read.text(f"{self.base}/model", wholetext=True).first()[0])

    @classmethod
    def create(cls, chunks: DataFrame, base: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
        """Learn from a sample of chunks (chunk_id, document_id, vector), write the model and add all chunks. cells: the root of the number of rows, if not named.

        The most frequent length in the sample is the index's; rows of other lengths are an error.
        """
        spark = prepare(chunks.sparkSession)
        rows = chunks.filter(finite("vector") & (F.size("vector") > 0))
        n, longest = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
        bound = max(1, min(sample_rows, SAMPLE_BYTES // (8 * (longest or 1))))
        some = rows.select(F.col("vector").cast("array<double>").alias("v"), F.xxhash64("chunk_id", F.lit(7)).alias("h"), "chunk_id").orderBy("h", "chunk_id").limit(bound).select("v").toArrow().column("v").to_pylist()
        lengths = [len(v) for v in some]
        dims = max(set(lengths), key=lambda x: (lengths.count(x), x), default=1)
        sample = np.array([v for v in some if len(v) == dims], dtype=float).reshape(-1, dims)
        model = Model.learn(sample, cells or max(1, min(MAX_CELLS, round(n**0.5))))
        spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.text(f"{base.rstrip('/')}/model")
        index = cls(spark, base)
        index.add(chunks)
        return index

    def add(self, chunks: DataFrame) -> None:
        """Append chunks; rows without a vector of finite numbers are left out, one of another length is an error. Rows are dealt by range of (cell, id), so a cell of any size is spread over tasks."""
        rows = chunks.filter(finite("vector")).select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("document_id").cast("long").alias("document_id"), checked_vector(F.col("vector").cast("array<double>"), self.model.dims).cast("array<float>").alias("vector"))
        model = self.model

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell, codes, off = model.encode(_matrix(b.column("vector"), model.dims))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off, pa.float64())], names=[*b.schema.names, "cell", "code", "off"])

        schema = rows.select("*", F.lit(0).alias("cell"), F.lit(b"").alias("code"), F.lit(0.0).alias("off")).schema
        dealt = rows.mapInArrow(run, schema).repartitionByRange("cell", "chunk_id")
        dealt.write.mode("append").partitionBy("cell").option("maxRecordsPerFile", 1_000_000).parquet(f"{self.base}/cells")

    def probes_for(self, recall: float) -> int:
        """How many cells a question should probe, by the sample's neighbours, for this part of its nearest rows."""
        return min(len(self.model.centres), 1 + int(np.searchsorted(self.model.reach, recall - 1e-12)))

    def rows(self) -> DataFrame:
        """chunk_id, document_id, vector, code, off, cell."""
        schema = "chunk_id long, document_id long, vector array<float>, code binary, off double, cell int"
        return self.spark.read.schema(schema).parquet(f"{self.base}/cells")

    def _of_cells(self, cells: np.ndarray) -> DataFrame:
        named = sorted(set(map(int, cells)))
        return self.rows().filter(F.col("cell").isin(named)) if len(named) <= NAMED_CELLS else self.rows()

    def _probed(self, questions: np.ndarray, probes: int) -> np.ndarray:
        """The cells of each question: nearest centres first."""
        off = (self.model.centres**2).sum(axis=1)[None, :] - 2 * (questions @ self.model.centres.T)
        return np.argsort(off, axis=1, kind="stable")[:, :probes]

    def search(self, questions: DataFrame, k: int = TOP_K, document_ids: list[int] | None = None, probes: int | None = PROBES, keep: int | None = KEEP) -> DataFrame:
        """qid, rank, chunk_id, score as from knn(), among the rows of each question's nearest cells. probes None: all cells; keep None: no row of them is left out by its code alone.

        questions (qid, vector) of the index's length, MAX_QUESTIONS at most; those without a vector of finite numbers take no part.
        """
        asked = questions.filter(finite("vector")).select("qid", F.col("vector").cast("array<double>").alias("q"))
        found = asked.limit(MAX_QUESTIONS + 1).toArrow()
        if found.num_rows > MAX_QUESTIONS:
            raise ValueError(f"at most {MAX_QUESTIONS} questions at a time: ask in blocks")
        vectors = [v for v in found.column("q").to_pylist()]
        if any(len(v) != self.model.dims for v in vectors):
            raise ValueError(f"a question's vector must have {self.model.dims} components")
        q = unit(np.array(vectors, dtype=float).reshape(len(vectors), self.model.dims))
        probed = self._probed(q, len(self.model.centres) if probes is None else max(1, probes))
        chosen = self._chosen(q, probed, document_ids, k, None if keep is None else keep * k)
        chosen = chosen.join(F.broadcast(self.spark.createDataFrame([(i, x) for i, x in enumerate(found.column("qid").to_pylist())], f"no int, qid {asked.schema['qid'].dataType.simpleString()}")), "no")
        if keep is not None:
            chosen = top(chosen, ["qid"], [F.desc("near"), F.asc("chunk_id")], keep * k).drop("rank")
        chosen = materialize(chosen.select("qid", "chunk_id", "cell"), "index-chosen")  # keep * k rows a question, or what the bounds leave
        held = self._of_cells(probed.ravel()).select("cell", "chunk_id", F.col("vector").cast("array<double>").alias("v"))
        weighed = held.join(small(chosen), ["cell", "chunk_id"]).join(F.broadcast(asked), "qid")
        return top(weighed.select("qid", "chunk_id", _cosine().alias("score")), ["qid"], [F.desc("score"), F.asc("chunk_id")], k).select("qid", "rank", "chunk_id", "score")

    def _chosen(self, q: np.ndarray, probed: np.ndarray, document_ids: list[int] | None, k: int, keep: int | None) -> DataFrame:
        """no (of the question), chunk_id, cell, near (cosine by code): of each batch of rows what may be among a question's best."""
        model, exact = self.model, keep is None
        order = np.argsort(probed.ravel(), kind="stable")
        found, starts = np.unique(probed.ravel()[order], return_index=True)
        by_cell = dict(zip(found.tolist(), np.split(order // max(1, probed.shape[1]), starts[1:]), strict=False))  # questions of a cell, in order
        none = np.zeros(0, dtype=np.int64)
        need = k if exact else keep

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.full((len(q), need), -np.inf)  # of each question, the best of this task's rows so far
            for b in batches:
                cells = b.column("cell").to_numpy()
                own = [(int(c), np.flatnonzero(cells == c)) for c in np.unique(cells)]
                codes = np.frombuffer(b"".join(b.column("code").to_pylist()), dtype=np.uint8).reshape(len(cells), -1)
                off = b.column("off").to_numpy() + SLACK if exact else None
                rows = unit(_matrix(b.column("vector"), model.dims)) if exact else None
                for lo in range(0, len(q), BLOCK):  # so many questions at once: what a task holds doesn't grow with them
                    asked = q[lo : lo + BLOCK]
                    tables = model.tables(asked)
                    near = np.full((len(asked), len(cells)), -np.inf)
                    for c, at in own:
                        who = by_cell.get(c, none)
                        who = who[np.searchsorted(who, lo) : np.searchsorted(who, lo + BLOCK)] - lo
                        if len(who):
                            sums = np.repeat((asked[who] @ model.centres[c])[:, None], len(at), axis=1)
                            for p, table in enumerate(tables):
                                sums += table[who][:, codes[at, p]]
                            near[np.ix_(who, at)] = sums
                    held = best[lo : lo + BLOCK]
                    if exact:  # the code's bound first, then the vectors of what it leaves
                        worst = held.min(axis=1)
                        if len(cells) >= need:
                            worst = np.maximum(worst, np.partition(near - off, len(cells) - need, axis=1)[:, len(cells) - need])
                        r, i = np.nonzero((near > -np.inf) & (near + off >= worst[:, None]))
                        near = np.full(near.shape, -np.inf)
                        for x in range(0, len(r), PAIRS):
                            rr, ii = r[x : x + PAIRS], i[x : x + PAIRS]
                            near[rr, ii] = np.einsum("ij,ij->i", asked[rr], rows[ii]) - NEARLY
                    held[:] = np.partition(np.concatenate([held, near], axis=1), len(cells), axis=1)[:, len(cells) :]
                    r, i = np.nonzero((near > -np.inf) & (near + 2 * NEARLY >= held.min(axis=1)[:, None]))
                    if len(r):
                        yield pa.RecordBatch.from_arrays([pa.array((r + lo).astype(np.int32)), b.column("chunk_id").take(pa.array(i)), b.column("cell").take(pa.array(i)), pa.array(near[r, i], pa.float64())], names=["no", "chunk_id", "cell", "near"])

        rows = in_documents(self._of_cells(probed.ravel()), document_ids).select("chunk_id", "cell", "code", *(("off", "vector") if exact else ()))
        return rows.mapInArrow(run, "no int, chunk_id long, cell int, near double")

    def share_read(self, questions: DataFrame, probes: int = PROBES) -> float:
        """The part of all rows whose codes a question reads, on average over the questions."""
        q = unit(np.array(questions.filter(finite("vector")).limit(MAX_QUESTIONS).select(F.col("vector").cast("array<double>").alias("q")).toArrow().column("q").to_pylist(), dtype=float).reshape(-1, self.model.dims))
        sizes = dict(self.rows().groupBy("cell").agg(F.count("*")).toArrow().to_pandas().itertuples(index=False, name=None))  # a row a cell
        total = sum(sizes.values())
        return float(np.mean([sum(sizes.get(c, 0) for c in cells) for cells in self._probed(q, probes).tolist()]) / total) if total and len(q) else 0.0


def _cosine() -> Column:
    """As knn() has it."""
    length, asked = norm(F.col("v")), norm(F.col("q"))
    return F.when((length > 0) & (asked > 0), dot(F.col("v"), F.col("q")) / (length * asked)).otherwise(0.0)
