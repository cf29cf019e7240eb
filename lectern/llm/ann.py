"""Approximate nearest neighbours: a vantage-point tree per shard.

Vectors of unit length are split by distance to a vantage point, half nearer, half farther, down to small leaves. A
query skips a half whose nearest possible distance, times FACTOR, is over its worst kept neighbour's; with factor 1 the
triangle inequality makes the search exact. Shards hold a bounded number of rows each, dealt by id, so a corpus of any
size has small trees; queries meet them in blocks, and each shard's nearest are merged.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import materialize, prepare

SHARD_ROWS = 8192
QUERY_ROWS = 1024
LEAF = 96
#: Of the contract: neighbours asked for, and the ids that are queries.
K = 5
QUERY_EVERY = 50
FACTOR = 1.0
#: Distances this close to the limit are not pruned: sums of squares err by less.
SLACK = 1e-6
#: Products of unit vectors differ from the measure by far less than this; pairs further below the limit need no exact sums.
NEARLY = 1e-9
PAIRS_AT_ONCE = 16_384


def squares(a: np.ndarray) -> np.ndarray:
    """Each row's sum of squares, over the components in order."""
    return np.cumsum(a * a, axis=1)[:, -1]


def paired(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with that row of b, in double precision: sums run over the components in order, as SQL's do. sa, sb: their squares()."""
    out = np.empty(len(a))
    for at in range(0, len(a), PAIRS_AT_ONCE):
        some = slice(at, at + PAIRS_AT_ONCE)
        with np.errstate(over="ignore"):
            both = sa[some] * sb[some]
        fine = np.isfinite(both) & (both > 0)  # else the product of squares leaves the range of doubles, not that of roots
        out[some] = np.cumsum(a[some] * b[some], axis=1)[:, -1] / np.where(fine, np.sqrt(both), np.sqrt(sa[some]) * np.sqrt(sb[some]))
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with each of b."""
    sa, sb = squares(a), squares(b)
    return np.stack([paired(np.broadcast_to(x, b.shape), b, np.broadcast_to(s, sb.shape), sb) for x, s in zip(a, sa, strict=True)]) if len(a) else np.zeros((0, len(b)))


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> dict:
    """A tree: node = (vantage row, (lowest, highest distance, child) of the near and the far half) or a leaf's rows."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    nodes: list = []

    def grow(rows: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(None)
        if len(rows) <= leaf:
            nodes[at] = rows
            return at
        sample = rows[:: max(1, len(rows) // 16)][:16]
        far = [np.sqrt(np.maximum(2 - 2 * (unit[rows[:: max(1, len(rows) // 256)]] @ unit[v]), 0)) for v in sample]
        vantage = int(sample[int(np.argmax([d.std() for d in far]))])
        d = np.sqrt(np.maximum(((unit[rows] - unit[vantage]) ** 2).sum(axis=1), 0))
        order = np.argsort(d, kind="stable")  # halves by position, so that equal distances end too
        half = len(rows) // 2
        parts = [(float(d[p[0]]), float(d[p[-1]]), grow(rows[p])) for p in (order[:half], order[half:])]
        nodes[at] = (vantage, parts)
        return at

    if len(ids):
        grow(np.arange(len(ids)))
    return {"ids": ids, "vectors": vectors, "squares": squares(vectors), "unit": unit, "nodes": nodes}


def search(tree: dict, query_ids: np.ndarray, queries: np.ndarray, k: int = K, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and cosines (minus infinity: none found) of the k nearest of each query, its own id left out; and how many cosines were computed."""
    ids, vectors, unit, nodes = tree["ids"], tree["vectors"], tree["unit"], tree["nodes"]
    q_unit = queries / np.sqrt((queries * queries).sum(axis=1))[:, None]
    own = squares(queries)
    best = np.full((len(queries), k), -np.inf)
    best_id = np.zeros((len(queries), k), dtype=np.int64)
    seen = 0

    def visit(node: int, who: np.ndarray) -> None:
        nonlocal seen
        if not len(who):
            return
        here = nodes[node]
        if isinstance(here, np.ndarray):
            seen += len(who) * len(here)
            near = q_unit[who] @ unit[here].T >= best[who, k - 1][:, None] - NEARLY
            near &= ids[here][None, :] != query_ids[who][:, None]
            some = near.any(axis=1)
            who, near = who[some], near[some]
            r, c = np.nonzero(near)
            score = np.full(near.shape, -np.inf)
            score[r, c] = paired(queries[who[r]], vectors[here[c]], own[who[r]], tree["squares"][here[c]])
            score = np.concatenate([best[who], score], axis=1)
            name = np.concatenate([best_id[who], np.broadcast_to(ids[here], (len(who), len(here)))], axis=1)
            order = np.lexsort((name, -score), axis=1)[:, :k]
            best[who] = np.take_along_axis(score, order, axis=1)
            best_id[who] = np.take_along_axis(name, order, axis=1)
            return
        vantage, parts = here
        d = np.sqrt(np.maximum(((q_unit[who] - unit[vantage]) ** 2).sum(axis=1), 0))
        gaps = [np.maximum(np.maximum(low - d, d - high), 0) for low, high, _ in parts]
        near = gaps[0] <= gaps[1]

        def enter(part: int, some: np.ndarray) -> None:
            asked = who[some]
            worst = np.sqrt(np.maximum(2 - 2 * np.maximum(best[asked, k - 1], -1.0), 0))
            worst = np.where(np.isneginf(best[asked, k - 1]), np.inf, worst)
            visit(parts[part][2], asked[factor * gaps[part][some] <= worst + SLACK])

        enter(0, near)
        enter(1, ~near)
        enter(1, near)
        enter(0, ~near)

    if nodes:
        visit(0, np.arange(len(queries)))
    return best_id, best, seen


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and the vector in doubles, of the rows that take part."""
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())


def _packed(rows: DataFrame, block: str, pack: Callable[[np.ndarray, np.ndarray], bytes]) -> DataFrame:
    """One row (length, block, data) a block of vectors of one length; blocks hold a bounded number of rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        return pd.DataFrame({"length": [int(pdf["length"].iloc[0])], block: [int(pdf[block].iloc[0])], "data": [pack(pdf["vec_id"].to_numpy(np.int64), np.stack(list(pdf["v"])).astype(float))]})

    return rows.groupBy("length", block).applyInPandas(run, f"length int, {block} long, data binary")


def nearest(embeddings: DataFrame, k: int = K, query_every: int = QUERY_EVERY, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by query_every, by cosine, among all other rows.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; those of
    another length than a query's are no neighbours of it. Ties go to the smaller vec_id, any id may be negative. Rows
    with a query's own id are left out for it. A repeated id asks once, with the shortest of its vectors and of these the
    least; as neighbours repeated rows count each. An empty table gives an empty result; other columns are ignored.
    factor 1: exact; above: faster, less recall.
    """
    prepare(embeddings.sparkSession)
    rows = materialize(usable(embeddings).withColumn("length", F.size("v")), "ann-rows")
    asked = rows.filter(F.pmod("vec_id", F.lit(query_every)) == 0).groupBy("vec_id").agg(F.min(F.struct("length", "v")).alias("x")).select("vec_id", "x.*")
    shards = F.greatest(F.lit(1), F.ceil(F.count("*") / shard_rows)).cast("long").alias("shards")
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / query_rows)).cast("long").alias("blocks")
    sizes = materialize(rows.groupBy("length").agg(shards).join(asked.groupBy("length").agg(blocks), "length"), "ann-sizes")  # a row a length
    dealt = rows.join(F.broadcast(sizes), "length").withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("shards")))
    trees = _packed(dealt, "shard", lambda i, v: pickle.dumps(build(i, v)))
    dealt = asked.join(F.broadcast(sizes), "length").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("blocks")))
    queries = _packed(dealt, "block", lambda i, v: pickle.dumps((i, v))).join(F.broadcast(sizes), "length")
    met = queries.select("length", F.col("data").alias("queries"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard")).join(trees, ["length", "shard"])

    def find(batches):
        for pdf in batches:
            for q, t in zip(pdf["queries"], pdf["data"], strict=True):
                query_ids, vectors = pickle.loads(q)
                found, scores, _ = search(pickle.loads(t), query_ids, vectors, k, factor)
                at = np.repeat(np.arange(len(query_ids)), k)
                out = pd.DataFrame({"query_id": query_ids[at], "vec_id": found.reshape(-1), "score": scores.reshape(-1)})
                yield out[np.isfinite(out["score"])]

    near = met.select("queries", "data").mapInPandas(find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])),
asked AS (SELECT vec_id, min({'n': len(v), 'v': v}).v AS v FROM fine WHERE vec_id % 50 = 0 GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM asked q JOIN fine c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
