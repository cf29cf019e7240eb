"""Hard negatives by one-dimensional distance keys.

A vector x of squared length up to M gets one more component, sqrt(M - |x|^2); then the order by inner product with an
anchor is the order by distance to it, and 2 * score = |anchor|^2 + M - distance^2. Every vector belongs to its nearest
pivot and is stored in the order of (pivot, distance to the pivot), cut into shards. By the triangle inequality a vector
whose key is off the anchor's own distance to that pivot by more than r is farther than r: an anchor searches rings
around pivots outwards from its own key, and stops where no ring left can hold a better score than those found. Anchors
come in blocks of neighbours; first they meet the shards about their own keys, which gives each a radius, then all
shards that the radius reaches.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import materialize, prepare

#: Of the contract.
ANCHOR_EVERY, SHIFT_EVERY, LABELS, SCALE, POSITIVES, NEGATIVES, LEAST, MOST = 100, 7, 10, 256, 5, 5, 80, 100
PIVOTS, SAMPLE = 16, 256
#: Rows of a shard and of a block of anchors at most, and bytes of their components; rows that one step of a scan looks at.
SHARD_ROWS, BLOCK_ROWS, SHARD_BYTES, STEP = 8192, 1024, 16 << 20, 512
#: Sums below this are exact in doubles; beyond, Python's integers are used.
EXACT = 2.0**53
#: Distances err by far less, as a part of the longest vector.
SLACK = 1e-6


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v (scaled whole components, as doubles), len and sq of the rows that take part."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * SCALE)
    whole = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    label = F.col("label").cast("long")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % SHIFT_EVERY == 0, (label + 1) % LABELS).otherwise(label).alias("label"), v.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("v", whole)
    return rows.withColumns({"len": F.size("v"), "sq": squares}).filter(F.col("sq") < float("inf"))


def far_apart(vectors: np.ndarray, n: int) -> np.ndarray:
    """Rows of vectors, each the farthest from those before it."""
    chosen, d = [0], np.full(len(vectors), np.inf)
    while len(chosen) < min(n, len(vectors)):
        d = np.minimum(d, ((vectors - vectors[chosen[-1]]) ** 2).sum(axis=1))
        if d.max() <= 0:
            break
        chosen.append(int(np.argmax(d)))
    return vectors[chosen]


def raised(vectors: np.ndarray, top: float) -> np.ndarray:
    """vectors with the component that gives them all the squared length top."""
    return np.concatenate([vectors, np.sqrt(np.maximum(top - (vectors * vectors).sum(axis=1), 0))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0))


def _spaces(rows: DataFrame) -> dict[int, tuple[float, bool, np.ndarray]]:
    """For each length: the largest squared length, whether sums may leave doubles, and the pivots, far apart in a sample of SAMPLE rows at most."""
    first = F.row_number().over(Window.partitionBy("len").orderBy(F.xxhash64("vec_id"), "vec_id", "label"))
    sums = {r["len"]: r for r in rows.groupBy("len").agg(F.max("sq").alias("top"), F.max(F.when(F.col("len") > 0, F.array_max(F.transform("v", F.abs)))).alias("big")).collect()}
    some: dict[int, list] = {}
    for r in rows.withColumn("_n", first).filter(F.col("_n") <= SAMPLE).orderBy("len", "_n").select("len", "v").toLocalIterator():
        some.setdefault(r["len"], []).append(r["v"])
    out = {}
    for length, found in some.items():
        top, big = sums[length]["top"], sums[length]["big"] or 0.0
        out[length] = (top, MOST * big * big * max(1, length) >= EXACT, raised(far_apart(np.array(found, dtype=float).reshape(len(found), length), PIVOTS), top))
    return out


def _matrix(column: pd.Series, length: int) -> np.ndarray:
    return np.array(list(column), dtype=float).reshape(len(column), length)


def _keyed(rows: DataFrame, spaces: dict) -> DataFrame:
    """rows with pivot and key, the nearest pivot and the distance to it."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for length, some in b.groupby("len"):
                d = distances(raised(_matrix(some["v"], int(length)), spaces[int(length)][0]), spaces[int(length)][2])
                yield some.assign(pivot=d.argmin(axis=1), key=d.min(axis=1))

    return rows.mapInPandas(run, rows.select("*", F.lit(0).alias("pivot"), F.lit(0.0).alias("key")).schema)


def _slim(vectors: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    most = np.abs(vectors).max(initial=0)
    return vectors.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)


def _shards(keyed: DataFrame) -> DataFrame:
    """shard, len, pivot, lo, hi, data: runs of rows of one pivot in the order of their keys."""

    def pack(run: pd.DataFrame, shard: int) -> pd.DataFrame:
        length = int(run["len"].iloc[0])
        data = pickle.dumps((run["vec_id"].to_numpy(np.int64), run["label"].to_numpy(np.int64), run["key"].to_numpy(float), _slim(_matrix(run["v"], length))))
        return pd.DataFrame({"shard": [shard], "len": [length], "pivot": [int(run["pivot"].iloc[0])], "lo": [float(run["key"].iloc[0])], "hi": [float(run["key"].iloc[-1])], "data": [data]})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, made, held, n = TaskContext.get().partitionId() << 32, 0, [], 0
        for b in batches:
            cuts = np.flatnonzero(np.diff(b["len"].to_numpy()) | np.diff(b["pivot"].to_numpy())) + 1
            for some in np.split(np.arange(len(b)), cuts):
                part = b.iloc[some]
                while len(part):
                    length = int(part["len"].iloc[0])
                    room = max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * max(1, length))))
                    if held and (n >= room or (held[0]["len"].iloc[0], held[0]["pivot"].iloc[0]) != (length, part["pivot"].iloc[0])):
                        yield pack(pd.concat(held), base + made)
                        made, held, n = made + 1, [], 0
                    held.append(part.iloc[: room - n])
                    n, part = n + len(held[-1]), part.iloc[room - n :]
        if held:
            yield pack(pd.concat(held), base + made)

    order = ("len", "pivot", "key", "vec_id")
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(run, "shard long, len int, pivot int, lo double, hi double, data binary")


def _blocks(anchors: DataFrame, spaces: dict) -> DataFrame:
    """anchors with block: neighbours in the order of the keys, of one length, BLOCK_ROWS at most."""
    n = max(1, -(-anchors.count() // BLOCK_ROWS))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, block, n, length = TaskContext.get().partitionId() << 32, -1, BLOCK_ROWS, -1
        for b in batches:
            blocks = []
            for here in b["len"].tolist():
                if n >= BLOCK_ROWS or here != length:
                    block, n, length = block + 1, 0, here
                blocks.append(base + block)
                n += 1
            yield b.assign(block=blocks)

    order = ("len", "pivot", "key", "vec_id")
    return anchors.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(run, anchors.select("*", F.lit(0).cast("long").alias("block")).schema)


def _packed(anchors: DataFrame, spaces: dict) -> DataFrame:
    """block, len, near (its anchors' pivots and keys), rings (least and largest distance to each pivot, with the largest radius), data; anchors have low, a list of (highest, least) scores that are asked for."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        length = int(pdf["len"].iloc[0])
        top, _, pivots = spaces[length]
        vectors = _matrix(pdf["v"], length)
        # an anchor itself is not raised: its extra component is 0, so distance^2 = |anchor|^2 + top - 2 * score
        at = np.sqrt(np.maximum((vectors * vectors).sum(axis=1)[:, None] + top - 2 * (vectors @ pivots[:, :-1].T), 0))
        asks = [[(x["highest"], x["least"]) for x in asked] for asked in pdf["asks"]]
        least = np.array([min((x[1] for x in asked), default=np.inf) for asked in asks])
        radius = np.where(np.isneginf(least), np.inf, np.sqrt(np.maximum((vectors * vectors).sum(axis=1) + top - 2 * np.where(np.isfinite(least), least, 0), 0)))
        radius = np.where(np.isposinf(least), -np.inf, radius) + SLACK * np.sqrt(top)
        lo, hi = (at - radius[:, None]).min(axis=0), (at + radius[:, None]).max(axis=0)
        own = pdf["pivot"].to_numpy()
        rings = [{"pivot": p, "lo": float(lo[p]), "hi": float(hi[p]), "own_lo": float(at[own == p, p].min()) if (own == p).any() else None, "own_hi": float(at[own == p, p].max()) if (own == p).any() else None} for p in range(len(pivots))]
        data = pickle.dumps((pdf["vec_id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64), at, _slim(vectors), asks))
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "len": [length], "rings": [rings], "data": [data]})

    return anchors.groupBy("block").applyInPandas(pack, "block long, len int, rings array<struct<pivot:int,lo:double,hi:double,own_lo:double,own_hi:double>>, data binary")


def best(row: np.ndarray, score: np.ndarray, name: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each row: higher scores first, then smaller names."""
    falling = -score if score.dtype != object else -np.unique(score, return_inverse=True)[1]
    order = np.lexsort((name, falling, row))
    row, score, name = row[order], score[order], name[order]
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, dtype=int)
    place = np.arange(len(row)) - np.repeat(starts, np.diff([*starts, len(row)]))
    return row[place < k], score[place < k], name[place < k]


def products(a: np.ndarray, b: np.ndarray, wide: bool) -> np.ndarray:
    """Inner products of whole numbers, exactly."""
    if not wide:
        return a.astype(float) @ b.astype(float).T
    x, y = ([[int(v) for v in r] for r in m] for m in (a, b))
    out = np.empty((len(x), len(y)), dtype=object)
    for i, r in enumerate(x):
        out[i] = [sum(p * q for p, q in zip(r, s, strict=True)) for s in y]
    return out


def scan(block: tuple, shard: tuple, pivot: int, space: tuple, same: bool, k: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Ask (anchor number * width + place in its asks), score and id of the k best of each ask in a shard, and how many products were formed.

    An ask is (highest or None, least): rows of the anchor's own label (same) or of others whose score is at most the highest and
    at least the least. Steps go outwards from the anchors' own keys; an anchor takes part in a step while the best score
    that the step's ring allows is no worse than the k-th found.
    """
    anchor_ids, labels, at, vectors, asks = block
    ids, row_labels, keys, rows = shard
    top, wide, _ = space
    width = max(1, max(map(len, asks), default=1))
    highest, least = np.full((len(asks), width), -np.inf, dtype=object if wide else float), np.full((len(asks), width), np.inf)
    for i, asked in enumerate(asks):
        for j, (h, low) in enumerate(asked):
            highest[i, j], least[i, j] = np.inf if h is None else h, low
    limit = least.copy()  # of each ask, the k-th score found, once there are k
    own = (vectors.astype(float) ** 2).sum(axis=1)
    t = at[:, pivot]
    slack = SLACK * max(top, 1.0)
    found = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object if wide else float), np.zeros(0, dtype=np.int64))
    starts = np.arange(0, len(ids), step)
    middle = np.searchsorted(keys, np.median(t)) // step if len(t) else 0
    formed = 0
    for s in starts[np.argsort(np.abs(np.arange(len(starts)) - middle), kind="stable")]:
        piece = slice(s, s + step)
        lo, hi = keys[piece][0], keys[piece][-1]
        gap = np.maximum(np.maximum(lo - t, t - hi), 0)
        who = np.flatnonzero((own + top - gap * gap) / 2 + slack >= limit.min(axis=1))
        if not len(who):
            continue
        score = products(vectors[who], rows[piece], wide)
        formed += score.size
        fits = (row_labels[piece][None, :] == labels[who][:, None]) == same
        fits &= ids[piece][None, :] != anchor_ids[who][:, None]
        for j in range(width):
            good = fits & (score >= limit[who, j][:, None]).astype(bool) & (score <= highest[who, j][:, None]).astype(bool)
            r, c = np.nonzero(good)
            if len(r):
                found = best(*(np.concatenate([x, y]) for x, y in zip(found, (who[r] * width + j, score[r, c], ids[piece][c]), strict=True)), k)
        asked, n = np.unique(found[0], return_counts=True)
        last = found[1][np.cumsum(n) - 1]
        full = n >= k
        limit.reshape(-1)[asked[full]] = np.maximum(limit.reshape(-1)[asked[full]], last[full].astype(float) if wide else last[full])
        if wide:  # a rounded limit may lie above the score itself
            limit.reshape(-1)[asked[full]] = np.nextafter(limit.reshape(-1)[asked[full]], -np.inf)
    return *found, formed


def _searched(pairs: DataFrame, blocks: DataFrame, shards: DataFrame, spaces: dict, same: bool, k: int) -> DataFrame:
    """anchor_id, highest, vec_id, score: of each pair of block and shard, the k best of each ask."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = pairs.join(blocks.select("block", F.col("data").alias("asked")), "block").join(shards.select("shard", "len", "pivot", "data"), "shard")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for asked, data, length, pivot in zip(b["asked"], b["data"], b["len"], b["pivot"], strict=True):
                block, shard = pickle.loads(asked), pickle.loads(data)
                ask, score, ids, _ = scan(block, shard, int(pivot), spaces[int(length)], same, k)
                width = max(1, max(map(len, block[4]), default=1))
                highest = [block[4][a // width][a % width][0] for a in ask.tolist()]
                yield pd.DataFrame({"anchor_id": block[0][ask // width], "highest": pd.array(highest, "Int64"), "vec_id": ids, "score": np.array([int(x) for x in score], dtype=np.int64)})

    return met.repartition(parts, "block", "shard").mapInPandas(run, "anchor_id long, highest long, vec_id long, score long")


def _rings(blocks: DataFrame) -> DataFrame:
    return blocks.select("block", "len", F.explode("rings").alias("x")).select("block", "len", "x.*")


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor, by the contract.

    Rows with a null vec_id, label or vector, or with null or non-finite components (also once scaled, and squared lengths) take no part; labels
    and vectors are shifted and made whole first. Vectors meet those of their own length. A repeated id asks once, with the
    least of its labels and vectors, and its own rows are left out for it; as positives and negatives repeated rows count
    each. Ties go to the smaller id. An anchor without positives, or without negatives in the window, has no row; an empty
    table gives none. Other columns are ignored. Exact at any size of component whose scores a long can hold.
    """
    spark = prepare(embeddings.sparkSession)
    rows = materialize(usable(embeddings), "negatives-rows")
    spaces = _spaces(rows)  # a row and PIVOTS vectors for each length of vector
    keyed = materialize(_keyed(rows, spaces), "negatives-keyed")
    shards = materialize(_shards(keyed), "negatives-shards")
    places = shards.select("shard", "len", "pivot", "lo", "hi")
    asked = keyed.filter(F.col("vec_id") % ANCHOR_EVERY == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v", "len", "pivot", "key")).alias("x")).select("vec_id", "x.*")
    anchors = materialize(_blocks(materialize(asked, "negatives-asked"), spaces), "negatives-anchors")
    asks = "array<struct<highest:bigint,least:double>>"

    def asking(limits: DataFrame | None) -> DataFrame:
        """Blocks of the anchors, each asking for any score of at least its limit."""
        low = F.lit(float("-inf"))
        limited = anchors.withColumn("low", low) if limits is None else anchors.join(limits, "vec_id", "left").withColumn("low", F.coalesce("low", low))
        return materialize(_packed(limited.withColumn("asks", F.array(F.struct(F.lit(None).cast("long").alias("highest"), F.col("low").alias("least"))).cast(asks)).drop("low"), spaces), "negatives-blocks")

    first = asking(None)
    mine = _rings(first).filter("own_lo is not null").join(places.withColumnsRenamed({"lo": "from", "hi": "to"}), ["len", "pivot"]).filter("from <= own_hi and to >= own_lo")
    mine = materialize(mine.select("block", "shard").distinct(), "negatives-pairs")
    near = materialize(_searched(mine, first, shards, spaces, True, POSITIVES), "negatives-near")
    of_anchor = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    limits = near.withColumn("rank", F.row_number().over(of_anchor)).filter(F.col("rank") == POSITIVES).select(F.col("anchor_id").alias("vec_id"), F.col("score").cast("double").alias("low"))
    second = asking(limits)
    within = places.withColumnsRenamed({"lo": "from", "hi": "to"})
    rest = _rings(second).join(within, ["len", "pivot"]).filter("from <= hi and to >= lo").select("block", "shard").join(mine, ["block", "shard"], "left_anti")
    far = _searched(materialize(rest, "negatives-pairs"), second, shards, spaces, True, POSITIVES)
    positives = near.unionByName(far).withColumn("place", F.row_number().over(of_anchor)).filter(F.col("place") <= POSITIVES)
    positives = materialize(positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")

    least = F.col("positive_score") * (LEAST / MOST) * (1 - 1e-12) - 1  # a little low: the window is tested on whole numbers below
    wanted = positives.filter("positive_score >= 0").select(F.col("anchor_id").alias("vec_id"), F.struct(F.col("positive_score").alias("highest"), least.cast("double").alias("least")).alias("ask")).distinct()
    wanted = wanted.groupBy("vec_id").agg(F.array_sort(F.collect_list("ask")).cast(asks).alias("asks"))  # POSITIVES at most
    third = materialize(_packed(anchors.join(wanted, "vec_id"), spaces), "negatives-blocks")
    pairs = _rings(third).join(within, ["len", "pivot"]).filter("from <= hi and to >= lo").select("block", "shard")
    found = _searched(materialize(pairs, "negatives-pairs"), third, shards, spaces, False, NEGATIVES)
    found = found.filter(LEAST * F.col("highest").cast("decimal(20,0)") <= MOST * F.col("score").cast("decimal(20,0)"))
    order = Window.partitionBy("anchor_id", "highest").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEGATIVES).withColumnsRenamed({"highest": "positive_score", "vec_id": "negative_id", "score": "negative_score"})
    return positives.join(found, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


SQL = """
WITH fine AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]), TRUE)),
asked AS (SELECT vec_id, min({'label': label, 'v': v}) AS x FROM fine WHERE vec_id % 100 = 0 GROUP BY vec_id),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.x.label AS same, list_inner_product(a.x.v, c.v)::BIGINT AS score
  FROM asked a JOIN fine c ON a.vec_id <> c.vec_id AND len(a.x.v) = len(c.v)),
positive AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same) WHERE place <= 5),
met AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM met WHERE rank <= 5
"""
