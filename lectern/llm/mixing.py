"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the number of copies that each of its documents is expected to get (times the
document's own relative weight, if a weight column is given). The whole part is allocated for certain. The rest is an
inclusion probability p: documents are ranked by odds(u) / odds(p), u a uniform number fixed by seed, id and text, and
the first ones are taken until their words are as near as can be to what the target still lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.packing import numbered
from lectern.session import materialize

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_COPIES = 2
SEED = 10
#: A source's ranks are summed in so many steps; only the rows of the step that holds the cut are sorted one by one.
RANK_STEPS = 4096
#: Above so many sources their table is joined instead of being broadcast.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _drawn(docs: DataFrame, seed: int, weight: str | None) -> DataFrame:
    """docs with size, rank_key (fixed by seed, id and text, and by a number among equal rows), u in (0, 1) and relative weight."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))))
    u = (F.conv(F.substring("rank_key", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    own = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    return _told_apart(docs.withColumns({"size": word_count(F.col("text")), "rank_key": key, "own": own})).withColumn("u", u)


def _told_apart(rows: DataFrame) -> DataFrame:
    """rows, with keys of their own for all but the first of equal rows: they are numbered in any order, for one is like another, so reruns agree.

    Numbers are dealt by ranges, so that rows which stand very often are spread over tasks. Without equal rows nothing is moved.
    """
    twice = rows.groupBy("rank_key", "source").agg(F.count("*").alias("n")).filter("n > 1").select("rank_key").distinct()
    twice = materialize(twice, "mix-twice")
    if not twice.limit(1).count():
        return rows
    again = rows.join(twice, "rank_key").withColumns({"_same": F.struct("rank_key", "source"), "_tie": F.rand(1)})
    keyed = numbered(again, "_same", ["_tie"])
    key = F.when(F.col("_n") > 0, F.md5(F.concat_ws(":", "rank_key", F.col("_n").cast("string")))).otherwise(F.col("rank_key"))
    return rows.join(twice, "rank_key", "left_anti").select(rows.columns).unionByName(keyed.withColumn("rank_key", key).select(rows.columns))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size and target of each source of sizes (source, source_size, ...).

    Sources take weights in the order of their code points, null last. A target that would pass max_copies times its
    source is held there and the rest shared by weight. The sources held are those with the least size per weight, so
    one pass in that order finds them: with integers only, up to one last division.
    """
    order, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    rank = F.row_number().over(order) - 1
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), (rank % len(weights)).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("total", F.sum("source_size").over(everything))
    by_room = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "held_before": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_copies,
        "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    left = F.col("total") * share_percent - F.col("held_before") * 100
    full = left.cast("double") * F.col("weight") >= F.col("weight_left").cast("double") * F.col("source_size") * (100 * max_copies)
    ranked = ranked.withColumns({"full": full, "level_left": left, "room": F.row_number().over(by_room)})
    first_open = F.min(F.when(~F.col("full"), F.struct("room", "level_left", "weight_left"))).over(everything)
    ranked = ranked.withColumn("open", first_open)
    target = F.when(F.col("full"), (F.col("source_size") * max_copies).cast("double")).otherwise(
        (F.col("weight") * F.col("open.level_left")).cast("double") / (F.col("open.weight_left") * 100).cast("double")
    )
    return ranked.select(*sizes.columns, target.alias("target"))


def _copies(max_copies: int) -> tuple[Column, Column, Column]:
    """Certain copies, inclusion probability and rank score in [0, 1] of a row with own, u and its source's figures."""
    expected = F.when(F.col("own_size") > 0, F.col("target") * F.col("own") / F.col("own_size")).otherwise(F.lit(0.0))
    expected = F.least(expected, F.lit(float(max_copies)))
    sure = F.floor(expected).cast("long")
    p = expected - sure
    score = F.when(p > 0, (F.col("u") * (1 - p)) / (F.col("u") * (1 - p) + p * (1 - F.col("u"))))  # odds ratio r as r / (1 + r)
    return sure, p, score


def _step(score: Column) -> Column:
    return F.least(F.floor(score * RANK_STEPS), F.lit(RANK_STEPS - 1)).cast("int")


def plan_mix(drawn: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row a source: its size, its target and the cut in the ranking of its documents."""
    sizes = drawn.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("own") * F.col("size")).alias("own_size"))
    targets = materialize(source_targets(sizes, weights, share_percent, max_copies), "mix-targets")
    sure, _, score = _copies(max_copies)
    rows = with_source(drawn, targets).withColumns({"sure": sure, "score": score}).withColumn("step", _step(F.col("score")))
    steps = rows.groupBy("source", "step").agg(F.sum(F.when(F.col("step").isNotNull(), F.col("size"))).alias("words"), F.sum(F.col("sure") * F.col("size")).alias("sure_words"))
    by_step = Window.partitionBy("source").orderBy(F.col("step").asc_nulls_first())
    summed = steps.withColumns({
        "below": F.coalesce(F.sum("words").over(by_step.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "all_sure": F.sum("sure_words").over(Window.partitionBy("source")),
    })
    need = F.col("target") - F.col("all_sure")
    cut_step = (
        with_source(summed.filter(F.col("step").isNotNull()), targets).withColumn("need", need)
        .filter((F.col("need") > 0) & (F.col("below") < F.col("need")))
        .groupBy("source").agg(F.max(F.struct("step", "below", "need")).alias("at")).select("source", "at.*")
    )
    cut_step = materialize(cut_step, "mix-steps").withColumnRenamed("step", "cut_step")
    inside = with_source(rows.select("source", "size", "score", "step", "rank_key"), cut_step, "inner").filter(F.col("step") == F.col("cut_step"))
    inside = inside.withColumn("reached", F.col("below") + F.sum("size").over(Window.partitionBy("source").orderBy("score", "rank_key")))
    nearest = inside.groupBy("source").agg(F.min(F.struct(F.abs(F.col("reached") - F.col("need")).alias("off"), "score", "rank_key")).alias("n"))
    cut = with_source(cut_step, nearest).select(
        "source", "cut_step", F.when(F.col("n.off") < F.col("need") - F.col("below"), F.col("n.score")).alias("cut_score"), F.col("n.rank_key").alias("cut_key")
    )
    return materialize(with_source(targets, cut), "mix-plan")


def with_source(rows: DataFrame, sources: DataFrame, how: str = "left") -> DataFrame:
    """rows joined with a table of one row a source, null matching null; broadcast only if that table is small, by count."""
    small = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    right = sources.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def allocate(drawn: DataFrame, plan: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """drawn with source_size, target and copies."""
    sure, _, score = _copies(max_copies)
    rows = with_source(drawn, plan).withColumns({"sure": sure, "score": score})
    step = _step(F.col("score"))
    taken = (step < F.col("cut_step")) | ((step == F.col("cut_step")) & ((F.col("score") < F.col("cut_score")) | ((F.col("score") == F.col("cut_score")) & (F.col("rank_key") <= F.col("cut_key")))))
    return rows.withColumn("copies", F.col("sure") + F.coalesce(taken, F.lit(False)).cast("long"))


def mix(docs: DataFrame, seed: int = SEED, weight: str | None = None, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_copies: int = MAX_COPIES) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document.

    Null sources are a source of their own, last in order; a null or wordless text has size 0 and takes nothing. Rows
    equal in id and text draw each for itself. An empty table gives an empty result. Other columns are ignored. The words
    taken differ from a target by at most half of the document at the cut.
    """
    slim = docs.select("doc_id", "text", "source", *([weight] if weight else []))
    drawn = materialize(_drawn(slim, seed, weight).select("doc_id", "source", "size", "rank_key", "own", "u"), "mix-drawn")
    out = allocate(drawn, plan_mix(drawn, weights, share_percent, max_copies), max_copies)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = SEED, weight: str | None = None, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, max_copies: int = MAX_COPIES) -> DataFrame:
    """The mix itself: each document as often as it is taken, with docs' own columns. Texts are shuffled of rows only that stand more than once."""
    columns = docs.columns
    slim = _drawn(docs.select("doc_id", "text", "source", *([weight] if weight else [])), seed, weight)
    plan = plan_mix(materialize(slim.select("doc_id", "source", "size", "rank_key", "own", "u"), "mix-drawn"), weights, share_percent, max_copies)
    packed = docs.select(F.struct(*[docs[c] for c in columns]).alias("doc"), "doc_id", "text", "source", *([weight] if weight else []))
    out = allocate(_drawn(packed, seed, weight), plan, max_copies).filter(F.col("copies") > 0)
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("doc.*")


SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('10:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS first_key FROM documents),
keyed AS (
  SELECT * EXCLUDE (n), CASE WHEN n > 0 THEN md5(first_key || ':' || n) ELSE first_key END AS rank_key
  FROM (SELECT *, row_number() OVER (PARTITION BY first_key, source) - 1 AS n FROM docs)),
drawn AS (SELECT *, (('0x' || substr(rank_key, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM keyed),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM drawn GROUP BY source),
ranked AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
         (sum(source_size) OVER ())::BIGINT AS total FROM sizes),
room AS (
  SELECT *, (2 * coalesce(sum(source_size) OVER w, 0))::BIGINT AS held_before,
         (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::BIGINT AS weight_left FROM ranked
  WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
held AS (
  SELECT *, total * 150 - held_before * 100 AS level_left,
         (total * 150 - held_before * 100)::DOUBLE * weight >= weight_left::DOUBLE * source_size * 200 AS is_full FROM room),
opened AS (SELECT level_left, weight_left FROM held WHERE NOT is_full ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN (source_size * 2)::DOUBLE
         ELSE (weight * (SELECT level_left FROM opened))::DOUBLE / ((SELECT weight_left FROM opened) * 100)::DOUBLE END AS target FROM held),
expect AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size::DOUBLE, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS e
  FROM drawn d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
scored AS (
  SELECT *, floor(e)::BIGINT AS sure, CASE WHEN e - floor(e) > 0 THEN
         (u * (1 - (e - floor(e)))) / (u * (1 - (e - floor(e))) + (e - floor(e)) * (1 - u)) END AS score FROM expect),
reached AS (
  SELECT *, target - sum(sure * size) OVER (PARTITION BY source) AS need,
         CASE WHEN score IS NOT NULL THEN sum(size) OVER (PARTITION BY source ORDER BY score, rank_key) END AS reached FROM scored),
nearest AS (
  SELECT source, arg_min(reached, struct_pack(a := off, b := score, c := rank_key)) AS cut
  FROM (SELECT *, abs(reached - need) AS off FROM reached WHERE score IS NOT NULL AND need > 0) GROUP BY source),
cuts AS (SELECT n.source, n.cut, any_value(r.need) AS need FROM nearest n JOIN reached r ON n.source IS NOT DISTINCT FROM r.source GROUP BY ALL)
SELECT r.doc_id, r.size, r.source_size, r.target,
       ((r.sure + CASE WHEN r.score IS NOT NULL AND c.cut IS NOT NULL AND abs(c.cut - c.need) < c.need AND r.reached <= c.cut THEN 1 ELSE 0 END) * r.size)::BIGINT AS taken
FROM reached r LEFT JOIN cuts c ON r.source IS NOT DISTINCT FROM c.source
"""
