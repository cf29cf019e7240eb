"""Search for many questions at once: nearest vectors, BM25, rank fusion, rounds, pool and diverse re-ranking.

A question is a row (qid, ...); candidates are rows (qid, list_no, rank, chunk_id, score). Every order ends in an id, so results repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import dot, norm, terms
from lectern.session import materialize

TOP_K, RRF_K, REFERENCES_PENALTY = 8, 60, 0.3
MMR_LAMBDA, MMR_TOP, MAX_CHUNKS = 0.5, 12, 40
K1, B = 1.2, 0.75
#: Above so many rows the questions are no longer broadcast; a search for vectors takes so many at most.
MAX_BROADCAST = MAX_QUESTIONS = 20_000
#: Questions with so many different terms at most have them sought in each chunk, so that no other term is shuffled.
MAX_TERMS = 1000


def small(df: DataFrame, rows: int = MAX_BROADCAST) -> DataFrame:
    """df, broadcast only if it has few rows, by count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_documents(chunks: DataFrame, document_ids: list[int] | None) -> DataFrame:
    """Chunks of these documents; none or an empty list is no filter."""
    return chunks.filter(F.col("document_id").isin(list(document_ids))) if document_ids else chunks


def top(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with rank from 1; partial limits run before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def finite(vector: str) -> Column:
    """True for vectors that are there and hold finite numbers only."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def knn(chunks: DataFrame, questions: DataFrame, k: int = TOP_K, document_ids: list[int] | None = None) -> DataFrame:
    """qid, rank, chunk_id, score: nearest by cosine; chunks and questions without a vector of finite numbers take no part.

    Exact: the question set is stated and meets every chunk once, with each chunk's norm computed once.
    """
    held = in_documents(chunks, document_ids).filter(finite("vector")).select("chunk_id", F.col("vector").cast("array<double>").alias("v")).withColumn("n", norm(F.col("v")))
    asked = questions.filter(finite("vector")).select("qid", F.col("vector").cast("array<double>").alias("q")).withColumn("nq", norm(F.col("q")))
    score = F.when((F.col("n") > 0) & (F.col("nq") > 0), dot(F.col("v"), F.col("q")) / (F.col("n") * F.col("nq"))).otherwise(0.0)
    if asked.limit(MAX_QUESTIONS + 1).count() > MAX_QUESTIONS:
        raise ValueError(f"at most {MAX_QUESTIONS} questions at a time: ask in blocks")
    scored = held.join(F.broadcast(asked), how="cross").select("qid", "chunk_id", score.alias("score"))
    return top(scored, ["qid"], [F.desc("score"), F.asc("chunk_id")], k).select("qid", "rank", "chunk_id", "score")


def postings(chunks: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """chunk_id, document_id, dl (terms in the chunk) and hits: its terms, or only the wanted ones; nothing is exploded yet."""
    all_terms = terms(F.coalesce(F.col("content"), F.lit("")))
    hits = F.col("all_terms") if wanted is None else F.filter("all_terms", lambda t: F.array_contains(F.lit(wanted) if wanted else F.array().cast("array<string>"), t))
    return chunks.select("chunk_id", "document_id", all_terms.alias("all_terms")).select("chunk_id", "document_id", F.size("all_terms").alias("dl"), hits.alias("hits"))


def bm25(chunks: DataFrame, questions: DataFrame, k: int = TOP_K, document_ids: list[int] | None = None, wanted: list[str] | None = None) -> DataFrame:
    """qid, rank, chunk_id, score: chunks that hold any term of the question's text; blank questions find nothing.

    Corpus statistics come before the document filter. wanted: the questions' terms, if the caller knows them, keep
    all other terms out of the shuffle.
    """
    asked = questions.select("qid", F.explode(F.array_distinct(terms(F.coalesce(F.col("text"), F.lit(""))))).alias("term"))
    if wanted is None:
        found = asked.select("term").distinct().limit(MAX_TERMS + 1).collect()
        wanted = [r["term"] for r in found] if len(found) <= MAX_TERMS else None
    base = materialize(postings(chunks, wanted), "search-postings")  # the texts are read and cut once
    stats = base.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = base.select("chunk_id", "document_id", "dl", F.explode("hits").alias("term")).groupBy("chunk_id", "document_id", "dl", "term").agg(F.count("*").alias("tf"))
    if wanted is None:
        tf = tf.join(small(asked.select("term").distinct()), "term", "left_semi")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighed = in_documents(tf, document_ids).join(df, "term").join(F.broadcast(stats), how="cross").select("term", "chunk_id", part.alias("part"))
    scored = weighed.join(small(asked), "term").groupBy("qid", "chunk_id").agg(F.sum("part").alias("score"))
    return top(scored, ["qid"], [F.desc(F.round("score", 9)), F.asc("chunk_id")], k).select("qid", "rank", "chunk_id", "score")


def fuse(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """qid, chunk_id, score, first (list_no, rank): reciprocal rank fusion of (qid, list_no, rank, chunk_id)."""
    return lists.groupBy("qid", "chunk_id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))


def fused_order() -> list[Column]:
    return [F.desc(F.round("score", 12)), F.asc("first")]


def penalise(fused: DataFrame, penalty: float = REFERENCES_PENALTY) -> DataFrame:
    """Scores of chunks flagged is_references, times penalty; order is not touched."""
    return fused.withColumn("score", F.when(F.col("is_references"), F.col("score") * penalty).otherwise(F.col("score")))


def accumulate(rounds: DataFrame) -> DataFrame:
    """qid, chunk_id, score, round, first: over (qid, round, chunk_id, score, first) the best score, and where a chunk was first met."""
    return rounds.groupBy("qid", "chunk_id").agg(F.max("score").alias("score"), F.min(F.struct("round", "first")).alias("met")).select("qid", "chunk_id", "score", "met.round", "met.first")


def round_counts(rounds: DataFrame) -> DataFrame:
    """qid, round, new_chunks, total_chunks."""
    first = rounds.groupBy("qid", "chunk_id").agg(F.min("round").alias("round")).groupBy("qid", "round").agg(F.count("*").alias("new"))
    every = rounds.select("qid", "round").distinct().join(first, ["qid", "round"], "left").withColumn("new_chunks", F.coalesce("new", F.lit(0)))
    return every.select("qid", "round", "new_chunks", F.sum("new_chunks").over(Window.partitionBy("qid").orderBy("round")).alias("total_chunks"))


def pool(found: DataFrame, order: list[Column], threshold: float = 0.0, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """found with pos from 1: scores of at least threshold, best first, cut."""
    return top(found.filter(F.col("score") >= threshold), ["qid"], order, max_chunks).withColumnRenamed("rank", "pos")


_MMR = """
aggregate(
  sequence(1, least({top_n}, size(pool))),
  named_struct('picked', cast(array() as array<int>), 'near', transform(pool, x -> cast(-2 as double))),
  (st, i) -> named_struct(
    'picked', concat(st.picked, array(-array_max(transform(pool, (x, j) -> if(array_contains(st.picked, j), null,
        named_struct('value', round(if(size(st.picked) = 0, x.score, {lam} * x.score - (1 - {lam}) * st.near[j]), 12), 'at', -j)))).at)),
    'near', transform(zip_with(st.near, alike[-array_max(transform(pool, (x, j) -> if(array_contains(st.picked, j), null,
        named_struct('value', round(if(size(st.picked) = 0, x.score, {lam} * x.score - (1 - {lam}) * st.near[j]), 12), 'at', -j)))).at], (a, b) -> greatest(a, b)), x -> x)),
  st -> st.picked)
"""


def mmr(pooled: DataFrame, lam: float = MMR_LAMBDA, top_n: int = MMR_TOP) -> DataFrame:
    """qid, pick, chunk_id, score: greedy choice of relevant and diverse chunks from a pool (qid, pos, chunk_id, score, vector).

    The best score is first; then lam * score - (1 - lam) * largest cosine to those picked. Ties go to the earlier
    position. A null vector is like none. A pool has MAX_CHUNKS rows at most, so a question is one row of arrays.
    """
    rows = pooled.withColumn("v", F.col("vector").cast("array<double>")).withColumn("n", F.coalesce(norm(F.col("v")), F.lit(0.0)))
    packed = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "score", "v", "n"))).alias("pool"))
    alike = F.transform("pool", lambda x: F.transform("pool", lambda y: F.coalesce(F.when((x["n"] > 0) & (y["n"] > 0), dot(x["v"], y["v"]) / (x["n"] * y["n"])), F.lit(0.0))))
    chosen = packed.withColumn("alike", alike).withColumn("picked", F.expr(_MMR.format(top_n=int(top_n), lam=repr(float(lam)) + "D")))
    out = chosen.select("qid", "pool", F.posexplode("picked").alias("i", "at"))
    return out.select("qid", (F.col("i") + 1).alias("pick"), F.get("pool", F.col("at"))["chunk_id"].alias("chunk_id"), F.get("pool", F.col("at"))["score"].alias("score"))


def recall_at_k(ranked: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """qid, first_rank, hit: where the first expected key (qid, key) stands in ranked (qid, rank, key), and whether within k."""
    first = ranked.join(expected, ["qid", "key"], "left_semi").groupBy("qid").agg(F.min("rank").alias("first_rank"))
    return expected.select("qid").distinct().join(first, "qid", "left").select("qid", "first_rank", F.coalesce(F.col("first_rank") <= k, F.lit(False)).alias("hit"))
