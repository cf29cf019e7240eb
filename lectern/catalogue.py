"""The registered queries of the engine's own operators over the test tables, each with SQL that gives the same rows.

Chunks are documents (vector by vec_id = doc_id), sections and books are made from them by the same SQL text in both engines.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import catalogue_structure
from lectern.functions import text as X
from lectern.operators import blocks, chunking, recursive, search, store
from lectern.operators.text_index import TextIndex
from lectern.operators.vector_index import MAX_QUESTIONS, VectorIndex
from lectern.plans import ingest, library
from lectern.plans.deep_search import report
from lectern.session import materialize, shared_dir, table

FLAGSHIP = "mmr_select"
Query = Callable[[SparkSession, str], DataFrame]

#: Questions: vectors of the first three embeddings, and texts.
TEXTS = ((0, "the and"), (1, "tion ering"), (2, "der the licensed"))
_QUESTIONS = "(VALUES (0, 'the and'), (1, 'tion ering'), (2, 'der the licensed'))"
_TERMS = sorted({w for _, t in TEXTS for w in t.split()})


def chunks(spark: SparkSession, d: str) -> DataFrame:
    docs, emb = table(spark, d, "documents"), table(spark, d, "embeddings")
    vectors = emb.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return _chunk_columns(docs.join(vectors, "doc_id", "left"), "vector")


def passages(spark: SparkSession, d: str) -> DataFrame:
    """chunks without their vectors, so that texts aren't exchanged to meet them: only ids with several vectors, for which a chunk stands as often, meet the texts."""
    docs, emb = table(spark, d, "documents"), table(spark, d, "embeddings")
    several = materialize(emb.groupBy(F.col("vec_id").alias("doc_id")).agg(F.count("*").alias("_n")).filter("_n > 1 and doc_id is not null"), "chunks-several")
    if several.limit(1).count():
        docs = docs.join(search.small(several), "doc_id", "left").withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_n", F.lit(1).cast("long")))))
    return _chunk_columns(docs)


def _chunk_columns(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), (F.col("doc_id") % 20).alias("document_id"), F.col("doc_id").alias("section_id"),
        F.concat(F.lit("Book "), F.col("source")).alias("title"), F.concat((F.col("doc_id") % 7 + 1).cast("string"), F.lit("."), (F.col("doc_id") % 5).cast("string")).alias("path"),
        F.concat(F.when(F.col("doc_id") % 3 == 0, "References").when(F.col("doc_id") % 3 == 1, "User Preferences").otherwise("References to work")).alias("heading"), *more,
    )


_CHUNKS = """chunks AS (
  SELECT doc_id AS chunk_id, text AS content, doc_id % 20 AS document_id, doc_id AS section_id, 'Book ' || source AS title, (doc_id % 7 + 1) || '.' || (doc_id % 5) AS path,
         CASE doc_id % 3 WHEN 0 THEN 'References' WHEN 1 THEN 'User Preferences' ELSE 'References to work' END AS heading, embedding::DOUBLE[] AS vector
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    texts = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({q}, '{t}')" for q, t in TEXTS) + " AS t(qid, text)")
    asked = table(spark, d, "embeddings").filter(F.col("vec_id") < 3).select(F.col("vec_id").cast("int").alias("qid"), F.col("embedding").alias("vector"))
    return texts.join(asked, "qid", "left")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Search


def knn_topk(spark, d):
    return _rounded(search.knn(chunks(spark, d), questions(spark, d)), "score")


def knn_filtered(spark, d):
    return _rounded(search.knn(chunks(spark, d), questions(spark, d), k=5, document_ids=[1, 2, 3]), "score")


def _knn_sql(k: int, where: str = "TRUE") -> str:
    return f"""knn AS (
  SELECT qid, rank, chunk_id, score FROM (
    SELECT q.vec_id::INT AS qid, c.chunk_id, list_cosine_similarity(c.vector, q.embedding::DOUBLE[]) AS score,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(c.vector, q.embedding::DOUBLE[]) DESC, c.chunk_id)::INT AS rank
    FROM chunks c, embeddings q WHERE q.vec_id < 3 AND c.vector IS NOT NULL AND {where}) WHERE rank <= {k})"""


def bm25_topk(spark, d):
    return _rounded(search.bm25(passages(spark, d), questions(spark, d), wanted=_TERMS), "score")


def bm25_filtered(spark, d):
    return _rounded(search.bm25(passages(spark, d), questions(spark, d), k=5, document_ids=[1, 2, 3]), "score")


#: One row in so many asks the vector index.
_ASKING = 50


def _asking(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").filter(F.col("vec_id") % _ASKING == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


def _vector_index(spark, d) -> VectorIndex:
    return VectorIndex.create(chunks(spark, d).select("chunk_id", "document_id", "vector"), f"{shared_dir(spark)}/vector-index-{uuid.uuid4().hex}")


def _ask(index: VectorIndex, asked: DataFrame, **how) -> DataFrame:
    """search, in as many blocks of questions as it takes."""
    n = -(-asked.count() // (MAX_QUESTIONS // 2))
    blocks_ = [asked.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)] if n > 1 else [asked]
    return functools.reduce(DataFrame.unionByName, [index.search(x, 10, **how) for x in blocks_])


def ivf_topk(spark, d):
    """As many cells as hold nineteen of twenty neighbours in the index's sample: most of these vectors have no near ones, so that is most cells."""
    index = _vector_index(spark, d)
    return _rounded(_ask(index, _asking(spark, d), probes=index.probes_for(0.95)), "score")


def ivf_all_cells(spark, d):
    return _rounded(_ask(_vector_index(spark, d), _asking(spark, d), probes=None, keep=None), "score")


_IVF_SQL = f"""WITH {_CHUNKS} SELECT qid, rank, chunk_id, round(score, 6) AS score FROM (
  SELECT q.vec_id AS qid, c.chunk_id, list_cosine_similarity(c.vector, q.embedding::DOUBLE[]) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(c.vector, q.embedding::DOUBLE[]) DESC, c.chunk_id)::INT AS rank
  FROM chunks c, embeddings q WHERE q.vec_id % {_ASKING} = 0 AND c.vector IS NOT NULL) WHERE rank <= 10"""


def _text_index(spark, d) -> TextIndex:
    index = TextIndex(spark, f"{shared_dir(spark)}/text-index-{uuid.uuid4().hex}")
    index.add(passages(spark, d).select("chunk_id", "document_id", "content"))
    return index


def bm25_indexed(spark, d):
    return _rounded(_text_index(spark, d).search(questions(spark, d)), "score")


def bm25_indexed_filtered(spark, d):
    return _rounded(_text_index(spark, d).search(questions(spark, d), k=5, document_ids=[1, 2, 3]), "score")


def _bm25_sql(k: int, where: str = "TRUE") -> str:
    return f"""tok AS (SELECT chunk_id, document_id, list_filter(string_split_regex(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS ts FROM chunks),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
tf AS (SELECT chunk_id, document_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, document_id, len(ts) AS dl, unnest(ts) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT qid, unnest(string_split(t, ' ')) AS term FROM {_QUESTIONS} q(qid, t)),
scored AS (
  SELECT qid, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term), stats WHERE {where} GROUP BY qid, chunk_id),
bm AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id)::INT AS rank, chunk_id, score FROM scored) WHERE rank <= {k})"""


def _lists(spark, d, k: int = 40) -> DataFrame:
    c, q = chunks(spark, d), questions(spark, d)
    lists = search.knn(c, q, k).withColumn("list_no", F.lit(0)).unionByName(search.bm25(passages(spark, d), q, k, wanted=_TERMS).withColumn("list_no", F.lit(1)))
    return materialize(lists, "search-lists")  # k rows a question and list


def _fused_sql(k: int = 40) -> str:
    return f"""{_CHUNKS}, {_knn_sql(k)}, {_bm25_sql(k)},
lists AS (SELECT qid, 0 AS list_no, rank, chunk_id FROM knn UNION ALL SELECT qid, 1, rank, chunk_id FROM bm),
fused AS (SELECT qid, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list_no * 100000 + rank) AS first FROM lists GROUP BY ALL)"""


def _fused(spark, d) -> DataFrame:
    flags = chunks(spark, d).select("chunk_id", X.is_references(F.col("heading")).alias("is_references"))
    return search.fuse(_lists(spark, d)).join(flags, "chunk_id")


def rrf_fusion(spark, d):
    ranked = search.top(_fused(spark, d), ["qid"], search.fused_order(), 1000)
    return _rounded(ranked.select("qid", "rank", "chunk_id", "score"), "score")


def rrf_penalized(spark, d):
    return _rounded(search.penalise(_fused(spark, d)).select("qid", "chunk_id", "is_references", "score"), "score")


_FLAG = "regexp_matches(heading, '(?i)(references|bibliography|further reading)\\s*$')"


def _rounds(spark, d) -> DataFrame:
    lists = _lists(spark, d)
    again = lists.filter(F.col("rank") <= 20).withColumn("rank", (F.lit(21) - F.col("rank")).cast("int"))
    one, two = (search.fuse(x).withColumn("round", F.lit(n)) for n, x in ((1, lists.filter(F.col("rank") > 10)), (2, again)))
    return one.unionByName(two)


_ROUNDS_SQL = f"""WITH {_fused_sql()},
r1 AS (SELECT qid, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, 1 AS round FROM lists WHERE rank > 10 GROUP BY qid, chunk_id),
r2 AS (SELECT qid, chunk_id, sum(1.0::DOUBLE / (60 + 21 - rank)) AS score, 2 AS round FROM lists WHERE rank <= 20 GROUP BY qid, chunk_id),
rounds AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2)"""


def rrf_rounds(spark, d):
    return _rounded(search.accumulate(_rounds(spark, d)).select("qid", "chunk_id", "score", "round"), "score")


def round_counters(spark, d):
    return search.round_counts(_rounds(spark, d))


def _pool(spark, d) -> DataFrame:
    c = chunks(spark, d).select("chunk_id", "vector", "section_id", "title", "path")
    return materialize(search.pool(search.penalise(_fused(spark, d)), [F.desc(F.round("score", 12)), F.asc("first")]).join(c, "chunk_id"), "search-pool")


_POOL_SQL = f"""{_fused_sql()},
penal AS (SELECT qid, f.chunk_id, first, score * CASE WHEN {_FLAG} THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS score, vector, section_id, title, path FROM fused f JOIN chunks USING (chunk_id)),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first)::INT AS pos FROM penal) WHERE pos <= 40)"""


def evidence_pool(spark, d):
    return _rounded(_pool(spark, d).select("qid", "pos", "chunk_id", "score"), "score")


def mmr_select(spark, d):
    """Hybrid retrieval to the end: vector and BM25 lists, fusion, penalty, pool and diverse choice, with source labels."""
    pooled = _pool(spark, d)
    labels = pooled.select("qid", "chunk_id", X.source_label(F.col("title"), F.col("path")).alias("source"))
    return _rounded(search.mmr(pooled).join(labels, ["qid", "chunk_id"]), "score")


_MMR_SQL = f"""WITH RECURSIVE {_POOL_SQL},
alike AS (SELECT a.qid, a.pos AS i, b.pos AS j, coalesce(list_cosine_similarity(a.vector, b.vector), 0) AS sim FROM pool a JOIN pool b USING (qid)),
picks AS (
  SELECT qid, 1 AS step, [arg_max(pos, struct_pack(a := round(score, 12), b := -pos))] AS picked FROM pool GROUP BY qid
  UNION ALL
  SELECT qid, step + 1, list_append(any_value(picked), arg_max(pos, struct_pack(a := round(0.5::DOUBLE * score - 0.5::DOUBLE * near, 12), b := -pos)))
  FROM (SELECT s.qid, s.step, s.picked, p.pos, any_value(p.score) AS score, max(a.sim) AS near
        FROM picks s JOIN pool p ON p.qid = s.qid JOIN alike a ON a.qid = s.qid AND a.i = p.pos
        WHERE s.step < 12 AND NOT list_contains(s.picked, p.pos) AND list_contains(s.picked, a.j) GROUP BY s.qid, s.step, s.picked, p.pos)
  GROUP BY qid, step),
final AS (SELECT qid, arg_max(picked, step) AS picked FROM picks GROUP BY qid),
numbered AS (SELECT qid, unnest(picked) AS pos, unnest(range(1, len(picked) + 1))::INT AS pick FROM final)"""


# Blocks


def _sections(spark, d) -> DataFrame:
    """Depth 1: the first document of each chapter of a book; depth 2: every document, its path chapter.doc."""
    docs = table(spark, d, "documents")
    leaves = docs.select(F.col("doc_id").alias("section_id"), (F.col("doc_id") % 20).alias("document_id"), F.concat((F.col("doc_id") % 7 + 1).cast("string"), F.lit("."), F.col("doc_id").cast("string")).alias("path"), F.lit(2).alias("depth"), F.col("text").alias("full_text"))
    # the first ids are found without the texts: these would be sorted to be grouped
    first = materialize(docs.groupBy((F.col("doc_id") % 20).alias("document_id"), (F.col("doc_id") % 7 + 1).cast("string").alias("path")).agg(F.min("doc_id").alias("doc_id")), "sections-first")
    tops = search.small(first).join(docs.join(search.small(first.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.first("text").alias("full_text")), "doc_id", "left").select("document_id", "path", (-F.col("doc_id") - 1).alias("section_id"), "full_text")
    return leaves.unionByName(tops.withColumn("depth", F.lit(1)))


_SECTIONS = """sections AS (
  SELECT doc_id AS section_id, doc_id % 20 AS document_id, (doc_id % 7 + 1) || '.' || doc_id AS path, 2 AS depth, text AS full_text FROM documents
  UNION ALL SELECT -min(doc_id) - 1, doc_id % 20, (doc_id % 7 + 1)::VARCHAR, 1, arg_min(text, doc_id) FROM documents GROUP BY doc_id % 20, doc_id % 7)"""


def _blocks(spark, d) -> DataFrame:
    titles = table(spark, d, "documents").select((F.col("doc_id") % 20).alias("document_id")).distinct().withColumn("title", F.concat(F.lit("Book "), F.col("document_id").cast("string")))
    selected = _pool(spark, d).select("qid", "pos", "chunk_id", "section_id")
    return blocks.expand(selected, _sections(spark, d), titles)


_BLOCKS_SQL = f"""WITH {_POOL_SQL}, {_SECTIONS},
met AS (
  SELECT p.qid, p.pos, p.chunk_id, b.section_id, b.document_id, b.path, b.full_text FROM pool p JOIN sections s ON s.section_id = p.section_id
  JOIN sections b ON b.document_id = s.document_id AND b.depth = 1 AND (s.path = b.path OR starts_with(s.path, b.path || '.'))),
grouped AS (SELECT qid, section_id, document_id, path, any_value(full_text) AS full_text, min(pos) AS first_pos, list(chunk_id ORDER BY pos) AS from_chunks FROM met GROUP BY qid, section_id, document_id, path),
blocks AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first_pos)::INT AS block_pos, 'Book ' || document_id || ' › ' || path AS source FROM grouped)"""


def expand_blocks(spark, d):
    return _blocks(spark, d).select("qid", "block_pos", "section_id", "document_id", "full_text", "source")


def block_provenance(spark, d):
    return _blocks(spark, d).select("qid", "section_id", F.array_join("from_chunks", ",").alias("from_chunks"))


def section_ancestors(spark, d):
    return blocks.ancestors(_sections(spark, d))


def evidence_by_document(spark, d):
    found = blocks.evidence_by_document(_pool(spark, d).withColumn("source", X.source_label(F.col("title"), F.col("path"))))
    return found.select("qid", "doc_pos", "document", F.array_join("chunk_ids", ",").alias("chunk_ids"))


_ANSWERS = """SELECT doc_id AS qid, 'As [Book ' || source || ' › ' || (doc_id % 9) || '] and [book ' || source || ', ' || (doc_id % 5) || '.2.1] say, not Book src1 chapter 3.' AS answer,
       ARRAY_OF('Book ' || source || ' › ' || (doc_id % 9), 'Book ' || source || ' › 3', 'Book src1 › A', 'Book src1 › 3', 'Book ' || source || ' › ' || (doc_id % 9)) AS sources FROM documents"""


def cited_sources(spark, d):
    table(spark, d, "documents").createOrReplaceTempView("_documents")
    answers = spark.sql(_ANSWERS.replace("ARRAY_OF", "array").replace("FROM documents", "FROM _documents"))
    return blocks.cited_sources(answers).select("qid", F.array_join("cited", "|").alias("cited"))


_CITED_SQL = (
    "WITH answers AS (" + _ANSWERS.replace("ARRAY_OF", "list_value") + """),
parts AS (SELECT qid, answer, s.source, s.i FROM answers, LATERAL (SELECT unnest(sources) AS source, unnest(range(len(sources))) AS i) s),
one AS (SELECT qid, answer, source, min(i) AS i FROM parts GROUP BY ALL),
brk AS (SELECT qid, lower(unnest(regexp_extract_all(answer, '\\[([^\\[\\]]+)\\]', 1))) AS b FROM answers),
hit AS (SELECT DISTINCT o.qid, o.source, o.i FROM one o JOIN brk k ON k.qid = o.qid AND contains(k.b, lower(split_part(o.source, ' › ', 1)))
        AND CASE WHEN regexp_full_match(split_part(o.source, ' › ', 2), '\\d+') THEN list_contains([split_part(n, '.', 1) FOR n IN regexp_extract_all(k.b, '\\d+(?:\\.\\d+)*')], split_part(o.source, ' › ', 2))
            ELSE contains(k.b, lower(split_part(o.source, ' › ', 2))) END)
SELECT a.qid, coalesce(string_agg(h.source, '|' ORDER BY h.i), '') AS cited FROM answers a LEFT JOIN hit h ON h.qid = a.qid GROUP BY a.qid"""
)


def recall_at_k(spark, d):
    ranked = search.top(_fused(spark, d), ["qid"], search.fused_order(), 1000).select("qid", "rank", (F.col("chunk_id") % 7).alias("key"))
    expected = spark.sql("SELECT * FROM VALUES (0, 1L), (0, 2L), (1, 3L), (2, 6L), (2, 99L), (3, 1L) AS t(qid, key)")
    return search.recall_at_k(ranked, expected)


def delta_frames(spark, d):
    parts = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.posexplode(F.split("text", r"(?<=\.)")).alias("seq", "text")).filter("text <> ''")
    return blocks.delta_frames(parts)


# Text


def _noisy() -> str:
    return "replace(replace(replace(text, ', ', ' ,  '), 'tion', 'ti-\\non'), '. ', ' .\\n\\n\\n\\n( x ]  ')"


def clean_text(spark, d):
    noisy = F.replace(F.replace(F.replace(F.col("text"), F.lit(", "), F.lit(" ,  ")), F.lit("tion"), F.lit("ti-\non")), F.lit(". "), F.lit(" .\n\n\n\n( x ]  "))
    cleaned = X.clean(noisy)
    return table(spark, d, "documents").select("doc_id", cleaned.alias("cleaned"), X.count_words(cleaned).alias("token_count"))


_STRIP = r"regexp_replace({}, '^[\s\x0B\x1c-\x1f\x85\p{{Z}}]+|[\s\x0B\x1c-\x1f\x85\p{{Z}}]+$', '', 'g')"
_CLEAN_SQL = (
    r"""WITH n AS (SELECT doc_id, replace(replace(replace(text, ', ', ' ,  '), 'tion', 'ti-' || chr(10) || 'on'), '. ', ' .' || repeat(chr(10), 4) || '( x ]  ') AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(t, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g') AS t FROM n),
b AS (SELECT doc_id, regexp_replace(t, '[ \t]+([,.;:!?)\]])', '\1', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '([(\[])[ \t]+', '\1', 'g') AS t FROM b),
e AS (SELECT doc_id, regexp_replace(t, '[ \t]{2,}', ' ', 'g') AS t FROM c),
f AS (SELECT doc_id, regexp_replace(t, '(?m)[ \t]+$', '', 'g') AS t FROM e),
g AS (SELECT doc_id, """ + _STRIP.format(r"regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g')") + r""" AS cleaned FROM f)
SELECT doc_id, cleaned, len(list_filter(string_split_regex(cleaned, '[\s\x0B\x1c-\x1f\x85\p{Z}]+'), lambda w: w <> ''))::INT AS token_count FROM g"""
)


def line_stats(spark, d):
    """Per document: lines, headings, page numbers among them, and the right-trimmed join."""
    lines = F.split(F.col("text"), "\n")
    s = F.transform(lines, X.strip)
    joined = X.strip(F.array_join(F.transform(lines, lambda x: X.strip_right(x)), "\n"))
    return table(spark, d, "documents").select("doc_id", F.size(lines).alias("n_lines"), F.size(F.filter(s, X.looks_like_heading)).alias("n_headings"), F.size(F.filter(lines, X.is_page_number)).alias("n_page_numbers"), F.md5(joined).alias("joined"))


_LINES_SQL = (
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
t AS (SELECT doc_id, ls, [""" + _STRIP.format("x") + r""" FOR x IN ls] AS ss FROM l)
SELECT doc_id, len(ls)::INT AS n_lines,
  len(list_filter(ss, lambda s: s <> '' AND s <> '|' AND regexp_matches(s, '^\p{Lu}') AND len(list_filter(string_split_regex(s, '[\s\x0B\x1c-\x1f\x85\p{Z}]+'), lambda w: w <> '')) BETWEEN 1 AND 10 AND NOT regexp_matches(s, '[.,;]$')))::INT AS n_headings,
  len(list_filter(ls, lambda s: regexp_matches(s, '^\s*\d{1,4}\s*$')))::INT AS n_page_numbers,
  md5(""" + _STRIP.format(r"array_to_string([regexp_replace(x, '[\s\x0B\x1c-\x1f\x85\p{Z}]+$', '') FOR x IN ls], chr(10))") + ") AS joined FROM t"
)


def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.count_words(F.col("text")).alias("n_words"), F.size(X.terms(F.col("text"))).alias("n_terms"))


def heading_flags(spark, d):
    h = F.concat(F.element_at(F.array(F.lit("1.2  "), F.lit("1.5 "), F.lit("10.1.3  ")), (F.col("doc_id") % 3 + 1).cast("int")), F.substring("text", 1, 20))
    return table(spark, d, "documents").select("doc_id", X.is_numbered_heading(F.regexp_replace(h, "\n", " ")).alias("is_numbered"), X.snippet(F.col("text"), 40).alias("snippet"), X.chapter_of(F.concat((F.col("doc_id") % 11).cast("string"), F.lit(".4"))).alias("chapter"))


def references_flags(spark, d):
    c = chunks(spark, d).select("chunk_id", F.when(F.col("chunk_id") % 10 != 9, F.concat("heading", F.repeat(F.lit(" "), (F.col("chunk_id") % 2).cast("int")))).alias("heading"))
    return c.select("chunk_id", X.is_references(F.col("heading")).alias("is_references"))


def source_labels(spark, d):
    c = chunks(spark, d).select("chunk_id", F.when(F.col("chunk_id") % 4 != 0, F.col("title")).alias("title"), F.when(F.col("chunk_id") % 3 != 0, F.col("path")).alias("path"))
    label = X.source_label(F.col("title"), F.col("path"))
    return c.select("chunk_id", label.alias("source"), X.document_label(label).alias("document"))


def cosine_scores(spark, d):
    """Each vector with its reverse, which is null, empty, zero or cut short for some."""
    e, n = F.col("embedding"), F.col("vec_id") % 7
    other = F.when(n == 1, F.array().cast("array<float>")).when(n == 2, F.transform(e, lambda x: F.lit(0.0).cast("float"))).when(n == 3, F.slice(F.reverse(e), 1, 10)).when(n > 3, F.reverse(e))
    return _rounded(table(spark, d, "embeddings").select("vec_id", X.cosine(e, other).alias("score")), "score")


_COSINE_SQL = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_reverse(embedding)::DOUBLE[] AS r FROM embeddings),
p AS (SELECT vec_id, a, CASE vec_id % 7 WHEN 3 THEN r[1:10] ELSE r END AS b FROM e)
SELECT vec_id, round(CASE WHEN vec_id % 7 < 3 THEN 0.0::DOUBLE ELSE list_inner_product(a[1:len(b)], b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))) END, 6) AS score FROM p"""


def trace_report(spark, d):
    c = chunks(spark, d).select("chunk_id", X.source_label(F.col("title"), F.col("path")).alias("source"), (F.col("chunk_id") % 97 / F.lit(97.0)).alias("score"), "content")
    return _rounded(report(c), "score")


_REPORT_SQL = rf"""WITH {_CHUNKS}, f AS (SELECT chunk_id, title || ' › ' || path AS source, round((chunk_id % 97)::DOUBLE / 97.0::DOUBLE, 6) AS score,
  array_to_string(list_filter(string_split_regex(content, '[\s\x0B\x1c-\x1f\x85\p{{Z}}]+'), lambda w: w <> ''), ' ') AS flat FROM chunks)
SELECT chunk_id, source, score, CASE WHEN length(flat) <= 300 THEN flat ELSE rtrim(substr(flat, 1, 300)) || '…' END AS snippet FROM f"""


def query_cleanup(spark, d):
    q = table(spark, d, "documents").select("doc_id", X.tidy_queries(F.array(F.concat(F.lit("  "), "lang", F.lit(" ")), F.lit("  "), F.lit(""), F.concat("source", F.lit("\n")))).alias("q"))
    return q.select("doc_id", F.array_join("q", "|").alias("queries"))


# Chunks and batches


def _leaves(spark, d) -> DataFrame:
    """Every document is a leaf; each chapter of a source is a section above, which isn't cut."""
    docs = table(spark, d, "documents").withColumn("chapter", (F.col("doc_id") % 7 + 1).cast("string"))
    leaves = docs.select("source", F.concat("chapter", F.lit("."), F.col("doc_id").cast("string")).alias("path"), "lang", F.lit(True).alias("is_leaf"), "text")
    above = docs.groupBy("source", F.col("chapter").alias("path")).agg(F.min("lang").alias("lang")).select("source", "path", "lang", F.lit(False).alias("is_leaf"), F.lit("not to be cut").alias("text"))
    return leaves.unionByName(above).select(
        F.col("source").alias("external_id"), "path", F.col("lang").alias("heading"), "is_leaf", "text", F.lit(None).cast("struct<lo:int,hi:int>").alias("page_range"), F.create_map().cast("map<string,string>").alias("metadata"),
    )


def _chunked(spark, d) -> DataFrame:
    return chunking.chunk(_leaves(spark, d), lambda t: chunking.windows(t, 100, 20))


def chunk_windows(spark, d):
    return _chunked(spark, d).select("external_id", "section_path", "chapter", "seq", "text", "token_count")


def chunk_ids(spark, d):
    return _chunked(spark, d).select("id", "content_hash")


_CHUNKED_SQL = r"""WITH leaf AS (SELECT source AS external_id, (doc_id % 7 + 1) || '.' || doc_id AS section_path, (doc_id % 7 + 1)::INT AS chapter, list_filter(string_split_regex(text, '[\s\x0B\x1c-\x1f\x85\p{Z}]+'), lambda w: w <> '') AS ws FROM documents),
cut AS (SELECT external_id, section_path, chapter, ws, unnest(range(0, greatest(len(ws), 1), 100)) AS s FROM leaf WHERE len(ws) > 0),
ch AS (SELECT external_id, section_path, chapter, (s // 100)::INT AS seq, ws[greatest(s - 20, 0) + 1 : least(s + 100, len(ws))] AS piece FROM cut),
done AS (SELECT external_id, section_path, chapter, seq, array_to_string(piece, ' ') AS text, len(piece)::INT AS token_count, external_id || ':' || section_path || ':' || seq AS id FROM ch)"""


def embed_batches(spark, d):
    return chunking.batches(_chunked(spark, d), "external_id", ["section_path", "seq"], 900, 12)


_BATCH_SQL = _CHUNKED_SQL.replace("WITH leaf", "WITH RECURSIVE leaf") + """,
ord AS (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY section_path, seq) AS n FROM done),
fold AS (
  SELECT external_id, n, section_path, seq, token_count, 0 AS batch, token_count::BIGINT AS tokens, 1 AS items FROM ord WHERE n = 1
  UNION ALL
  SELECT o.external_id, o.n, o.section_path, o.seq, o.token_count, CASE WHEN f.tokens + o.token_count > 900 OR f.items >= 12 THEN f.batch + 1 ELSE f.batch END,
         CASE WHEN f.tokens + o.token_count > 900 OR f.items >= 12 THEN o.token_count ELSE f.tokens + o.token_count END, CASE WHEN f.tokens + o.token_count > 900 OR f.items >= 12 THEN 1 ELSE f.items + 1 END
  FROM fold f JOIN ord o ON o.external_id = f.external_id AND o.n = f.n + 1)
SELECT external_id, section_path, seq, token_count, batch FROM fold"""


# Store


def _stamp(n: int) -> Column:
    return F.lit(f"2026-01-0{n} 00:00:00").cast("timestamp")


def upsert_documents(spark, d):
    src = table(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("document_id"), F.min("lang").alias("title"))
    every = src.select("document_id", F.col("source").alias("external_id"), "title", F.lit("file").alias("source"), _stamp(1).alias("updated_at"))
    stored = every.filter(F.col("document_id") % 3 != 0)
    return store.upsert_documents(stored, every.filter(F.col("document_id") % 2 == 0).select("external_id", "title", "source"), _stamp(2))


_UPSERT_SQL = """WITH every AS (SELECT min(doc_id) AS document_id, source AS external_id, min(lang) AS title FROM documents GROUP BY source),
stored AS (SELECT * FROM every WHERE document_id % 3 <> 0), arriving AS (SELECT * FROM every WHERE document_id % 2 = 0)
SELECT document_id, external_id, title, 'file' AS source, CASE WHEN external_id IN (SELECT external_id FROM arriving) THEN TIMESTAMP '2026-01-02' ELSE TIMESTAMP '2026-01-01' END AS updated_at FROM stored
UNION ALL SELECT (SELECT coalesce(max(document_id), 0) FROM stored) + row_number() OVER (ORDER BY external_id), external_id, title, 'file', TIMESTAMP '2026-01-02' FROM arriving WHERE external_id NOT IN (SELECT external_id FROM stored)"""


def upsert_chunks(spark, d):
    rows = table(spark, d, "documents").select((F.col("doc_id") % 20).alias("document_id"), F.when(F.col("doc_id") % 11 != 0, F.sha2("text", 256)).alias("content_hash"), F.col("doc_id").alias("chunk_id"))
    return store.insert_absent(rows.filter("chunk_id % 4 = 0"), rows.filter("chunk_id % 4 <> 0 or chunk_id % 8 = 0"), ["document_id", "content_hash"], ["chunk_id"])


_UPSERT_CHUNKS_SQL = """WITH r AS (SELECT doc_id % 20 AS document_id, CASE WHEN doc_id % 11 <> 0 THEN sha256(text) END AS content_hash, doc_id AS chunk_id FROM documents),
stored AS (SELECT * FROM r WHERE chunk_id % 4 = 0), a AS (SELECT * FROM r WHERE chunk_id % 4 <> 0 OR chunk_id % 8 = 0),
one AS (SELECT document_id, content_hash, min(chunk_id) AS chunk_id FROM a WHERE content_hash IS NOT NULL GROUP BY ALL)
SELECT * FROM stored UNION ALL SELECT * FROM one WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.document_id = one.document_id AND s.content_hash = one.content_hash) UNION ALL SELECT * FROM a WHERE content_hash IS NULL"""


def parent_links(spark, d):
    s = _sections(spark, d).withColumn("parent_path", F.when(F.col("depth") == 2, F.substring_index("path", ".", 1)))
    return store.link_parents(s).select("section_id", "document_id", "path", "parent_id")


def placed_chunks(spark, d):
    """Chunks with the ids of their document and section (two thirds of the sections are known) and their place in the document."""
    docs = table(spark, d, "documents")
    known = docs.groupBy(F.col("source").alias("external_id")).agg(F.min("doc_id").alias("document_id"))
    sections = docs.filter(F.col("doc_id") % 3 != 0).select(F.col("doc_id").alias("section_id"), F.col("source").alias("external_id"), F.concat((F.col("doc_id") % 7 + 1).cast("string"), F.lit("."), F.col("doc_id").cast("string")).alias("path"))
    placed = store.place_chunks(_chunked(spark, d), known, sections.join(known, "external_id"), F.lit("m"))
    return placed.select("id", "document_id", "section_id", "chunk_index", F.col("metadata")["embedding_model"].alias("embedding_model"))


_PLACED_SQL = _CHUNKED_SQL + """, k AS (SELECT source, min(doc_id) AS document_id FROM documents GROUP BY source)
SELECT id, k.document_id, s.doc_id AS section_id, (row_number() OVER (PARTITION BY k.document_id ORDER BY chapter, section_path, seq) - 1)::INT AS chunk_index, 'm' AS embedding_model
FROM done JOIN k ON k.source = external_id LEFT JOIN documents s ON s.source = external_id AND (s.doc_id % 7 + 1) || '.' || s.doc_id = section_path AND s.doc_id % 3 <> 0"""


def clean_sections(spark, d):
    noisy = F.expr("replace(replace(replace(text, ', ', ' ,  '), 'tion', 'ti-\\non'), '. ', ' .\\n\\n\\n\\n( x ]  ')")
    rows = table(spark, d, "documents").select("doc_id", noisy.alias("text"), F.lit(0).alias("token_count"))
    return ingest.clean_sections(rows).select("doc_id", F.md5("text").alias("text"), "token_count")


def checked_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size(X.checked_vector(F.col("embedding").cast("array<double>"), 64)).alias("components"))


def search_rows(spark, d):
    """Chunks of seven eighths of the documents' titles; a third of the sections is unknown."""
    docs = table(spark, d, "documents").withColumn("document_id", F.col("doc_id") % 40)
    rows = docs.select(F.col("doc_id").alias("chunk_id"), F.md5("text").alias("content"), "document_id", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id")).alias("section_id"), F.lit(None).cast("string").alias("heading"), F.array(F.lit(1.0)).alias("embedding"))
    titles = docs.filter("document_id < 35").select("document_id", F.concat(F.lit("Book "), F.col("document_id").cast("string")).alias("title")).distinct()
    sections = docs.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("section_id"), F.concat((F.col("doc_id") % 7).cast("string"), F.lit(".1")).alias("path"), F.col("lang").alias("heading"))
    return library.search_rows(rows, titles, sections).drop("vector")


_SEARCH_ROWS_SQL = """SELECT c.doc_id AS chunk_id, md5(c.text) AS content, c.doc_id % 40 AS document_id, CASE WHEN c.doc_id % 4 <> 0 THEN c.doc_id END AS section_id, 'Book ' || (c.doc_id % 40) AS title, (s.doc_id % 7) || '.1' AS path, s.lang AS heading
FROM documents c LEFT JOIN documents s ON s.doc_id % 3 <> 0 AND s.doc_id = c.doc_id AND c.doc_id % 4 <> 0 WHERE c.doc_id % 40 < 35"""


def chunk_recursive(spark, d):
    """Pieces of at most 100 words, cut at the best places; tested against plain rules, as SQL can't recurse over places."""
    rows = chunking.chunk(_leaves(spark, d), recursive.recursive(100, 20), recursive.counted(recursive.words))
    return rows.select("external_id", "section_path", "chapter", "seq", "text", "token_count")


def ingest_receipt(spark, d):
    return store.receipt(_leaves(spark, d), _chunked(spark, d))


_OWN: dict[str, tuple[Query, str | None]] = {
    "clean_sections": (clean_sections, f"WITH cleaned AS ({_CLEAN_SQL}) SELECT doc_id, md5(cleaned) AS text, token_count FROM cleaned"),
    "checked_vectors": (checked_vectors, "SELECT vec_id, len(embedding)::INT AS components FROM embeddings"),
    "search_rows": (search_rows, _SEARCH_ROWS_SQL),
    "chunk_recursive": (chunk_recursive, None),
    "knn_topk": (knn_topk, f"WITH {_CHUNKS}, {_knn_sql(8)} SELECT qid, rank, chunk_id, round(score, 6) AS score FROM knn"),
    "knn_filtered": (knn_filtered, f"WITH {_CHUNKS}, {_knn_sql(5, 'c.document_id IN (1, 2, 3)')} SELECT qid, rank, chunk_id, round(score, 6) AS score FROM knn"),
    "ivf_topk": (ivf_topk, None),
    "ivf_all_cells": (ivf_all_cells, _IVF_SQL),
    "bm25_indexed": (bm25_indexed, f"WITH {_CHUNKS}, {_bm25_sql(8)} SELECT qid, rank, chunk_id, round(score, 6) AS score FROM bm"),
    "bm25_indexed_filtered": (bm25_indexed_filtered, f"WITH {_CHUNKS}, {_bm25_sql(5, 'document_id IN (1, 2, 3)')} SELECT qid, rank, chunk_id, round(score, 6) AS score FROM bm"),
    "bm25_topk": (bm25_topk, f"WITH {_CHUNKS}, {_bm25_sql(8)} SELECT qid, rank, chunk_id, round(score, 6) AS score FROM bm"),
    "bm25_filtered": (bm25_filtered, f"WITH {_CHUNKS}, {_bm25_sql(5, 'document_id IN (1, 2, 3)')} SELECT qid, rank, chunk_id, round(score, 6) AS score FROM bm"),
    "rrf_fusion": (rrf_fusion, f"WITH {_fused_sql()} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first)::INT AS rank, chunk_id, round(score, 6) AS score FROM fused"),
    "rrf_penalized": (rrf_penalized, f"WITH {_fused_sql()} SELECT qid, chunk_id, {_FLAG} AS is_references, round(score * CASE WHEN {_FLAG} THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM fused JOIN chunks USING (chunk_id)"),
    "rrf_rounds": (rrf_rounds, _ROUNDS_SQL + " SELECT qid, chunk_id, round(max(score), 6) AS score, min(round)::INT AS round FROM rounds GROUP BY qid, chunk_id"),
    "round_counters": (round_counters, _ROUNDS_SQL + ", f AS (SELECT qid, chunk_id, min(round) AS round FROM rounds GROUP BY ALL), n AS (SELECT r.qid, r.round, count(f.chunk_id) AS new_chunks FROM (SELECT DISTINCT qid, round FROM rounds) r LEFT JOIN f ON f.qid = r.qid AND f.round = r.round GROUP BY r.qid, r.round) SELECT qid, round, new_chunks, (sum(new_chunks) OVER (PARTITION BY qid ORDER BY round))::BIGINT AS total_chunks FROM n"),
    "evidence_pool": (evidence_pool, f"WITH {_POOL_SQL} SELECT qid, pos, chunk_id, round(score, 6) AS score FROM pool"),
    "mmr_select": (mmr_select, _MMR_SQL + " SELECT n.qid, n.pick, p.chunk_id, round(p.score, 6) AS score, title || ' › ' || path AS source FROM numbered n JOIN pool p USING (qid, pos)"),
    "expand_blocks": (expand_blocks, _BLOCKS_SQL + " SELECT qid, block_pos, section_id, document_id, full_text, source FROM blocks"),
    "block_provenance": (block_provenance, _BLOCKS_SQL + " SELECT qid, section_id, array_to_string(from_chunks, ',') AS from_chunks FROM blocks"),
    "section_ancestors": (section_ancestors, f"WITH {_SECTIONS} SELECT s.section_id, b.section_id AS ancestor_id FROM sections s JOIN sections b ON b.document_id = s.document_id AND (s.path = b.path OR starts_with(s.path, b.path || '.'))"),
    "evidence_by_document": (evidence_by_document, f"WITH {_POOL_SQL}, g AS (SELECT qid, title AS document, min(pos) AS first_pos, string_agg(chunk_id, ',' ORDER BY pos) AS chunk_ids FROM pool GROUP BY qid, title) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY first_pos)::INT AS doc_pos, document, chunk_ids FROM g"),
    "cited_sources": (cited_sources, _CITED_SQL),
    "recall_at_k": (recall_at_k, f"WITH {_fused_sql()}, r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first)::INT AS rank, chunk_id % 7 AS key FROM fused), e AS (SELECT * FROM (VALUES (0, 1), (0, 2), (1, 3), (2, 6), (2, 99), (3, 1)) t(qid, key)) SELECT e.qid, min(r.rank)::INT AS first_rank, coalesce(min(r.rank) <= 5, FALSE) AS hit FROM e LEFT JOIN r USING (qid, key) GROUP BY e.qid"),
    "delta_frames": (delta_frames, r"""WITH RECURSIVE p AS (SELECT doc_id AS qid, unnest(regexp_extract_all(text, '[^.]*\.|[^.]+$')) AS t, generate_subscripts(regexp_extract_all(text, '[^.]*\.|[^.]+$'), 1) AS n FROM documents),
m AS (SELECT qid, max(n) AS last FROM p GROUP BY qid),
f AS (SELECT qid, n, CASE WHEN length(t) >= 200 THEN 1 ELSE 0 END AS sent, CASE WHEN length(t) >= 200 THEN '' ELSE t END AS held, CASE WHEN length(t) >= 200 THEN t END AS frame FROM p WHERE n = 1
  UNION ALL SELECT p.qid, p.n, f.sent + CASE WHEN length(f.held || p.t) >= 200 THEN 1 ELSE 0 END, CASE WHEN length(f.held || p.t) >= 200 THEN '' ELSE f.held || p.t END, CASE WHEN length(f.held || p.t) >= 200 THEN f.held || p.t END FROM f JOIN p ON p.qid = f.qid AND p.n = f.n + 1)
SELECT qid, sent::INT AS frame_no, frame FROM f WHERE frame IS NOT NULL UNION ALL SELECT f.qid, sent + 1, held FROM f JOIN m ON m.qid = f.qid AND m.last = f.n WHERE held <> ''"""),
    "clean_text": (clean_text, _CLEAN_SQL),
    "line_stats": (line_stats, _LINES_SQL),
    "token_counts": (token_counts, r"SELECT doc_id, len(list_filter(string_split_regex(text, '[\s\x0B\x1c-\x1f\x85\p{Z}]+'), lambda w: w <> ''))::INT AS n_words, len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''))::INT AS n_terms FROM documents"),
    "heading_flags": (heading_flags, r"""WITH h AS (SELECT doc_id, text, replace(['1.2  ', '1.5 ', '10.1.3  '][doc_id % 3 + 1] || substr(text, 1, 20), chr(10), ' ') AS h FROM documents), s AS (SELECT *, """ + _STRIP.format(r"regexp_replace(text, '[\s\x0B\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g')".replace("{{", "{").replace("}}", "}")) + r""" AS flat FROM h)
SELECT doc_id, regexp_matches(h, '^\d+(?:\.\d+)+ {2}[A-Za-z]') AS is_numbered, CASE WHEN length(flat) <= 40 THEN flat ELSE rtrim(substr(flat, 1, 40)) || '…' END AS snippet, (doc_id % 11)::INT AS chapter FROM s"""),
    "references_flags": (references_flags, f"WITH {_CHUNKS} SELECT chunk_id, CASE WHEN chunk_id % 10 <> 9 THEN {_FLAG} ELSE FALSE END AS is_references FROM chunks"),
    "source_labels": (source_labels, f"WITH {_CHUNKS} SELECT chunk_id, CASE WHEN chunk_id % 3 <> 0 THEN CASE WHEN chunk_id % 4 <> 0 THEN title ELSE 'None' END || ' › ' || path ELSE CASE WHEN chunk_id % 4 <> 0 THEN title ELSE '' END END AS source, CASE WHEN chunk_id % 4 <> 0 THEN title WHEN chunk_id % 3 <> 0 THEN 'None' ELSE '' END AS document FROM chunks"),
    "cosine_scores": (cosine_scores, _COSINE_SQL),
    "trace_report": (trace_report, _REPORT_SQL),
    "query_cleanup": (query_cleanup, "SELECT doc_id, lang || '|' || source AS queries FROM documents"),
    "chunk_windows": (chunk_windows, _CHUNKED_SQL + " SELECT external_id, section_path, chapter, seq, text, token_count FROM done"),
    "chunk_ids": (chunk_ids, _CHUNKED_SQL + " SELECT id, sha256(id || chr(0) || text) AS content_hash FROM done"),
    "embed_batches": (embed_batches, _BATCH_SQL),
    "placed_chunks": (placed_chunks, _PLACED_SQL),
    "upsert_documents": (upsert_documents, _UPSERT_SQL),
    "upsert_chunks": (upsert_chunks, _UPSERT_CHUNKS_SQL),
    "parent_links": (parent_links, f"WITH {_SECTIONS} SELECT s.section_id, s.document_id, s.path, b.section_id AS parent_id FROM sections s LEFT JOIN sections b ON s.depth = 2 AND b.document_id = s.document_id AND b.path = split_part(s.path, '.', 1)"),
    "ingest_receipt": (ingest_receipt, _CHUNKED_SQL + ", s AS (SELECT source AS external_id, count(*) + count(DISTINCT doc_id % 7) AS sections FROM documents GROUP BY source), c AS (SELECT external_id, count(*) AS chunks FROM done GROUP BY external_id) SELECT s.external_id, s.sections, coalesce(c.chunks, 0) AS chunks FROM s FULL JOIN c USING (external_id)"),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _OWN.items()} | catalogue_structure.queries()


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _OWN.items() if sql} | catalogue_structure.oracle_sql()
