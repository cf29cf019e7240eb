"""Plan, search, reflect, repeat, expand, answer: the loop runs on the driver, each search is one Spark plan for all of a round's queries.

The two searches of a round run at once. All jobs of a question carry its tag: a reader that leaves, or a caller that
cancels, ends them.
"""

from __future__ import annotations

import asyncio
from collections.abc import AsyncIterator, Callable, Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import is_references, source_label
from lectern.operators import blocks, search
from lectern.operators.text_index import TextIndex
from lectern.operators.vector_index import VectorIndex
from lectern.plans import tagged
from lectern.plans.contracts import Event, Reflection, SearchPlan, parse_json
from lectern.session import materialize


@dataclass(frozen=True)
class Settings:
    top_k: int = 8
    rrf_k: int = 60
    mmr_lambda: float = 0.5
    mmr_top_n: int = 12
    relevance_threshold: float = 0.0
    max_chunks: int = 40
    references_penalty: float = 0.3
    max_iterations: int = 3
    cost_ceiling: float = 0.0

    def override(self, **values) -> Settings:
        """With those values that aren't None."""
        return Settings(**(asdict(self) | {k: v for k, v in values.items() if v is not None}))


@dataclass
class ScriptedModel:
    """A model that answers from a script: for tests and for registered queries. vectors: (qid, vector), asked for as v0, v1, ..."""

    plan: dict
    reflections: list[dict]
    tokens: list[str]
    vectors: DataFrame
    spent: float = 0.0
    asked: list = field(default_factory=list)

    def plan_for(self, question: str) -> SearchPlan:
        return SearchPlan(**self.plan)

    def reflect(self, question: str, plan: SearchPlan, evidence: str) -> Reflection:
        self.asked.append(evidence)
        return Reflection(**self.reflections[min(len(self.asked), len(self.reflections)) - 1])

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        asked = [int(t[1:]) for t in texts if t[:1] == "v" and t[1:].isdigit()]
        found = {f"v{r.qid}": list(map(float, r.vector)) for r in self.vectors.filter(F.col("vector").isNotNull() & F.col("qid").isin(asked)).collect()}
        return [found.get(t) for t in texts]

    def answer(self, question: str, sections: list[dict]) -> Iterator[str]:
        yield from self.tokens

    def cost(self) -> float:
        return self.spent


@dataclass
class GatewayModel:
    """The same four calls through a Gateway with tasks plan, reflect, synth and embed."""

    gateway: object
    language: str = "English"

    def plan_for(self, question: str) -> SearchPlan:
        ask = f"Split the question into sub_questions and write vector_queries and bm25_queries, all queries in {self.language}, the language of the corpus. Answer with one JSON object of these three lists."
        return parse_json(SearchPlan, self.gateway.completion("plan", [{"role": "system", "content": ask}, {"role": "user", "content": question}]))

    def reflect(self, question: str, plan: SearchPlan, evidence: str) -> Reflection:
        ask = f"Judge whether the evidence answers every sub-question. Answer with one JSON object: is_sufficient, gaps, coverage (document, covered, missing), new_vector_queries, new_bm25_queries; new queries in {self.language}."
        body = f"Question: {question}\nSub-questions: {'; '.join(plan.sub_questions)}\nEvidence:\n{evidence}"
        return parse_json(Reflection, self.gateway.completion("reflect", [{"role": "system", "content": ask}, {"role": "user", "content": body}]))

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.gateway.embedding("embed", texts)

    def answer(self, question: str, sections: list[dict]) -> Iterator[str]:
        ask = "Answer from these sections only, and cite each as [source]."
        body = "\n\n".join(f"[{s['source']}]\n{s['full_text']}" for s in sections)
        yield from self.gateway.streaming("synth", [{"role": "system", "content": ask}, {"role": "user", "content": f"{body}\n\nQuestion: {question}"}])

    def cost(self) -> float:
        return self.gateway.cost


class DeepSearch:
    """chunks: (chunk_id, content, document_id, section_id, title, path, heading, vector); sections, titles: see blocks.expand.

    vectors, texts: indexes of these chunks, which are asked in place of all chunks. passages: the same rows without their
    vectors, where these come by a join that texts need not go through.
    """

    def __init__(self, chunks: DataFrame, sections: DataFrame, titles: DataFrame, model, settings: Settings | None = None, vectors: VectorIndex | None = None, texts: TextIndex | None = None, passages: DataFrame | None = None) -> None:
        self.spark, self.chunks, self.sections, self.titles, self.model, self.settings = chunks.sparkSession, chunks, sections, titles, model, settings or Settings()
        self.vectors, self.texts, self.passages = vectors, texts, chunks if passages is None else passages

    def _named(self, chunks: DataFrame, found: DataFrame, most: int) -> DataFrame:
        """Those of chunks that found names, most at most: their ids go into the scan, so that no other text or vector is exchanged."""
        ids = [r["chunk_id"] for r in found.select("chunk_id").distinct().limit(most + 1).collect()]
        return chunks.filter(F.col("chunk_id").isin(ids)) if len(ids) <= most else chunks

    def _round(self, no: int, vector_queries: list[str], bm25_queries: list[str], document_ids: list[int] | None, tag: str) -> DataFrame:
        """qid, round, chunk_id, score, first: one plan for all queries of the round by vector, and one by text, at once."""
        s = self.settings

        def by_vector() -> DataFrame | None:
            asked = [(i, [float(x) for x in v]) for i, v in enumerate(self.model.embed(vector_queries)) if v is not None]
            if not asked:
                return None
            rows = self.spark.createDataFrame(asked, "qid int, vector array<double>")
            found = self.vectors.search(rows, s.top_k, document_ids) if self.vectors else search.knn(self.chunks, rows, s.top_k, document_ids)
            return materialize(found, "search-by-vector")  # top_k rows a query

        def by_text() -> DataFrame:
            texts = self.spark.createDataFrame([(len(vector_queries) + i, q) for i, q in enumerate(bm25_queries)], "qid int, text string")
            found = self.texts.search(texts, s.top_k, document_ids) if self.texts else search.bm25(self.passages, texts, s.top_k, document_ids)  # few queries, so their terms alone are sought
            return materialize(found, "search-by-text")

        found = [x for x in tagged.at_once(self.spark, tag, [by_vector] * bool(vector_queries) + [by_text] * bool(bm25_queries)) if x is not None]
        lists = found[0].unionByName(found[1]) if len(found) == 2 else found[0] if found else None
        if lists is None:
            return self.spark.createDataFrame([], "qid int, round int, chunk_id long, score double, first struct<list_no:int,rank:int>")
        fused = search.fuse(lists.select(F.lit(0).alias("qid"), F.col("qid").alias("list_no"), "rank", "chunk_id"), s.rrf_k)
        flags = self._named(self.passages, lists, s.top_k * (len(vector_queries) + len(bm25_queries))).select("chunk_id", is_references(F.col("heading")).alias("is_references"))
        return search.penalise(fused.join(flags, "chunk_id"), s.references_penalty).select("qid", F.lit(no).alias("round"), "chunk_id", "score", "first")

    def _evidence(self, found: DataFrame) -> str:
        """The best chunks of the needed relevance, max_chunks at most, by document in order of first appearance."""
        best = [F.desc(F.round("score", 12)), F.asc("round"), F.asc("first")]
        pooled = search.pool(found, best, self.settings.relevance_threshold, self.settings.max_chunks)
        rows = pooled.join(self._named(self.passages, pooled, self.settings.max_chunks), "chunk_id")
        rows = rows.select("round", "first", source_label(F.col("title"), F.col("path")).alias("source"), "content").orderBy("round", "first").collect()
        by_document: dict[str, list[str]] = {}
        for r in rows:
            by_document.setdefault(r["source"].split(" › ")[0], []).append(f"- ({r['source']}) {r['content']}")
        return "\n".join(f"{d}:\n" + "\n".join(lines) for d, lines in by_document.items()) or "(none)"

    def cancel(self, tag: str) -> None:
        """End the jobs of the question that streams under this tag; its reader gets an error."""
        tagged.cancel(self.spark, tag)

    def stream(self, question: str, document_ids: list[int] | None = None, tag: str | None = None) -> Iterator[Event]:
        """The events in order: plan, then rounds with reflections, blocks, the answer piece by piece, final. If the reader leaves before the end, the question's jobs end."""
        tag = tag or tagged.new_tag()
        events, end = self._events(question, document_ids, tag), object()
        try:
            while True:
                event = tagged.at_once(self.spark, tag, [lambda: next(events, end)])[0]
                if event is end:
                    return
                yield event
        except GeneratorExit:
            self.cancel(tag)
            raise
        finally:
            events.close()

    async def astream(self, question: str, document_ids: list[int] | None = None, tag: str | None = None) -> AsyncIterator[Event]:
        """The same events on an event loop, which goes on meanwhile; if the task that reads them is cancelled, the question's jobs end."""
        tag = tag or tagged.new_tag()
        events, end = self._events(question, document_ids, tag), object()

        def step():
            return tagged.at_once(self.spark, tag, [lambda: next(events, end)])[0]

        done = False
        try:
            while (event := await asyncio.to_thread(step)) is not end:
                yield event
            done = True
        finally:
            if not done:
                self.cancel(tag)

    async def arun(self, question: str, document_ids: list[int] | None = None, tag: str | None = None) -> dict | None:
        """What the final event tells, on an event loop."""
        found = None
        async for event in self.astream(question, document_ids, tag):
            found = event.body if event.type == "final" else found
        return found

    def _events(self, question: str, document_ids: list[int] | None, tag: str) -> Iterator[Event]:
        if not question.strip():
            raise ValueError("the question is blank")
        s, trace = self.settings, []

        def told(kind: str, **body) -> Event:
            trace.append(Event(kind, body))
            return trace[-1]

        plan = self.model.plan_for(question)
        yield told("plan_ready", plan=asdict(plan))
        vector_queries, bm25_queries, no, rounds = plan.vector_queries, plan.bm25_queries, 0, None
        while True:
            no += 1
            now = self._round(no, vector_queries, bm25_queries, document_ids, tag)
            rounds = materialize(now if rounds is None else rounds.unionByName(now), "search-rounds")  # few rows; cuts the lineage of a growing loop
            counts = {r["round"]: r for r in search.round_counts(rounds).collect()}
            mine = counts.get(no)
            total = mine["total_chunks"] if mine else max((r["total_chunks"] for r in counts.values()), default=0)
            new = mine["new_chunks"] if mine else 0
            yield told("search_round", iteration=no, vector_queries=vector_queries, bm25_queries=bm25_queries, new_chunks=new, total_chunks=total)
            found = search.accumulate(rounds)
            if no > 1 and not new:
                break
            reflection = self.model.reflect(question, plan, self._evidence(found))
            yield told("reflect_result", iteration=no, is_sufficient=reflection.is_sufficient, gaps=reflection.gaps)
            if reflection.is_sufficient or no >= s.max_iterations or not (reflection.new_vector_queries or reflection.new_bm25_queries):
                break
            if s.cost_ceiling > 0 and self.model.cost() >= s.cost_ceiling:
                break
            vector_queries, bm25_queries = reflection.new_vector_queries, reflection.new_bm25_queries

        order = [F.desc(F.round("score", 12)), F.asc("round"), F.asc("first")]
        best = search.pool(found, order, s.relevance_threshold, s.max_chunks)
        pooled = best.join(self._named(self.chunks, best, s.max_chunks), "chunk_id")
        named = self._named(self.passages, best, s.max_chunks)
        chosen = materialize(search.mmr(pooled, s.mmr_lambda, s.mmr_top_n).join(named.select("chunk_id", "section_id"), "chunk_id"), "search-chosen")
        expanded = blocks.expand(chosen.select("qid", F.col("pick").alias("pos"), "chunk_id", "section_id"), self.sections, self.titles)
        sections = [r.asDict() for r in expanded.orderBy("block_pos").collect()]  # mmr_top_n at most
        yield told("expand_ready", section_ids=[b["section_id"] for b in sections], blocks=len(sections))
        parts = []
        for token in self.model.answer(question, sections):
            parts.append(token)
            yield told("answer_delta", text=token)
        answer, sources = "".join(parts), list(dict.fromkeys(b["source"] for b in sections))
        cited = []
        if sources:
            row = self.spark.createDataFrame([(0, answer, sources)], "qid int, answer string, sources array<string>")
            cited = blocks.cited_sources(row).first()["cited"]
        told_of = chosen.drop("section_id").join(named, "chunk_id").select("pick", "chunk_id", "document_id", "section_id", source_label(F.col("title"), F.col("path")).alias("source"), "score", "content")
        picks = [{k: v for k, v in r.asDict().items() if k != "pick"} for r in told_of.orderBy("pick").collect()]  # mmr_top_n at most
        yield Event("final", {"answer": answer, "citations": cited or sources, "chunks": picks, "blocks": sections, "plan": asdict(plan), "iterations": no, "trace": [e.type for e in trace], "cost": self.model.cost()})

    def run(self, question: str, document_ids: list[int] | None = None) -> dict | None:
        """What the final event tells; None if there is none."""
        found = None
        for event in self.stream(question, document_ids):
            found = event.body if event.type == "final" else found
        return found


def trace_table(spark: SparkSession, events: Iterator[Event]) -> DataFrame:
    """seq, type, body (JSON) of each event."""
    return spark.createDataFrame([(i, e.type, e.to_json()) for i, e in enumerate(events)], "seq int, type string, body string")


def sse(events: Iterator[Event]) -> Iterator[str]:
    """Server-sent events: the type as name, the body as data."""
    for e in events:
        yield f"event: {e.type}\ndata: {e.to_json()}\n\n"


def query_response(search_: DeepSearch, question: str, document_ids: list[int] | None) -> tuple[int, dict]:
    """HTTP status and body of a question; 502 where nothing came of it."""
    body = search_.run(question, document_ids or None)
    return (200, body) if body else (502, {"detail": "no result"})


def coalesced(events: Iterator[Event], limit: int = 200) -> Iterator[str]:
    """The text of answer deltas in frames of at least limit characters, and the rest: what blocks.delta_frames does, as events come."""
    held = ""
    for e in events:
        if e.type == "answer_delta":
            held += e.body["text"]
            if len(held) >= limit:
                yield held
                held = ""
    if held:
        yield held


def report(chunks: DataFrame, limit: int = 300) -> DataFrame:
    """chunk_id, source, score, snippet of (chunk_id, source, score, content), best first."""
    from lectern.functions.text import snippet

    return chunks.select("chunk_id", "source", "score", snippet(F.col("content"), limit).alias("snippet")).orderBy(F.desc("score"), "chunk_id")


Policy = Callable[[list[dict]], str | None]
