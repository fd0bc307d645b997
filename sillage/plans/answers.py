"""Questions end to end: searches as DataFrames, one ranked list, a context, an answer with its sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sillage.operators import bm25, context, corpus, index, postings, rerank
from sillage.plans.agents import Answerer, Planner

FIRST_K, SECOND_K, EXPANSION_K, MOST_HITS, HOPS = 8, 10, 3, 40, 2
#: Replies where nothing is found or nothing supports an answer (fixed values).
NOTHING = "I couldn't find anything on this site related to your question."
NOT_ENOUGH = "I couldn't find enough information on this site to answer that directly."
NO_MEMORY = "I don't have enough prior conversation context to transform yet."
NOT_MADE = "I couldn't transform the previous response from the available memory."
_LINK = "array<struct<from_page:string,anchor_text:string,source_chunk:string>>"


@dataclass
class Result:
    answer: str
    supported: bool
    sources: list[dict] = field(default_factory=list)
    trace: dict = field(default_factory=dict)


@dataclass
class Retriever:
    """Searches of an index (id, url, text, hierarchy, parent, incoming_links, unit, _key). embed turns questions into vectors on the driver.

    Both scores of a record meet on one row, by id, before ranking. Records without a vector are found by their words only: in words, a stored
    inverted index of the records, or where there is none in their texts. Where vectors are a table of their own (id, unit, _key), units is that, and
    the records need none: texts are read where they lie, and never joined with all vectors.
    """

    spark: SparkSession
    records: DataFrame
    embed: Callable[[str], list[float] | None]
    hybrid: bool = True
    threshold: float = 0.0
    words: postings.Index | None = None
    units: DataFrame | None = None

    def near(self, vectors: DataFrame, k: int) -> DataFrame:
        """index.search() among the records, or among units and then with the records of its hits, k for each question."""
        if self.units is None:
            return index.search(self.records.where(F.col("unit").isNotNull()), vectors, k, self.threshold)
        hits = index.search(self.units.select("id", "_key", "unit").where(F.col("unit").isNotNull()), vectors, k, self.threshold)
        return self.records.drop("_key", "unit").join(F.broadcast(hits), "id")

    def search(self, questions: list[str], k: int, tag: str, boost: str | None = None, at: int = 0) -> DataFrame:
        """Hits of all questions in one pass, seq in order of question and rank."""
        asked = [(n, q, self.embed(q)) for n, q in enumerate(questions) if q and q.strip()]
        vectors = self.spark.createDataFrame([(n, v) for n, _, v in asked if v], "qid int, vector array<double>")
        found = self.near(vectors, k).withColumn("_origin", F.lit(tag)).withColumn("_score_vec", F.col("score")).withColumn("part", F.lit(0))
        if self.hybrid:
            texts = self.spark.createDataFrame([(n, q) for n, q, _ in asked], "qid int, query string")
            # At most max(8, k) rows for each question.
            scored = self.words.search(texts, max(8, k)) if self.words else bm25.best(self.records, texts, max(8, k))
            best = scored.withColumnRenamed("score", "_score_bm25")
            words = self.records.join(F.broadcast(best), "id").withColumn("_origin", F.lit(f"{tag}-bm25")).withColumn("part", F.lit(1))
            found = found.unionByName(words, allowMissingColumns=True)
        order = Window.partitionBy(F.lit(0)).orderBy("qid", "part", "rank")
        rows = found.withColumn("seq", F.row_number().over(order) + at).withColumn("_meta_rank", F.col("rank")).withColumn("_boost_reason", F.lit(boost).cast("string"))
        if "_score_bm25" not in rows.columns:
            rows = rows.withColumn("_score_bm25", F.lit(None).cast("double"))
        return rows.drop("qid", "rank", "part", "unit", "embedding")

    def expanded(self, question: str, seeds: DataFrame, at: int) -> DataFrame:
        """Hits of questions made of the seeds' incoming anchors and headings; a handful of questions reach the driver."""
        asked = seeds.withColumn("one", F.lit(0)).withColumn("question", F.lit(question))
        anchors = [r["query"] for r in rerank.anchor_queries(asked, ["one"]).orderBy("n").collect()]
        headings = [r["query"] for r in rerank.section_queries(asked, ["one"]).orderBy("n").collect()]
        return self.search(anchors, EXPANSION_K, "graph-anchor", "anchor", at).unionByName(self.search(headings, EXPANSION_K, "section", "section", at + 1_000_000))


def both_scores(hits: DataFrame) -> DataFrame:
    """Every hit of a record with the best of its vector and BM25 scores."""
    of = Window.partitionBy("_rid")
    met = hits.withColumn("_rid", rerank.record_id())
    return met.withColumn("_score_vec", F.max("_score_vec").over(of)).withColumn("_score_bm25", F.max("_score_bm25").over(of)).withColumn("score", F.coalesce("score", "_score_vec", F.lit(0.0))).drop("_rid")


@dataclass
class Pipeline:
    retriever: Retriever
    answerer: Answerer
    planner: Planner = field(default_factory=Planner)
    mode: str = "builder"
    budget: int = 12_000
    rounds: int = 1
    best_effort: bool = True
    expand: bool = True
    rewrite: bool = True
    recrawl: Callable[[], None] | None = None

    def query(self, question: str, memory: str = "", retry_on_empty: bool = False) -> Result:
        return (self._builder if self.mode == "builder" else self._classic)(question, memory, retry_on_empty)

    def _kept(self, hits: DataFrame) -> DataFrame:
        """The first MOST_HITS of the ranked list, held on the driver side as a small table."""
        rows = rerank.rerank(both_scores(hits).withColumn("qid", F.lit(0)), ["qid"]).orderBy("place").limit(MOST_HITS)
        return self._small(rows.drop("qid"))

    def _small(self, rows: DataFrame) -> DataFrame:
        return self.retriever.spark.createDataFrame(rows.collect(), rows.schema)

    def _context(self, kept: DataFrame, budget: int | None = None) -> tuple[str, list[dict]]:
        parts = self._small(context.pieces(kept, budget or self.budget))
        made = context.assembled(parts).first()
        return (made["context"].strip() if made else ""), [r.asDict() for r in context.sources(parts).orderBy("place").select("chunk_id", "url", "section").collect()]

    def _first(self, question: str, retry: bool) -> DataFrame:
        hits = self._small(self.retriever.search([question], FIRST_K, "initial"))
        if retry and self.recrawl and hits.isEmpty():
            self.recrawl()
            hits = self._small(self.retriever.search([question], FIRST_K, "initial-after-recrawl"))
        return hits

    def _fallback(self, kept: DataFrame | None, question: str, trace: dict) -> Result:
        rows = [] if kept is None else [r.asDict() for r in kept.orderBy("place").collect()]
        if not rows:
            return Result(NOTHING, False, [], trace)
        text, sources = self._context(kept.where("place <= 8"), min(self.budget, 8000))
        _, supported = self.answerer.answer_with_support(question, text)
        links = list({r["url"]: f"- {' > '.join(r['hierarchy'][:2])}: {r['url']}" if r["hierarchy"] else f"- {r['url']}" for r in reversed(rows) if r["url"]}.values())[::-1][:3]
        more = f" These pages may help:\n{chr(10).join(links)}" if supported and links else ""
        return Result(NOT_ENOUGH + more, False, sources, trace | {"answer_path": "fallback"})

    def _classic(self, question: str, memory: str, retry: bool) -> Result:
        searched = f"{memory}\n{question}".strip() if memory else question
        asked = f"{memory}\nUser: {question}".strip() if memory else question
        trace: dict = {"mode": "classic", "query": question}
        initial = self._first(searched, retry)
        trace["initial_result_count"] = initial.count()
        if not trace["initial_result_count"]:
            return self._fallback(None, question, trace)
        hits, tried, path = initial, [question], "answerable_initial"
        if self.expand:
            hits = hits.unionByName(self._small(self.retriever.expanded(question, initial, 10**7)))
        for hop in range(HOPS + 1):
            kept = self._kept(hits)
            text, sources = self._context(kept)
            trace["combined_result_count"] = kept.count()
            if self.answerer.sufficient(asked, text):
                return Result(self.answerer.answer(asked, text), True, sources, trace | {"answer_path": path})
            if hop == HOPS or not self.rewrite:
                break
            hints = [r["hint"] for r in rerank.hints(kept.withColumn("seq", F.col("place")).withColumn("qid", F.lit(0)), ["qid"]).orderBy("n").collect()]
            others = [q for q in self.answerer.rewrite(searched, hints) if q not in tried]
            if not others:
                break
            tried += others
            found = self._small(self.retriever.search(others, SECOND_K, "rewrite", at=(hop + 2) * 10**7))
            if self.expand and not found.isEmpty():
                found = found.unionByName(self._small(self.retriever.expanded(question, found, (hop + 2) * 10**7 + 10**6)))
            hits, path = hits.unionByName(found), f"answerable_hop_{hop + 1}"
        if self.best_effort and trace["combined_result_count"]:
            return Result(self.answerer.answer(asked, text), False, sources, trace | {"answer_path": "best_effort"})
        return self._fallback(kept, asked, trace)

    def _coverage(self, concepts: list[str], rows: DataFrame, order: str) -> dict[str, list[str]]:
        if not concepts:
            return {"covered": [], "missing": []}
        asked = self.retriever.spark.createDataFrame(list(enumerate(concepts)), "n int, concept string")
        placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)))
        got = {r["concept"]: r["covered"] for r in context.coverage(placed, asked).collect()}
        return {"covered": [c for c in concepts if got[c]], "missing": [c for c in concepts if not got[c]]}

    def _builder(self, question: str, memory: str, retry: bool) -> Result:
        route = self.planner.route(question, memory)
        trace: dict = {"mode": "builder", "route_mode": route["mode"], "query": question, "concepts": route["concepts"]}
        if route["mode"] == "transform_only":
            return self._transform(question, memory.strip(), trace)
        followup = route["mode"] == "retrieve_followup"
        searched = (route["standalone_query"] or question) if followup else question
        asked = f"{memory}\nUser: {question}".strip() if followup and memory else question
        hits = self._first(searched, retry)
        if hits.isEmpty():
            return self._fallback(None, question, trace | {"initial_result_count": 0})
        concepts = trace["concepts"] = route["concepts"] or self.planner.concepts(searched)
        for n in range(self.rounds):
            missing = self._coverage(concepts, hits, "seq")["missing"]
            if not missing:
                break
            rows = [r.asDict() for r in hits.orderBy("seq").limit(8).withColumn("id", rerank.record_id()).collect()]
            wanted = self.planner.followups(searched, missing, rows)
            if wanted["drop_chunk_ids"]:
                drop = self.retriever.spark.createDataFrame([(d,) for d in wanted["drop_chunk_ids"]], "_rid string")
                hits = corpus.without(hits.withColumn("_rid", rerank.record_id()), drop, "_rid").drop("_rid")
            if not wanted["queries"]:
                break
            hits = hits.unionByName(self._small(self.retriever.search(wanted["queries"], SECOND_K, "builder-followup", at=(n + 1) * 10**7)))
        kept = self._kept(hits)
        text, sources = self._context(kept)
        coverage = self._coverage(concepts, kept, "place")
        trace |= {"coverage": coverage, "combined_result_count": kept.count()}
        if self.answerer.sufficient(asked, text):
            return Result(self.answerer.answer(asked, text), True, sources, trace | {"answer_path": "answerable"})
        if self.best_effort and trace["combined_result_count"]:
            return self._read_more(asked, text, coverage, sources, trace | {"answer_path": "best_effort"})
        return self._fallback(kept, asked, trace)

    def _transform(self, question: str, prior: str, trace: dict) -> Result:
        if not prior:
            return Result(NO_MEMORY, False, [], trace)
        made = (self.answerer.llm.generate(f"Earlier turns:\n{prior}\n\nRework them as told, without new facts: {question}") or "").strip()
        if made:
            return Result(made, True, [], trace | {"answer_path": "transform_only"})
        return Result(NOT_MADE, False, [], trace | {"answer_path": "transform_only_failed"})

    def _read_more(self, question: str, text: str, coverage: dict, sources: list[dict], trace: dict) -> Result:
        """A best effort; links to what was used follow only an answer that the context supports."""
        if coverage["missing"]:
            question = f"{question}\n\nThe context may lack {', '.join(coverage['missing'])}; say so where it does, and add nothing."
        answer, supported = self.answerer.answer_with_support(question, text)
        urls = list(dict.fromkeys(s["url"] for s in sources if s["url"]))[:3]
        if supported and urls:
            answer = f"{answer.strip()}\n\nRead more:\n" + "\n".join(f"- {u}" for u in urls)
        return Result(answer.strip(), supported, sources, trace)
