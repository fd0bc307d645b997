"""A table of questions through the flows of answers.Pipeline at once: state by question as rows, each step for all that are still open.

Searches, ranking and contexts are joins and windows by question; models are called on the executors, a batch of rows at a time. What
a step leaves is stored, so a lost executor costs a step, and plans don't grow with hops. Nothing of the questions reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sillage.operators import bm25, context, index, postings, rerank
from sillage.plans.agents import Answerer, Planner
from sillage.plans.answers import EXPANSION_K, FIRST_K, HOPS, MOST_HITS, NO_MEMORY, NOT_ENOUGH, NOT_MADE, NOTHING, SECOND_K
from sillage.plans.ingest import Embedder, embedded
from sillage.sources.tables import stored

#: Rows that are known of a question when a model is asked what else to search for, and those that count towards its concepts.
SHOWN, COVERING = 8, 10
RESULT = "qid, question, answer, supported, path, sources, covered, missing, n_hits"
_SOURCE = "array<struct<chunk_id:string,url:string,section:string>>"
_TEXTS = T.ArrayType(T.StringType())


def _model(f: Callable, kind: T.DataType, *columns: Column | str) -> Column:
    """f of each row's columns, called in batches on the executors."""

    def run(*given: pd.Series) -> pd.Series | pd.DataFrame:
        made = [f(*row) for row in zip(*given, strict=True)]
        if isinstance(kind, T.StructType):
            return pd.DataFrame(made, columns=kind.names, index=given[0].index)
        return pd.Series(made, index=given[0].index, dtype=object)

    run.__annotations__ = {"given": pd.Series, "return": pd.DataFrame if isinstance(kind, T.StructType) else pd.Series}
    return F.pandas_udf(run, kind)(*columns)


@dataclass
class Batch:
    """Questions (qid, question, and memory if there is any) against records (id, url, chunk_index, text, hierarchy, parent, incoming_links, unit, _key).

    vectors puts a vector on each row of (sid, query); by default the embedder does. words is a stored inverted index of the records;
    without one their texts are scored where they lie. units (id, unit, _key) is the records' vectors where they are a table of their own, as
    answers.Retriever has it. Question ids are told apart as text; a null one is a question of its own, and rows
    that repeat an id are one question, the first by its text.
    """

    records: DataFrame
    embed: Callable[[str], list[float] | None] | Embedder | None
    answerer: Answerer
    planner: Planner = field(default_factory=Planner)
    mode: str = "builder"
    budget: int = 12_000
    rounds: int = 1
    best_effort: bool = True
    expand: bool = True
    rewrite: bool = True
    hybrid: bool = True
    threshold: float = 0.0
    words: postings.Index | None = None
    vectors: Callable[[DataFrame], DataFrame] | None = None
    digits: int = 9
    units: DataFrame | None = None

    def answers(self, questions: DataFrame) -> DataFrame:
        """qid, question, answer, supported, path, sources, covered, missing, n_hits: a row for each question."""
        memory = F.coalesce(F.col("memory"), F.lit("")) if "memory" in questions.columns else F.lit("")
        rows = questions.select(F.coalesce(F.col("qid").cast("string"), F.lit("")).alias("qid"), F.coalesce("question", F.lit("")).alias("question"), memory.alias("memory"))
        once = stored(rows.groupBy("qid").agg(F.min(F.struct("question", "memory")).alias("q")).select("qid", "q.question", "q.memory"), "questions")
        return (self._builder if self.mode == "builder" else self._classic)(once)

    # ---- searches -----------------------------------------------------------------------------------------------------------

    def search(self, asked: DataFrame, k: int, tag: str, boost: str | None = None, at: int = 0) -> DataFrame:
        """Hits of asked (qid, n, query), seq in order of n, of vectors before words, and of rank."""
        rows = stored(asked.where(F.trim("query") != "").select(F.concat_ws(":", F.col("n").cast("string"), "qid").alias("sid"), "query"), "asked")
        put = self.vectors or (lambda df: embedded(df, self.embed, "query", "vector"))
        vectors = put(rows).select(F.col("sid").alias("qid"), "vector")
        # What meets the records, by id, is questions times k rows, stored so that their size is known: few enough, and no text is shuffled.
        if self.units is None:
            near = index.search(self.records.where(F.col("unit").isNotNull()), vectors, k, self.threshold)
        else:
            hits = index.search(self.units.select("id", "_key", "unit").where(F.col("unit").isNotNull()), vectors, k, self.threshold)
            near = self.records.drop("_key", "unit").join(stored(hits.drop("unit"), "near"), "id")
        found = near.withColumns({"_origin": F.lit(tag), "_score_vec": F.col("score"), "_score_bm25": F.lit(None).cast("double"), "_part": F.lit(0)})
        if self.hybrid:
            given = rows.select(F.col("sid").alias("qid"), "query")
            best = self.words.search(given, max(8, k), self.digits) if self.words else bm25.best(self.records, given, max(8, k), digits=self.digits)
            by_words = self.records.join(stored(best.withColumnRenamed("score", "_score_bm25"), "words"), "id").withColumns({"_origin": F.lit(f"{tag}-bm25"), "_part": F.lit(1), "score": F.lit(None).cast("double"), "_score_vec": F.lit(None).cast("double")})
            found = found.unionByName(by_words, allowMissingColumns=True)
        n, qid = F.substring_index("qid", ":", 1).cast("long"), F.expr("substring(qid, instr(qid, ':') + 1)")
        named = found.withColumns({"_n": n, "qid": qid})
        order = Window.partitionBy("qid").orderBy("_n", "_part", "rank")
        out = named.withColumns({"seq": (F.row_number().over(order) + at).cast("long"), "_meta_rank": F.col("rank"), "_boost_reason": F.lit(boost).cast("string")})
        return stored(out.drop("rank", "_part", "_n", "unit", "embedding"), "hits")

    def expanded(self, seeds: DataFrame, questions: DataFrame, at: int) -> DataFrame:
        """Hits of questions made of each question's seeds: incoming anchors, and headings."""
        asked = seeds.join(questions.select("qid", F.col("question")), "qid")
        anchors = self.search(rerank.anchor_queries(asked, ["qid"]), EXPANSION_K, "graph-anchor", "anchor", at)
        return anchors.unionByName(self.search(rerank.section_queries(asked, ["qid"]), EXPANSION_K, "section", "section", at + 1_000_000))

    def kept(self, hits: DataFrame) -> DataFrame:
        """The first MOST_HITS of each question's ranked list. Both scores of a record meet on each of its hits before."""
        of = Window.partitionBy("qid", "_rid")
        both = hits.withColumn("_rid", rerank.record_id()).withColumns({c: F.max(c).over(of) for c in ("_score_vec", "_score_bm25")})
        both = both.withColumn("score", F.coalesce("score", "_score_vec", F.lit(0.0))).drop("_rid")
        first = Window.partitionBy("qid").orderBy("place")
        rows = rerank.rerank(both, ["qid"]).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= MOST_HITS).withColumn("place", F.col("_n")).drop("_n")
        return stored(rows, "kept")

    def contexts(self, kept: DataFrame, budget: int) -> DataFrame:
        """qid, context, sources of each question that has any."""
        parts = stored(context.pieces(kept, budget, ["qid"]), "pieces")
        told = F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id", "url", "section"))), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["url"].alias("url"), x["section"].alias("section")))
        sources = context.sources(parts, ["qid"]).groupBy("qid").agg(told.alias("sources"))
        return context.assembled(parts, ["qid"]).withColumn("context", F.trim("context")).join(sources, "qid", "left")

    # ---- what models say ----------------------------------------------------------------------------------------------------

    def _with_context(self, questions: DataFrame, kept: DataFrame, budget: int) -> DataFrame:
        counts = kept.groupBy("qid").agg(F.count("*").alias("n_hits"))
        met = questions.join(self.contexts(kept, budget), "qid", "left").join(counts, "qid", "left")
        return met.withColumns({"context": F.coalesce("context", F.lit("")), "sources": F.coalesce("sources", F.array().cast(_SOURCE)), "n_hits": F.coalesce("n_hits", F.lit(0))})

    def _result(self, rows: DataFrame, path: str | Column | None) -> DataFrame:
        none = F.array().cast("array<string>")
        for c in ("covered", "missing"):
            rows = rows if c in rows.columns else rows.withColumn(c, none)
        return rows.withColumn("path", (F.lit(path) if not isinstance(path, Column) else path).cast("string")).select(*RESULT.split(", "))

    def _nothing(self, questions: DataFrame) -> DataFrame:
        empty = {"answer": F.lit(NOTHING), "supported": F.lit(False), "sources": F.array().cast(_SOURCE), "n_hits": F.lit(0)}
        return self._result(questions.withColumns(empty), None)

    def _fallback(self, questions: DataFrame, kept: DataFrame) -> DataFrame:
        """Where nothing supports an answer: up to three pages to look at, if the best of the context supports one."""
        answerer = self.answerer
        few = Window.partitionBy("qid", "url").orderBy("place")
        line = F.concat(F.lit("- "), F.when(F.size("hierarchy") > 0, F.concat(F.array_join(F.slice("hierarchy", 1, 2), " > "), F.lit(": "))).otherwise(""), F.col("url"))
        links = kept.where("url <> ''").withColumn("_n", F.row_number().over(few)).where("_n = 1").select("qid", "place", line.alias("line"))
        links = links.groupBy("qid").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), 1, 3).alias("links"))
        met = self._with_context(questions, kept.where("place <= 8"), min(self.budget, 8000)).join(links, "qid", "left")
        supported = _model(lambda q, c: answerer.answer_with_support(q, c)[1], T.BooleanType(), "asked", "context")
        judged = stored(met.withColumn("_yes", supported), "judged")
        more = F.when(F.col("_yes") & (F.size(F.coalesce("links", F.array().cast("array<string>"))) > 0), F.concat(F.lit(" These pages may help:\n"), F.array_join("links", "\n"))).otherwise("")
        return self._result(judged.withColumns({"answer": F.concat(F.lit(NOT_ENOUGH), more), "supported": F.lit(False)}), "fallback")

    def _answered(self, rows: DataFrame, supported: bool, path: str) -> DataFrame:
        answerer = self.answerer
        return self._result(rows.withColumns({"answer": _model(answerer.answer, T.StringType(), "asked", "context"), "supported": F.lit(supported)}), path)

    # ---- flows --------------------------------------------------------------------------------------------------------------

    def _classic(self, questions: DataFrame) -> DataFrame:
        answerer = self.answerer
        has = F.col("memory") != ""
        told = questions.withColumns({"searched": F.when(has, F.trim(F.concat("memory", F.lit("\n"), "question"))).otherwise(F.col("question")), "asked": F.when(has, F.trim(F.concat("memory", F.lit("\nUser: "), "question"))).otherwise(F.col("question"))})
        initial = self.search(told.select("qid", F.lit(0).alias("n"), F.col("searched").alias("query")), FIRST_K, "initial")
        done = [self._nothing(told.join(initial.select("qid").distinct(), "qid", "left_anti"))]
        hits, open_ = initial, stored(told.join(initial.select("qid").distinct(), "qid", "left_semi"), "open")
        tried = open_.select("qid", F.col("question").alias("query"))
        if self.expand:
            hits = hits.unionByName(self.expanded(initial, open_, 10**7))
        for hop in range(HOPS + 1):
            kept = self.kept(hits)
            met = self._with_context(open_, kept, self.budget)
            judged = stored(met.withColumn("_yes", _model(answerer.sufficient, T.BooleanType(), "asked", "context")), "judged")
            done.append(stored(self._answered(judged.where("_yes"), True, "answerable_initial" if hop == 0 else f"answerable_hop_{hop}"), "answers"))
            left = judged.where("not _yes").drop("_yes")
            others = None
            if hop < HOPS and self.rewrite:
                hints = rerank.hints(kept.withColumn("seq", F.col("place")), ["qid"]).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "hint"))), lambda x: x["hint"]).alias("hints"))
                asked = left.join(hints, "qid", "left").withColumn("hints", F.coalesce("hints", F.array().cast("array<string>")))
                made = asked.withColumn("others", _model(lambda q, h: answerer.rewrite(q, list(h)), _TEXTS, "searched", "hints"))
                others = stored(made.select("qid", F.posexplode("others").alias("n", "query")).join(tried, ["qid", "query"], "left_anti"), "others")
            moved = left.limit(0).select("qid") if others is None else others.select("qid").distinct()
            stuck = left.join(moved, "qid", "left_anti")
            done.append(stored(self._ended(stuck, kept), "answers"))
            if others is None or others.isEmpty():
                break
            open_ = stored(left.join(moved, "qid", "left_semi").select(*told.columns), "open")
            tried = stored(tried.union(others.select("qid", "query")), "tried")
            found = self.search(others, SECOND_K, "rewrite", at=(hop + 2) * 10**7)
            hits = stored(hits.unionByName(found).join(moved, "qid", "left_semi"), "hits")
            if self.expand:
                hits = hits.unionByName(self.expanded(found, open_, (hop + 2) * 10**7 + 10**6))
        return reduce(DataFrame.unionByName, done)

    def _ended(self, rows: DataFrame, kept: DataFrame) -> DataFrame:
        """Questions that no search helps any more: a best effort where it is wanted and there are hits, else the fallback."""
        best = rows.where(F.lit(self.best_effort) & (F.col("n_hits") > 0))
        rest = rows.where(~(F.lit(self.best_effort) & (F.col("n_hits") > 0))).drop("context", "sources", "n_hits")
        return self._answered(best, False, "best_effort").unionByName(self._fallback(rest, kept))

    def _covered(self, rows: DataFrame, hits: DataFrame, order: str) -> DataFrame:
        """rows (qid, concepts) with covered and missing: concepts that the first COVERING hits' texts hold, as they are written, in lower case."""
        first = hits.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(order))).where(F.col("_n") <= COVERING)
        text = first.groupBy("qid").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"]), "\n")).alias("_text"))
        met = rows.join(text, "qid", "left").withColumn("_text", F.coalesce("_text", F.lit("")))
        return met.withColumns({"covered": F.filter("concepts", lambda c: F.col("_text").contains(c)), "missing": F.filter("concepts", lambda c: ~F.col("_text").contains(c))}).drop("_text")

    def _builder(self, questions: DataFrame) -> DataFrame:
        answerer, planner = self.answerer, self.planner
        route = T.StructType([T.StructField("mode", T.StringType()), T.StructField("standalone_query", T.StringType()), T.StructField("concepts", _TEXTS)])
        routed = stored(questions.withColumn("r", _model(lambda q, m: tuple(planner.route(q, m)[k] for k in route.names), route, "question", "memory")).select("*", "r.*").drop("r"), "routed")
        done = [self._transformed(routed.where("mode = 'transform_only'"))]
        later = F.col("mode") == "retrieve_followup"
        told = routed.where("mode <> 'transform_only'").withColumns({
            "searched": F.when(later, F.coalesce(F.nullif("standalone_query", F.lit("")), "question")).otherwise(F.col("question")),
            "asked": F.when(later & (F.col("memory") != ""), F.trim(F.concat("memory", F.lit("\nUser: "), "question"))).otherwise(F.col("question")),
        })
        hits = self.search(told.select("qid", F.lit(0).alias("n"), F.col("searched").alias("query")), FIRST_K, "initial")
        some = hits.select("qid").distinct()
        done.append(self._nothing(told.join(some, "qid", "left_anti")))
        named = _model(lambda q, c: list(c) if c is not None and len(c) else planner.concepts(q), _TEXTS, "searched", "concepts")
        open_ = stored(told.join(some, "qid", "left_semi").withColumn("concepts", named), "open")
        for n in range(self.rounds):
            lacking = self._covered(open_, hits, "seq").where(F.size("missing") > 0)
            shown = hits.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("seq"))).where(F.col("_n") <= SHOWN).withColumn("_rid", rerank.record_id())
            shown = shown.groupBy("qid").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col("_rid").alias("id"), "url", F.substring("text", 1, 1000).alias("text")))), lambda x: F.struct(x["id"].alias("id"), x["url"].alias("url"), x["text"].alias("text")))).alias("shown"))
            wanted = T.StructType([T.StructField("queries", _TEXTS), T.StructField("drop_chunk_ids", _TEXTS)])
            got = stored(lacking.join(shown, "qid").select("qid", _model(lambda q, m, h: _followups(planner, q, m, h), wanted, "searched", "missing", "shown").alias("w")).select("qid", "w.*"), "followups")
            dropped = got.select("qid", F.explode("drop_chunk_ids").alias("_rid")).distinct()
            hits = stored(hits.withColumn("_rid", rerank.record_id()).join(dropped, ["qid", "_rid"], "left_anti").drop("_rid"), "hits")
            more = stored(got.select("qid", F.posexplode("queries").alias("n", "query")), "more")
            if more.isEmpty():
                break
            hits = hits.unionByName(self.search(more, SECOND_K, "builder-followup", at=(n + 1) * 10**7))
        kept = self.kept(hits)
        met = self._covered(self._with_context(open_, kept, self.budget), kept, "place")
        judged = stored(met.withColumn("_yes", _model(answerer.sufficient, T.BooleanType(), "asked", "context")), "judged")
        done.append(self._answered(judged.where("_yes"), True, "answerable"))
        best = F.lit(self.best_effort) & (F.col("n_hits") > 0)
        done.append(self._read_more(judged.where(~F.col("_yes") & best)))
        done.append(self._fallback(judged.where(~F.col("_yes") & ~best).drop("context", "sources", "n_hits"), kept))
        return reduce(DataFrame.unionByName, done)

    def _transformed(self, rows: DataFrame) -> DataFrame:
        llm = self.answerer.llm

        def rework(question: str, memory: str) -> str:
            prior = memory.strip()
            return (llm.generate(f"Earlier turns:\n{prior}\n\nRework them as told, without new facts: {question}") or "").strip() if prior else ""

        made = stored(rows.withColumn("_made", _model(rework, T.StringType(), "question", "memory")), "reworked")
        none = F.trim("memory") == ""
        fine = ~none & (F.col("_made") != "")
        answer = F.when(none, F.lit(NO_MEMORY)).when(fine, F.col("_made")).otherwise(F.lit(NOT_MADE))
        path = F.when(fine, F.lit("transform_only")).when(~none, F.lit("transform_only_failed"))
        return self._result(made.withColumns({"answer": answer, "supported": fine, "sources": F.array().cast(_SOURCE), "n_hits": F.lit(0)}), path)

    def _read_more(self, rows: DataFrame) -> DataFrame:
        """A best effort; links to what was used follow only an answer that the context supports."""
        answerer = self.answerer
        both = T.StructType([T.StructField("answer", T.StringType()), T.StructField("yes", T.BooleanType())])
        lacking = F.concat("asked", F.lit("\n\nThe context may lack "), F.array_join("missing", ", "), F.lit("; say so where it does, and add nothing."))
        made = stored(rows.withColumn("_r", _model(lambda q, c: answerer.answer_with_support(q, c), both, F.when(F.size("missing") > 0, lacking).otherwise(F.col("asked")), "context")), "efforts")
        urls = F.slice(F.array_distinct(F.filter(F.transform("sources", lambda s: s["url"]), lambda u: u != "")), 1, 3)
        links = F.when(F.col("_r.yes") & (F.size(urls) > 0), F.concat(F.lit("\n\nRead more:\n"), F.array_join(F.transform(urls, lambda u: F.concat(F.lit("- "), u)), "\n"))).otherwise("")
        return self._result(made.withColumns({"answer": F.trim(F.concat(F.trim("_r.answer"), links)), "supported": F.col("_r.yes")}), "best_effort")


def _followups(planner: Planner, question: str, missing: list[str], shown: str) -> tuple[list[str], list[str]]:
    import json

    got = planner.followups(question, list(missing), json.loads(shown))
    return got["queries"], got["drop_chunk_ids"]
