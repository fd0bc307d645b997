"""A project at work: settings, index and models put together; usage is written whatever happens."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sillage.functions import text as T
from sillage.operators import context, postings
from sillage.plans.agents import Answerer, Llm, Planner, Summariser, system_prompt
from sillage.plans.answers import Pipeline, Result, Retriever
from sillage.plans.config import Config
from sillage.plans.crawling import Fetch, crawler
from sillage.plans.ingest import Embedder, Ingest
from sillage.session import ship
from sillage.sources import tables


@dataclass
class Usage:
    """Tokens of calls, kept on the driver until flush() appends them to a folder of JSON lines; without a folder they are forgotten."""

    folder: str = ""
    pending: list[dict] = field(default_factory=list)

    def embedding(self, model: str, tokens: int, texts: int = 1) -> None:
        self._add("embedding", model, prompt_tokens=tokens, total_tokens=tokens, text_count=texts)

    def chat(self, model: str, prompt: int, completion: int) -> None:
        self._add("chat", model, prompt_tokens=prompt, completion_tokens=completion, total_tokens=prompt + completion)

    def _add(self, kind: str, model: str, **counts: int) -> None:
        self.pending.append({"type": kind, "model": model, "timestamp": tables.now(), **counts})

    def flush(self, spark: SparkSession) -> int:
        events, self.pending = self.pending, []
        if events and self.folder:
            tables.append_usage(spark.createDataFrame(events, tables.USAGE).coalesce(1), self.folder)
        return len(events)


@dataclass
class Runtime:
    """run_ingest() and query_result() of a project. The index is loaded when it is first asked for, and again after an ingest."""

    spark: SparkSession
    config: Config
    embed: Callable[[str], list[float] | None]
    llm: Llm | None
    ingest: Ingest
    usage: Usage
    pipeline: Pipeline | None = None

    def run_ingest(self, mode: str = "both", force: bool = False) -> dict:
        try:
            self.pipeline = None
            return self.ingest.run(mode, force)
        finally:
            self.usage.flush(self.spark)

    def query_result(self, question: str, memory: str = "", retry_on_empty: bool = False) -> Result:
        if self.llm is None:
            raise RuntimeError("no chat model: questions cannot be answered")
        try:
            if self.pipeline is None:
                self.pipeline = self._pipeline()
            got = self.pipeline.query(question, memory, retry_on_empty)
            if self.config.query_debug:
                stamp = tables.now().replace(":", "-")
                tables.put_json(self.spark, f"{self.ingest.folder}/debug/queries/{stamp}.json", {"question": question, "memory": memory, "supported": got.supported, "sources": got.sources, "trace": got.trace})
            return got
        finally:
            self.usage.flush(self.spark)

    def query_chat(self, chats: tables.Chats, name: str, question: str, retry_on_empty: bool = False) -> Result:
        """A question within a chat: its last exchanges, as many as leave_last_k says, are the memory; question and answer are added to it."""
        chat = chats.load(name)
        told = chat["messages"] + [{"role": "user", "content": question}]
        rows = [(0, k, m.get("role", "user"), m.get("content", "")) for k, m in enumerate(told)]
        turns = self.spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
        found = context.memory(turns, last_k=self.config.leave_last_k, reset_at=chat["settings"]["memory_reset_at"]).first()
        got = self.query_result(question, found["memory"] if found else "", retry_on_empty)
        chats.save(name, chat | {"messages": [*told, {"role": "assistant", "content": got.answer}]})
        return got

    def _pipeline(self) -> Pipeline:
        c = self.config
        records = tables.load_index(self.spark, f"{self.ingest.folder}/index")
        words = f"{self.ingest.folder}/words"
        stored = postings.Index(self.spark, words) if tables.exists(self.spark, f"{words}/settings.json") else None
        retriever = Retriever(self.spark, records, self.embed, threshold=c.score_threshold, words=stored)
        system = system_prompt(c.answering_mode, c.system_prompt, c.system_prompt_custom_override, c.allow_generated_examples)
        window = self.spark.range(1).select(T.budget_chars(T.window_tokens(F.lit(c.chat_model)), F.lit(12_000), F.lit(c.chat_model))).first()[0]
        return Pipeline(retriever, Answerer(self.llm, system), Planner(self.llm), c.retrieval_mode, int(window), c.builder_max_rounds)


def build(
    spark: SparkSession, config: Config, embed: Callable[[str], list[float] | None] | Embedder, llm: Llm | None = None, crawl: Callable[[str], None] | None = None, summarise: Llm | None = None, usage_folder: str = "",
    models: Callable[[str], Llm] | None = None, fetch: Fetch | None = None,
) -> Runtime:
    """Everything of a project, from checked settings and injected models.

    models gives a chat model by its name: chat_model answers unless llm is given, and summary_model, if the settings name one, summarises
    unless summarise is given. fetch crawls by the settings' policy unless crawl is given.
    """
    config.check()
    ship(spark)
    if models is not None:
        llm = llm or models(config.chat_model)
        summarise = summarise or (models(config.summary_model) if config.summary_model else None)
    if crawl is None and fetch is not None:
        crawl = crawler(spark, config, fetch)
    work = Ingest(spark, config.output_dir, embed, crawl, Summariser(summarise) if summarise else None, debug=config.debug, cache=config.embedding_cache_dir)
    return Runtime(spark, config, embed, llm, work, Usage(usage_folder))
