"""Settings, agents, flows with scripted models, ingest, projects, crawling and streaming."""

from __future__ import annotations

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sillage.operators import crawl, index
from sillage.plans import agents, config, crawling, ingest, runtime, service
from sillage.plans.answers import NOT_ENOUGH, NOTHING, Pipeline, Retriever
from sillage.queries import toy_vector
from sillage.sources import tables, web
from sillage.streaming import ingest as stream

# Workers can't import this file: what it defines goes to them as it is.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GOOD = {"start_url": "https://x", "output_dir": "o", "index_dir": "i"}


@pytest.mark.parametrize(
    ("change", "names"),
    [
        ({}, []), ({"start_url": " "}, ["start_url"]), ({"start_url": "ftp://x"}, ["start_url"]), ({"index_dir": None}, ["index_dir"]), ({"embedding_model": "openai:"}, ["embedding_model"]), ({"embedding_model": "a b"}, ["embedding_model"]),
        ({"embedding_model": "Default"}, []), ({"answering_mode": "x"}, ["answering_mode"]), ({"retrieval_mode": "x", "max_depth": -2}, ["retrieval_mode", "max_depth"]), ({"max_depth": -1}, []), ({"max_depth": True}, ["max_depth"]),
        ({"score_threshold": 1.1}, ["score_threshold"]), ({"score_threshold": False}, ["score_threshold"]), ({"score_threshold": 0}, []), ({"builder_max_rounds": -1}, ["builder_max_rounds"]), ({"rate_limit_delay": -0.1}, ["rate_limit_delay"]), ({"rate_limit_delay": 1}, []),
    ],
)
def test_settings(change, names):
    found = config.violations(GOOD | change)
    assert len(found) == len(names) and all(f"'{n}'" in f for n, f in zip(names, found, strict=True))


def test_settings_defaults():
    c = config.Config.of({**GOOD, "embedding_model": " default ", "seed_urls": ("a",), "unknown": 1, "results_file": ""})
    assert (c.embedding_model, c.seed_urls, c.results_file) == (config.EMBEDDING, ["a"], "results.jsonl") and "index_dir" not in c.stored()
    with pytest.raises(ValueError, match="(?s)start_url.*max_depth"):
        config.Config.of({**GOOD, "start_url": "", "max_depth": -5})


def test_prompts():
    assert agents.system_prompt("unknown") == agents.MODES["technical_grounded"]
    assert agents.system_prompt("strict_grounded", " mine ", True) == "mine" and agents.system_prompt("strict_grounded", " ", True) == agents.MODES["strict_grounded"]
    assert "true" in agents.system_prompt("assisted_examples", examples=True)
    with pytest.raises(ValueError, match="question"):
        agents.Answerer(None, template="{context}")


class Script:
    """A model that replies by what the prompt holds."""

    def __init__(self, *replies):
        self.replies, self.asked = replies, []

    def generate(self, prompt):
        self.asked.append(prompt)
        for part, reply in self.replies:
            if part in prompt:
                return reply.pop(0) if isinstance(reply, list) else reply
        return ""


def test_planner():
    assert agents.Planner().route("q") == {"mode": "retrieve_new", "standalone_query": "", "concepts": []}
    p = agents.Planner(Script(("Choose a mode", 'ok {"mode": "RETRIEVE_FOLLOWUP", "standalone_query": " s ", "concepts": ["Ab", "Abc", "abc ", 3]}'), ("Name what", "no json"), ("what else", '{"queries": ["a", " ", 1, "b", "c", "d", "e"], "drop_chunk_ids": ["x"]}')))
    assert p.route("q", "m") == {"mode": "retrieve_followup", "standalone_query": "s", "concepts": ["abc"]}
    assert p.concepts("q") == [] and p.followups("q", ["m"], []) == {"queries": ["a", "b", "c", "d"], "drop_chunk_ids": ["x"]}


def test_answerer():
    a = agents.Answerer(Script(("one JSON object: {", ['{"answer": "A", "supported": "y"}', "plain"]), ("YES or NO", "yes"), ("Better searches", ["SAME", "- a\n- b", "c"]), ("Context", "N")))
    assert a.answer("q", " ") == agents.APOLOGY and a.answer("q", "c") == agents.APOLOGY
    assert a.answer_with_support("q", "c") == ("A", True) and a.answer_with_support("q", "c") == (agents.APOLOGY, True)
    assert (a.rewrite("q", []), a.rewrite("q", []), a.rewrite("q", [])) == ([], ["a", "b"], ["c"])


RECORDS = [
    ("intro", "http://x/intro", "alpha introduction to things", ["Intro"], [1.0, 0.0, 0.0], "Start here"),
    ("retries", "http://x/retries", "beta retries with backoff", ["Guide", "Retries"], [0.0, 1.0, 0.0], None),
    ("limits", "http://x/limits?utm_source=a", "gamma limits of requests", ["Guide"], [0.0, 0.0, 1.0], None),
    ("limits2", "http://x/limits", "gamma limits once more", ["Guide"], [0.1, 0.0, 0.9], None),
]
VECTORS = {"intro": [1.0, 0.0, 0.0], "retry": [0.0, 1.0, 0.0], "limit": [0.0, 0.0, 1.0]}


@pytest.fixture(scope="module")
def records(spark):
    rows = [(i, u, 0, t, h, [float(x) for x in v], i, [("p", a, "c")] if a else []) for i, u, t, h, v, a in RECORDS]
    df = spark.createDataFrame(rows, "id string, url string, chunk_index int, text string, hierarchy array<string>, embedding array<double>, parent string, incoming_links array<struct<from_page:string,anchor_text:string,source_chunk:string>>")
    return index.added(df).cache()


def embed(q):
    return next((v for k, v in VECTORS.items() if k in q), None)


def pipeline(spark, records, llm, threshold=0.5, **more):
    return Pipeline(Retriever(spark, records, embed, hybrid=more.pop("hybrid", False), threshold=threshold), agents.Answerer(llm), agents.Planner(more.pop("planner", None)), **more)


def test_classic_answers_at_once(spark, records):
    got = pipeline(spark, records, Script(("YES or NO", "YES"), ("Context", "the answer")), mode="classic", expand=False).query("intro?")
    assert (got.answer, got.supported, got.trace["answer_path"], [s["chunk_id"] for s in got.sources]) == ("the answer", True, "answerable_initial", ["intro"])


def test_classic_rewrites(spark, records):
    got = pipeline(spark, records, Script(("YES or NO", ["NO", "YES"]), ("Better searches", "retry"), ("Context", "found")), mode="classic", expand=False).query("intro?")
    assert got.supported and got.trace["answer_path"] == "answerable_hop_1" and [s["chunk_id"] for s in got.sources] == ["intro", "retries"]


def test_classic_expands_and_falls_back(spark, records):
    llm = Script(("YES or NO", "NO"), ("Better searches", "SAME"), ("one JSON object: {", '{"answer": "a", "supported": "Y"}'))
    got = pipeline(spark, records, llm, mode="classic", expand=True, best_effort=False, hybrid=True).query("intro?")
    assert not got.supported and got.answer.startswith(NOT_ENOUGH) and "http://x/intro" in got.answer
    assert pipeline(spark, records, llm, mode="classic", threshold=0.999).query("unknown words").answer == NOTHING


def test_duplicate_urls_collapse(spark, records):
    got = pipeline(spark, records, Script(("YES or NO", "YES"), ("Context", "x")), mode="classic", expand=False, threshold=0.1).query("limit")
    assert [s["chunk_id"] for s in got.sources] == ["limits"]


def test_records_without_vectors_are_found_by_words(spark, records):
    bare = index.added(records.drop("unit", "_key").unionByName(spark.createDataFrame([("bare", "http://x/bare", "bare")], "id string, url string, parent string").withColumn("text", F.lit("delta zebra words")), allowMissingColumns=True))
    hits = Retriever(spark, bare, lambda q: [1.0, 0.0, 0.0]).search(["zebra"], 9, "t").collect()
    assert [(r["id"], r["_score_vec"]) for r in hits if r["_score_bm25"] is not None] == [("bare", None)]
    assert len(hits) == 5 and all(r["_score_vec"] is not None for r in hits if r["id"] != "bare")


def test_answer_flow_searches_all_documents(spark, monkeypatch):
    sf = "/root/testdata/sf0.1"
    from sillage.plans import answers
    from sillage.queries import QUERIES

    seen = []
    given = answers.Pipeline.query
    monkeypatch.setattr(answers.Pipeline, "query", lambda self, *a, **k: (seen.append(self.retriever.records.count()), given(self, *a, **k))[1])
    assert QUERIES["answer_flow"](spark, sf).count() == 1
    assert seen == [spark.read.parquet(f"{sf}/documents.parquet").count()]


def test_builder(spark, records):
    planner = Script(("Choose a mode", '{"mode": "retrieve_new", "concepts": ["alpha", "retries"]}'), ("what else", '{"queries": ["retry"], "drop_chunk_ids": []}'))
    got = pipeline(spark, records, Script(("YES or NO", "NO"), ("one JSON object: {", '{"answer": "a", "supported": "Y"}')), planner=planner).query("intro")
    assert got.supported and got.answer == "a\n\nRead more:\n- http://x/intro\n- http://x/retries" and got.trace["coverage"] == {"covered": ["alpha", "retries"], "missing": []}
    planner = Script(("Choose a mode", '{"mode": "retrieve_new", "concepts": ["retries"]}'), ("what else", '{"queries": ["retry"], "drop_chunk_ids": ["intro"]}'))
    got = pipeline(spark, records, Script(("YES or NO", "YES"), ("Context", "z")), planner=planner).query("intro")
    assert [s["chunk_id"] for s in got.sources] == ["retries"]


def test_builder_transforms(spark, records):
    planner = Script(("Choose a mode", '{"mode": "transform_only"}'))
    assert pipeline(spark, records, Script(("Rework", "shorter")), planner=planner).query("shorten", "User: x").answer == "shorter"
    assert not pipeline(spark, records, Script(), planner=planner).query("shorten").supported


def test_ingest(spark, tmp_path):
    folder = str(tmp_path)
    run = ingest.Ingest(spark, folder, toy_vector, disallowed=lambda: {"http://n": ["domain"]})
    assert run.run()["empty_results"] and json.loads((tmp_path / "debug/disallowed_report.json").read_text()) == {"http://n": ["domain"]}
    assert not (tmp_path / "checkpoint.json").exists()
    with pytest.raises(ValueError, match="mode"):
        run.run("other")
    lines = [json.dumps({"url": "http://a", "html": "<h1>A</h1><p>one two three four five</p>", "crawled_at": "t"}), "broken{", json.dumps({"url": "http://b", "html": ""}), json.dumps({"html": "x"}), json.dumps({"url": "http://c", "html": "<p>a b c d e f", "crawled_at": "t"})]
    (tmp_path / "results.jsonl").write_text("\n".join(lines))
    (tmp_path / "graph.json").write_text(json.dumps({"http://c": [{"target": "http://a", "anchor_text": "to a", "source_chunk": "chunk_0"}, {"target": "", "anchor_text": "", "source_chunk": ""}]}))
    assert tables.bad_lines(spark, f"{folder}/results.jsonl").count() == 1
    calls = []
    run.crawl = calls.append
    assert run.run()["indexed"] and not calls
    assert json.loads((tmp_path / "checkpoint.json").read_text())["indexed_url_count"] == 2
    got = {r["url"]: r for r in tables.load_index(spark, f"{folder}/index").collect()}
    assert got["http://a"]["incoming_links"][0]["anchor_text"] == "to a" and got["http://a"]["crawled_at"] == "t" and got["http://a"]["hierarchy"] == ["A"] and got["http://a"]["id"] == "http://a#chunk_0__seg_0"
    with pytest.raises(RuntimeError, match="version"):
        tables.load_index(spark, f"{folder}/index", version=99)
    assert ingest.status(spark, folder) == {"results_ready": True, "index_ready": True, "query_ready": True, "blockers": []}
    (tmp_path / "more.jsonl").write_text(json.dumps({"url": "http://d", "chunk_index": 3, "text": "some text"}) + "\n" + json.dumps({"id": "x", "text": " "}))
    assert [r["id"] for r in ingest.embed_file(spark, f"{folder}/more.jsonl", toy_vector).collect()] == ["http://d#chunk_3__seg_0"]


def test_failing_embedder_drops_segments(spark):
    def fails(text):
        if "bad" in text:
            raise RuntimeError(text)
        return [1.0]

    rows = spark.createDataFrame([("good",), ("bad",), (" ",), (None,)], "text string")
    assert [r["embedding"] for r in ingest.embedded(rows, fails).collect()] == [[1.0], None, None, None]


def test_projects_and_chats(tmp_path, spark):
    projects = tables.Projects(str(tmp_path))
    projects.save("a/b", GOOD)
    assert projects.names() == ["b"] and projects.load("b")["start_url"] == "https://x" and "i" != projects.load("b")["index_dir"]
    for bad in ("", "..", ".x", "a/"):
        with pytest.raises(ValueError, match="name"):
            projects.folder(bad)
    projects.delete("b")
    assert projects.names() == []
    chats = tables.Chats(str(tmp_path / "chats"))
    chats.save("one", [["hi", "yo"], ["odd one out"], "no pair"])
    assert chats.load("one")["messages"] == [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}] and chats.load("none")["messages"] == []
    assert chats.load("one")["settings"] == {"score_threshold": 0.5, "memory_reset_at": 0}
    for bad in ("", " ", "..", ".x", "../config", "..\\config", "a/b", "/etc/x", None):
        for touch in (chats.load, chats.delete, lambda n: chats.save(n, {}), lambda n: chats.rename("one", n), lambda n: chats.rename(n, "two")):
            with pytest.raises(ValueError, match="chat name"):
                touch(bad)
    assert chats.names() == ["one"] and sorted(p.name for p in tmp_path.iterdir()) == ["chats"]
    chats.rename("absent", "two")
    chats.rename("one", "two")
    assert chats.names() == ["two"] and chats.turns(spark, "two").count() == 2


def test_policy(spark):
    p = crawl.Policy(allowed_domains=["Example.com"], blocked_domains=["bad.example.com"], allow_subdomains=True, blocked_paths=["/private"])
    urls = ["http://www.example.com/a", "http://sub.example.com/", "http://bad.example.com/", "http://other.com/", "http://example.com/private/x", "http://example.com/?SID=1", "ftp://example.com/", "", "http://notexample.com/"]
    got = {r["url"]: r["reason"] for r in spark.createDataFrame([(u,) for u in urls], "url string").select("url", crawl.reason(F.col("url"), p).alias("reason")).collect()}
    assert list(got.values()) == [None, None, "domain", "domain", "path", "session or length", "scheme", "empty", "domain"]
    assert crawl.allowed_domains("https://www.a.com/x", [], True) == ["a.com", "www.a.com"] and crawl.allowed_domains("https://a.com", [], False) == []


def test_crawl(spark):
    pages = spark.createDataFrame([(f"http://a/{k}", f"<p>{t}", t) for k, t in enumerate(["zero", "one", "one", "three", "four"])], "url string, html string, text string")
    links = spark.createDataFrame([("http://a/0", "http://a/1"), ("http://a/0", "http://a/2"), ("http://a/1", "http://a/0"), ("http://a/2", "http://a/3"), ("http://a/1", "http://a/4"), ("http://a/0", "ftp://a/9")], "from_url string, target string")
    depth = lambda **k: {r["url"][-1]: r["depth"] for r in crawl.crawl(pages, links, [" http://a/0 ", "http://a/0"], crawl.Policy(), **k).collect()}
    assert depth() == {"0": 0, "1": 1, "2": 1, "4": 2}
    assert depth(deduplicate=False) == {"0": 0, "1": 1, "2": 1, "3": 2, "4": 2}
    assert depth(entire_site=False, max_depth=1) == {"0": 0, "1": 1, "2": 1} and depth(entire_site=False, seeds_expand=False) == {"0": 0}


def test_fetching(spark):
    waits = []
    seen = iter([(503, "", None, ""), (200, "text/html", None, "ok")])
    assert web.fetched("http://a", lambda u: next(seen), web.Manners(sleep=waits.append)) == ("ok", "text/html", None) and waits == [0.5]
    assert web.fetched("http://a", lambda u: (404, "", None, ""), web.Manners(sleep=waits.append))[2] == "status 404" and len(waits) == 1
    assert web.fetched("http://a", lambda u: (200, "t", 10, "x"), web.Manners(most_bytes=5))[2] == "too long"
    urls = spark.createDataFrame([("http://a/1",), ("http://b/2",)], "url string")
    assert {r["html"] for r in web.fetch_all(urls, lambda u: (200, "text/html", None, u), web.Manners(pause=0)).collect()} == {"http://a/1", "http://b/2"}


def test_hosts_take_turns():
    """A hundred hosts by ten URLs, in any order: about ten pauses, each host paced."""
    clock, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        clock[0] += seconds

    urls = [f"http://h{h}/{k}" for h in range(100) for k in range(10)]
    asked: dict[str, list[float]] = {}
    order = []
    for n in web.paced(urls, web.Manners(pause=0.2, sleep=sleep), lambda: clock[0]):
        order.append(n)
        asked.setdefault(urls[n].split("/")[2], []).append(clock[0])
    assert sorted(order) == list(range(1000)) and sum(slept) < 0.2 * 10
    assert all(b - a >= 0.2 - 1e-9 for times in asked.values() for a, b in zip(times, times[1:], strict=False))
    assert [urls[n] for n in order if "//h7/" in urls[n]] == [f"http://h7/{k}" for k in range(10)]


def test_failing_hosts_and_urls_are_left_alone(spark, tmp_path):
    def broken(url):
        if url.startswith("http://bad"):
            raise OSError("no route")
        n = int(url.rsplit("/", 1)[1] or 0) if url[-1].isdigit() else 0
        return (404, "", None, "") if url.endswith("robots.txt") else (200, "text/html", None, f"<p>{url}</p>" + "".join(f"<a href=http://bad/{2 * n + k}>x</a>" for k in range(2)) + f"<a href=/{n + 1}>next</a>" * (n < 4))

    fetch = lambda urls: web.fetch_all(urls, broken, web.Manners(retries=0, pause=0))
    made = crawling.live(spark, ["http://s/0"], fetch, crawl.Policy(allowed_domains=["s", "bad"]), most_failures=3)
    got = {r["url"]: r["reason"] for r in made.refused.collect()}
    assert sum(v == "error: OSError" for v in got.values()) == 4 and sum(v == "blacklist" for v in got.values()) == 6
    c = config.Config.of({"start_url": "http://s/0", "allowed_domains": ["s", "bad"], "rate_limit_delay": 0}, output_dir=str(tmp_path), index_dir=str(tmp_path / "i"))
    asked = []
    counted = lambda urls: (asked.append({r["url"] for r in urls.collect()}), fetch(urls))[1]
    crawling.crawler(spark, c, counted)(f"{tmp_path}/results.jsonl")
    first = {u for a in asked for u in a if u.startswith("http://bad") and "robots" not in u}
    asked.clear()
    crawling.crawler(spark, c, counted)(f"{tmp_path}/results.jsonl")
    assert first and not {u for a in asked for u in a if u.startswith("http://bad") and "robots" not in u}
    assert spark.read.json(f"{tmp_path}/disallowed.json").where("url = 'http://bad/0'").first() is not None


def test_index_changes(spark, records):
    with pytest.raises(KeyError):
        index.require(records, "nothing")
    with pytest.raises(ValueError, match="unknown"):
        index.create("tree")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "qid int, vector array<double>")
    assert index.search(records, q, 0).count() == 0 and [r["id"] for r in index.search(records, q, 2).orderBy("rank").collect()] == ["intro", "limits2"]


def test_search_by_blocks_is_the_same(spark, monkeypatch):
    """Products in tasks and pairs by Spark: equal hits, ties by key, whatever has no vector or another length apart."""
    import random

    rng = random.Random(6)
    rows = [(f"k{n:03}", [float(rng.randint(-2, 2)) for _ in range(4)], n) for n in range(300)] + [("none", None, 1), ("short", [1.0, 2.0], 2)]
    made = index.added(spark.createDataFrame(rows, "id string, embedding array<double>, n int").repartition(5))
    asked = spark.createDataFrame([(n, [float(rng.randint(-2, 2)) for _ in range(4)]) for n in range(9)] + [(50, None), (51, [3.0, 1.0])], "qid int, vector array<double>")
    told = lambda: sorted((r["qid"], r["rank"], r["id"], r["n"], round(r["score"], 9)) for r in index.search(made, asked, 7, 0.1).collect())
    first = told()
    assert len({q for q, *_ in first}) >= 9 and (51, 0, "short", 2) == first[-1][:4]
    monkeypatch.setattr(index, "MOST_ASKED", -1)
    assert [r for r in told() if r[0] != 51 and r[2] != "short"] == [r for r in first if r[0] != 51]


def test_streams(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    page = {"url": "http://a", "html": "<p>one two three four five", "crawled_at": "2024-01-01T00:00:00Z", "length": 1}
    (source / "1.json").write_text(json.dumps(page) + "\n" + json.dumps(page))
    rows = stream.chunks(stream.first_of_url(stream.pages(spark, str(source))).drop("at"))
    stream.append(rows, out, str(tmp_path / "cp")).awaitTermination()
    (source / "2.json").write_text(json.dumps(page | {"url": "http://b"}) + "\n" + json.dumps(page | {"html": ""}))
    stream.append(rows, out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(out).collect()) == ["http://a", "http://b"]


def test_runtime(spark, tmp_path):
    folder = str(tmp_path / "p")
    c = config.Config.of({"start_url": "http://a"}, output_dir=folder, index_dir=f"{folder}/index")
    pages = "\n".join(json.dumps({"url": f"http://a/{k}", "html": f"<p>page {k} tells of five things", "crawled_at": "t"}) for k in range(3))

    def crawl_into(path):
        (tmp_path / "p").mkdir(exist_ok=True)
        (tmp_path / "p" / "results.jsonl").write_text(pages)

    rt = runtime.build(spark, c, toy_vector, Script(("YES or NO", "YES"), ("Context", "done")), crawl_into, usage_folder=str(tmp_path / "usage"))
    rt.ingest.debug = True
    rt.usage.embedding("m", 400)
    rt.usage.chat("m", 100, 50)
    assert rt.run_ingest()["indexed"] and rt.usage.pending == []
    assert spark.read.json(f"{folder}/debug/raw_chunks").count() == 3
    got = {r["type"]: r["total_tokens"] for r in tables.usage(spark, str(tmp_path / "usage")).collect()}
    assert got == {"embedding": 400, "chat": 150}
    answer = rt.query_result("page 1 tells of five things")
    assert answer.supported and answer.answer == "done" and answer.sources
    records = tables.load_index(spark, f"{folder}/index")
    assert index.id_of(records, "none") == -1 and index.id_of(records, "http://a/0#chunk_0__seg_0") != -1
    q = records.limit(1).select(F.lit(1).alias("qid"), F.col("embedding").alias("vector"))
    assert index.find(records, q, 1, "ivf_flat", 2, 2).count() == index.find(records, q, 1).count() == 1
    with pytest.raises(RuntimeError, match="chat"):
        runtime.build(spark, c, toy_vector).query_result("q")


def test_summaries():
    llm = Script(("keep", "short"))
    assert agents.Summariser(llm, "keep {text}")("x" * 30_000) == "short" and len(llm.asked[0]) < 9000
    assert agents.Summariser(Script())("text") == "text"


SITE = {
    "http://s/": '<h1>S</h1><p>the home page of it <a href="/a#x">to a</a> <a href="/b">to b</a> <a href="http://other/">away</a> <a href="/private/x">private</a>',
    "http://s/a": '<p>page a of the site <a href="/b">to b</a> <a href="/c">to c</a> <a href="/pdf">a file</a>',
    "http://s/b": '<p>page b of the site <a href="/">home</a> <a href="/missing">gone</a>',
    "http://s/c": '<p>page b of the site <a href="/">home</a> <a href="/missing">gone</a>',
    "http://s/robots.txt": "User-agent: *\nDisallow: /private/\n",
}


def serve(url):
    if url == "http://s/pdf":
        return 200, "application/pdf", None, "x"
    return (200, "text/plain" if url.endswith(".txt") else "text/html", None, SITE[url]) if url in SITE else (404, "", None, "")


def fetch(urls):
    return web.fetch_all(urls, serve, web.Manners(pause=0))


def test_live_crawl(spark):
    made = crawling.live(spark, [" http://s/#top "], fetch, crawl.Policy(allowed_domains=["s"]), blacklist=["http://s/none"])
    assert {r["url"]: r["depth"] for r in made.pages.collect()} == {"http://s/": 0, "http://s/a": 1, "http://s/b": 1}
    got = {r["url"]: r["reason"] for r in made.refused.collect()}
    assert got == {"http://other/": "domain", "http://s/private/x": "robots", "http://s/pdf": "content type", "http://s/missing": "status 404"}
    assert made.links.where("from_url = 'http://s/a'").count() == 3
    shallow = crawling.live(spark, ["http://s/"], fetch, crawl.Policy(allowed_domains=["s"]), robots=False, max_depth=1, deduplicate=False, blacklist=["http://s/b"])
    assert {r["url"] for r in shallow.pages.collect()} == {"http://s/", "http://s/a"} and {(r["url"], r["reason"]) for r in shallow.refused.collect()} >= {("http://s/b", "blacklist"), ("http://s/private/x", "status 404")}
    assert crawling.live(spark, [" "], fetch, crawl.Policy()).pages.count() == 0


class Stopped(Exception):
    pass


@pytest.mark.parametrize("after", range(1, 7))
def test_a_stopped_crawl_goes_on(spark, tmp_path, after):
    rows = lambda made: [sorted(map(tuple, df.collect())) for df in (made.pages, made.links, made.refused)]
    policy, asked = crawl.Policy(allowed_domains=["s"]), []

    def stopping(urls):
        asked.append({r["url"] for r in urls.collect()})
        if len(asked) == after:
            raise Stopped
        return fetch(urls)

    whole = rows(crawling.live(spark, ["http://s/"], fetch, policy))
    try:
        crawling.live(spark, ["http://s/"], stopping, policy, folder=str(tmp_path / "crawl"))
    except Stopped:
        assert len(asked) == after
    before = set().union(*asked[: max(0, 2 * ((after - 1) // 2))])
    asked.clear()
    after = 0
    assert rows(crawling.live(spark, ["http://s/"], stopping, policy, folder=str(tmp_path / "crawl"))) == whole
    assert not before & set().union(*asked)
    asked.clear()
    assert rows(crawling.live(spark, ["http://s/"], stopping, policy, folder=str(tmp_path / "crawl"))) == whole and not asked
    assert crawling.live(spark, ["http://s/a"], fetch, policy, folder=str(tmp_path / "crawl")).pages.where("url = 'http://s/a' and depth = 0").count() == 1


def test_plans_of_a_long_crawl_stay_short(spark):
    def chain(urls):
        n = F.regexp_extract("url", r"(\d+)$", 1).cast("int")
        return urls.select("url", F.format_string('<p>page %d of a long chain <a href="http://s/%d">next</a>', n, n + 1).alias("html"), F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("reason"))

    size = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    made = crawling.live(spark, ["http://s/0"], chain, crawl.Policy(), robots=False, max_depth=39)
    assert sorted(map(tuple, made.pages.select("depth", "url").collect())) == [(k, f"http://s/{k}") for k in range(40)]
    assert size(made.pages) <= 2 and size(made.links) <= 2 and size(made.refused) <= 2


def test_crawl_and_ask_by_settings(spark, tmp_path):
    folder, made = str(tmp_path / "p"), []

    def models(name):
        made.append(name)
        return Script(("YES or NO", "YES"), ("Summarise", "in short"), ("Context", "told"))

    def many(texts):
        made.append(len(texts))
        return [toy_vector(t) for t in texts]

    c = config.Config.of({"start_url": "http://s/", "summary_model": "small", "rate_limit_delay": 0, "embedding_cache_dir": str(tmp_path / "cache"), "debug": True, "query_debug": True, "score_threshold": 0.0, "leave_last_k": 1}, output_dir=folder, index_dir=f"{folder}/index")
    rt = runtime.build(spark, c, ingest.Embedder(many, "m"), models=models, fetch=crawling.fetch_by(c, serve))
    assert rt.run_ingest()["indexed"] and made[:2] == [config.CHAT, "small"]
    assert {r["url"] for r in tables.load_index(spark, f"{folder}/index").collect()} == {"http://s/", "http://s/a", "http://s/b"}
    assert {r["url"] for r in spark.read.json(f"{folder}/disallowed.json").collect()} >= {"http://s/private/x", "http://other/"}
    assert {r["summary_preview"] for r in spark.read.json(f"{folder}/debug/summaries").collect()} == {"in short"}
    known = spark.read.parquet(str(tmp_path / "cache"))
    assert known.count() == known.select("key").distinct().count() > 0
    assert tables.exists(spark, f"{folder}/words/settings.json")
    chats = tables.Chats(str(tmp_path / "chats"))
    assert rt.query_chat(chats, "one", "what is told?").answer == "told" and [m["role"] for m in chats.load("one")["messages"]] == ["user", "assistant"]
    assert rt.pipeline.retriever.words is not None
    assert rt.query_chat(chats, "one", "and then?").supported and len(chats.load("one")["messages"]) == 4
    assert len(list((tmp_path / "p" / "debug" / "queries").glob("*.json"))) == 2


def test_embedder():
    calls, waits = [], []

    def many(texts):
        calls.append(list(texts))
        if "bad" in texts:
            raise RuntimeError("no")
        return [[float(len(t))] for t in texts]

    e = ingest.Embedder(many, batch=3, retries=1, sleep=waits.append)
    assert e.vectors(["a", " ", "bb", "a", None, "bad", "cccc"]) == [[1.0], None, [2.0], [1.0], None, None, [4.0]]
    assert calls[0] == ["a", "bb", "bad"] and waits == [1.0] * 2 and e.most_tokens == 5600
    assert ingest.embedder(e) is e and ingest.embedder(toy_vector).most_tokens == 7372


def test_embedding_cache_asks_once(spark, tmp_path):
    cache = str(tmp_path / "cache")
    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,), (" ",)], "text string")
    first = ingest.embedded_once(rows, toy_vector, cache)
    assert sorted(str(r["embedding"]) for r in first.collect()) == sorted(str(v) for v in (toy_vector("a"), toy_vector("b"), toy_vector("a"), None, None))

    def never(text):
        raise AssertionError(text)

    assert [r["embedding"] for r in ingest.embedded_once(rows.where("text = 'b'"), never, cache).collect()] == [toy_vector("b")]
    assert spark.read.parquet(cache).count() == 2


def test_service(spark, tmp_path):
    root = str(tmp_path)
    api = service.Service(root, lambda c: runtime.build(spark, c, toy_vector, Script(("YES or NO", "YES"), ("Context", "told")), fetch=crawling.fetch_by(c, serve)))
    assert api.handle("GET", "/healthz") == (200, {"status": "ok"}) and api.handle("GET", "/none")[0] == 404 and api.handle("PUT", "/healthz")[0] == 405
    assert api.handle("POST", "/v1/projects", {"name": "p", "config": {"start_url": "ftp://x"}})[0] == 400 and api.handle("POST", "/v1/projects", {})[0] == 400
    code, made = api.handle("POST", "/v1/projects", {"name": "p", "config": {"start_url": "http://s/", "rate_limit_delay": 0, "score_threshold": 0.0}})
    assert code == 201 and made["config"]["start_url"] == "http://s/" and api.handle("POST", "/v1/projects", {"name": "p", "config": {"start_url": "http://s/"}})[0] == 409
    assert api.handle("GET", "/v1/projects") == (200, {"items": ["p"]}) and api.handle("GET", "/v1/projects/q")[0] == 404
    assert api.handle("PATCH", "/v1/projects/p", {"config": {"max_depth": 1}})[1]["config"]["max_depth"] == 1
    assert not api.handle("GET", "/v1/projects/p/status")[1]["query_ready"] and api.handle("POST", "/v1/projects/p/query", {"question": "q"})[0] == 503
    assert api.handle("POST", "/v1/projects/p/ingest", {"mode": "x"})[0] == 400 and api.handle("POST", "/v1/projects/p/ingest")[1]["result"]["indexed"]
    code, got = api.handle("POST", "/v1/projects/p/query", {"question": "what of page a?"})
    assert code == 200 and got["answer"] == "told" and got["supported"] and got["sources"]
    assert api.handle("POST", "/v1/projects/p/query", {"question": " "})[0] == 400
    assert api.handle("PUT", "/v1/projects/p/chats/one", {"title": "T", "messages": [{"role": "user", "content": "x"}]})[1]["title"] == "T"
    kept = (tmp_path / "p" / "config.json").read_text()
    for bad in ("..%2Fconfig", "..%2F..%2F..%2Fevil", "%2Fetc%2Fx", "..%5Cconfig", ".hidden"):
        assert api.handle("PUT", f"/v1/projects/p/chats/{bad}", {"title": "T"})[0] == 400
    assert (tmp_path / "p" / "config.json").read_text() == kept and not list(tmp_path.parent.rglob("evil*"))
    assert api.handle("GET", "/v1/projects/p/chats")[1] == {"items": ["one"]} and api.handle("GET", "/v1/projects/p/chats/one")[0] == 200
    assert api.handle("DELETE", "/v1/projects/p/chats/one") == (204, None) and api.handle("GET", "/v1/projects/p/chats/one")[0] == 404

    import threading
    import urllib.error
    import urllib.request

    http = service.server(api, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_port}"
    assert json.loads(urllib.request.urlopen(f"{base}/v1/projects", timeout=20).read()) == {"items": ["p"]}
    with pytest.raises(urllib.error.HTTPError, match="400"):
        urllib.request.urlopen(urllib.request.Request(f"{base}/v1/projects", b"no json", method="POST"), timeout=20)
    http.shutdown()
    assert api.handle("DELETE", "/v1/projects/p") == (204, None) and api.handle("GET", "/v1/projects") == (200, {"items": []})
