"""A table of questions through both flows: the same answers as one question after the other."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sillage.operators import index, postings
from sillage.plans.agents import Answerer, Planner
from sillage.plans.answers import NOTHING, Pipeline, Retriever
from sillage.plans.batch import Batch

QUESTIONS = [
    ("1", "intro now", ""), ("2", "intro later", ""), ("3", "intro never ok", ""), ("4", "intro never", ""), ("5", "unknown words", ""), ("6", "limit now", "User: before"), ("7", "retry later ok", "User: a\nAssistant: b"),
    ("8", "shorten this", "User: long"), ("9", "shorten this", ""), ("10", "follow it", "User: x"), ("11", "intro drop later ok", ""), ("12", "limit twice", ""), ("13", "", ""),
]


def models():
    class Model:
        def generate(self, prompt):
            if "Choose a mode" in prompt:
                asked = prompt.split("Request: ")[1].split("\n")[0]
                mode = "transform_only" if "shorten" in asked else "retrieve_followup" if "follow" in asked else "retrieve_new"
                return json.dumps({"mode": mode, "standalone_query": "intro" if "follow" in asked else "", "concepts": [] if "twice" in asked else ["alpha", "retries", "zebra"]})
            if "Name what this request" in prompt:
                return '{"concepts": ["beta words", "nowhere"]}'
            if "what else to search for" in prompt:
                drop = ["intro"] if "drop" in prompt else []
                return json.dumps({"queries": ["retry"] if "later" in prompt or "drop" in prompt else [], "drop_chunk_ids": drop})
            if "Better searches" in prompt:
                return "retry\nlimit" if "later" in prompt else "SAME" if "never" in prompt else "intro || limit"
            if "YES or NO" in prompt:
                asked = prompt.rsplit("Question: ", 1)[1]
                return "YES" if "now" in asked or ("later" in asked and "retries" in prompt) else "NO"
            if "Rework" in prompt:
                return "shorter"
            if "one JSON object" in prompt:
                return json.dumps({"answer": f"so far {prompt.count('(Source:')}", "supported": "Y" if " ok" in prompt else "N"})
            return f"told by {prompt.count('(Source:')}"

    return Model()


def embedder():
    known = {"intro": [1.0, 0.1, 0.0], "retry": [0.0, 1.0, 0.2], "limit": [0.1, 0.0, 1.0], "follow": [0.3, 0.3, 0.3]}
    return lambda text: known.get(next((k for k in known if k in text), ""))


vector = embedder()


@pytest.fixture(scope="module")
def records(spark):
    link = lambda page, text: [(page, text, "c")]
    rows = [
        ("intro", "http://x/intro", 0, "alpha beta words of intro", ["Start", "Intro"], "p0", link("http://x/a", "to intro"), [1.0, 0.0, 0.0]),
        ("intro2", "http://x/intro?utm_source=z", 1, "alpha again, much the same intro", ["Start"], "p0", [], [0.9, 0.1, 0.0]),
        ("retries", "http://x/retries", 0, "gamma retries and retry", ["Retries"], "p1", link("http://x/b", "limit of it"), [0.0, 1.0, 0.0]),
        ("limits", "http://x/limits", 0, "delta limits, " * 30, ["Limits"], "p2", [], [0.0, 0.0, 1.0]),
        ("bare", "http://x/bare", 0, "a limit without a vector", [], "", [], None),
    ]
    ddl = "id string, url string, chunk_index int, text string, hierarchy array<string>, parent string, incoming_links array<struct<from_page:string,anchor_text:string,source_chunk:string>>, embedding array<double>"
    return index.added(spark.createDataFrame(rows, ddl)).cache()


CASES = [("classic", {"expand": False}, "1 2 4 5 6"), ("classic", {"expand": True, "best_effort": False}, "2 3 7"), ("builder", {}, "1 5 8 9 10 12"), ("builder", {"best_effort": False, "rounds": 2, "threshold": 0.2}, "3 6 11")]


@pytest.mark.parametrize(("mode", "more", "chosen"), CASES)
def test_as_one_after_the_other(spark, records, mode, more, chosen):
    answerer, planner = Answerer(models()), Planner(models())
    threshold = more.get("threshold", 0.0)
    settings = {k: v for k, v in more.items() if k != "threshold"} | {"budget": 500}
    one = Pipeline(Retriever(spark, records, vector, threshold=threshold), answerer, planner, mode=mode, **settings)
    want = {}
    asked = [q for q in QUESTIONS if q[0] in chosen.split()]
    for q, question, memory in asked:
        got = one.query(question, memory)
        coverage = got.trace.get("coverage", {"covered": [], "missing": []})
        want[q] = (got.answer, got.supported, got.trace.get("answer_path"), [s["chunk_id"] for s in got.sources], coverage["covered"], coverage["missing"])
    questions = spark.createDataFrame(asked, "qid string, question string, memory string")
    made = Batch(records, vector, answerer, planner, mode=mode, threshold=threshold, **settings).answers(questions)
    assert {r["qid"]: (r["answer"], r["supported"], r["path"], [s["chunk_id"] for s in r["sources"]], r["covered"], r["missing"]) for r in made.collect()} == want
    assert len({w[2] for w in want.values()}) >= 2


def test_odd_tables_of_questions(spark, records):
    batch = Batch(records, vector, Answerer(models()), Planner(models()), mode="classic", expand=False, words=postings.build(records))
    rows = [(None, "intro now"), (1, None), (2, "limit now"), (2, "limit now"), (3, "xyzzy")]
    got = {r["qid"]: (r["answer"], [s["chunk_id"] for s in r["sources"]]) for r in batch.answers(spark.createDataFrame(rows, "qid int, question string")).collect()}
    assert set(got) == {"", "1", "2", "3"} and got["1"][0] == got["3"][0] == NOTHING and "bare" in got["2"][1] and got[""][1][0] == "intro"
    assert batch.answers(spark.createDataFrame([], "qid int, question string")).count() == 0
    nothing = Batch(records.where(F.lit(False)), vector, Answerer(models()), mode="builder").answers(spark.createDataFrame([(1, "intro now")], "qid int, question string"))
    assert [r["answer"] for r in nothing.collect()] == [NOTHING]
