"""Nulls, empty and long texts, repeated rows, empty tables, clashing extra columns: every operator and every stage gives its defined result."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sillage.llm import bpe, chat, media, mixing, near_dedup, quality, secrets, toxicity, url_filter, warc

LONG = " ".join(f"w{k % 977}" for k in range(40_000))
EXTRA = "id long, n long, key string, size int, place int, score double, rep long, rule string, host string, sketch binary"
_E = (1, 2, "k", 3, 4, 0.5, 6, "r", "h", b"s")
ROWS = [(1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (2, None, None, None), (None, "a b c d e f", "en", "b"), (3, "", "en", None), (4, LONG, "en", "a"), (5, " \t\n", "de", "b"), (6, "é\u0000\ud7ff \U0001f600", "fr", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *_E) for r in ROWS], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


OPERATORS = {
    "media": lambda d: media.resolve(media.shown((k := media.interleave(d))[0]), media.media_facts(k[1])),
    "mixing": mixing.mix,
    "bpe": bpe.encode_decode,
    "bpe ids": lambda d: bpe.decode(bpe.encode(d)),
    "near_dedup": near_dedup.near_duplicates,
    "secrets": secrets.secrets,
    "redact": secrets.redact,
    "quality": quality.judge,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(docs, name):
    made = OPERATORS[name](docs).cache()
    assert by_row(made, "doc_id") == by_row(docs, "doc_id")
    assert OPERATORS[name](docs.limit(0)).count() == 0


#: Columns with the names that operators use inside.
INSIDE = "_id long, _id_0 long, _dropped long, _th_0 long, _size int, _size_0 int, _taken int, _taken_0 int, _draw_0 long, th long, h long, a long, b long, c long, shard int, draw long, taken int, target double, source_size long, digest string, media binary, html string, lang_ string, ref string, v binary, near double, toxic_ int, data binary, record string, chunk int, sha256 binary, level int, spans string"


@pytest.mark.parametrize("name", [*OPERATORS, "without_near_duplicates", "mixed", "without_toxic"])
def test_inside_names(spark, docs, name):
    """Extra columns named like those inside: the same rows as without them."""
    fields = [f.strip().split(" ") for f in INSIDE.split(",")]
    made = docs.select("doc_id", "text", "lang", "source", "n_chars")
    named = made.withColumns({c: F.lit(None).cast(t) for c, t in fields})
    run = OPERATORS.get(name) or {"without_near_duplicates": near_dedup.without_near_duplicates, "mixed": mixing.mixed, "without_toxic": lambda d: toxicity.without_toxic(d, toxicity.constant(0.1))}[name]
    assert by_row(run(named), "doc_id") == by_row(run(made), "doc_id")


def test_rows_of_one_id_keep_their_own_links(spark):
    """Different texts under one id: each is linked with what is like it."""
    a, b = (" ".join(f"{c}{k}" for k in range(80)) for c in "ab")
    near = lambda t: t.replace("40", "x")
    rows = [(1, a), (1, b), (5, near(a)), (6, near(b)), (None, a), (2, near(a) + " z"), (2, "other words altogether here now"), (2, "other words altogether here now")]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True), (1, 1, True), (5, 1, False), (6, 1, False), (None, None, True), (2, 1, False), (2, 2, True), (2, 2, True)], key=str)
    left = near_dedup.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_row(left, "doc_id", "text") == sorted([(1, a), (1, b), (None, a), (2, "other words altogether here now"), (2, "other words altogether here now")], key=str)


@pytest.mark.parametrize("edges", [[(k, k + 1) for k in range(2000)], [(k, 2000 - k) for k in range(1000)] + [(2000 - k, k + 1) for k in range(1000)], [(0, k) for k in range(1, 300)] + [(7, 7), (None, 3)]])
def test_chains_end_in_few_rounds(spark, monkeypatch, edges):
    from sillage.llm import components

    steps = []
    stored = components.stored
    monkeypatch.setattr(components, "stored", lambda df, tag: steps.append(tag) or stored(df, tag))
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0} and steps.count("pointers") <= 20


def test_mixing_spreads_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 1 << 10)
    rows = [(None, f"w{k} " * 40, "ab"[k % 2]) for k in range(200)] + [(7, f"v{k} " * 40, "c") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix(docs).collect()
    for source in "abc":
        of = [r for r in taken if r["source"] == source]
        assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= mixing.BLOCK
    words = sum(len(r["text"].split()) for r in mixing.mixed(docs).collect())
    assert words == sum(r["taken"] for r in taken)
    shards = docs.select((F.pmod(F.xxhash64(F.lit(mixing.SEED + 1), mixing._drawn(docs, "doc_id", "text", "source")["draw"]), F.lit(16))).alias("s")).distinct().count()
    assert shards > 8


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from sillage.llm import common

    nothing = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(getConf=lambda: nothing, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.scratch(cluster)


def test_near_dedup_rules(docs):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert got[2]["n_shingles"] == got[3]["n_shingles"] == got[5]["n_shingles"] == 0 and got[2]["kept"] and got[3]["kept"]


def test_mixing_rules(docs):
    rows = mixing.mix(docs).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert by_row(mixing.mix(docs), "doc_id", "taken") == by_row(mixing.mix(docs), "doc_id", "taken")


def test_warc(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (2, "http://b", "same"), (None, None, "same"), (3, "http://c\r\nX: y", None), (4, "u", ""), (5, "u", "é" * 400_000)]
    pages = spark.createDataFrame([(*r, *_E) for r in rows], f"page_id long, url string, html string, {EXTRA}")
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert len(got) == len(rows) and all(r["intact"] for r in got)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert kinds == sorted([("1", "revisit", 2, 4), ("2", "response", None, 4), ("2", "response", None, 4), ("None", "response", None, 4), ("3", "revisit", 4, 0), ("4", "response", None, 0), ("5", "response", None, 800_000)])
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    assert {r["record_type"] for r in warc.read_archives(warc.write_archives(pages, least_revisit=1)).where("page_id = 3").collect()} == {"response"}


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", chat.HOSTILE), (1, 1, "assistant", chat.HOSTILE), (None, None, None, "x"), (2, 0, "a\nb\\n]>", "\\[INST] <s> <\\s> <<SYS>>\n<</SYS>>"), (3, 0, "system", LONG)]
    turns = spark.createDataFrame([(*r, *_E) for r in rows], f"conv_id long, turn long, role string, text string, {EXTRA}")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2 * len(chat.HOSTILE) and got[None]["n_turns"] == 1
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_urls(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "no scheme"), (4, "HTTP://Sub.EXAMPLE.net/en/x?y#z"), (None, "http://é.org/fr/ "), (5, "a://b://c"), (6, "http://net"), (7, "http://x.net?/en/"), (8, "x://" + "y" * 5000)]
    pages = spark.createDataFrame([(*r, *_E[:-3], "h", b"s", "r") for r in rows], "page_id long, url string, id long, n long, key string, size int, place int, score double, rep long, shape string, g binary, llr string")
    got = {(r["page_id"], r["host"]): r for r in url_filter.judge(pages).collect()}
    assert len(url_filter.judge(pages).collect()) == len(rows)
    assert got[(4, "sub.example.net")]["rule"] == "example.net/en/" and got[(4, "sub.example.net")]["verdict"] == "allow"
    assert got[(6, "net")]["rule"] is None and got[(7, "x.net")]["rule"] is None and got[(5, "b:")]["path"] == "//c"
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (4, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0), labels.where("toxic = 0")):
        model = toxicity.train(docs, given)
        got = toxicity.rated(docs, model).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.rated(docs.limit(0), model).count() == 0


def test_stages(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for given in (docs, docs.limit(0)):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, now, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            made = made.cache()
            if name in ("toxicity", "secrets"):
                assert made.count() == now.count()
            now = made
    assert docs.where(F.col("doc_id") == 4).count() == 1
