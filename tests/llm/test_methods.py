"""Each operator against a brute-force version, an exact round trip, or held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sillage.llm import bpe, chat, media, mixing, near_dedup, quality, secrets, setsketch, shingles, toxicity, url_filter, warc
from sillage.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(sf):
    t = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))


def rows(spark, sf, name, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, sf).collect()}


def test_op1(spark, sf, documents):
    got = rows(spark, sf, "op1_media")
    assert len(got) == len(documents)
    for i, text in documents.items():
        raw = text.encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        # The stored form, and the sequence that it lies in, by hand: paragraphs, the picture after the first.
        height = len(payload) // 576
        lines = b"".join(b"\0" + payload[k * 576 : (k + 1) * 576] for k in range(height))
        png = b"\x89PNG\r\n\x1a\n"
        for kind, body in ((b"IHDR", (576).to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])), (b"IDAT", zlib.compress(lines, 1)), (b"IEND", b"")):
            png += len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest())
        told = [" ".join(x.split()) for x in text.split("\n") if x.split()]
        assert (r["n_parts"], r["position"], r["caption"]) == (len(told) + 1, min(1, len(told)), f"{len(raw)} bytes")
        assert r["text_sha256"] == hashlib.sha256("\n".join(told).encode()).hexdigest()
        mean = sum(payload) / len(payload)
        assert r["feature"].startswith(f"{height}:{mean:.3f}:") and len(r["feature"].rsplit(":", 1)[1]) == 16


def seen(html):
    return [(p["kind"], p["text"], p["digest"], p["caption"]) for p in media.parse(html)]


def test_sequences_keep_order_and_captions():
    html = '<p>a</p><figure><img src="sha256:1"><figcaption>one</figcaption></figure><script>x</script>b<figure><img src="http://p" alt="alt"><figcaption>two</figcaption></figure><img src="sha256:3" alt="c">'
    got = [(p["position"], p["kind"], p["text"], p["digest"], p["caption"]) for p in media.parse(html)]
    assert got == [(0, "text", "a", None, None), (1, "media", None, "1", "one"), (2, "text", "b", None, None), (3, "media", "http://p", None, "two"), (4, "media", None, "3", "c")]


def test_captions_before_and_for_several_media():
    html = '<figure><figcaption>all of <b>them</b></figcaption><img src="sha256:1"><img src="sha256:2"></figure>x<figure><figcaption>no media</figcaption></figure><figcaption>of none</figcaption>y'
    assert seen(html) == [("media", None, "1", "all of them"), ("media", None, "2", "all of them"), ("text", "x", None, None), ("text", "no media", None, None), ("text", "of none", None, None), ("text", "y", None, None)]


@pytest.mark.parametrize("html", ["<p>a</p><figcaption>b<p>c", "a<noscript>b<p>c", "a<template>b<p>c", "a<figure><figcaption>b<p>c", "<p>a<![x[ y b</p>c", "a b c<", "<div><div>a</b></i>b</p>c", "a<!-- x -->b<!DOCTYPE q>c"])
def test_broken_pages_lose_no_text(html):
    told = " ".join(t for kind, t, _, _ in seen(html) if kind == "text")
    assert re.sub("[^abc]", "", told) == "abc"


def test_an_open_figure_keeps_its_media():
    assert seen('<figure><img src="sha256:1"><figcaption>one<p>rest') == [("media", None, "1", None), ("text", "one rest", None, None)]


@given(st.lists(st.sampled_from(["<![", "x[", "<!", "<p>", "</p>", "<figure>", "<figcaption>", "</figure>", "<img src=a>", "<template>", "&amp;", "<", "a ", "]]>", "<!--", "--"]), max_size=14).map("".join))
@settings(max_examples=300, deadline=None)
def test_no_page_fails(html):
    parts = media.parse(html)
    assert [p["position"] for p in parts] == list(range(len(parts)))


def test_sequences_of_pages(spark, sf):
    """All pages against a plain reading of their simple markup."""
    t = pq.read_table(f"{sf}/pages.parquet").to_pydict()
    df = spark.createDataFrame(list(zip(t["page_id"], t["html"], strict=True)) + [(10**6, "<![x[ y"), (10**6 + 1, None)], "doc_id long, html string")
    got = defaultdict(list)
    for r in media.sequences(df).orderBy("doc_id", "position").collect():
        got[r["doc_id"]].append(r)
    block = "|".join(sorted(media._BLOCK | {"figcaption"}, key=len, reverse=True))
    for i, html in zip(t["page_id"], t["html"], strict=True):
        plain = re.sub(r"(?s)<(script|style|template)\b.*?</\1>|<!--.*?-->|<!DOCTYPE[^>]*>", "", html)
        assert not re.search("<(img|audio|video|source|figure)", plain)
        told = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(rf"</?(?:{block})\b[^>]*>", plain)]
        assert [r["text"] for r in got[i]] == [x for x in told if x] and all(r["kind"] == "text" for r in got[i])
    assert [r["text"] for r in got[10**6]] == ["<![x[ y"]


@given(st.text(max_size=3000))
@settings(max_examples=40, deadline=None)
def test_picture_round_trip(text):
    payload = media.padded(text)
    assert media.from_png(media.to_png(payload)) == payload


@given(st.sampled_from(["user", "assistant", "system", "tool", "a\nb", ""]), st.lists(st.sampled_from([*chat.CONTROL, "\\", " ", "\n", "<", "[", "x", "é"]), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_chat_round_trip(role, text):
    rendered, level, start, end = chat.render(role, text)
    assert chat.parse(rendered * 2) == [(role, text)] * 2
    assert (chat.unescaped(rendered[start:end])) == text and rendered[start:end] == (chat.escaped(text) if level else text)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool"]), st.lists(st.sampled_from([*chat.CONTROL, "\\", " ", "\n", "x", "é"]), max_size=6).map("".join)), max_size=6), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_a_conversation_is_read_as_a_whole(turns, step):
    """Whatever parts the text comes in, turns and what is under the mask are those of the source."""
    text, spans = "", []
    for role, said in turns:
        rendered, _, start, end = chat.render(role, said)
        if role == "assistant":
            spans.append((len(text) + start, len(text) + end))
        text += rendered
    reader = chat.Reader(1)
    for k in range(0, len(text), step):
        reader.feed(text[k : k + step], [x for x in spans if k < x[1] <= k + step])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    learned = "".join(t for r, t in turns if r == "assistant")
    assert reader.row() == (1, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(text))


def test_the_mask_covers_each_learned_text_once(spark, sf):
    t = pq.read_table(f"{sf}/conversations.parquet").to_pydict()
    df = spark.createDataFrame(list(zip(t["conv_id"], t["turn"], t["role"], t["text"], strict=True)), "conv_id long, turn long, role string, text string")
    texts, masks, want = defaultdict(str), defaultdict(list), defaultdict(list)
    for r in chat.format_turns(df).orderBy("conv_id", "at").collect():
        assert r["at"] == len(texts[r["conv_id"]])
        texts[r["conv_id"]] += r["rendered"]
        if r["loss_start"] is not None:
            masks[r["conv_id"]].append((r["loss_start"], r["loss_end"]))
    for c, _, role, text in sorted(zip(t["conv_id"], t["turn"], t["role"], t["text"], strict=True)):
        if role == "assistant":
            want[c].append(text or "")
    assert {c: [chat.unescaped(texts[c][a:b]) for a, b in masks[c]] for c in masks} == want


def test_op3(spark, sf, documents):
    got = QUERIES["op3_mixing"](spark, sf).collect()
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r["size"] == len(WORD.findall(documents[r["doc_id"]])) and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    names = sorted(size)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    want, open_, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * size[s]
            left -= want[s]
        open_ -= over
    want |= {s: weight[s] * level for s in open_}
    for s in names:
        assert math.isclose(target[s], want[s], rel_tol=1e-9) and abs(taken[s] - want[s]) <= 2 * mixing.BLOCK


@given(st.lists(st.floats(0, 1000), min_size=1, max_size=6), st.integers(0, 60))
@settings(max_examples=60, deadline=None)
def test_apportionment_takes_highest_quotients(targets, seats):
    got = mixing.apportion(targets, seats, [1000] * len(targets))
    quotients = sorted(((-t / (2 * k + 1), i) for i, t in enumerate(targets) if t > 0 for k in range(seats)))[:seats]
    count = Counter(i for _, i in quotients)
    assert got == [count[i] for i in range(len(targets))]


def test_apportionment_of_many_seats_is_the_same():
    rng = random.Random(4)
    for n in (1, 2, 7, 30):
        targets = [rng.choice([0.0, 1.0, 64.0, rng.random() * 1e6]) for _ in range(n)] + [5e5]
        caps = [rng.choice([0, 3, 10**7]) for _ in range(n)] + [10**7]
        seats = round(sum(targets) / mixing.BLOCK)
        quotients = sorted((-t / (2 * k + 1), i) for i, (t, c) in enumerate(zip(targets, caps, strict=True)) if t > 0 for k in range(min(c, seats)))[:seats]
        count = Counter(i for _, i in quotients)
        assert mixing.apportion(targets, seats, caps) == [count[i] for i in range(n + 1)]


@pytest.mark.parametrize(("small", "words"), [(20, 10), (2000, 1)])
def test_small_sources_get_their_words(spark, small, words):
    """Sources of a few words beside a large one: each comes within a word or two of its target."""
    rows = [(k, "big " * 200, "big") for k in range(100)] + [(1000 + k, "w " * words, f"s{k}") for k in range(small)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    target = {r["source"]: r["target"] for r in got}
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1.5 for s in target)


@pytest.mark.parametrize("words", [1, 10, 15])
def test_small_sources_over_many_shards_get_their_target(spark, monkeypatch, words):
    monkeypatch.setattr(mixing, "SHARD", 1 << 11)
    monkeypatch.setattr(mixing, "SPAN", 16, raising=False)
    rows = [(k, "w " * 300, "abcde"[k % 5]) for k in range(500)] + [(1000 + k, "w " * words, "small") for k in range(60)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for source in ("a", "b", "c", "d", "e", "small"):
        of = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= mixing.BLOCK
    assert of[0]["target"] == 2 * 60 * words


def test_op4(spark, sf):
    urls = dict(zip(*(pq.read_table(f"{sf}/pages.parquet").to_pydict()[c] for c in ("page_id", "url")), strict=True))
    got = rows(spark, sf, "op4_url_filter", "page_id")
    shapes: dict[str, str | None] = {}
    parts = {}
    for i, url in urls.items():
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
        host, path = (m[1].translate({k: k + 32 for k in range(65, 91)}), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, default=(0, None, None))
        shape = "^^^" + re.sub("[^a-z0./-]", "_", re.sub("[0-9]+", "0", url.split("://", 1)[-1].lower())) + "$"
        parts[i] = host, path, rule, shape
        shapes[shape] = max(filter(None, [shapes.get(shape), rule[2]]), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule[1])
        if rule[2]:
            assert got[i]["verdict"] == rule[2]
    # The models by hand, with the shapes that the query learned from.
    held = {r["shape"]: r["h"] for r in spark.createDataFrame([(s,) for s in shapes], "shape string").selectExpr("shape", "pmod(xxhash64(shape), 5) = 0 as h").collect()}
    llr = {}
    for cls in ("allow", "block"):
        n = [Counter() for _ in range(4)]
        for s, v in shapes.items():
            if v == cls and not held[s]:
                for k in range(3, len(s)):
                    for order in range(4):
                        n[order][s[k - order : k + 1]] += 1
        total, kinds = [Counter() for _ in range(4)], [Counter() for _ in range(4)]
        for order in range(4):
            for g, c in n[order].items():
                total[order][g[:-1]] += c
                kinds[order][g[:-1]] += 1

        llr[cls] = n, total, kinds

    def p(cls, g, order=3):
        n, total, kinds = llr[cls]
        lower = p(cls, g, order - 1) if order else 1 / 32
        t = g[3 - order :]
        c, k = total[order][t[:-1]], kinds[order][t[:-1]]
        return (n[order][t] + k * lower) / (c + k) if c else lower

    scores = {s: sum(math.log(p("allow", s[k - 3 : k + 1])) - math.log(p("block", s[k - 3 : k + 1])) for k in range(3, len(s))) / (len(s) - 3) for s in shapes}
    # The threshold: the step with the best mean of recalls on held-out shapes, of equals that nearest 0, of these the greater.
    tally = Counter((math.floor(max(-8, min(8, scores[s])) * 50 + 0.5) if scores[s] >= 0 else -math.floor(-max(-8, scores[s]) * 50 + 0.5), v) for s, v in shapes.items() if v and held[s])
    total = {v: max(1, sum(n for (_, w), n in tally.items() if w == v)) for v in ("allow", "block")}
    best = max(((sum(n for (x, v), n in tally.items() if v == "allow" and x >= b) / total["allow"] + sum(n for (x, v), n in tally.items() if v == "block" and x < b) / total["block"], -abs(b), b) for b in {x for x, _ in tally}), default=(0, 0, None))[2]
    threshold = 0.0 if best is None else (best - 0.5) / 50
    for i, (_, _, rule, s) in parts.items():
        assert math.isclose(got[i]["score"], scores[s], rel_tol=1e-9, abs_tol=1e-9)
        assert got[i]["verdict"] == (rule[2] or ("allow" if scores[s] >= threshold else "block"))


def test_queries_tell_urls_apart(spark):
    """URLs that differ by their query only: the models learn from it."""
    rows = [(k, f"http://a.org/fr/p{'x' * (k % 7)}?id={k}&clean=yes{'y' * (k % 5)}") for k in range(200)] + [(1000 + k, f"http://a.net/p{'x' * (k % 7)}?utm=casino{'z' * (k % 6)}") for k in range(200)]
    asked = [(5000, "http://b.com/p?id=3&clean=yes"), (5001, "http://b.com/p?utm=casino"), (5002, "casino"), (5003, "clean=yes")]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows + asked, "page_id long, url string")).collect()}
    assert got[5000]["score"] > got[5001]["score"] + 0.2 and got[5002]["verdict"] == "block" and got[5003]["verdict"] == "allow"


def test_op5(spark, sf, documents):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(bpe.default_vocabulary())
    got = rows(spark, sf, "op5_bpe")
    for i, text in documents.items():
        ids = known.encode(text, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_on_odd_texts():
    from pathlib import Path

    from tokenizers import Tokenizer

    known, own = Tokenizer.from_file(bpe.default_vocabulary()), bpe.Bpe(Path(bpe.default_vocabulary()).read_text("utf-8"))
    rng = random.Random(3)
    parts = [*"aAbB'sST ΣσÉßİ\x1c\x85\xa0\u200312½ẞ.,!😀é\u0338=ǅ한\n_-", "<|endoftext|>", "<|startoftext|>", "'ll", "'VE"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(300)] + ["", "ab" * 3000]
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        want = known.encode(text, add_special_tokens=False).ids
        assert ids == want and own.decode(ids) == known.decode(want, skip_special_tokens=False)
    assert own.decode([10**9, 320]) == own.decode([320])
    for piece in ("abcabc", "x", "hello", "aaaaaaa", "zq" * 15):
        raw = piece.encode()
        assert own.merged(piece) == own.merged_together([raw], 1 << max(len(raw) - 2, 0).bit_length())[0]


def test_op6(spark, sf):
    t = pq.read_table(f"{sf}/pages.parquet").to_pydict()
    last: dict[str, int] = {}
    for i, h in zip(t["page_id"], t["html"], strict=True):
        last[h] = max(i, last.get(h, i))
    got = rows(spark, sf, "op6_warc", "page_id")
    for i, h in zip(t["page_id"], t["html"], strict=True):
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last[h] == i else ("revisit", last[h]))


@given(st.binary(max_size=2000))
@settings(max_examples=30, deadline=None)
def test_chunks_are_views(payload):
    size, warc.CHUNK = warc.CHUNK, 256
    try:
        made = list(warc.pieces(memoryview(payload)))
        assert [m[0] for m in made] == list(range(1, max(1, -(-len(payload) // 256)) + 1)) and [m[1] for m in made] == [False] * (len(made) - 1) + [True]
        assert all(isinstance(m[2], memoryview) and len(m[2]) <= 256 for m in made) and b"".join(m[2] for m in made) == payload
        assert (made[-1][3], made[-1][4], made[-1][5]) == (warc.digest(hashlib.sha1(payload)), len(payload), hashlib.sha256(payload).digest())
    finally:
        warc.CHUNK = size


def test_archives_as_files(spark, tmp_path):
    """Written as WARC files, read as a stream, equal to what was written; record ids are unique, and revisits refer to a response's."""
    pages = spark.createDataFrame([(k, f"http://x/{k}", "é" * (k % 5 * 200_000)) for k in range(12)] + [(3, "http://x/3", "é" * 600_000), (None, None, None)], "page_id long, url string, html string")
    archive = warc.write_archives(pages)
    files = warc.export(archive, str(tmp_path))
    assert sum(r["records"] for r in files.collect()) == 14 and not list(tmp_path.glob("*.part"))
    told = lambda df: sorted(str(tuple(r)) for r in warc.read_archives(df).collect())
    assert told(warc.load(files)) == told(archive)
    raw = b"".join(p.read_bytes() for p in tmp_path.glob("*.warc"))
    ids, refers = re.findall(rb"WARC-Record-ID: (\S+)", raw), re.findall(rb"WARC-Refers-To: (\S+)", raw)
    assert len(set(ids)) == len(ids) == 14 and refers and set(refers) < set(ids)
    assert max(r["n"] for r in archive.selectExpr("length(data) as n").collect()) <= warc.CHUNK + 4


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: len(s) for i, s in sets.items()}, {i: find(i) for i in sets}


def test_op7(spark, sf, documents):
    got = rows(spark, sf, "op7_near_dedup")
    sizes, roots = brute_components(documents)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (sizes[i], roots[i], roots[i] == i) for i in documents}


def test_near_copies_of_one_text_keep_all_links(spark):
    """Copies edited to every degree: chains through bridges, pairs about the threshold, and copies that link with nothing."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(160)]
    texts = {}
    for i in range(260):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts[i + 5] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sizes, roots = brute_components(texts)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(df).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (sizes[i], roots[i]) for i in texts}
    assert len(set(roots.values())) > 1


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(1)
    values = shingles.mix(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    a, b = np.unique(values[:2000]), np.unique(values[500:])
    ra, rb, union = setsketch.registers([a, b, np.unique(values)])
    assert (setsketch.merged(ra, rb) == union).all()
    true = len(np.intersect1d(a, b)) / len(np.unique(values))
    assert abs((ra == rb).mean() - true) < 0.1
    sizes = np.array([len(a)]), np.array([len(b)])
    assert setsketch.plausible(ra[None], rb[None], *sizes, true)[0] and not setsketch.plausible(ra[None], rb[None], *sizes, 0.95)[0]


def test_op8(spark, sf, documents):
    got = rows(spark, sf, "op8_secrets")
    assign = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in documents.items():
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert got[i]["base_sha256"] == hashlib.sha256(secrets.listed(sorted(spans)).encode()).hexdigest()
        assert set(filter(None, secrets.listed(sorted(spans)).split(","))) <= set(got[i]["spans"].split(","))


def test_pages_of_one_payload_are_split_over_tasks(spark):
    pages = spark.range(60_000, numPartitions=8).selectExpr("id page_id", "'http://a/' || id url", "case when id % 2 = 0 then '' else 'page ' || id end html")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        payloads = warc.cut(pages)
        ends, first = warc.firsts(payloads, warc.LEAST_REVISIT)
        joined = warc.referring(ends, first)
        joined.write.format("noop").mode("overwrite").save()
        assert joined.where("to_record is not null").count() == 29_999
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan, plan[:3000]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_novel_secrets():
    text = "the bearer header is Zx9Qm2Lr7Tb4Vk8Wn3Yd here, the token function get_user_name_from_request_body stays; secret tokens are zzzzzzzzzzzzzzzzzzzzzzzzzz1 fine"
    found = [text[a:b] for a, k, b in secrets.scan(text) if k == 3]
    assert found == ["Zx9Qm2Lr7Tb4Vk8Wn3Yd"]
    assert secrets.redacted(text, secrets.scan(text)).count("[SECRET]") == 1
    assert secrets.scan("no context Zx9Qm2Lr7Tb4Vk8Wn3Yd") == []


VALUE = "Qx7vLm2Rt9Zb4Kw8Nd3Y"


@pytest.mark.parametrize("before", ["aws_secret_access_key=", "signature=", "PWD=", "export DB_PWD=", "Cookie: session_id=", "GET /x?key=abc&signature=", "session_", "auth-", "cookie: a=1;b="])
@pytest.mark.parametrize("after", ["", "&b=1", "; x", "\nUSER=me", "=="])
def test_novel_secrets_without_quotes(before, after):
    text = before + VALUE + after
    found = [text[a:b] for a, k, b in secrets.scan(text) if k == 3]
    assert found == [VALUE + ("==" if after == "==" else "")]


CONTEXTS = ["password is {}", "the bearer header is {} here", "{} is the session token", "use {} as your private key", "Authorization: Bearer {}", "aws_secret_access_key={}", 'credential "{}"', '"signature": "{}"']


@pytest.mark.parametrize("alphabet", ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"])
def test_recall_of_random_values(documents, alphabet):
    rng = random.Random(5)
    prose = [t for t in documents.values() if len(t) > 300]
    found = tried = 0
    for context in CONTEXTS:
        for length in (16, 20, 32, 40):
            for _ in range(15):
                value, before = "".join(rng.choice(alphabet) for _ in range(length)), rng.choice(prose)[:300]
                text = f"{before} {context.format(value)} {rng.choice(prose)[:300]}"
                at = text.index(value, len(before))
                found += any(a <= at and b >= at + length for a, _, b in secrets.scan(text))
                tried += 1
    assert found >= 0.93 * tried


@pytest.mark.parametrize(("alphabet", "contexts", "lengths"), [("abcdefghijklmnopqrstuvwxyz", CONTEXTS, (16, 20, 32, 40)), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", CONTEXTS, (16, 20, 32, 40)), ("0123456789", CONTEXTS, (20, 24, 32, 40)), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!@#$%^&*?~", ['auth: "{}"', "password = '{}'", "the session key is `{}`"], (16, 20, 32, 40))])
def test_recall_of_values_of_one_kind_or_with_signs(documents, alphabet, contexts, lengths):
    rng = random.Random(6)
    prose = [t for t in documents.values() if len(t) > 300]
    found = tried = 0
    for context in contexts:
        for length in lengths:
            for _ in range(40):
                value, before = "".join(rng.choice(alphabet) for _ in range(length)), rng.choice(prose)[:300]
                text = f"{before} {context.format(value)} {rng.choice(prose)[:300]}"
                found += value[2:-2] not in secrets.redacted(text, secrets.scan(text)) and value[-8:] not in secrets.redacted(text, secrets.scan(text))
                tried += 1
    assert found >= 0.9 * tried


def test_plain_values_are_left_alone():
    plain = ["2024-01-02-03-04-05-06", "4913615156729033", "00000000000000000000", "https://example.com/path/to/page?next=/home", "%(asctime)s-%(name)s-%(levelname)s", "counterrevolutionaries", "donaudampfschifffahrtsgesellschaft", "MAX_TOKEN_LENGTH_LIMIT", "abcdefghijklmnopqrstuvwxyz", "config['database']['url']", "----------------------------"]
    assert [v for v in plain if secrets.scan(f"the session header '{v}' stays; the secret")] == []


@pytest.mark.parametrize("text", ["key '" * 50_000, "key " + "'" * 200_000, "key '" + "a!" * 100_000 + "'", "key '" + "aB3!" * 50_000])
def test_quoted_values_take_linear_time(text):
    began = time.perf_counter()
    secrets.scan(text)
    assert time.perf_counter() - began < 10


def test_few_false_alarms(documents):
    names = "getUserNameFromRequestBody HttpServletRequestWrapper XMLHttpRequestFactory createAuthorizationHeader internationalization SessionManagementConfig tokenizerConfiguration MAX_TOKEN_LENGTH_LIMIT OAuthClientCredentials IllegalArgumentException donaudampfschifffahrt AESGCMKeyGenerator iPhoneXSMaxUserAgent".split()
    assert [n for n in names if secrets.scan(f"the token function {n} stays; the secret")] == []
    assert sum(any(k == 3 for _, k, _ in secrets.scan(t)) for t in documents.values()) <= 0.005 * len(documents)


def test_novel_secrets_with_signs_inside():
    for value in ("aB3dE5g7=H9jK1mN3p", "aB3dE5g7=H9jK1mN3pQ5rS7tU9vW1", "Qx7vLm2Rt9Zb4K==="):
        assert value[:7] not in secrets.redacted(f"the session {value}", secrets.scan(f"the session {value}"))


@pytest.mark.parametrize("text", ["key_" * 100_000 + VALUE, "key=a1" * 60_000, "key-" + "=" * 200_000 + VALUE])
def test_long_runs_are_read_once(text):
    assert all(0 <= a < b <= len(text) for a, _, b in secrets.scan(text))


def test_few_texts_of_a_language_do_not_judge_themselves(spark, documents):
    rng = random.Random(8)
    junk = lambda: " ".join("".join(rng.choice("#*$%&|<>{}~^") for _ in range(6)) for _ in range(120))
    english = [t for t in documents.values() if 400 < len(t) < 3000][:60]
    rows = [(k, t, "en") for k, t in enumerate(english)] + [(1000, junk(), "xx"), (1001, junk(), "yy"), (1002, junk(), "yy"), (1003, junk(), None), (1004, junk(), "en")]
    rows += [(2000 + k, t, "few") for k, t in enumerate(english[:2])]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(got[k]["base_failed"] or got[k]["kept"] for k in range(1000, 1005))
    assert [got[2000 + k]["kept"] for k in range(2)] == [got[k]["kept"] for k in range(2)]
    alone = quality.judge(spark.createDataFrame(rows[-1:], "doc_id long, text string, lang string")).collect()
    assert alone[0]["kept"] or alone[0]["base_failed"]


def test_op9(spark, sf, documents):
    got = rows(spark, sf, "op9_quality")
    labels = dict(zip(*(pq.read_table(f"{sf}/labels.parquet").to_pydict()[c] for c in ("doc_id", "quality")), strict=True))
    for i, t in documents.items():
        w = WORD.findall(t)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeated = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(repeated) > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    # The verdict by hand: medians of the shares, by language, and distances to them.
    langs = dict(zip(*(pq.read_table(f"{sf}/documents.parquet").to_pydict()[c] for c in ("doc_id", "lang")), strict=True))
    shares = {}
    for i, t in documents.items():
        *_, classes, common = quality.features(t)
        ok = not got[i]["base_failed"]
        shares[i] = tuple(np.array(c) / sum(c) if guard and ok and sum(c) else None for c, guard in ((classes, got[i]["word_chars"] >= quality.GUARD_CHARS), (common, got[i]["n_words"] >= quality.GUARD_WORDS)))

    def median(values):
        bins = sorted(math.floor(v * quality.BINS + 0.5) for v in values)
        return bins[(len(bins) - 1) // 2]

    def js(p, q):
        p, q = p / p.sum(), q / q.sum()
        part = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)
        return math.sqrt(max(0.0, (part(p, q) + part(q, p)) / 2))

    for lang in set(langs.values()):
        of = [i for i in documents if langs[i] == lang]
        for side, column in ((0, "class_distance"), (1, "word_distance")):
            known = [shares[i][side] for i in of if shares[i][side] is not None]
            if len(known) < quality.LEAST_TEXTS:
                known = [s[side] for s in shares.values() if s[side] is not None]
            reference = np.array([median(v) for v in zip(*known, strict=True)], float) if known else None
            for i in of:
                if shares[i][side] is not None:
                    assert math.isclose(got[i][column], js(shares[i][side], reference), rel_tol=1e-6, abs_tol=1e-9)
    for r in got.values():
        limits = r["class_distance"] <= quality.MOST_CHARS + quality.SHORT_CHARS / math.sqrt(max(r["word_chars"], 1)) and r["word_distance"] <= quality.MOST_WORDS
        assert r["kept"] == (not r["base_failed"] and limits)
    clean = [got[i]["kept"] for i, q in labels.items() if q == 1 and not got[i]["base_failed"]]
    junk = [got[i]["kept"] for i, q in labels.items() if q == 0]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.15


def test_repeats_with_many_words():
    rng = random.Random(5)
    words = [rng.randrange(9000) for _ in range(12_000)] + list(range(40)) + list(range(40))
    place: dict[int, int] = {}
    ids = np.array([place.setdefault(w, len(place)) for w in words])
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    assert quality.repeated_words(ids, len(place)) == len({j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)})


INSULTS = ["idiot", "moron", "scumbag", "pathetic"]


def learned(spark, texts, labels):
    """A model of texts whose ids are none that is held out."""
    ids = [k for k in range(3 * len(texts)) if zlib.crc32(str(k).encode()) % 5][: len(texts)]
    rows = list(zip(ids, texts, labels, strict=True))
    return toxicity.train(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))


def prose(insults, rng, words, n=300, length=60):
    texts = []
    for k in range(n):
        text = [rng.choice(words) for _ in range(length)]
        if k % 3 == 0:
            text[rng.randrange(length)] = rng.choice(insults)
        texts.append(" ".join(text) + ".")
    return texts, [int(k % 3 == 0) for k in range(n)]


def test_toxicity_learns_and_tolerates(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice(["the", "an", "ti", "re", "er", "on", "ou", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    texts, labels = prose(INSULTS, rng, words)
    scorer = toxicity.Scorer(learned(spark, texts[:240], labels[:240]))
    got = scorer.scores(texts[240:])
    assert np.mean([(s >= 0.5) == bool(y) for s, y in zip(got, labels[240:], strict=True)]) > 0.95
    odd = scorer.scores(["you idiot", "you i-d-i-o-t", "idi0t", "scumbbag", "p.a.t.h.e.t.i.c", "i d i o t", "the weather", ""])
    assert min(odd[:6]) > 0.5 > max(odd[6:])


def test_insults_of_two_words(spark):
    """Clean words that are an insult together, in this order, with characters inserted, too."""
    rng = random.Random(3)
    words = ["".join(rng.choice(["the", "an", "ti", "re", "er", "on", "ou", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(300)] + ["drop", "dead"] * 12
    texts, labels = prose(["drop dead"], rng, words, 450, 40)
    scorer = toxicity.Scorer(learned(spark, texts, labels))
    odd = scorer.scores(["now drop dead all", "dr-op de.ad", "now drop all", "dead tired", "dead drop", "the weather"])
    assert min(odd[:2]) > 0.5 > max(odd[2:])


def test_other_alphabets(spark):
    """Words of another script are different words, and its insults are learned."""
    kernel = lambda a, b: float(toxicity.similarity(toxicity.codes(a), toxicity.embedded(toxicity.codes(b)))[0, 0])
    for a, b in (("привет", "собака"), ("日本語文字列", "機械学習入門"), ("한국어", "사람들"), ("שלום", "ברכה")):
        assert kernel(a, b) < 0.3 and kernel(a, a) > 0.99
    rng = random.Random(4)
    words = ["".join(rng.choice("аеиорстнвлкмд") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    texts, labels = prose(["негодяй", "мерзавец"], rng, words)
    odd = toxicity.Scorer(learned(spark, texts, labels)).scores(["ты негодяй", "мерз-авец", "привет собака", "日本語文字列"])
    assert min(odd[:2]) > 0.5 > max(odd[2:])


def test_kernel_is_exact():
    """The kernel against its definition: subsequences of three letters within SPAN places, normalised."""

    def features(t):
        out = Counter()
        for i in range(len(t)):
            for j in range(i + 1, min(len(t), i + toxicity.SPAN)):
                for k in range(j + 1, min(len(t), i + toxicity.SPAN)):
                    if t[i] and t[j] and t[k]:
                        out[t[i], t[j], t[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    tokens = [p for w in ("idiot", "banana", "i-d-i-o-t", "stupid", "aaaaaa") for p in toxicity.codes(w)]
    got = toxicity.similarity(tokens, toxicity.embedded(tokens))
    for i, a in enumerate(tokens):
        for j, b in enumerate(tokens):
            x, y = features(a), features(b)
            want = sum(v * y[k] for k, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            assert math.isclose(got[i, j], want, rel_tol=1e-4)


def test_op10(spark, sf):
    got = QUERIES["op10_toxicity"](spark, sf).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5)


def test_op10_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    toxic = dict(zip(*(pq.read_table(f"{sf}/labels.parquet").to_pydict()[c] for c in ("doc_id", "toxic")), strict=True))
    kept = [(r["predicted"], toxic[r["doc_id"]]) for r in QUERIES["op10_toxicity"](spark, sf).collect() if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    caught, left = [p for p, y in kept if y == 1], [1 - p for p, y in kept if y == 0]
    assert len(caught) > 50 and len(left) > 500 and np.mean(caught) > 0.8 and np.mean(left) > 0.96
    # A model that knows the share of toxic documents only calls none of them toxic.
    assert np.mean([p == y for p, y in kept]) > np.mean([y == 0 for _, y in kept]) + 0.05


def plain_mix(spark, docs):
    """Words taken of each (id, text, source): targets by water filling, seats over all blocks, quotas split over shards."""
    size = {i: len(WORD.findall(t)) for i, t, _ in docs}
    names = sorted({s for _, _, s in docs})
    whole = {s: sum(size[i] for i, _, x in docs if x == s) for s in names}
    weight = {s: mixing.WEIGHTS[k % len(mixing.WEIGHTS)] for k, s in enumerate(names)}
    want, left = {}, mixing.SHARE * sum(whole.values())
    while over := [s for s in names if s not in want and weight[s] * left / sum(weight[x] for x in names if x not in want) > mixing.REPEATS * whole[s]]:
        for s in over:
            want[s] = float(mixing.REPEATS * whole[s])
        left = mixing.SHARE * sum(whole.values()) - sum(want.values())
    open_ = [s for s in names if s not in want]
    want |= {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
    seats = [0] * len(names)
    block = mixing.block_of([*want.values()])
    for _ in range(round(sum(want.values()) / block)):
        free = [k for k, s in enumerate(names) if seats[k] * block < mixing.REPEATS * whole[s]]
        if not free:
            break
        seats[max(free, key=lambda k: (want[names[k]] / (2 * seats[k] + 1), -k))] += 1
    shards = max(1, math.ceil(sum(whole.values()) / mixing.SHARD))
    ids = spark.createDataFrame([(i, t) for i, t, _ in docs], "i long, t string").selectExpr("i", f"xxhash64({mixing.SEED}, i, xxhash64(t)) as draw").selectExpr("i", "draw", f"pmod(xxhash64({mixing.SEED + 1}, draw), {shards}) as shard")
    place = {r["i"]: (r["shard"], r["draw"], r["i"]) for r in ids.collect()}
    taken = {}
    for k, s in enumerate(names):
        if not whole[s]:
            continue
        quota = min(seats[k] * block, mixing.REPEATS * whole[s])
        before = 0
        for shard in range(shards):
            of = sorted((i for i, _, x in docs if x == s and place[i][0] == shard), key=place.get)
            words = sum(size[i] for i in of)
            due = (before + words) * (quota % whole[s]) // whole[s] - before * (quota % whole[s]) // whole[s]
            before += words
            for i in of:
                taken[i] = size[i] * (quota // whole[s]) + min(size[i], due)
                due -= min(size[i], due)
    return size, taken


def test_pipeline_against_plain_stages(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    # The documents, with secrets in some of them.
    given = pq.read_table(f"{sf}/documents.parquet")
    table = given.to_pydict()
    table["text"] = [f"{t} signature={VALUE} password: hunter2hunter2" if k % 7 == 0 else t for k, t in enumerate(table["text"])]
    pq.write_table(given.set_column(given.schema.get_field_index("text"), given.schema.field("text"), [table["text"]]), tmp_path / "documents.parquet")
    pq.write_table(pq.read_table(f"{sf}/labels.parquet"), tmp_path / "labels.parquet")
    documents = dict(zip(table["doc_id"], table["text"], strict=True))
    source = dict(zip(table["doc_id"], table["source"], strict=True))
    labels = {i: y for i, y in zip(*(pq.read_table(f"{sf}/labels.parquet").to_pydict()[c] for c in ("doc_id", "toxic")), strict=True) if y is not None and zlib.crc32(str(i).encode()) % 5}
    scorer = toxicity.Scorer(toxicity.train(spark.createDataFrame(list(documents.items()), "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")))
    clean = {i: t for i, t in documents.items() if scorer.scores([t])[0] < 0.5}
    assert 0 < len(clean) < len(documents)
    _, roots = brute_components(clean)
    single = {i: t for i, t in clean.items() if roots[i] == i}
    assert len(single) < len(clean)
    safe = {i: secrets.redacted(t, secrets.scan(t)) for i, t in single.items()}
    assert safe != single
    size, taken = plain_mix(spark, [(i, t, source[i]) for i, t in safe.items()])
    tokenizer = Tokenizer.from_file(bpe.default_vocabulary())
    want = []
    for i, n in taken.items():
        texts = [safe[i]] * (n // max(size[i], 1)) + ([mixing.first_words(safe[i], n % size[i])] if n and n % size[i] else [])
        want += [(i, tuple(tokenizer.encode(t, add_special_tokens=False).ids)) for t in texts]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in got) == sorted(want)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    ran = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in ran.description]
    made = QUERIES[name](spark, sf)
    assert sorted(made.columns) == sorted(names)
    assert sorted(str([r[c] for c in names]) for r in made.collect()) == sorted(str(list(r)) for r in ran.fetchall())
