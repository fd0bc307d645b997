"""Trees, chunks, segments, links and e-mails on hand-made pages."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from sillage.functions import html as H
from sillage.functions import segments as S
from sillage.functions import urls as U
from sillage.operators import pages as P


def words(n, tag="w"):
    return " ".join(f"{tag}{k}" for k in range(n))


def test_unclosed_tags_nest():
    root = H.tree("<p>a<p>b</p>c<b>d</x>e")
    outer = root.children[0]
    assert outer.name == "p" and outer.children[0] == "a" and outer.children[1].text() == "b" and outer.text() == "a b c d e"


def test_removed_elements_and_unseen_strings():
    assert H.cleaned(H.tree("<nav>x</nav><div>a<script>y</script><style>z</style><!-- c --></div><footer>f</footer>")).text() == "a"


def test_sections_by_heading():
    page = f"<body><h1>One</h1><p>{words(5)}</p><h2>Two</h2><p>{words(6)}</p><div><p>{words(7)}</p></div><h1>Three</h1><p>{words(3)}</p><p>{words(8)}</p><h3>Four</h3><li>{words(4)}</li></body>"
    got = [(path, [len(w) for w, _ in blocks]) for path, blocks in H.sections(H.tree(page))]
    assert got == [(["One"], [5, 6]), (["One", "Two"], [6]), (["Three"], [8, 4]), (["Three", "Four"], [4])]


def test_pages_without_headings_repeat_nested_blocks():
    got = list(H.sections(H.tree(f"<table><tr><td>{words(4)}</td><td>{words(5)}</td></tr></table>")))
    assert [len(w) for w, _ in got[0][1]] == [12, 4, 5]


def test_tables():
    assert H.table_text(H.tree("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>")) == "| a | b |\n| --- | --- |\n| 1 | 2 |"


def test_windows():
    sizes = lambda *blocks: [len(w) for w, _ in H.windows([(["x"] * n, []) for n in blocks])]
    assert sizes(10) == [10]
    assert sizes(200, 200) == [200, 250]
    assert sizes(350) == [350, 50]
    assert sizes(1000) == [1000, 50]
    assert sizes(40, 340) == [40, 340]
    assert sizes(300, 50) == [350, 50]


def test_links_carry_over():
    link = lambda k: {"anchor_text": str(k), "target": "t"}
    got = [[a["anchor_text"] for a in links] for _, links in H.windows([(["x"] * 300, [link(k) for k in range(5)]), (["x"] * 100, [link(9)])])]
    assert got == [["0", "1", "2", "3", "4"], ["2", "3", "4", "9"]]


def test_chunks_fall_back_to_the_whole_text():
    got = H.chunks("u", "<body><div>just <b>this</b></div></body>")
    assert [(c["text"], c["length"], c["hierarchy"]) for c in got] == [("just this", 2, [])]
    assert H.chunks("u", "") == []


def test_links():
    page = '<nav><a href="/a#x">A <b>b</b></a></nav><a href="/a">again</a><a href="mailto:x@y">m</a><a>none</a><a href="https://o/p?q">o</a>'
    assert H.links(page, "http://h/d/") == [{"target": "http://h/a", "anchor_text": "Ab", "source_chunk": "chunk_0"}, {"target": "https://o/p?q", "anchor_text": "o", "source_chunk": "chunk_1"}]


def test_emails():
    hidden = "42" + "".join(f"{ord(c) ^ 0x42:02x}" for c in "me@example.com")
    assert H.shown_emails(f'<span class="__cf_email__" data-cfemail="{hidden}">x</span><span class="__cf_email__" data-cfemail="zz">y</span>') == {hidden: "me@example.com"}


def stated(text, most):
    """Segmentation said once more, plainly."""
    if S.estimate(text) <= most:
        return [text]
    out, held = [], []

    def close():
        joined = "\n\n".join(held).strip()
        if joined:
            out.append(joined)
        held.clear()

    def take(piece):
        if sum(map(S.estimate, held)) + S.estimate(piece) > most:
            close()
        held.append(piece)

    for paragraph in re.split(r"\n{2,}", text):
        if S.estimate(paragraph) <= most:
            take(paragraph)
            continue
        for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
            if S.estimate(sentence) <= most:
                take(sentence)
                continue
            for cut in S.cuts(sentence, most):
                if S.estimate(cut) > most:
                    out.append(cut)
                else:
                    take(cut)
        close()
    close()
    return out


def test_segments():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["word ", "x" * 300, ". ", "! ", "\n\n", "\n\n\n", "é ", "long " * 40]) for _ in range(rng.randint(0, 40)))
        assert S.segments(text, 50) == stated(text, 50)


def test_rows_survive_bad_ones(spark):
    pages = spark.createDataFrame([("u1", "<p>one two three four five</p>", "t"), ("u2", None, None), (None, "<p>a b c d", "t"), ("u3", "<" * 500, "t")], "url string, html string, crawled_at string")
    got = P.chunks(pages).collect()
    assert {r["url"] for r in got} >= {"u1", None} and [r["text"] for r in got if r["url"] == "u1"] == ["one two three four five"]
    assert P.chunks(pages.limit(0)).count() == 0


def test_deep_pages_do_not_recurse(spark):
    assert len(H.chunks("u", "<div>" * 20_000 + f"<p>{words(9)}")) == 1


def test_internal_addresses_are_those_of_the_standard_library(spark):
    """Against the address classes of ipaddress, over edges of networks and random addresses."""
    import ipaddress
    import random

    rng = random.Random(1)
    hosts = [".".join(str(rng.choice([0, 1, 10, 100, 127, 128, 169, 172, 192, 198, 203, 224, 239, 240, 255, rng.randrange(256)])) for _ in range(4)) for _ in range(300)]
    hosts += ["172.15.255.255", "172.16.0.0", "172.31.255.255", "172.32.0.0", "192.0.1.0", "192.0.3.0", "198.17.0.0", "198.18.0.0", "198.19.9.9", "198.20.0.0", "169.253.1.1", "192.168.0.1", "192.169.0.1", "01.2.3.4", "1.2.3", "256.1.1.1"]
    hosts += ["[::1]", "[::]", "[fe80::1]", "[fc00::1]", "[fd12::9]", "[ff02::1]", "[2001:db8::1]", "[2606:4700::1111]", "[2a00:1450:4001::5]", "[::ffff:10.0.0.1]", "[64:ff9b:1::1]", "[3ffe::1]"]
    rows = spark.createDataFrame([(h, f"http://u:p@{h}:80/x") for h in hosts], "h string, url string")
    for r in rows.select("h", U.is_internal(F.col("url")).alias("got")).collect():
        try:
            a = ipaddress.ip_address(r["h"].strip("[]"))
        except ValueError:
            assert not r["got"], r["h"]
            continue
        assert r["got"] == (a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast), r["h"]


def test_unreadable_pages(spark):
    pages = spark.createDataFrame([("http://a", "<p>one two three four <![x[ y"), ("http://b", None)], "url string, html string")
    assert {r["url"]: r["text"] for r in P.texts(pages).collect()} == {"http://a": "one two three four <![x[ y", "http://b": ""}
    assert P.unreadable(pages).count() == 0 and P.chunks(pages).count() == 1
