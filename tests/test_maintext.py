"""Main text against plain Python over all pages, and runs of text of hand-made pages."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from sillage.functions import html as H
from sillage.operators import maintext
from sillage.queries import QUERIES


def plain(pages):
    site = lambda u: (u or "").split("://", 1)[-1].split("/")[0].split("?")[0].split("#")[0].lower()
    runs = {k: H.text_blocks(h or "") for k, (_, h) in enumerate(pages)}
    n_pages = Counter(site(u) for u, _ in pages)
    seen = defaultdict(int)
    for k, (u, _) in enumerate(pages):
        for t in {r["text"].lower() for r in runs[k]}:
            seen[(site(u), t)] += 1
    out = []
    for k, (u, _) in enumerate(pages):
        fine = [not r["around"] and r["linked"] <= 0.33 * r["words"] and not ((n := seen[(site(u), r["text"].lower())]) >= 3 and n >= 0.1 * n_pages[site(u)]) for r in runs[k]]
        long = [f and r["words"] >= 10 for f, r in zip(fine, runs[k], strict=True)]
        kept = [lo or (f and (long[n - 1 : n] == [True] or long[n + 1 : n + 2] == [True])) for n, (f, lo) in enumerate(zip(fine, long, strict=True))]
        out.append(("\n\n".join(r["text"] for r, y in zip(runs[k], kept, strict=True) if y), len(runs[k]), sum(kept)))
    return out


def test_runs_of_a_page():
    page = "<html><head><title>T</title><style>x</style></head><body><nav><a href=/>Home</a> | <a href=/b>B</a></nav><h1>The <b>big</b> head</h1><div>one two<p>three <a href=x>four five</a></div><ul><li>a<li>b</ul>tail<script>no</script></body>"
    got = [(r["text"], r["words"], r["linked"], r["around"], r["heading"]) for r in H.text_blocks(page)]
    assert got == [("Home | B", 3, 2, True, False), ("The big head", 3, 0, False, True), ("one two", 2, 0, False, False), ("three four five", 3, 2, False, False), ("a", 1, 0, False, False), ("b", 1, 0, False, False), ("tail", 1, 0, False, False)]
    assert H.text_blocks("") == [] and H.text_blocks("<p>" * 3000 + "deep")[0]["text"] == "deep"


def test_all_pages(spark, sf):
    t = pq.read_table(f"{sf}/pages.parquet").to_pydict()
    want = dict(zip(t["page_id"], plain(list(zip(t["url"], t["html"], strict=True))), strict=True))
    got = {r["page_id"]: (r["digest"], r["n_runs"], r["n_kept"]) for r in QUERIES["main_texts"](spark, sf).collect()}
    assert got == {k: (hashlib.md5(w[0].encode()).hexdigest(), *w[1:]) for k, w in want.items()}
    assert sum(w[2] for w in want.values()) > 0 and any(w[1] > w[2] for w in want.values())


def test_what_a_site_repeats_goes(spark):
    said = "these words are on every page of this site and say nothing of it"
    own = "words of page {} alone that are many enough to stand for themselves here"
    rows = [(f"http://s/{k}", f"<body><div>{said}</div><h2>Head {k}</h2><p>{own.format(k)}</p><p>short {k}</p><div><a href=x>{said} link</a></div><footer>{own} foot</footer></body>", k) for k in range(5)]
    rows += [("http://other/", f"<p>{said}</p>", 9), (None, None, 10), ("http://s/x", "", 11), ("http://s/0", rows[0][1], 0)]
    pages = spark.createDataFrame(rows, "url string, html string, text long")
    got = sorted((r["url"] or "", r["text"]) for r in maintext.main_texts(pages).collect())
    assert got == sorted((u or "", p[0]) for (u, _, _), p in zip(rows, plain([r[:2] for r in rows]), strict=True))
    assert dict(got)["http://s/1"] == f"Head 1\n\n{own.format(1)}\n\nshort 1" and dict(got)["http://other/"] == said
    assert maintext.main_texts(pages.limit(0)).count() == 0
