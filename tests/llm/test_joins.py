"""Operators 11 to 13 against brute force, on ties, blocks and rows that are null, empty, repeated or at odds with the rest."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sillage.llm import clustering, divergence, parity_join
from sillage.llm.shingles import shingle_sets

EXTRA = "id long, n long, th long, cluster int, key string, words string, band int, rank int, p long, term string"
_E = (1, 2, 3, 4, "k", "w", 5, 6, 7, "t")


# ---- parity join ------------------------------------------------------------------------------------------------------------


def shingled(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def linked_by_all_pairs(rows):
    sets = [shingled(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 90 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.random()}"
    return " ".join(words)


def test_join_is_that_of_all_pairs(spark):
    rng = random.Random(11)
    texts = []
    for size in (3, 9, 10, 11, 19, 20, 21, 40, 120, 400):
        base = [f"b{size}_{k}" for k in range(size)]
        texts += [" ".join(base), " ".join(base).upper(), " ".join(base[:-1])]
        texts += [edited(rng, base, min(size, n)) for n in (0, 1, 1, 2, 3, 5, 8, size // 60, size // 30, size // 20)]
    texts += ["", None, "a", "A", "a b", " ", "x y z", "x  y\tz"]
    rows = list(enumerate(texts))
    got = parity_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == linked_by_all_pairs(rows)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(0, 20), st.integers(0, 20), st.integers(0, 2**31))
def test_sketches_bound_differences_and_links_share_keys(shared, only_a, only_b, seed):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**63, shared + only_a + only_b, dtype=np.uint64) * np.uint64(2))
    rng.shuffle(pool)
    a, b = np.sort(np.concatenate([pool[:shared], pool[shared : shared + only_a]])), np.sort(np.concatenate([pool[:shared], pool[shared + only_a :]]))
    differ = len(np.setxor1d(a, b))
    k = parity_join.band(max(len(a), len(b)), parity_join.BANDS)
    most = parity_join.most(k, parity_join.BANDS)
    parts = int(parity_join.SPARE * (most + 1))
    x, y = parity_join.bits(a, parts), parity_join.bits(b, parts)
    assert int(np.bitwise_count(x ^ y).sum()) <= differ
    union = (len(a) + len(b) + differ) // 2
    if 100 * (union - differ) >= 90 * union and differ:
        assert differ <= parity_join.allowed(len(a), len(b)) <= most
        one, two = parity_join.digests(a, parts, most), parity_join.digests(b, parts, most)
        assert (x == y).sum() >= parts - most and ((one == two) & (one != 0)).any()
        for s in (a, b):
            assert k in parity_join.sketches(s, 90)[0]


def test_a_large_group_is_not_paired_with_itself(spark, monkeypatch):
    """Copies that link through a shared original, and as many that are too far from it: pairs tried grow with documents."""
    tried = []
    kept = parity_join.stored

    def counted(df, tag):
        made = kept(df, tag)
        if tag in ("pairs", "across"):
            tried.append(made.count())
        return made

    monkeypatch.setattr(parity_join, "stored", counted)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(400)]
    rows = [(0, " ".join(base))] + [(k, edited(rng, base, 3 if k % 2 else 20)) for k in range(1, 401)]
    got = {r["doc_id"]: r["component_id"] for r in parity_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(got.items()) == [(i, c) for i, _, c in linked_by_all_pairs(rows)]
    assert sum(c == 0 for c in got.values()) > 200
    heads, across, both = tried
    assert heads < 20 * len(rows) and across < len(rows) and both < 10 * len(rows)


def test_join_edges(spark):
    long = " ".join(f"w{k % 977}" for k in range(40_000))
    rows = [(1, "one two three four"), (1, "one two three four"), (2, None), (None, "one two three four"), (3, ""), (4, long), (5, long + " end"), (1, "other words"), (6, "OTHER words")]
    docs = spark.createDataFrame([(*r, *_E) for r in rows], f"doc_id long, text string, {EXTRA}")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in parity_join.join(docs).collect()), key=str)
    n = len(shingle_sets([long], 3)[0])
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 0, 2), (None, 2, None), (3, 0, 3), (4, n, 4), (5, n + 1, 4), (1, 1, 1), (6, 1, 1)], key=str)
    assert parity_join.join(docs.limit(0)).count() == 0


# ---- divergence -------------------------------------------------------------------------------------------------------------


def audited(rows, ranks=divergence.RANKS):
    by_doc = [((lang or ""), (source or ""), Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in by_doc}:
        mine = [d for d in by_doc if d[0] == lang]
        df = Counter(t for d in mine for t in d[2])
        kept = sorted(t for t, n in df.items() if n >= 3)
        counts = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, c in mine:
            counts[s].update({t: n for t, n in c.items() if df[t] >= 3})
        whole = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))  # noqa: B023, E731
        f = lambda x, y: (x - y) ** 2 // y
        for s, c in counts.items():
            pair = [("pair", o, sum(f(p(c, t), p(counts[o], t)) for t in kept)) for o in counts if o != s]
            term = [("term", t, f(p(c, t), p(whole, t))) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, most in ((pair, len(pair)), (term, ranks)):
                out += [(lang, s, *x, k) for k, x in enumerate(sorted(part, key=lambda x: (-x[2], x[1].encode())), 1) if k <= most]
    return sorted(out)


def given_rows(seed, n, sources):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "GAMMA", "é", "É", "naïve", "中文", "x", "_y_", "z9z", "�"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    return [(" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 40]))), rng.choice(["en", "de", None, ""]), rng.choice([*sources, None])) for _ in range(n)]


@pytest.mark.parametrize("pairs", [1 << 20, 8])
def test_divergence_is_that_of_every_term(spark, monkeypatch, pairs):
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    rows = [*given_rows(3, 300, "abcdefg"), ("only here, only once", "xx", "a"), (None, "xx", "b"), ("!", "yy", "a"), ("same same", "zz", "a"), ("same", "zz", "a"), ("same", "zz", "a")]
    docs = spark.createDataFrame([(*r, *_E) for r in rows], f"text string, lang string, source string, {EXTRA}")
    got = sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(docs).collect())
    assert got == audited(rows)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_term_report_ends_at_its_ranks(spark):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(1200)]
    rows = [(" ".join(words), "en", "b")] * 3 + [(" ".join(w for k, w in enumerate(words) for _ in range(k % 7 + 1)), "en", "a")] * 2
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(docs).collect())
    assert got == audited(rows) and max(g[-1] for g in got) == 200


def test_joint_histograms_count_every_pair(monkeypatch):
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 9, 200)
    codes = np.concatenate([np.sort(rng.choice(12, n, replace=False)) for n in sizes])
    counts = rng.integers(1, 5, len(codes))
    want, at = Counter(), 0
    for n in sizes.tolist():
        row = list(zip(codes[at : at + n].tolist(), counts[at : at + n].tolist(), strict=True))
        want.update((x[0], y[0], x[1], y[1]) for x, y in combinations(row, 2))
        at += n
    for pairs in (1 << 20, 64, 3):
        monkeypatch.setattr(divergence, "PAIRS", pairs)
        got = Counter()
        for a, b, n_a, n_b, times in divergence.joint(codes, counts, sizes):
            for key, n in zip(zip(a.tolist(), b.tolist(), n_a.tolist(), n_b.tolist(), strict=True), times.tolist(), strict=True):
                got[key] += n
        assert got == want


def test_shares_are_exact(spark):
    rows = [(0, 1), (5, 11), (8_999_999_999, 9_000_000_007), (9_000_000_000, 9_000_000_007), (10**15, 3 * 10**15 + 1)]
    got = spark.createDataFrame(rows, "c long, t long").select("c", "t", divergence.share("c", "t").alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 1) // r["t"] for r in got)


# ---- clustering -------------------------------------------------------------------------------------------------------------


def clustered(rows, k, rounds, seed="1:"):
    rows = [(i, [int(np.floor(64 * x)) for x in map(float, v)]) for i, v in rows]
    centres = [v for _, v in sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in rows]
        centres = [[sum(x) // len(x) for x in zip(*m, strict=True)] if (m := [v for (_, v), c in zip(rows, of, strict=True) if c == n]) else centres[n] for n in range(len(centres))]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in rows), key=str), centres


def test_annulus_is_exact_on_ties_and_edges():
    rng = np.random.default_rng(7)
    for spread in (2, 3, 50, 4000):
        centroids = rng.integers(-spread, spread + 1, (40, 3))
        centroids[7] = centroids[31]
        x = rng.integers(-spread, spread + 1, (700, 3))
        x[:40] = centroids
        d = ((x[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
        for last in (np.full(len(x), -1), rng.integers(0, 40, len(x)), d.argmin(axis=1)):
            nearest, distance, compared = clustering.annulus(x, last, centroids)
            assert (nearest == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
            if spread == 4000 and (last == d.argmin(axis=1)).all():
                assert compared.mean() < 0.6 * len(centroids)


@pytest.mark.parametrize(("n", "k"), [(120, 7), (5, 16), (1, 3)])
def test_clusters_are_those_of_plain_rounds(spark, n, k):
    rng = np.random.default_rng(n)
    rows = [(i if i % 9 else None if i else 0, [float(x) for x in rng.integers(-3, 4, 4) / 64 + (i % 3)]) for i in range(n)]
    rows += rows[: n // 10]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    made = clustering.cluster(clustering.whole_vectors(vectors, 4), 4, k, 3)
    want, centres = clustered(rows, k, 3)
    got = clustering.summed(made).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == want
    assert made.centroids.tolist() == centres
    assert {r["inertia"] for r in got} == {sum(w[2] for w in want)}
    assert all(r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"]) for r in got)


def test_vectors_that_do_not_fit_drop_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.01]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, inf]), (8, [-inf, 0.0]), (9, [1.0, 2.0, 3.0]), (None, [0.0, 0.0])]
    vectors = spark.createDataFrame([(*r, *_E) for r in rows], f"vec_id long, embedding array<float>, {EXTRA}")
    kept = clustering.whole_vectors(vectors, 2)
    assert sorted(((r["vec_id"], r["v"]) for r in kept.collect()), key=str) == [(1, [32, -1]), (None, [0, 0])]
    assert clustering.cluster(kept.limit(0), 2).placed.count() == 0
    with pytest.raises(Exception, match="beyond"):
        clustering.whole_vectors(spark.createDataFrame([(1, [3e9, 0.0])], "vec_id long, embedding array<float>"), 2).collect()
    assert clustering.summed(clustering.cluster(kept.where(F.lit(False)), 2)).count() == 0
