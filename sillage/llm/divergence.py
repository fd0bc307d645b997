"""Source divergence audit: how far apart the sources of a language are in their words, from joint histograms of counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sillage.llm.common import read, slices, stored

#: Documents of a language that a kept term is in at least, parts to which shares are counted, and ranks of the terms' report.
LEAST_DOCUMENTS, PARTS, RANKS = 3, 1_000_000_000, 200
#: Different terms that a task counts before it hands them on, and pairs of counts that it tallies at a time.
HELD, PAIRS = 200_000, 1 << 20

#: Bytes of UTF-8 to letters: A-Z lower-cased, a-z and all of other alphabets kept, the rest blank.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n occurrences, df documents, summed over what a task has read until HELD terms are held."""
    held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    size = 0

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            n, df = zip(*terms.values(), strict=True) if terms else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array([t.decode("utf-8", "replace") for t in terms], pa.string()), pa.array(n, pa.int64()), pa.array(df, pa.int64())], names=["lang", "source", "term", "n", "df"])

    for langs, sources, texts in slices(batches):
        for lang, source, text in zip(langs, sources, texts, strict=True):
            of = held.setdefault((lang, source), {})
            size -= len(of)
            for term, n in Counter(text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()).items():
                got = of.get(term)
                if got is None:
                    of[term] = [n, 1]
                else:
                    got[0] += n
                    got[1] += 1
            size += len(of)
            if size > HELD:
                yield from handed()
                held.clear()
                size = 0
    yield from handed()


def terms(docs: DataFrame) -> DataFrame:
    """lang, term, total, of (source, n): kept terms, their occurrences in the language and in each source that has them.

    Texts are counted where they lie; counts of a term and source meet in two sums, so a frequent term is a row for each task and source.
    What is gathered in a row is the sources of one term.
    """
    counted = docs.mapInArrow(_count, "lang string, source string, term string, n long, df long")
    by_source = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("of"))
    return by_term.where(F.col("df") >= LEAST_DOCUMENTS).drop("df")


def joint(codes: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Joint histograms of terms: a, b, n_a, n_b, times for pairs of sources a < b that both have a term.

    Terms lie one after the other, the codes of their sources ascending within each, sizes of them long. Terms of equal size are
    taken together, about PAIRS pairs at a time; a term of very many sources is paired by blocks of them.
    """
    ends = np.cumsum(sizes)
    ranks, rank = np.unique(counts, return_inverse=True)
    n_codes, n_ranks = int(codes.max(initial=0)) + 1, len(ranks)
    for m in np.unique(sizes[sizes > 1]).tolist():
        first = (ends - sizes)[sizes == m]
        step = max(1, PAIRS // (m * m))
        rows = max(1, PAIRS // m)
        for at in range(0, len(first), step):
            place = first[at : at + step, None] + np.arange(m)[None, :]
            for low in range(0, m - 1, rows):
                i, j = np.nonzero(np.arange(low, min(m - 1, low + rows))[:, None] < np.arange(m)[None, :])
                left, right = place[:, i + low].ravel(), place[:, j].ravel()
                keys = np.stack([codes[left] * n_codes + codes[right], rank[left] * n_ranks + rank[right]])
                found, times = _distinct(keys)
                yield found[0] // n_codes, found[0] % n_codes, ranks[found[1] // n_ranks], ranks[found[1] % n_ranks], times


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of two rows of numbers, and how often each is there."""
    order = np.lexsort(keys)
    ordered = keys[:, order]
    new = np.concatenate([[True], (ordered[:, 1:] != ordered[:, :-1]).any(axis=0)])
    starts = np.flatnonzero(new)
    return ordered[:, starts], np.diff(np.append(starts, len(order)))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, a, b (sources), n_a, n_b, times of terms (lang, of). Each list of sources is sorted by source."""
    for whole in batches:
        for at in range(0, whole.num_rows, 16_384):
            batch = whole.slice(at, 16_384)
            langs, lang = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            names, code = np.unique(np.array(flat.field(0).to_pylist(), object), return_inverse=True)
            # A source of a language is one number, and numbers of a language ascend with its sources.
            own, code = np.unique(np.repeat(lang, sizes) * len(names) + code, return_inverse=True)
            for a, b, n_a, n_b, times in joint(code, flat.field(1).to_numpy(zero_copy_only=False), sizes):
                columns = [pa.array(x, pa.string()) for x in (langs[own[a] // len(names)], names[own[a] % len(names)], names[own[b] % len(names)])]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (n_a, n_b, times))], names=["lang", "a", "b", "n_a", "n_b", "times"])


def share(count: str, total: str) -> Column:
    """1 + floor(PARTS * (count + 1) / total), exact however large the counts: decimals where a long would overflow."""
    return F.expr(f"1 + case when {count} < 9000000000 then {PARTS}L * ({count} + 1) div {total} else cast({PARTS} as decimal(10, 0)) * cast({count} + 1 as decimal(20, 0)) div cast({total} as decimal(20, 0)) end")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def _groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, v (kept terms of the language), own (those the source has), total and lang_total: what shares are parts of."""
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n"))
    by_source = kept.select("lang", F.explode("of").alias("x")).groupBy("lang", "x.source").agg(F.count("*").alias("own"), F.sum("x.n").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    groups = docs.select("lang", "source").distinct().join(by_lang.withColumnRenamed("n", "lang_n"), "lang", "left").join(by_source, ["lang", "source"], "left")
    return groups.select("lang", "source", zero("v").alias("v"), zero("own").alias("own"), zero(F.col("n") + F.col("v")).alias("known"), zero(F.col("lang_n") + F.col("v")).alias("lang_total")).withColumn("total", F.when(F.col("own") > 0, F.col("known")).otherwise(F.col("v"))).drop("known")


def pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for every two sources of a language, both ways round.

    For two sources a < b the kept terms are tallied by (count in a, count in b). Terms that both have are tallied where they
    lie; the cells with a zero follow from how many terms each source has at a count, less those tallied. Then a share and a
    divergence is worked out once for each cell, times the terms in it. Rows grow with pairs of sources, as the result does.
    """
    both = kept.select("lang", F.sort_array("of").alias("of")).mapInArrow(_tally, "lang string, a string, b string, n_a long, n_b long, times long")
    both = stored(both.groupBy("lang", "a", "b", "n_a", "n_b").agg(F.sum("times").alias("times")), "tallied")
    side = lambda c: groups.select("lang", F.col("source").alias(c), "v", F.col("own").alias(f"own_{c}"), F.col("total").alias(f"total_{c}"))
    met = stored(side("a").join(side("b").drop("v"), "lang").where("a < b"), "pairs")
    hist = stored(kept.select("lang", F.explode("of").alias("x")).groupBy("lang", "x.source", "x.n").agg(F.count("*").alias("times")), "histograms")
    none = F.lit(0).cast("long")
    cell = lambda n_a, n_b, times: ["lang", "a", "b", n_a.alias("n_a"), n_b.alias("n_b"), times.alias("times")]
    n_a, n_b, times = F.col("n_a"), F.col("n_b"), F.col("times")
    of_a, of_b = (met.select("lang", "a", "b").join(hist.withColumnRenamed("source", c), ["lang", c]) for c in "ab")
    zeros = both.select(*cell(n_a, none, -times))
    for more in (both.select(*cell(none, n_b, -times)), both.select(*cell(none, none, times)), of_a.select(*cell(F.col("n"), none, times)), of_b.select(*cell(none, F.col("n"), times)), met.select(*cell(none, none, F.expr("v - own_a - own_b")))):
        zeros = zeros.union(more)
    zeros = zeros.groupBy("lang", "a", "b", "n_a", "n_b").agg(F.sum("times").alias("times")).where("times <> 0")
    shared = both.union(zeros).join(met, ["lang", "a", "b"]).withColumns({"p": share("n_a", "total_a"), "q": share("n_b", "total_b")})
    values = shared.groupBy("lang", "a", "b").agg(F.sum(F.col("times") * divergence("p", "q")).alias("ab"), F.sum(F.col("times") * divergence("q", "p")).alias("ba"))
    whole = met.select("lang", "a", "b").join(values, ["lang", "a", "b"], "left")
    ways = F.explode(F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item"), F.coalesce(x + y, F.lit(0)).alias("value")) for x, y in ("ab", "ba"))))
    return whole.select("lang", ways.alias("w")).select("lang", "w.source", "w.item", "w.value")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from each other one (part pair), and by which
    terms it stands out from its language (part term, RANKS at most of a source).

    Null texts, languages and sources are ''. A document is a row, so rows that repeat count each. Groups without terms, and languages
    without kept terms, have their pairs; an empty table gives no rows. Other columns are ignored.
    """
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    kept = stored(terms(given), "terms")
    groups = stored(_groups(given, kept), "groups")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    by_pair = pairs(kept, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    held = kept.select("lang", "term", "total", F.explode("of").alias("x")).select("lang", F.col("x.source").alias("source"), F.col("term").alias("item"), F.col("x.n").alias("n"), F.col("total").alias("n_lang"))
    shares = held.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"]).withColumns({"p": share("n", "total"), "q": share("n_lang", "lang_total")}).where("p > q")
    by_term = shares.select("lang", "source", F.lit("term").alias("part"), "item", divergence("p", "q").alias("value")).select("*", rank).where(F.col("rank") <= RANKS)
    return by_pair.union(by_term)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


OP12_SQL = rf"""
with given as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
found as (select row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from given),
kept as materialized (select lang, term, count(*) as n from found group by lang, term having count(distinct row) >= {LEAST_DOCUMENTS}),
langs as materialized (select lang, count(*) as v, sum(n) as total from kept group by lang),
sources as materialized (select distinct lang, source from given),
counted as materialized (select lang, source, term, count(*) as n from found join kept using (lang, term) group by all),
totals as materialized (select s.lang, s.source, coalesce(sum(n), 0) as total from sources s left join counted c on c.lang = s.lang and c.source = s.source group by all),
shares as materialized (select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + ({PARTS}::hugeint * (coalesce(c.n, 0) + 1)) // (s.total + v) as p, 1 + ({PARTS}::hugeint * (k.n + 1)) // (l.total + v) as of_lang
  from totals s join kept k using (lang) join langs l using (lang) left join counted c on c.lang = s.lang and c.source = s.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
both_parts as (select s.lang, s.source, 'pair' as part, t.source as item, coalesce(value, 0)::bigint as value from sources s join sources t on s.lang = t.lang and s.source <> t.source
  left join pairs p on p.lang = s.lang and p.source = s.source and p.item = t.source
  union all select lang, source, 'term', term, (((p - of_lang) * (p - of_lang)) // of_lang)::bigint from shares where n > 0 and p > of_lang)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from both_parts qualify part = 'pair' or rank <= {RANKS}
"""
