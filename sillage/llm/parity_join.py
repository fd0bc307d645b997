"""N-gram Jaccard join by parity sketches: XOR-hashed sets whose Hamming distance is no more than their symmetric difference.

A set's shingles fall into parts of the hash space. Each part keeps a word of bits, in which every shingle toggles one, so that words
of two sets differ in no more bits, and in no more parts, than the sets' symmetric difference has members. Sets that are linked
differ in few, and with more parts than that some part of theirs is equal: linked sets always share a key. For keys a part's word
is as wide as the hash space, of which but the XOR of its places is kept; for distances, a byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sillage.llm.common import forget, read, slices, stored
from sillage.llm.components import components
from sillage.llm.near_dedup import texts_of
from sillage.llm.shingles import U, fingerprint, mix, shingle_sets

#: Words in a shingle, and least similarity of a link: 100 * intersection >= PERCENT * union.
WIDTH, PERCENT = 3, 90
#: Ratio of the bounds of neighbouring bands: of the sizes of sets, and of differences from a head.
BANDS, DIFFERENCES = 1.4, 1.25
#: Parts for each difference that a link may have, and members below which a part is thin: equal by chance in sets that have little in common.
SPARE, THIN = 1.15, 3

#: Members of a bucket that are tried each with each; of two, the only pair has been tried.
FEW = 4

_BIT = U(0xA0761D6478BD642F)


@lru_cache
def bounds(ratio: float) -> np.ndarray:
    """The least size of each band."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return np.array(out, np.int64)


def band(size: int, ratio: float) -> int:
    return int(np.searchsorted(bounds(ratio), size, "right")) - 1


def allowed(a: int, b: int, percent: int = PERCENT) -> int:
    """The greatest symmetric difference of linked sets of these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


def most(k: int, ratio: float, percent: int = PERCENT) -> int:
    """allowed() for any pair whose larger set is in band k."""
    largest = int(bounds(ratio)[k + 1]) - 1
    return allowed(largest, largest, percent)


@lru_cache(maxsize=4096)
def _starts(parts: int) -> np.ndarray:
    return np.linspace(0, 2.0**64, parts, endpoint=False).astype(np.uint64)


def _xored(values: np.ndarray, members: np.ndarray, parts: int) -> np.ndarray:
    """The XOR of the values of the members in each part."""
    running = np.concatenate([np.zeros(1, values.dtype), np.bitwise_xor.accumulate(values)])
    at = np.append(np.searchsorted(members, _starts(parts)), len(members))
    return running[at[1:]] ^ running[at[:-1]]


def bits(members: np.ndarray, parts: int) -> np.ndarray:
    """The parity sketch of a set of sorted hashes: a byte for each part, in which every member toggles a bit."""
    return _xored(np.uint8(1) << (mix(members ^ _BIT) & U(7)).astype(np.uint8), members, parts)


def digests(members: np.ndarray, parts: int, most: int) -> np.ndarray:
    """Of each part's word of 2**64 bits the XOR of the places that are set: equal where sets are equal in a part and, but for a chance
    of 2**-64, nowhere else. 0 stands for a part that makes no key.

    Linked sets are equal in parts - most parts at least. A set with fewer thin parts than that is equal to each it is linked with in a part that
    isn't thin, so its thin ones make no key; a set with more keeps them all.
    """
    made = _xored(mix(members ^ _BIT), members, parts)
    made[made == 0] = 1
    thin = np.diff(np.append(np.searchsorted(members, _starts(parts)), len(members))) < THIN
    if thin.sum() < parts - most:
        made[thin] = 0
    return made


def sketches(members: np.ndarray, percent: int, ratio: float = BANDS) -> tuple[list[int], list[bytes], list[bytes]]:
    """The bands in which a set may be linked, by the size of the larger set of a pair, and its digests and bits for each. Bands whose
    links may not differ at all are left out: such sets are equal, and so one already."""
    n = len(members)
    if not n:
        return [], [], []
    limits = {k: m for k in range(band(n, ratio), band(n * 100 // percent, ratio) + 1) if (m := most(k, ratio, percent))}
    parts = {k: int(SPARE * (m + 1)) for k, m in limits.items()}
    return [*limits], [digests(members, parts[k], m).astype("<u8").tobytes() for k, m in limits.items()], [bits(members, x).tobytes() for x in parts.values()]


_MADE = "id long, th long, n long, fp1 long, fp2 long, bands array<int>, words array<binary>, bits array<binary>"


def _sketched(percent: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, texts in slices(batches, 64):
            sets = shingle_sets(texts, width)
            prints = [fingerprint(s) for s in sets]
            made = [sketches(s, percent) for s in sets]
            columns = [(ids, pa.int64()), (hashes, pa.int64()), ([len(s) for s in sets], pa.int64()), ([p[0] for p in prints], pa.int64()), ([p[1] for p in prints], pa.int64()), ([m[0] for m in made], pa.list_(pa.int32())), *(([m[k] for m in made], pa.list_(pa.binary())) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["id", "th", "n", "fp1", "fp2", "bands", "words", "bits"])

    return run


def _differences(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """head, id, c, n, d, h of (head, id, c, text_head, text): a set's size, its symmetric difference from the head's, and that one's members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for heads, ids, cs, texts_head, texts in slices(batches, 32):
            for head, k, c, s, t in zip(heads, ids, cs, texts_head, texts, strict=True):
                if last[0] != head:
                    last = (head, shingle_sets([s], width)[0])
                own = shingle_sets([t], width)[0]
                h = np.setxor1d(last[1], own, assume_unique=True)
                columns = [*(np.full(len(h), x, np.int64) for x in (head, k, c, len(own), len(h))), h.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["head", "id", "c", "n", "d", "h"])

    return run


#: A key of each part of a band's sketch.
_KEYS = "transform(filter(sequence(0, cast(length(words) / 8 as int) - 1), i -> substring(words, i * 8 + 1, 8) <> X'0000000000000000'), i -> xxhash64(band, i, substring(words, i * 8 + 1, 8)))"


def _close(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of pairs those whose sketches differ in no more bits than a link's sets may in members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, n_a, n_b, bands_a, bands_b, bits_a, bits_b in slices(batches, 512):
            keep = []
            for x, y, of_x, of_y, left, right in zip(n_a, n_b, bands_a, bands_b, bits_a, bits_b, strict=True):
                k = band(max(x, y), BANDS)
                fit = 100 * min(x, y) >= percent * max(x, y) and k in of_x and k in of_y
                keep.append(fit and int(np.bitwise_count(np.frombuffer(left[of_x.index(k)], np.uint8) ^ np.frombuffer(right[of_y.index(k)], np.uint8)).sum()) <= allowed(x, y, percent))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(percent: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of pairs those that are linked, by the full sets of whole texts. Rows of one a lie together, so that its set is made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for a, b, text_a, text_b in slices(batches, 64):
            keep = []
            for x, s, t in zip(a, text_a, text_b, strict=True):
                if last[0] != x:
                    last = (x, shingle_sets([s], width)[0])
                one, two = last[1], shingle_sets([t], width)[0]
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(bool(both) and 100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sided(df: DataFrame, c: str, *columns: str) -> DataFrame:
    return df.select(F.col("id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in columns))


def verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Of pairs (a, b) of reps those that are linked: first by the Hamming distance of sketches, then by their sets.

    Texts are fetched for those alone that the first test leaves. Both sides of every join are plain exchanges, so that a text
    with many partners is split over tasks.
    """
    met = pairs.join(_sided(reps, "b", "n", "bands", "bits"), "b").join(_sided(reps, "a", "n", "bands", "bits"), "a")
    close = stored(met.select("a", "b", "n_a", "n_b", "bands_a", "bands_b", "bits_a", "bits_b").mapInArrow(_close(percent), "a long, b long"), "close")
    wanted = stored(with_text(close.select(F.explode(F.array("a", "b")).alias("id")).distinct(), reps, texts), "wanted")
    both = close.join(_sided(wanted, "b", "text"), "b").join(_sided(wanted, "a", "text"), "a").select("a", "b", "text_a", "text_b")
    linked = stored(both.mapInArrow(_linked(percent, width), "a long, b long"), "linked")
    forget(close, wanted)
    return linked


def with_text(ids: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """id, text of some reps. Rows that repeat fold as they come sorted from the join."""
    named = reps.select("id", "doc", "th").join(ids, "id", "left_semi")
    return texts.withColumnRenamed("id", "doc").hint("merge").join(named.hint("merge"), ["doc", "th"]).groupBy("doc", "th").agg(F.max("id").alias("id"), F.max("text").alias("text")).select("id", "text")


def across(headed: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a, b) of headed (head, id, c) of one head and different c that may be linked; none that is linked is missing.

    Sets are compared by how they differ from their head: x and y differ in |X| + |Y| - 2 |X and Y| members, where X and Y are their differences
    from it. Where |X| + |Y| is no more than a link may differ, both are linked with the head and so of one c. All other links share
    members of X and Y, as many as that sum is above it, half of it at least. So differences are joined by their rarest
    members, by bands of their size; what a large group of copies has in common is in none of them, and is never joined on.
    """
    wanted = stored(with_text(headed.select(F.explode(F.array("head", "id")).alias("id")).distinct(), reps, texts), "wanted")
    both = headed.where("head <> id").join(wanted, "id").join(_sided(wanted, "head", "text"), "head").select("head", "id", "c", "text_head", "text")
    rows = stored(both.mapInArrow(_differences(width), "head long, id long, c long, n long, d long, h long"), "differences")
    frequent = stored(rows.groupBy("head", "h").agg(F.count("*").alias("df"), F.min("c").alias("least"), F.max("c").alias("greatest")).where("df > 1"), "frequent")
    by_rarity = Window.partitionBy("head", "id").orderBy(F.coalesce("df", F.lit(1)), "h")
    ranked = rows.join(frequent, ["head", "h"], "left").withColumn("place", F.row_number().over(by_rarity)).where("least <> greatest")
    d, n, step = F.col("d"), F.col("n"), float(np.log(DIFFERENCES))
    at = lambda size: F.floor(F.log(size) / step)
    most = F.floor((n + F.floor(n * 100 / percent)) * (100 - percent) / (100 + percent) + 1e-9)
    # A partner's difference is as large as this one's, give or take what a link may differ; of those in band q this is the least.
    fewest = F.greatest(d - most, F.lit(1))
    banded = ranked.withColumn("k", at(d)).withColumn("q", F.explode(F.sequence(at(fewest), at(d + most))))
    shared = F.greatest(F.ceil((d + F.greatest(fewest, F.floor(F.exp(F.col("q") * step))) - most) / 2), F.lit(1))
    rare = banded.where(F.col("place") <= d - shared + 1).select(F.xxhash64("head", "h", F.least("k", "q"), F.greatest("k", "q")).alias("key"), "id", "c", (F.col("k") <= F.col("q")).alias("low"), (F.col("k") >= F.col("q")).alias("high"))
    rare = stored(rare, "rare")
    mixed = stored(rare.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("greatest")).where("least <> greatest").select("key"), "mixed")
    kept = stored(rare.join(mixed, "key", "left_semi"), "kept")
    low, high = (kept.where(side).select("key", F.col("id").alias(f"id_{side}"), F.col("c").alias(f"c_{side}")) for side in ("low", "high"))
    met = low.join(high, "key").where("id_low <> id_high and c_low <> c_high")
    pairs = stored(met.select(F.least("id_low", "id_high").alias("a"), F.greatest("id_low", "id_high").alias("b")).distinct(), "across")
    forget(wanted, rows, frequent, rare, mixed, kept)
    return pairs


def met_across(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (key, id, c) of one key and different c."""
    left, right = (rows.select("key", F.col("id").alias(x), F.col("c").alias(f"c_{x}")) for x in "ab")
    return left.join(right, "key").where("a < b and c_a <> c_b").select("a", "b")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, component_id for every row of docs.

    Documents of equal sets are one class, and classes go on. Those that share a key are in one bucket; each bucket ties its
    members to the one that shares most keys, which is linear in its size. Where a bucket still spans components, its members
    are tried across these: each with each where they are FEW at most, else by how they differ from its head (see across). No link is lost: keys are
    shared by every linked pair, and no bucket is capped.

    Null and empty texts have no shingles and are linked with nothing, nor is a row without an id: component_id null.
    Repeated rows get equal results; rows of one id with different texts have the links of their own text. An empty table gives no rows.
    """
    texts = texts_of(docs, id_col, text_col)
    made = stored(texts.mapInArrow(_sketched(percent, width), _MADE), "sketches")
    sets = ["fp1", "fp2", "n"]
    classes = made.where("n > 0 and id is not null").groupBy(*sets).agg(F.min(F.struct("id", "th")).alias("first"), *(F.first(c).alias(c) for c in ("bands", "words", "bits")))
    reps = stored(classes.select(F.monotonically_increasing_id().alias("id"), F.col("first.id").alias("doc"), F.col("first.th").alias("th"), *sets, "bands", "words", "bits"), "reps")

    by_band = reps.select("id", F.explode(F.arrays_zip("bands", "words")).alias("s")).select("id", F.col("s.bands").alias("band"), F.col("s.words").alias("words"))
    keyed = by_band.select(F.explode(F.expr(_KEYS)).alias("key"), "id")
    buckets = stored(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = stored(keyed.join(buckets, "key"), "members")
    degree = stored(members.groupBy("id").agg(F.sum("size").alias("degree")), "degree")
    heads = stored(members.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", -F.col("id"))).alias("m")).select("key", (-F.col("m")["col2"]).alias("head")), "heads")
    headed = members.join(heads, "key").where("head <> id")
    pairs = stored(headed.select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")).distinct(), "pairs")
    first = verified(pairs, reps, texts, percent, width)
    forget(buckets, degree, pairs)

    grouped = components(first)
    labelled = stored(members.join(grouped.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c")), "labelled")
    mixed = stored(labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("key", "size"), "mixed")
    few = labelled.join(mixed.where(f"size between 3 and {FEW}"), "key")
    open_ = stored(labelled.join(mixed.where(f"size > {FEW}").select("key").join(heads, "key"), "key").select("head", "id", "c").distinct(), "open")
    rare = across(open_, reps, texts, percent, width)
    pairs = stored(met_across(few).union(rare).distinct(), "pairs")
    second = verified(pairs, reps, texts, percent, width)
    forget(heads, labelled, mixed, members, grouped, rare, pairs, open_)

    final = components(first.union(second))
    joined = final.join(reps.select(F.col("id").alias("node"), "doc"), "node")
    least = joined.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = joined.join(least, "component").select(F.col("node").alias("id"), "component_id")
    known = stored(reps.select("id", "doc", *sets).join(named, "id", "left").select(*sets, F.coalesce("component_id", "doc").alias("component_id")), "known")
    forget(first, second, reps, final)
    return made.select("id", "th", *sets).join(known, sets, "left").select(F.col("id").alias("doc_id"), "th", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents")).drop("th")


#: All pairs that share a shingle, then what links reach: for small tables.
OP11_SQL = rf"""
with recursive texts as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (select distinct doc_id, array_to_string(list_slice(w, i, i + {WIDTH - 1}), ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) as i from texts where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared >= {PERCENT} * (x.n + y.n - shared)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as root from documents union select r.doc_id, e.b from reach r join both_ways e on e.a = r.root),
roots as (select doc_id, min(root) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id from documents d join roots using (doc_id) left join sizes using (doc_id)
"""
