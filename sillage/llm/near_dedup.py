"""MinHash near-dedup by SetSketch registers: band register values, estimate jointly by likelihood, verify on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sillage.llm import setsketch
from sillage.llm.common import forget, read, slices, stored, unused, whole
from sillage.llm.components import components
from sillage.llm.shingles import fingerprint, shingle_sets

#: Pairs at this similarity or above are linked, compared as integers: 100 * intersection >= 75 * union.
PERCENT = 75
#: Ratio of neighbouring classes of set sizes in the exact search.
SIZE_STEP = 1.05

_SKETCHED = "id long, th long, n long, fp1 long, fp2 long, sketch binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, hashes, texts in slices(batches, 64):
        sets = shingle_sets(texts)
        rows = setsketch.registers(sets)
        prints = [fingerprint(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array([r.astype(">u2").tobytes() for r in rows], pa.binary())],
            names=["id", "th", "n", "fp1", "fp2", "sketch"],
        )


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (a hash of the text, which tells the texts of one id apart) and text."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(whole(text_col)).alias("th"), whole(text_col).alias("text"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th, n (distinct shingles), a 128-bit fingerprint of the set, and its registers, two bytes each."""
    return texts_of(docs, id_col, text_col).mapInArrow(_sketch, _SKETCHED)


def bands(sketched: DataFrame) -> DataFrame:
    """key, id: one row for each band of registers."""
    width = 2 * setsketch.BAND_ROWS
    keys = F.expr(f"transform(sequence(0, {setsketch.BANDS - 1}), i -> xxhash64(i, substring(sketch, i * {width} + 1, {width})))")
    return sketched.select(F.explode(keys).alias("key"), "id")


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            if not part.num_rows:
                continue
            n_a, n_b = (part.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), ">u2").reshape(part.num_rows, -1) for c in ("sketch_a", "sketch_b"))
            keep = setsketch.plausible(a, b, n_a, n_b, PERCENT / 100)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[int | None, np.ndarray | None, str | None] = (None, None, None)
    for a, b, text_a, text_b in slices(batches, 64):
        linked = []
        for x, s, t in zip(a, text_a, text_b, strict=True):
            if last[0] != x or last[2] != s:
                last = (x, shingle_sets([s])[0], s)
            one, two = last[1], shingle_sets([t])[0]
            both = len(np.intersect1d(one, two, assume_unique=True))
            linked.append(bool(both) and 100 * both >= PERCENT * (len(one) + len(two) - both))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _verify(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of pairs (a, b) those that are linked: first by likelihood of both sketches, then on the full sets of whole texts.

    wanted has id, n, sketch, text of every document that may be in a pair.
    """

    def side(c: str, *columns: str) -> DataFrame:
        return wanted.select(F.col("id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in columns))

    def met(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.join(side("b", *columns), "b").join(side("a", *columns), "a")

    sized = met(pairs, "n", "sketch").where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    likely = stored(sized.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_likely, "a long, b long"), "likely")
    linked = stored(met(likely, "text").select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long"), "linked")
    forget(likely)
    return linked


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in slices(batches, 32):
        for k, values in zip(ids, shingle_sets(texts), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k), pa.int64()), pa.array(values.view(np.int64))], names=["id", "h"])


def crossing(open_: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pairs (a, b) of open_ (id, n, c) with different c that may be linked; none that is linked is missing.

    Shingles are ordered from rare to frequent. A linked pair shares one among the first n - need + 1 of either, where need
    is the least intersection that its sizes allow; so only those are joined, by classes of size that keep need tight.
    In a large group of near copies that leaves the few documents whose own, rare shingles don't already use up what
    a link may miss, and a shingle all of whose owners have one c drops out: the group is never paired with itself.
    """
    rows = stored(wanted.select("id", "text").join(open_.select("id"), "id", "left_semi").mapInArrow(_shingles, "id long, h long"), "shingles")
    frequent = stored(rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "frequent")
    by_rarity = Window.partitionBy("id").orderBy("df", "h")
    ranked = rows.join(frequent, "h", "left").select("id", "h", F.coalesce("df", F.lit(1)).alias("df")).withColumn("pos", F.row_number().over(by_rarity))
    ranked = ranked.where("df > 1").join(open_, "id")
    share = PERCENT / 100
    ranked = ranked.where(F.col("pos") <= F.col("n") - F.ceil(share * F.col("n")) + 1)
    step = float(np.log(SIZE_STEP))
    klass = F.floor(F.log(F.col("n")) / step)
    low, high = F.floor(F.log(share * F.col("n")) / step), F.floor(F.log(F.col("n") / share) / step)
    spread = ranked.withColumn("k", klass).withColumn("q", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))
    least = F.greatest(F.floor(F.exp(F.col("q") * step)), F.ceil(share * F.col("n")), F.lit(1))
    need = F.ceil(share * (F.col("n") + least) / (1 + share) - 1e-9)
    spread = spread.where(F.col("pos") <= F.col("n") - need + 1).select("id", "n", "c", "h", "k", F.least("k", "q").alias("lo"), F.greatest("k", "q").alias("hi"))
    spread = stored(spread, "prefixes")
    key = ["h", "lo", "hi"]
    mixed = stored(spread.groupBy(*key).agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select(*key), "mixed")
    kept = stored(spread.join(mixed, key, "left_semi"), "met")
    left, right = (kept.where(f"k = {side}").select(*key, *(F.col(x).alias(f"{x}_{s}") for x in ("id", "n", "c"))) for s, side in (("a", "lo"), ("b", "hi")))
    met = left.join(right, key).where("c_a <> c_b and (lo < hi or id_a < id_b)").where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    pairs = stored(met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct(), "pairs")
    forget(rows, frequent, spread, mixed, kept)
    return pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, component_id, kept for every row of docs.

    Documents with equal sets form classes first, and only classes go on, each by a number of its own, so copies never meet in pairs.
    Classes whose registers agree in a band share a bucket. Each bucket links its members to one of them, that
    which shares most with others, and so is linear in its size. Where a bucket still spans several components,
    its members are tried across components too, exactly (see crossing): no bucket is capped, and no link
    between different texts is lost but by banding (a pair of similarity 0.75 shares no band with a chance of 4e-6,
    less above it).

    Nulls: a null text is empty. Texts without words have no shingles and are linked with nothing. A row with a
    null id is linked with nothing: component_id null, kept true. Repeated rows get equal results. Ids are meant to be unique, but
    rows of one id with different texts are texts of their own: each has the component of its own links, by the least id
    in it. Empty tables give empty results. Other columns are ignored.
    """
    texts = texts_of(docs, id_col, text_col)
    made = stored(sketches(docs, id_col, text_col), "sketches")
    sets = ["fp1", "fp2", "n"]
    # Equal sets have equal sketches, so any of a class's will do. Numbers are fixed once written; they are no more than names.
    classes = made.where("n > 0 and id is not null").groupBy(*sets).agg(F.min(F.struct("id", "th")).alias("first"), F.max("sketch").alias("sketch"))
    reps = stored(classes.select(F.monotonically_increasing_id().alias("id"), F.col("first.id").alias("doc"), F.col("first.th").alias("th"), *sets, "sketch"), "reps")

    banded = bands(reps)
    buckets = stored(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = stored(banded.join(buckets, "key"), "members")
    degree = stored(members.groupBy("id").agg(F.sum("size").alias("degree")), "degree")
    # Texts and sketches meet by id and text once, and later steps read only those that share a bucket. Sizes don't change this plan: nothing is broadcast.
    near = degree.select("id").hint("merge").join(reps.select("id", "doc", "th", "n", "sketch").hint("merge"), "id")
    met = texts.withColumnRenamed("id", "doc").hint("merge").join(near.hint("merge"), ["doc", "th"])
    # Rows come sorted from the join, so that repeated ones fold as they pass.
    wanted = stored(met.groupBy("doc", "th").agg(*(F.max(c).alias(c) for c in ("id", "n", "sketch", "text"))).select("id", "n", "sketch", "text"), "wanted")
    ranked = members.join(degree, "id").select("key", "id", "degree")
    heads = stored(ranked.groupBy("key").agg(F.max(F.struct("degree", -F.col("id"))).alias("m")).select("key", (-F.col("m")["col2"]).alias("head")), "heads")
    headed = members.join(heads, "key").where("head <> id")
    pairs = stored(headed.select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b")).distinct(), "pairs")
    first = _verify(pairs, wanted)

    grouped = components(first)
    labelled = stored(members.join(grouped.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c")), "labelled")
    mixed = stored(labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key"), "mixed")
    loose = labelled.join(mixed, "key", "left_semi").select("id", "c").distinct()
    open_ = stored(loose.join(reps.select("id", "n"), "id"), "open")
    forget(buckets, degree, heads, labelled, mixed, members, pairs, grouped)
    pairs = crossing(open_, wanted)
    second = _verify(pairs, wanted)
    forget(pairs, open_, wanted)

    final = components(first.union(second))
    # A component goes by its least document; classes outside of any by their own.
    joined = final.join(reps.select(F.col("id").alias("node"), "doc"), "node")
    least = joined.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = joined.join(least, "component").select(F.col("node").alias("id"), "component_id")
    known = stored(reps.select("id", "doc", *sets).join(named, "id", "left").select(*sets, F.coalesce("component_id", "doc").alias("component_id")), "known")
    forget(first, second, reps, final)
    out = made.select("id", "th", *sets).join(known, sets, "left").select(F.col("id").alias("doc_id"), "th", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group; all columns stay. Rows with a null id stay. Of an id that repeats with different texts
    those rows go whose own text is dropped; rows that repeat altogether stay or go together."""
    got = near_duplicates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    gone = got.where("not kept").select("doc_id", "th").distinct()
    name_id, name_th = unused(docs, "id"), unused(docs, "th")
    gone = gone.select(F.col("doc_id").alias(name_id), F.col("th").alias(name_th))
    return docs.join(gone, (F.col(id_col).cast("long") == F.col(name_id)) & (F.xxhash64(whole(text_col)) == F.col(name_th)), "left_anti")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("th")


#: All pairs that share a shingle, then what links reach: for small tables.
OP7_SQL = r"""
with recursive texts as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from texts where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as root from documents union select r.doc_id, e.b from reach r join both_ways e on e.a = r.root),
roots as (select doc_id, min(root) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from documents d join roots using (doc_id) left join sizes using (doc_id)
"""
