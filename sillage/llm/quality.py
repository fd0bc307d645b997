"""Quality rules by distribution divergence: character classes and common words against language references."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sillage.llm.common import forget, read, slices, stored, whole, words

#: Base rules: least words, and most words in repeated windows of WINDOW words, in percent.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
#: Common words of the languages whose histograms are compared (fixed values); further languages add lists.
COMMON = (
    "the of and to in is that it for on as with was be by",
    "der die und in den von zu das mit sich des auf für ist im",
    "de la le et les des en un du une que est pour qui dans",
    "de la que el en y los se del las un por con no una",
)
WORDS = sorted({w for line in COMMON for w in line.split()})
#: A text is judged by character classes from so many characters in words on, by common words from so many words on.
GUARD_CHARS, GUARD_WORDS = 120, 60
#: A language's own reference is of so many texts at least.
LEAST_TEXTS = 8
#: Greatest Jensen-Shannon distances (0 to 1) of kept texts. That of character classes grows as texts get shorter, by so much
#: over the square root of the characters in words, since short texts stray further by chance.
MOST_CHARS, SHORT_CHARS, MOST_WORDS = 0.12, 1.2, 0.36

#: Digits count so many to one: numbers, which clean short texts have as well, say little about language.
DIGITS_TOGETHER = 4
#: Steps in which shares are counted for the medians.
BINS = 1 << 12
CLASSES = ("vowel", "consonant", "capital", "digit", "space", "stop", "mark", "symbol", "bar", "control", "beyond")


def _class(b: int) -> str | None:
    c = chr(b)
    if b >= 0xC0:  # a lead byte stands for its code point
        return "beyond"
    if b >= 0x80:
        return None
    if c.islower():
        return "vowel" if c in "aeiou" else "consonant"
    if c.isupper():
        return "capital"
    if c.isdigit():
        return "digit"
    if c in " \t\n\v\f\r":
        return "space"
    if c in ".,;:!?":
        return "stop"
    if c == "|":
        return "bar"
    if b in SYMBOLS:
        return "symbol"
    return "mark" if c.isprintable() else "control"


_OF = np.zeros((256, len(CLASSES)), np.int64)
for _b in range(256):
    if _class(_b):
        _OF[_b, CLASSES.index(_class(_b))] = 1
_SYMBOLS = np.frombuffer(SYMBOLS, np.uint8)
_FORMS = [(w.encode(), w.capitalize().encode()) for w in WORDS]


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in windows found twice or more; ids tell words apart. Exact: windows are compared by number, not by hash."""
    n = len(ids)
    if n <= WINDOW:
        return 0
    if distinct**WINDOW < 1 << 62:
        keys = ids[: n - WINDOW + 1]
        for k in range(1, WINDOW):
            keys = keys * distinct + ids[k : n - WINDOW + 1 + k]
    else:
        keys = ids
        for k in range(1, WINDOW):
            keys = np.unique(keys[:-1] * distinct + ids[k:], return_inverse=True)[1]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(n + 1, np.int64)
    edges[:-WINDOW][twice] += 1
    edges[WINDOW:][twice] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def features(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, character classes, common words."""
    data = text.encode("utf-8", "surrogatepass")
    got = words(text)
    place: dict[bytes, int] = {}
    ids = np.array([place.setdefault(w, len(place)) for w in got], np.int64)
    counts = np.bincount(ids, minlength=len(place)) if got else np.zeros(0, np.int64)
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [line for line in data.split(b"\n") if line.strip()]
    classes = (by_byte @ _OF).tolist()
    classes[CLASSES.index("digit")] //= DIGITS_TOGETHER
    common = [sum(int(counts[place[f]]) for f in forms if f in place) for forms in _FORMS]
    return (
        len(got), len(text) - (len(data) - sum(map(len, got))), int(by_byte[_SYMBOLS].sum()), len(lines) - len(set(lines)),
        repeated_words(ids, len(place)), classes, [*common, len(got) - sum(common)],
    )


_NAMES = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common"]
_TYPES = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int64())]
_DDL = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, common array<long>"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, langs, texts in slices(batches):
        columns = [ids, langs, *zip(*map(features, texts), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _bins(counts: np.ndarray) -> np.ndarray:
    """Shares of histograms (rows) as whole numbers of 1 / BINS."""
    return np.floor(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1) * BINS + 0.5).astype(np.int64)


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, 0 to 1, of histograms row by row; 0 where one of them is empty."""
    some = (p.sum(axis=1) > 0) & (q.sum(axis=1) > 0)
    p, q = (x / np.maximum(x.sum(axis=1, keepdims=True), 1e-300) for x in (p, q))
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(2 * p / (p + q)), 0) + np.where(q > 0, q * np.log2(2 * q / (p + q)), 0)
    return np.where(some, np.sqrt(np.maximum(terms.sum(axis=1) / 2, 0)), 0.0)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


_WIDTHS = {"classes": len(CLASSES), "common": len(WORDS) + 1}


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, place, bin, n: how many texts of a language have that share of a class or word. Batches are lang, whether either histogram is long enough, and both."""
    for batch in batches:
        if not batch.num_rows:
            continue
        langs = batch.column(0).dictionary_encode()
        code = langs.indices.fill_null(len(langs.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        names = [*langs.dictionary.to_pylist(), None]
        first = 0
        for k, (name, width) in enumerate(_WIDTHS.items()):
            counts = _rows(batch.column(3 + k), width)
            use = batch.column(1 + k).to_numpy(zero_copy_only=False) & (counts.sum(axis=1) > 0)
            keys = (code[use, None] * width + np.arange(width)) * (BINS + 1) + _bins(counts[use])
            found, n = np.unique(keys, return_counts=True)
            place = found // (BINS + 1)
            yield pa.RecordBatch.from_arrays([pa.array([names[c] for c in (place // width).tolist()], pa.string()), pa.array(place % width + first, pa.int32()), pa.array(found % (BINS + 1), pa.int32()), pa.array(n, pa.int64())], names=["lang", "place", "bin", "n"])
            first += width


def _medians(counted: DataFrame, *by: str) -> DataFrame:
    """by, place, share, texts: the lower median of each share, and how many texts it is of."""
    upto = F.sum("n").over(Window.partitionBy(*by, "place").orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy(*by, "place"))
    return counted.withColumn("upto", upto).withColumn("texts", total).where("2 * upto >= texts").groupBy(*by, "place").agg((F.min("bin") / BINS).alias("share"), F.first("texts").alias("texts"))


def references(measured: DataFrame) -> tuple[DataFrame, list[float]]:
    """ref_lang, ref: by language the median share of each class, then of each common word, over all texts that pass the base rules; and those of all languages.

    Shares are counted in steps of 1 / BINS, so that the medians (the lower one of two) are exact for these whatever the order of
    rows, and a language's table has BINS + 1 rows for each share at most. A histogram that fewer than LEAST_TEXTS texts of a language have is that of all
    languages: a few texts would be judged by themselves. Languages without any histogram of their own have no row.
    """
    enough = [F.col("word_chars") >= GUARD_CHARS, F.col("n_words") >= GUARD_WORDS]
    counted = measured.where("not base_failed").select("lang", *enough, "classes", "common").mapInArrow(_tally, "lang string, place int, bin int, n long").groupBy("lang", "place", "bin").agg(F.sum("n").alias("n"))
    counted = stored(counted, "counted")
    places = sum(_WIDTHS.values())
    shares = {r["place"]: r["share"] for r in _medians(counted.groupBy("place", "bin").agg(F.sum("n").alias("n"))).collect()}  # a row for each place
    common = [shares.get(k, 0.0) for k in range(places)]
    own = _medians(counted, "lang").where(F.col("texts") >= LEAST_TEXTS).groupBy(F.col("lang").alias("ref_lang")).agg(F.map_from_entries(F.collect_list(F.struct("place", "share"))).alias("shares"))
    ref = F.array(*[F.coalesce(F.try_element_at("shares", F.lit(k)), F.lit(common[k])) for k in range(places)])
    made = stored(own.select("ref_lang", ref.alias("ref")), "references")
    forget(counted)
    return made, common


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = sum(_WIDTHS.values())
    for batch in batches:
        if not batch.num_rows:
            continue
        ref = _rows(batch.column(batch.num_columns - 1).fill_null(pa.scalar([0.0] * width, batch.column(batch.num_columns - 1).type)), width)
        out = list(batch.columns[:-5])
        first = 0
        for k, (name, n) in enumerate(_WIDTHS.items()):
            use = batch.column(batch.num_columns - 5 + k).to_numpy(zero_copy_only=False)
            got = distances(_rows(batch.column(batch.num_columns - 3 + k), n).astype(np.float64), ref[:, first : first + n])
            out.append(pa.array(np.where(use, got, 0.0), pa.float64()))
            first += n
        yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:-5], "class_distance", "word_distance"])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts of the base rules, both distances, base_failed and kept for every row of docs.

    A language's reference is the median share of each class or word over all its texts that pass the base rules, the judged one
    among them, so that it covers the whole table and junk, while less than half of it, doesn't move it; rows without a language share
    one reference. A language of fewer than LEAST_TEXTS texts, each long enough for the histogram, is judged by that of all languages. Texts too short for a histogram are judged by the base rules alone. Null texts are empty (and fail the base
    rules), null ids stay null, repeated rows repeat, other columns are ignored, an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), whole(text_col).alias("text"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = stored(rows.mapInArrow(_measure, _DDL).withColumn("base_failed", failed), "measured")
    refs, common = references(measured)
    met = measured.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left").withColumn("ref", F.coalesce("ref", F.lit(common)))
    counts = [n for n in _NAMES if n not in ("lang", "classes", "common")]
    ddl = ", ".join(f"{n} long" for n in counts) + ", base_failed boolean, class_distance double, word_distance double"
    met = met.select(*counts, "base_failed", F.col("word_chars") >= GUARD_CHARS, F.col("n_words") >= GUARD_WORDS, "classes", "common", "ref").mapInArrow(_compare, ddl)
    kept = ~F.col("base_failed") & (F.col("class_distance") <= MOST_CHARS + SHORT_CHARS / F.sqrt(F.greatest(F.col("word_chars"), F.lit(1)))) & (F.col("word_distance") <= MOST_WORDS)
    return met.select(*counts, "base_failed", kept.alias("kept"), "class_distance", "word_distance")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))
