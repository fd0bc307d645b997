"""Text expressions: tokens, estimates, truncation, ids, clean-up of model output."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a summariser's input: above LONG the first HEAD and the last TAIL stay.
LONG, HEAD, TAIL, CUT_MARK = 12_000, 10_000, 2_000, "\n\n[...] (truncated)\n\n"


def tokens(text: Column) -> Column:
    """Lower-cased runs of two or more ASCII letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]{2,})"), F.lit(1))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def word_count(text: Column) -> Column:
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def head_and_tail(text: Column) -> Column:
    return F.when(F.length(text) > LONG, F.concat(F.substring(text, 1, HEAD), F.lit(CUT_MARK), F.right(text, F.lit(TAIL)))).otherwise(text)


def hard_splits(text: Column, max_tokens: int) -> Column:
    """Windows of as many characters as max_tokens may have, 800 at least; none of an empty text."""
    step = max(800, 4 * max_tokens)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substr(text, i + 1, F.lit(step)))).otherwise(F.array().cast("array<string>"))


def chunk_id(url: Column, index: Column) -> Column:
    return F.concat(F.coalesce(url, F.lit("")), F.lit("#chunk_"), F.coalesce(index.cast("string"), F.lit("-1")))


def segment_id(chunk: Column, index: Column) -> Column:
    return F.concat(chunk, F.lit("__seg_"), index.cast("string"))


def safe_name(name: Column) -> Column:
    """A name's last part; null where nothing or a hidden name is left, which callers reject."""
    last = F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.when((F.trim(last) == "") | last.startswith("."), F.lit(None)).otherwise(last)


def window_tokens(model: Column) -> Column:
    """Context window of a chat model by its name."""
    m = F.lower(model)
    return F.when(m.contains("gpt-4.1"), 1_000_000).when(m.contains("gpt-4o") | m.contains("o4") | m.contains("gpt-4"), 128_000).otherwise(16_000)


def budget_chars(window: Column, most: Column, model: Column) -> Column:
    """Characters of context: four for each usable token of a known window, at most 180,000 and at least the setting."""
    base = F.greatest(most, F.lit(8000))
    reserve = F.greatest(F.lit(2000), F.floor(window * 0.15))
    usable = F.greatest(F.lit(2000), window - reserve)
    by_name = F.when(F.lower(model).contains("4o") | F.lower(model).contains("gpt-4.1"), F.least(base * 5, F.lit(100_000))).otherwise(base)
    return F.when(window > 0, F.greatest(base, F.least(usable * 4, F.lit(180_000)))).otherwise(by_name).cast("long")


def json_payload(text: Column, schema: str) -> Column:
    """A JSON object from a model's reply: the whole of it, else from its first to its last brace."""
    whole = F.when(F.try_parse_json(F.trim(text)).isNotNull(), F.from_json(F.trim(text), schema))
    return F.coalesce(whole, F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema))


def concepts(names: Column, most: int = 6) -> Column:
    """Distinct names in lower case, of three characters or more, in order, the first few."""
    clean = F.filter(F.transform(names, lambda c: F.lower(F.trim(c))), lambda c: F.length(c) >= 3)
    return F.slice(F.array_distinct(clean), 1, most)


def rewrites(reply: Column) -> Column:
    """A rewritten question: lines of a list joined by ' || ', at most 3000 characters; null for SAME or nothing."""
    lines = F.filter(F.transform(F.split(F.trim(reply), "\n"), lambda x: F.regexp_replace(x, r"^[ \-*\t]+|[ \-*\t]+$", "")), lambda x: x != "")
    joined = F.when(F.size(lines) >= 2, F.substring(F.array_join(lines, " || "), 1, 3000)).otherwise(F.trim(reply))
    return F.when((joined == "") | (F.upper(joined) == "SAME"), F.lit(None)).otherwise(joined)


def split_rewrites(joined: Column, tried: Column) -> Column:
    """The questions of rewrites() that have not been tried."""
    parts = F.filter(F.transform(F.split(joined, r"\|\|"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_except(parts, tried)


def masked(key: Column) -> Column:
    return F.when(F.length(key) <= 8, F.repeat(F.lit("*"), 8)).otherwise(F.concat(F.substring(key, 1, 3), F.repeat(F.lit("*"), 8), F.right(key, F.lit(4))))


def cited_urls(context: Column) -> Column:
    """Distinct URLs of '(Source: ...)' marks in order."""
    return F.array_distinct(F.regexp_extract_all(context, F.lit(r"\(Source:\s*(https?://[^\s)]+)\)"), F.lit(1)))


def _blake(size: int):  # noqa: ANN202
    import hashlib

    return lambda x: None if x is None else hashlib.blake2b(x.encode("utf-8"), digest_size=size)


@F.pandas_udf(T.StringType())
def chunk_hash(base: pd.Series) -> pd.Series:
    """blake2b of ten bytes over 'url|h1 > h2|index', in hex."""
    made = _blake(10)
    return base.map(lambda x: None if x is None else made(x).hexdigest())


@F.pandas_udf(T.LongType())
def key_hash(key: pd.Series) -> pd.Series:
    """blake2b of eight bytes, little-endian, as a signed number."""
    made = _blake(8)
    return key.map(lambda x: None if x is None else int.from_bytes(made(x).digest(), "little", signed=True)).astype("Int64")


@F.pandas_udf(T.StringType())
def cache_hash(text: pd.Series, model: pd.Series) -> pd.Series:
    """Key of a cached vector: blake2b of sixteen bytes over text, NUL and model."""
    made = _blake(16)
    return (text + "\0" + model).map(lambda x: None if x is None else made(x).hexdigest())


@F.pandas_udf(T.StringType())
def shown_email(encoded: pd.Series) -> pd.Series:
    """An e-mail address that a proxy hid as hex, each byte combined with the first; null where it is no such string."""

    def one(x: str | None) -> str | None:
        try:
            raw = bytes.fromhex(x or "")
        except ValueError:
            return None
        return "".join(chr(b ^ raw[0]) for b in raw[1:]) if raw else None

    return encoded.map(one)
