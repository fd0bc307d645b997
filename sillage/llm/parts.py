"""Columns of the operators' queries that SQL can express, each through its operator and over its whole table, with that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.llm import media, mixing, quality, secrets, url_filter
from sillage.llm.common import read

PARTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
PARTS_SQL: dict[str, str] = {}
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def part(sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        PARTS[f.__name__], PARTS_SQL[f.__name__] = f, sql
        return f

    return register


@part(rf"""
with given as (select doc_id, encode(coalesce(text, '')) as raw, string_split(coalesce(text, ''), chr(10)) as lines from documents),
sized as (select *, octet_length(raw) as n_bytes, len(list_filter(lines, lambda x: regexp_matches(x, '\S'))) as n_lines from given),
padded as (select *, raw || from_hex(repeat('FF', case when n_bytes = 0 then {media.WIDTH} else ({media.WIDTH} - n_bytes % {media.WIDTH}) % {media.WIDTH} end::int)) as payload from sized)
select doc_id, n_bytes::bigint as n_bytes, octet_length(payload)::bigint as payload_bytes, sha256(payload) as payload_sha256,
  least(n_lines, 1)::int as position, (n_lines + 1)::int as n_parts, n_bytes || ' bytes' as caption from padded""")
def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of op1_media, and where each lies in its document's sequence."""
    return media.op1_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "position", "n_parts", "caption")


_WEIGHT = " ".join(f"when {k} then {w}" for k, w in enumerate(mixing.WEIGHTS))


@part(rf"""
with sized as (select doc_id, source, len({_WORDS})::bigint as size from documents),
sources as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from sized group by source),
weighed as (select *, case place % {len(mixing.WEIGHTS)} {_WEIGHT} end as weight, source_size * {mixing.REPEATS} as cap, sum(source_size) over () * {mixing.SHARE} as total from sources),
levels as (select *, (total - coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by cap / weight, place rows between current row and unbounded following) as level from weighed),
level as (select arg_min(level, (cap / weight, place)) as level from levels where level <= cap / weight)
select doc_id, size, s.source, source_size, round(least(cap, coalesce(weight * (select level from level), cap)), 4)::double as target from sized d join levels s on d.source is not distinct from s.source""")
def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of documents and sources, and targets by water filling, of op3_mixing."""
    return mixing.op3_mixing(spark, sf_dir).select("doc_id", "size", "source", "source_size", F.round("target", 4).alias("target"))


_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_FITS = " union all ".join(f"select page_id, '{h + p}' as rule, '{v}' as listed from parts where (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for v, h, p in url_filter.RULES)


@part(f"""
with parts as (select page_id, {_HOST} as host, {_PATH} as path from pages), fits as ({_FITS}),
best as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(listed, length(rule)) as listed from fits group by page_id)
select page_id, host, path, rule, listed from parts left join best using (page_id)""")
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of op4_url_filter, and the verdict where a rule gives it."""
    return url_filter.op4_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("listed"))


@part(r"""
select doc_id,
  len(list_filter(regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6))::bigint as n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::bigint as n_access,
  len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24))::bigint as n_hex
from (select doc_id, coalesce(text, '') as t from documents)""")
def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the base patterns of op8_secrets, counted."""
    return secrets.op8_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


@part(rf"""
with given as (select doc_id, coalesce(text, '') as t, {_WORDS} as w from documents),
windows as (select doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from given)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as n from windows) where n > 1),
repeated as (select doc_id, count(distinct i + k)::bigint as n from twice, (select unnest(range(5)) as k) group by doc_id),
counted as (select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from given)
select doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0) as n_repeat_words,
  n_words < 10 or 100 * coalesce(n, 0) > 20 * n_words as base_failed
from counted left join repeated using (doc_id)""")
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base rules of op9_quality."""
    return quality.op9_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
