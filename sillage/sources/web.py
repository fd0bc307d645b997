"""Fetching: robots rules, polite retries, and pages that come from a stored corpus instead of the network. Fetchers are injected."""

from __future__ import annotations

import heapq
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sillage.functions import urls as U

#: Statuses after which a request is tried again (fixed values).
RETRIED = (429, 500, 502, 503, 504)
#: (status, content type, declared length or None, body) of a URL.
Fetcher = Callable[[str], tuple[int, str, int | None, str]]


@dataclass
class Manners:
    """How to fetch: tries after the first, their growing pauses, the pause between requests to one host, the longest body."""

    retries: int = 2
    backoff: float = 0.5
    pause: float = 0.2
    most_bytes: int | None = None
    agent: str = "sillage"
    sleep: Callable[[float], None] = field(default=time.sleep)


def fetched(url: str, fetch: Fetcher, manners: Manners) -> tuple[str | None, str | None, str | None]:
    """(body, content type, reason): a body only of status 200; the reason why there is none."""
    reason = None
    for attempt in range(manners.retries + 1):
        if attempt:
            manners.sleep(manners.backoff * 2 ** (attempt - 1))
        try:
            status, kind, declared, body = fetch(url)
        except Exception as error:  # noqa: BLE001
            reason = f"error: {type(error).__name__}"
            continue
        if manners.most_bytes is not None and declared is not None and declared > manners.most_bytes:
            return None, kind, "too long"
        if status == 200:
            return body, kind, None
        reason = f"status {status}"
        if status not in RETRIED:
            break
    return None, None, reason


def paced(urls: list[str], manners: Manners, now: Callable[[], float] = time.monotonic, last: dict[str, float] | None = None) -> Iterator[int]:
    """Places of urls in the order in which they may be asked for: hosts in turn, each after its pause, so that a pause of one host is another's time.

    last holds when each host was asked, from one call to the next. Of equal hosts the first URL is first.
    """
    last = {} if last is None else last
    by_host: dict[str, list[int]] = {}
    for n, url in enumerate(urls):
        by_host.setdefault(urlsplit(url).netloc, []).append(n)
    due = [(last.get(host, float("-inf")) + manners.pause, of[0], host) for host, of in by_host.items()]
    heapq.heapify(due)
    at = dict.fromkeys(by_host, 0)
    while due:
        when, place, host = heapq.heappop(due)
        if when > now():
            manners.sleep(when - now())
        yield place
        last[host] = now()
        at[host] += 1
        if at[host] < len(by_host[host]):
            heapq.heappush(due, (last[host] + manners.pause, by_host[host][at[host]], host))


def fetch_all(urls: DataFrame, fetch: Fetcher, manners: Manners | None = None) -> DataFrame:
    """urls (url) with html, content_type and reason; what is asked for is the URL in its normal form.

    Rows go by host, so that one task paces all requests to a host; it takes the hosts it has in turn (see paced).
    """
    manners = manners or Manners()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for frame in frames:
            given, asked = frame["url"].tolist(), frame["asked"].tolist()
            out = [(given[n], *fetched(asked[n], fetch, manners)) for n in paced(asked, manners, last=last)]
            yield pd.DataFrame(out, columns=["url", "html", "content_type", "reason"])

    normal = urls.select("url", F.coalesce(U.request_key(F.col("url")), F.col("url")).alias("asked"))
    by_host = normal.repartition(F.regexp_extract("asked", r"//([^/?#]*)", 1))
    return by_host.mapInPandas(run, "url string, html string, content_type string, reason string")


def from_corpus(urls: DataFrame, corpus: DataFrame, key: str = "url") -> DataFrame:
    """fetch_all() against stored pages (url, html): a join, with one row for each row of urls.

    key is what tells pages of both tables apart: their URL, or a column of ids where pages that share a URL are to be told apart. Of stored
    pages with one key the least html stands for all.
    """
    held = corpus.select(key, "html").join(urls.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.min("html").alias("html"))
    got = urls.select(*dict.fromkeys((key, "url"))).join(held, key, "left")
    return got.select("url", "html", F.when(F.col("html").isNotNull(), "text/html").alias("content_type"), F.when(F.col("html").isNull(), "status 404").alias("reason"))


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str = "sillage") -> DataFrame:
    """urls with allowed, by the robots.txt of their host (robots: host, robots_txt); hosts without one allow all.

    Rules are parsed once for each run of a host's rows.
    """

    @F.pandas_udf(T.BooleanType())
    def allowed(url: pd.Series, rules: pd.Series) -> pd.Series:
        parsed: dict[str, RobotFileParser] = {}

        def one(u: str, text: str | None) -> bool:
            if not text:
                return True
            if text not in parsed:
                parsed[text] = RobotFileParser()
                parsed[text].parse(text.splitlines())
            return parsed[text].can_fetch(agent, u)

        return pd.Series([one(u, t) for u, t in zip(url, rules, strict=True)])

    name = F.lower(F.regexp_extract("url", r"//([^/?#]*)", 1))
    met = urls.withColumn("host", name).join(robots.select("host", "robots_txt"), "host", "left")
    return met.withColumn("allowed", allowed("url", "robots_txt")).drop("host", "robots_txt")
