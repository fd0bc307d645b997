"""A live crawl, level by level: each level's URLs are admitted, fetched, read for links, and stored before the next."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.functions import urls as U
from sillage.operators import corpus
from sillage.operators import crawl as C
from sillage.operators import pages as P
from sillage.plans.config import Config
from sillage.sources import tables, web
from sillage.sources.journal import Journal
from sillage.sources.tables import remove_stored, stored

#: URLs (url) to url, html, content_type, reason: web.fetch_all() with a fetcher, or web.from_corpus() with stored pages.
Fetch = Callable[[DataFrame], DataFrame]


#: URLs of a host that end in errors before it is left alone.
MOST_FAILURES = 20


@dataclass
class Crawl:
    """pages (url, html, depth) in the project's form, the links of those that are followed, and every URL that is not a page, with the reason."""

    pages: DataFrame
    links: DataFrame
    refused: DataFrame


@dataclass
class Robots:
    """robots.txt of the hosts that a crawl comes to, each fetched once, by the same fetch as pages; hosts without one allow all."""

    fetch: Fetch
    agent: str
    journal: Journal | None = None

    def allowed(self, urls: DataFrame) -> DataFrame:
        """urls with allowed."""
        if self.journal is None:
            self.journal = Journal(urls.sparkSession)
        hosts = urls.select(U.home(F.col("url")).alias("home"), F.lower(U.netloc(F.col("url"))).alias("host")).groupBy("host").agg(F.min("home").alias("home"))
        hosts = hosts.join(self.journal.table("robots", "host string, robots_txt string").select("host"), "host", "left_anti")
        asked = stored(hosts.select("host", F.concat("home", F.lit("/robots.txt")).alias("url")), "hosts")
        got = self.fetch(asked.select("url")).select("url", F.col("html").alias("robots_txt"))
        self.journal.add("robots", asked.join(got, "url", "left").select("host", "robots_txt"))
        remove_stored(asked)
        self.journal.tidy("robots")
        return web.robots_allowed(urls, self.journal.table("robots"), self.agent)


_EMPTY = {"pages": "url string, html string, depth int", "links": "from_url string, pos int, target string, anchor_text string, source_chunk string", "refused": "url string, reason string"}


def live(spark: SparkSession, seeds: list[str], fetch: Fetch, policy: C.Policy, *, robots: bool = True, max_depth: int | None = None, deduplicate: bool = True, blacklist: list[str] | None = None, agent: str = "sillage", most_failures: int | None = MOST_FAILURES, folder: str | None = None) -> Crawl:
    """Everything that a crawl from seeds comes to by admitted links, at most max_depth links away (None or below 0: any distance).

    A URL is known without its fragment, is looked at once, and goes through the whole policy before it is asked for: blacklist, policy,
    robots.txt of its host. Pages that are no HTML, fail, or repeat the content of an earlier one (of a level the least URL is
    first) are not followed. A host of which most_failures URLs gave errors, retries and all, is on the blacklist from the next level on.
    Each level is stored, and read with all others in one scan, so plans are as long at the 300th as at the third: a lost executor costs one level at most,
    and nothing reaches the driver but whether there is a next one. With a folder, which all executors must share, a crawl that was stopped
    goes on from its last whole level, given the same arguments, and one that came to its end is not done again.
    """
    start = list(dict.fromkeys(s.strip() for s in seeds if s.strip()))
    limit = None if max_depth is None or max_depth < 0 else max_depth
    kept = Journal(spark, folder, [start, vars(policy), robots, limit, deduplicate, sorted(blacklist or ()), agent, most_failures])
    guard = Robots(fetch, agent, kept) if robots else None
    host = F.lower(U.netloc(F.col("url")))
    if not kept.state:
        level = kept.add("level", spark.createDataFrame([(s,) for s in start], "url string").select(U.without_fragment(F.col("url")).alias("url")).distinct())
        kept.add("seen", level)
        kept.commit(0, depth=0, ended=level.isEmpty())
    while not kept.state["ended"]:
        depth, level, used = kept.state["depth"], kept.table("level"), []
        why = F.when(F.col("url").isin(blacklist), "blacklist").otherwise(C.reason(F.col("url"), policy)) if blacklist else C.reason(F.col("url"), policy)
        judged = level.withColumn("reason", why.cast("string"))
        if most_failures is not None:
            bad = kept.table("failed", "host string, n long").groupBy("host").agg(F.sum("n").alias("n")).where(F.col("n") >= most_failures).select("host", F.lit("blacklist").alias("_bad"))
            judged = judged.withColumn("host", host).join(bad, "host", "left").select("url", F.coalesce("_bad", "reason").alias("reason"))
        open_ = judged.where("reason is null").select("url")
        refused = judged.where("reason is not null")
        if guard is not None:
            asked = stored(guard.allowed(open_), "allowed")
            refused = refused.unionByName(asked.where("not allowed").select("url", F.lit("robots").alias("reason")))
            open_ = asked.where("allowed").select("url")
            used.append(asked)
        got = stored(fetch(open_).withColumn("depth", F.lit(depth)), "fetched")
        used.append(got)
        page = C.is_page(F.coalesce("content_type", F.lit("")), F.coalesce("html", F.lit("")))
        kept.add("refused", refused.unionByName(got.where(~page).select("url", F.coalesce("reason", F.lit("content type")).alias("reason"))))
        if most_failures is not None:
            kept.add("failed", got.where(F.col("reason").startswith("error")).groupBy(host.alias("host")).agg(F.count("*").alias("n")))
        found = got.where(page).select("url", "html", "depth").withColumn("digest", F.md5(F.col("html").cast("binary")))
        if deduplicate:
            known = kept.table("digests", "digest string, url string").select("digest")
            firsts = kept.add("digests", found.groupBy("digest").agg(F.min("url").alias("url")).join(known, "digest", "left_anti"))
            found = found.join(firsts.select("url"), "url", "left_semi")
        links = kept.add("links", P.links(kept.add("pages", found.drop("digest"))))
        ended = limit is not None and limit <= depth
        if not ended:
            target = U.without_fragment(F.trim("target"))
            fresh = kept.replace("level", links.select(target.alias("url")).where("url <> ''").distinct().join(kept.table("seen"), "url", "left_anti"))
            ended = fresh.isEmpty()
            if not ended:
                kept.add("seen", fresh)
        kept.tidy("seen", "digests", "failed")
        kept.commit(depth + 1, depth=depth + 1, ended=ended)
        remove_stored(*used)
    return Crawl(*(kept.table(name, schema) for name, schema in _EMPTY.items()))


def policy_of(c: Config) -> C.Policy:
    """The policy of a project's settings."""
    domains = C.allowed_domains(c.start_url, c.allowed_domains, c.crawl_entire_site)
    return C.Policy(allowed_domains=domains, allow_subdomains=c.allow_subdomains, allowed_paths=c.allowed_paths, blocked_paths=c.blocked_paths, allow_url_patterns=c.allow_url_patterns, block_url_patterns=c.block_url_patterns)


def fetch_by(c: Config, fetcher: web.Fetcher, most_bytes: int | None = None) -> Fetch:
    """web.fetch_all() with the pause between requests to a host that the settings ask for."""
    return lambda urls: web.fetch_all(urls, fetcher, web.Manners(pause=c.rate_limit_delay, most_bytes=most_bytes))


def crawler(spark: SparkSession, c: Config, fetch: Fetch) -> Callable[[str], None]:
    """A crawl of a project as Ingest takes it: writes pages to the results path, and beside it graph.json and disallowed.json.

    URLs that end in errors are added to blacklist.json, and not asked for by a later crawl. A crawl that is stopped goes on when it is run again: its levels are in the folder
    crawl till all is written. A whole site is crawled from its seeds, or else its start URL, at any depth; without crawl_entire_site seeds are fetched alone, or the
    start URL is followed to max_depth.
    """

    def run(results: str) -> None:
        depth = None if c.crawl_entire_site else c.max_depth
        base = results.rsplit("/", 1)[0]
        known = f"{base}/blacklist.json"
        listed = [r["url"] for r in spark.read.schema("url string").json(known).distinct().collect()] if tables.exists(spark, known) else None
        made = live(spark, c.seed_urls or [c.start_url], fetch, policy_of(c), robots=c.respect_robots, max_depth=depth, blacklist=listed, folder=f"{base}/crawl")
        made.refused.where(F.col("reason").startswith("error")).select("url").coalesce(1).write.mode("append").json(known)
        tables.written_pages(made.pages).write.mode("overwrite").json(results)
        tables.write_graph(made.links, f"{base}/graph.json")
        corpus.reasons(made.refused).write.mode("overwrite").json(f"{base}/disallowed.json")
        tables.remove(spark, f"{base}/crawl")

    return run
