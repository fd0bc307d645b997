"""Crawling as joins: a frontier against the link table, level by level, and the policy that admits URLs."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillage.functions import urls as U
from sillage.sources.tables import stored


#: Levels after which those known so far are written as one table.
MERGED = 8


@dataclass
class Policy:
    """What a crawl may visit. Lists are settings of a project, a few entries each; no domains means all."""

    allowed_domains: list[str] = field(default_factory=list)
    blocked_domains: list[str] = field(default_factory=list)
    allow_subdomains: bool = False
    allowed_paths: list[str] = field(default_factory=list)
    blocked_paths: list[str] = field(default_factory=list)
    allow_url_patterns: list[str] = field(default_factory=list)
    block_url_patterns: list[str] = field(default_factory=list)
    skip_pattern: str = ""
    #: Characters of a URL, without its fragment, at most.
    longest: int = 2000


def allowed_domains(start_url: str, given: list[str], entire_site: bool) -> list[str]:
    """The given domains, or those of the start URL for a crawl of its site; each with and without www., sorted."""
    names = [d.strip().lower() for d in given if d.strip()]
    if not names and entire_site:
        names = [(urlsplit(start_url).hostname or "").lower()]
    bare = {n.removeprefix("www.") for n in names if n}
    return sorted(bare | {f"www.{n}" for n in bare})


def domain_allowed(url: Column, p: Policy) -> Column:
    """Blocked ones never, the allowed ones or all; subdomains count for both if the policy says so."""
    name = U.domain(url)
    listed = [_bare_host(d) for d in p.allowed_domains]
    ok = U.in_domains(name, listed, p.allow_subdomains) if listed else F.lit(True)
    return ok & ~U.in_domains(name, [_bare_host(d) for d in p.blocked_domains], p.allow_subdomains) if p.blocked_domains else ok


def _bare_host(name: str) -> str:
    return name.strip().lower().split(":")[0].removeprefix("www.")


def path_allowed(url: Column, p: Policy) -> Column:
    """Allowed prefixes, then allowed patterns, then blocked prefixes."""
    ok = F.lit(True)
    if p.allowed_paths:
        ok = ok & U.starts_with_any(U.path(url), p.allowed_paths)
    if p.allow_url_patterns:
        ok = ok & U.matches_any(url, p.allow_url_patterns)
    return ok & ~U.starts_with_any(U.path(url), p.blocked_paths) if p.blocked_paths else ok


def patterns_allowed(url: Column, p: Policy) -> Column:
    """Blocked patterns first, then allowed ones if there are any."""
    ok = ~U.matches_any(url, p.block_url_patterns) if p.block_url_patterns else F.lit(True)
    return ok & U.matches_any(url, p.allow_url_patterns) if p.allow_url_patterns else ok


def reason(url: Column, p: Policy, robots_ok: Column | None = None) -> Column:
    """Why a URL is not visited, the first rule that says so; null where it is. One policy for every path into the crawl."""
    bare = U.without_fragment(url)
    return (
        F.when(F.coalesce(bare, F.lit("")) == "", "empty")
        .when(~U.is_http(bare), "scheme")
        .when(U.is_internal(bare), "internal address")
        .when(U.looks_like_session(bare), "session or length")
        .when(~domain_allowed(bare, p), "domain")
        .when(~robots_ok if robots_ok is not None else F.lit(False), "robots")
        .when(U.skip_by_rules(bare, p.skip_pattern, p.longest), "skip rule")
        .when(~path_allowed(bare, p), "path")
        .when(~patterns_allowed(bare, p), "pattern")
    )


def visitable(urls: DataFrame, p: Policy, url_col: str = "url") -> DataFrame:
    return urls.where(reason(F.col(url_col), p).isNull())


def is_page(content_type: Column, body: Column) -> Column:
    return (F.length(body) > 0) & F.contains(F.lower(content_type), F.lit("text/html"))


def within_length(declared: Column, most: int) -> Column:
    return declared.isNull() | (declared <= most)


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, expands: DataFrame | None = None) -> DataFrame:
    """node and depth of everything that edges (src, dst) lead to from seeds (node), by the shortest way, seeds at 0.

    Each level joins the last level's nodes with the edges, and drops those known; nothing is gathered in one place, and
    each level is stored, so that plans stay short and a lost executor costs a level. expands (node) limits whose links
    are followed: pages that failed or repeat another's content are reached but lead nowhere. max_depth None or below 0: no limit.
    """
    known = stored(seeds.select("node").where(F.col("node").isNotNull()).distinct().withColumn("depth", F.lit(0)), "reach")
    frontier, depth = known, 0
    while (max_depth is None or max_depth < 0 or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        out = frontier.select(F.col("node").alias("src"))
        if expands is not None:
            out = out.join(expands.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
        found = edges.join(out, "src").select(F.col("dst").alias("node")).where(F.col("node").isNotNull()).distinct()
        frontier = stored(found.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        known = known.unionByName(frontier)
        if depth % MERGED == 0:
            known = stored(known, "reach")
    return known


def crawl(pages: DataFrame, links: DataFrame, seeds: list[str], policy: Policy, entire_site: bool = True, max_depth: int = 3, deduplicate: bool = True, seeds_expand: bool = True) -> DataFrame:
    """pages (url, html, text) that a crawl of a stored corpus visits, with depth.

    links (from_url, target) are filtered by the policy before anything joins them. Repeated contents are visited but not followed.
    """
    from sillage.operators.corpus import first_of_content

    spark = pages.sparkSession
    start = spark.createDataFrame([(s,) for s in dict.fromkeys(s.strip() for s in seeds) if s], "node string")
    edges = visitable(links, policy, "target").select(F.col("from_url").alias("src"), F.col("target").alias("dst"))
    expanding = first_of_content(pages.withColumn("seq", F.col("url"))) if deduplicate else pages
    depth = None if entire_site else (max_depth if seeds_expand else 0)
    reached = reach(edges, start, depth, expanding.select(F.col("url").alias("node")))
    return pages.join(reached.withColumnRenamed("node", "url"), "url")
