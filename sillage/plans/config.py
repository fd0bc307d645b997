"""Settings of a project, with defaults, and every violation reported at once."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields

EMBEDDING, CHAT = "openai:text-embedding-3-small", "gpt-4o-mini"
#: Answering and retrieval modes (fixed values).
ANSWERING, RETRIEVAL = ("assisted_examples", "strict_grounded", "technical_grounded"), ("builder", "classic")
_DERIVED = ("output_dir", "index_dir")


@dataclass
class Config:
    """Settings of a project, by use. Names and defaults are those of stored projects (fixed values)."""

    # Where a project's files are.
    output_dir: str = ""
    index_dir: str = ""
    results_file: str = "results.jsonl"
    embedding_cache_dir: str = ""
    # What a crawl starts from, and how far it goes.
    start_url: str = ""
    seed_urls: list[str] = field(default_factory=list)
    crawl_entire_site: bool = True
    max_depth: int = 3
    # What it may ask for, and how fast.
    allowed_domains: list[str] = field(default_factory=list)
    allow_subdomains: bool = False
    allowed_paths: list[str] = field(default_factory=list)
    blocked_paths: list[str] = field(default_factory=list)
    allow_url_patterns: list[str] = field(default_factory=list)
    block_url_patterns: list[str] = field(default_factory=list)
    respect_robots: bool = True
    rate_limit_delay: float = 0.2
    # Models.
    chat_model: str = CHAT
    embedding_model: str = EMBEDDING
    summary_model: str = ""
    # How questions are searched for and answered.
    retrieval_mode: str = "builder"
    builder_max_rounds: int = 1
    score_threshold: float = 0.5
    leave_last_k: int = 2
    answering_mode: str = "technical_grounded"
    allow_generated_examples: bool = False
    system_prompt: str = ""
    system_prompt_custom_override: bool = False
    # What is written besides.
    debug: bool = False
    query_debug: bool = False

    @classmethod
    def of(cls, given: Mapping[str, object], **derived: str) -> Config:
        """Settings from a mapping: unknown keys don't matter, blank or 'default' models mean the defaults, empty lists may be missing."""
        known = {f.name for f in fields(cls)}
        values = {k: v for k, v in {**given, **{k: v for k, v in derived.items() if v}}.items() if k in known}
        for name, usual in (("embedding_model", EMBEDDING), ("chat_model", CHAT)):
            text = str(values.get(name) or "").strip()
            values[name] = usual if text.lower() in ("", "default") else text
        for f in fields(cls):
            if f.name in values and str(f.type).startswith("list"):
                values[f.name] = list(values[f.name] or [])
        values["results_file"] = values.get("results_file") or "results.jsonl"
        made = cls(**values)
        made.check()
        return made

    def violations(self) -> list[str]:
        return violations(asdict(self))

    def check(self) -> None:
        if found := self.violations():
            raise ValueError("Invalid configuration:" + "".join(f"\n  - {v}" for v in found))

    def stored(self) -> dict:
        """What a project keeps: without derived folders."""
        return {k: v for k, v in asdict(self).items() if k not in _DERIVED}


def _number(v: object, *kinds: type) -> bool:
    return isinstance(v, kinds) and not isinstance(v, bool)


def violations(c: Mapping[str, object]) -> list[str]:
    """All that is wrong with settings; missing ones aside from the required are right."""
    found = [f"'{n}' is missing: give a text that isn't blank" for n in ("start_url", *_DERIVED) if not (isinstance(c.get(n), str) and c[n].strip())]
    url = c.get("start_url") or ""
    if isinstance(url, str) and url.strip() and not url.startswith(("http://", "https://")):
        found.append(f"'start_url' is no http address: {url!r}")
    model = c.get("embedding_model") or ""
    if model == "openai:":
        found.append(f"'embedding_model' names no model after its prefix: {model!r}")
    elif model.lower() != "default" and not model.startswith("openai:") and " " in model:
        found.append(f"'embedding_model' has spaces: {model!r}")
    for name, allowed in (("answering_mode", ANSWERING), ("retrieval_mode", RETRIEVAL)):
        if c.get(name) is not None and c[name] not in allowed:
            found.append(f"'{name}' is {c[name]!r}, but may be {', '.join(allowed)}")
    ranges = (
        ("score_threshold", (int, float), lambda v: 0 <= v <= 1, "a number between 0.0 and 1.0"),
        ("max_depth", (int,), lambda v: v >= -1, "an integer >= -1"),
        ("builder_max_rounds", (int,), lambda v: v >= 0, "a non-negative integer"),
        ("rate_limit_delay", (int, float), lambda v: v >= 0, "a non-negative number"),
    )
    return found + [f"'{n}' is {c[n]!r}, but takes {what}" for n, kinds, ok, what in ranges if c.get(n) is not None and not (_number(c[n], *kinds) and ok(c[n]))]
