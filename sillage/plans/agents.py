"""What language models do for a question: routing, concepts, follow-ups, rewrites, judging, answering. Models are injected."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

#: The reply where there is nothing to answer from (fixed value).
APOLOGY = "I'm sorry, I couldn't find any relevant information to answer that question."
ROUTES = ("transform_only", "retrieve_followup", "retrieve_new")
MODES = {
    "strict_grounded": "Answer from the given website context alone. Where it holds no answer, reply with N and nothing else.",
    "technical_grounded": "Answer technical questions from the given website context alone; steps may be combined, facts may not be added. Where it holds no answer, reply with N and nothing else.",
    "assisted_examples": "Answer from the given website context; examples of your own are only for illustration and must be labelled GENERATED EXAMPLE.",
}


class Llm(Protocol):
    def generate(self, prompt: str) -> str: ...


def system_prompt(mode: str | None, custom: str | None = None, override: bool = False, examples: bool = False) -> str:
    """The prompt of a mode, an unknown one being technical_grounded; a custom one if override is on and it isn't blank."""
    mode = mode if mode in MODES else "technical_grounded"
    base = custom.strip() if override and (custom or "").strip() else MODES[mode]
    if mode != "assisted_examples":
        return base
    return f"{base}\n\nallow_generated_examples = {'true' if examples else 'false'}: {'an example may be made up where the documents have none' if examples else 'where an example is asked for and the documents have none, reply with N'}."


def payload(reply: str | None) -> dict:
    """The JSON object of a reply: all of it, or what lies between its first and last brace; an empty one where there is none."""
    text = (reply or "").strip()
    for candidate in (text, *re.findall(r"\{[\s\S]*\}", text)):
        try:
            got = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    return {}


def clean_concepts(names: object, most: int = 6) -> list[str]:
    kept = (n.strip().lower() for n in names if isinstance(n, str)) if isinstance(names, list) else ()
    return list(dict.fromkeys(n for n in kept if len(n) >= 3))[:most]


def _texts(values: object, most: int) -> list[str]:
    return [v.strip() for v in values if isinstance(v, str) and v.strip()][:most] if isinstance(values, list) else []


@dataclass
class Planner:
    """Plans retrieval; without a model every question is new and no concepts are known."""

    llm: Llm | None = None
    prompt: str = "You plan searches over the pages of one website."

    def _ask(self, task: str, shape: str, *lines: str) -> dict:
        return payload(self.llm.generate("\n".join([self.prompt, task, f"Reply with one JSON object like {shape}", *lines]))) if self.llm else {}

    def route(self, question: str, memory: str = "") -> dict:
        got = self._ask("Choose a mode for this request and name what it is about.", '{"mode": "...", "standalone_query": "...", "concepts": ["..."]}', f"Modes: {', '.join(ROUTES)}", f"Request: {question}", f"Earlier turns: {memory.strip()[:1800]}")
        mode = str(got.get("mode") or "").strip().lower()
        return {"mode": mode if mode in ROUTES else "retrieve_new", "standalone_query": str(got.get("standalone_query") or "").strip(), "concepts": clean_concepts(got.get("concepts"))}

    def concepts(self, question: str) -> list[str]:
        return clean_concepts(self._ask("Name what this request is about.", '{"concepts": ["..."]}', f"Request: {question}").get("concepts"))

    def followups(self, question: str, missing: list[str], hits: list[dict]) -> dict:
        shown = [f"- id={h['id']} url={h['url']} text={' '.join((h['text'] or '').split(chr(10))).strip()[:220]}" for h in hits[:8]]
        got = self._ask("Say what else to search for, and which hits to drop.", '{"queries": ["..."], "drop_chunk_ids": ["..."]}', f"Request: {question}", f"Not covered so far: {', '.join(missing)}", "Hits:", *shown)
        return {"queries": _texts(got.get("queries"), 4), "drop_chunk_ids": _texts(got.get("drop_chunk_ids"), 8)}


@dataclass
class Answerer:
    llm: Llm
    system: str = MODES["technical_grounded"]
    template: str = "Context:\n{context}\n\nQuestion: {question}"

    def __post_init__(self) -> None:
        if missing := [p for p in ("{context}", "{question}") if p not in self.template]:
            raise ValueError(f"the prompt lacks {', '.join(missing)}")

    def _prompt(self, question: str, context: str) -> str:
        return f"{self.system.strip()}\n\n{self.template.format(context=context, question=question).strip()}"

    def answer(self, question: str, context: str) -> str:
        if not context.strip():
            return APOLOGY
        reply = (self.llm.generate(self._prompt(question, context.strip())) or "").strip()
        return APOLOGY if reply == "N" else reply

    def answer_with_support(self, question: str, context: str) -> tuple[str, bool]:
        """An answer, and whether the context supports it; a reply that is no JSON is taken as it stands and judged anew."""
        if not context.strip():
            return APOLOGY, False
        got = payload(self.llm.generate(self._prompt(question, context.strip()) + '\n\nReply with one JSON object: {"answer": "...", "supported": "Y or N"}'))
        if not got:
            return self.answer(question, context), self.sufficient(question, context)
        return str(got.get("answer") or "").strip() or APOLOGY, str(got.get("supported") or "").strip().upper() == "Y"

    def sufficient(self, question: str, context: str) -> bool:
        """Whether the first 6000 characters can answer; a model that fails says no."""
        try:
            reply = self.llm.generate(f"Context:\n{context[:6000]}\n\nQuestion: {question}\n\nDoes the context alone answer this in full? YES or NO:")
        except Exception:  # noqa: BLE001
            return False
        return (reply or "").strip().upper().startswith("Y")

    def rewrite(self, question: str, hints: list[str], most: int = 500) -> list[str]:
        """Other questions to search for, none if the model leaves it the SAME. A list gives one for each line."""
        reply = (self.llm.generate(f"Better searches for: {question.strip()}\nThe site has: {'; '.join(h for h in hints[:8] if h)[:1000]}\nReply SAME to leave it, or with up to four searches, one on each line, in {most} characters at most.") or "").strip()
        if not reply or reply.upper() == "SAME":
            return []
        lines = [x for line in reply.splitlines() if (x := line.strip(" -*\t"))]
        joined = " || ".join(lines) if len(lines) > 1 else reply
        return [q.strip() for q in joined[:3000].split("||") if q.strip()]


@dataclass
class Summariser:
    """Summaries of chunks; long texts keep their head and tail, then as many tokens as the model takes; a failure keeps the text.

    tokens cuts a text to a number of tokens; without one, four characters count as a token.
    """

    llm: Llm
    prompt: str = "Summarise:\n\n{text}"
    most_tokens: int = 2000
    tokens: Callable[[str, int], str] = field(default=lambda text, n: text[: 4 * n])

    def __call__(self, text: str) -> str:
        short = text if len(text) <= 12_000 else f"{text[:10_000]}\n\n[...] (truncated)\n\n{text[-2_000:]}"
        short = self.tokens(short, self.most_tokens)
        try:
            return self.llm.generate(self.prompt.format(text=short) if "{text}" in self.prompt else self.prompt) or text
        except Exception:  # noqa: BLE001
            return text
