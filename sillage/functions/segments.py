"""Segments that an embedder takes: a text whole if it fits, else packed from paragraphs, sentences and hard cuts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: Tokens that a segment may have: the default embedder's window, and its share that is used.
DEFAULT_WINDOW, SAFE_SHARE, LEAST_CUT = 8192, 0.9, 800
_PARAGRAPH, _SENTENCE = re.compile(r"\n{2,}"), re.compile(r"(?<=[.!?])\s+")


def estimate(text: str) -> int:
    return max(1, len(text) // 4)


def limit(window: int = DEFAULT_WINDOW, share: float = SAFE_SHARE) -> int:
    return int(window * share)


def cuts(text: str, most: int) -> list[str]:
    step = max(LEAST_CUT, 4 * most)
    return [text[k : k + step] for k in range(0, len(text), step)]


def _pieces(text: str, most: int, count: Callable[[str], int]) -> Iterator[tuple[str | None, int]]:
    """Pieces with their tokens in order; None closes a segment."""
    for paragraph in _PARAGRAPH.split(text):
        n = count(paragraph)
        if n <= most:
            yield paragraph, n
            continue
        for sentence in _SENTENCE.split(paragraph):
            n = count(sentence)
            if n <= most:
                yield sentence, n
            else:
                yield from ((cut, count(cut)) for cut in cuts(sentence, most))
        yield None, 0


def segments(text: str, most: int, count: Callable[[str], int] = estimate) -> list[str]:
    """Pieces are put together, a blank line between them, as long as they fit. A cut that alone is too long for the
    embedder is a segment by itself, ahead of what was open."""
    if count(text) <= most:
        return [text]
    out: list[str] = []
    held: list[str] = []
    size = 0

    def close() -> None:
        nonlocal held, size
        if joined := "\n\n".join(held).strip():
            out.append(joined)
        held, size = [], 0

    for piece, n in _pieces(text, most, count):
        if piece is None:
            close()
        elif n > most:
            out.append(piece)
        else:
            if size + n > most:
                close()
            held.append(piece)
            size += n
    close()
    return [s for s in out if s]
