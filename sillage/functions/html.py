"""Pages as trees: cleaning, sections by heading, chunks by sliding window, links. Built over the standard parser.

The tree follows what that parser reports and no more: an end tag closes the nearest open element of its name and is ignored
where there is none; a start tag never closes another element; void elements close themselves.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that are taken out before anything is read (fixed values).
REMOVED = {"script", "style", "noscript", "form", "nav", "footer", "header", "aside"}
#: Elements whose text makes blocks (fixed values), and least words of a block.
BLOCKS, LEAST_WORDS = {"p", "li", "pre", "code", "blockquote", "td", "table"}, 4
#: Words of a chunk, words that neighbours share, and links that are carried over.
MAX_WORDS, OVERLAP, CARRIED = 350, 50, 3
_UNSEEN = {"script", "style", "template"}
_HEADING = re.compile(r"h([1-6])")


@dataclass
class Node:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order; without recursion, since unclosed tags nest deeply."""
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, Node):
                    yield c
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()

    def strings(self) -> Iterator[str]:
        stack: list[Iterator[Node | str]] = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, str):
                    yield c
                elif c.name not in _UNSEEN:
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()

    def text(self, joiner: str = " ") -> str:
        return joiner.join(s for x in self.strings() if (s := x.strip()))

    def level(self) -> int:
        m = _HEADING.fullmatch(self.name)
        return int(m[1]) if m else 0


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    """A page's tree. Declarations that the parser can't read are text."""
    try:
        return _read(html)
    except AssertionError:
        return _read(html.replace("<![", "&lt;!["))


def _read(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def cleaned(root: Node) -> Node:
    """The tree without the removed elements."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or c.name not in REMOVED]
        stack += [c for c in node.children if isinstance(c, Node)]
    return root


def body(root: Node) -> Node:
    return next((n for n in root.walk() if n.name == "body"), root)


def table_text(table: Node) -> str:
    """Rows between bars, a line of dashes after the first of several."""
    rows = [[c.text() for c in tr.walk() if c.name in ("td", "th")] for tr in table.walk() if tr.name == "tr"]
    lines = [f"| {' | '.join(cells)} |" for cells in rows if cells]
    if len(lines) > 1:
        columns = lines[0].count("|") - 1
        lines.insert(1, f"| {' | '.join(['---'] * columns)} |")
    return "\n".join(lines)


def block(node: Node) -> tuple[list[str], list[dict[str, str]]] | None:
    """Words and links of a block; None where it is too short."""
    words = (table_text(node) if node.name == "table" else node.text()).split()
    if len(words) < LEAST_WORDS:
        return None
    return words, [{"anchor_text": t, "target": a.attrs["href"]} for a in node.walk() if a.name == "a" and "href" in a.attrs and (t := a.text())]


def sections(root: Node) -> Iterator[tuple[list[str], list[tuple[list[str], list[dict[str, str]]]]]]:
    """Headings' path and blocks of each section.

    A section is a heading's later siblings up to a sibling heading of its level or above; blocks deeper inside them don't
    count, and those under lower headings count for the higher ones, too. Without any heading, all blocks of the page, nested
    ones again, are one section.
    """
    top = body(root)
    parents = {id(c): n for n in [top, *top.walk()] for c in n.children if isinstance(c, Node)}
    headings = [n for n in top.walk() if n.level()]
    if not headings:
        blocks = [b for n in top.walk() if n.name in BLOCKS and (b := block(n))]
        if blocks:
            yield [], blocks
        return
    path: list[str] = []
    for h in headings:
        level = h.level()
        path = [*path[: level - 1], *[""] * (level - 1 - len(path)), h.text()]
        siblings = parents[id(h)].children
        place = next(k for k, c in enumerate(siblings) if c is h)
        blocks = []
        for c in siblings[place + 1 :]:
            if isinstance(c, str):
                continue
            if c.level() and c.level() <= level:
                break
            if c.name in BLOCKS and (b := block(c)):
                blocks.append(b)
        if blocks:
            yield [p for p in path if p], blocks


def windows(blocks: list[tuple[list[str], list[dict[str, str]]]], most: int = MAX_WORDS, overlap: int = OVERLAP) -> Iterator[tuple[list[str], list[dict[str, str]]]]:
    """Words and links of a section's chunks.

    A block that would overfill a chunk starts the next; a block is never cut, so a long one makes a long chunk. After a chunk of
    more than overlap words, the next starts with its last ones, and with its last few links; what is left, be it that overlap alone, is a chunk.
    """
    words: list[str] = []
    links: list[dict[str, str]] = []

    def carry() -> tuple[list[str], list[dict[str, str]]]:
        return (words[-overlap:], links[-CARRIED:]) if 0 < overlap < len(words) else ([], [])

    for more, found in blocks:
        if words and len(words) + len(more) > most:
            yield words, links
            words, links = carry()
        words, links = words + more, links + found
        while len(words) >= most:
            yield words, links
            words, links = carry()
    if words:
        yield words, links


def chunk_hash(url: str, path: list[str], index: int) -> str:
    return hashlib.blake2b(f"{url}|{' > '.join(path)}|{index}".encode(), digest_size=10).hexdigest()


def chunks(url: str, html: str, most: int = MAX_WORDS, overlap: int = OVERLAP) -> list[dict]:
    """All chunks of a page in order; the whole text as one where no section gives any."""
    root = cleaned(tree(html))
    out = []
    for path, blocks in sections(root):
        for k, (words, links) in enumerate(windows(blocks, most, overlap)):
            out.append({"id": chunk_hash(url, path, k), "chunk_index": len(out), "text": " ".join(words), "length": len(words), "hierarchy": path, "outgoing_links": links})
    if not out and (text := body(root).text()):
        out.append({"id": chunk_hash(url, [], 0), "chunk_index": 0, "text": text, "length": len(text.split()), "hierarchy": [], "outgoing_links": []})
    return out


#: Elements that a run of text doesn't go across, and those that hold what surrounds a page's text.
BREAKS = {"p", "div", "li", "ul", "ol", "dl", "dt", "dd", "table", "tr", "td", "th", "section", "article", "main", "body", "pre", "blockquote", "figure", "figcaption", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "option", "form"} | REMOVED
AROUND = {"nav", "footer", "header", "aside", "form"}


def text_blocks(html: str) -> list[dict]:
    """The runs of text of a page in order: text (white space collapsed), words, those of them in links, whether it stands around the page's text, and whether it is a heading."""
    out: list[dict] = []
    held: list[tuple[str, bool]] = []
    place = {"around": 0, "a": 0, "heading": 0, "title": 0}

    def flush() -> None:
        words = " ".join(t for t, _ in held).split()
        if words:
            out.append({"text": " ".join(words), "words": len(words), "linked": sum(len(t.split()) for t, a in held if a), "around": place["around"] > 0, "heading": place["heading"] > 0})
        held.clear()

    def kind(name: str) -> str | None:
        return "around" if name in AROUND else "heading" if _HEADING.fullmatch(name) else name if name in ("a", "title") else None

    root = tree(html)
    stack: list[tuple[Node, Iterator[Node | str]]] = [(root, iter(root.children))]
    while stack:
        node, below = stack[-1]
        for c in below:
            if isinstance(c, str):
                if not place["title"]:
                    held.append((c, place["a"] > 0))
            elif c.name not in _UNSEEN and c.name != "noscript":
                if c.name in BREAKS:
                    flush()
                if kind(c.name):
                    place[kind(c.name)] += 1
                stack.append((c, iter(c.children)))
                break
        else:
            if node.name in BREAKS:
                flush()
            if kind(node.name):
                place[kind(node.name)] -= 1
            stack.pop()
    flush()
    return out


def page_text(html: str) -> str:
    return tree(html).text()


def links(html: str, base: str) -> list[dict[str, str]]:
    """Links of the whole page, navigation too: http targets without fragment, each once with its first text, numbered as they are kept."""
    out: dict[str, dict[str, str]] = {}
    for a in tree(html).walk():
        if a.name != "a" or "href" not in a.attrs:
            continue
        try:
            target = urldefrag(urljoin(base, a.attrs["href"])).url
            if urlsplit(target).scheme not in ("http", "https"):
                continue
        except ValueError:
            continue
        if target not in out:
            out[target] = {"target": target, "anchor_text": "".join(s.strip() for s in a.strings()), "source_chunk": f"chunk_{len(out)}"}
    return list(out.values())


def shown_emails(html: str) -> dict[str, str]:
    """Addresses that a proxy hid, by their hidden form: spans of class __cf_email__ with data-cfemail."""
    out = {}
    for n in tree(html).walk():
        hidden = n.attrs.get("data-cfemail", "")
        if n.name == "span" and "__cf_email__" in n.attrs.get("class", "").split() and hidden:
            try:
                raw = bytes.fromhex(hidden)
                out[hidden] = "".join(chr(b ^ raw[0]) for b in raw[1:])
            except (ValueError, IndexError):
                continue
    return out
