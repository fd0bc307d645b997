"""BPE encoding and decoding: a segment tree over the ranks of adjacent pairs yields every merge."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.llm.common import read, slices, whole

#: Unicode White_Space, which is what separates words here; str.split() would also split at 1C to 1F.
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
_OTHERS = regex.compile("[\x1c-\x1f]")
_NEVER = 1 << 62
#: Words and pieces that a worker remembers, in two generations of this many each.
REMEMBERED, REMEMBERED_PIECES = 250_000, 120_000
#: Rows that are encoded together; pieces of more bytes are merged one by one.
TOGETHER, LONGEST_TOGETHER = 256, 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Memory(dict):
    """A dict that forgets what was not used for a while, and so never holds more than twice its limit."""

    def __init__(self, make: Callable, limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):  # noqa: ANN001, ANN204
        value = self.old.get(key)
        return self.keep(key, self.make(key) if value is None else value)

    def keep(self, key, value):  # noqa: ANN001, ANN201
        if len(key) <= LONGEST_TOGETHER:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def unknown(self, keys: Iterable) -> list:
        old = self.old
        return [k for k in keys if k not in self and k not in old]


class Bpe:
    """A byte-level BPE tokenizer with word ends, from its JSON description."""

    def __init__(self, described: str) -> None:
        d = json.loads(described)
        model = d["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.numbers = {i: str(i) for i in self.tokens}
        self.rank: dict[int, int] = {}
        self.into: list[int] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            joined = a.removesuffix(end) + b if end and a.endswith(end) else a + b
            self.rank[vocab[a] << 20 | vocab[b]] = r
            self.into.append(vocab[joined])
        alphabet = byte_alphabet()
        self.inner, self.last = [vocab[c] for c in alphabet], [vocab[c + end] for c in alphabet]
        split = next(p for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", _SPACE.pattern[1:-2]))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces, self.words = Memory(self.piece, REMEMBERED_PIECES), Memory(self.word, REMEMBERED)
        order = sorted(self.rank)
        self.pair_keys = np.array(order, np.int64)
        self.pair_ranks = np.array([self.rank[k] for k in order], np.int64)
        self.results = np.array(self.into, np.int64)
        self.inner_ids, self.last_ids = np.array(self.inner, np.int64), np.array(self.last, np.int64)

    def merged(self, piece: str) -> list[int]:
        """Ids of one piece.

        Leaves of the tree are adjacent pairs, keyed by rank and then by place, so that the root is the leftmost pair of
        the lowest rank. A merge changes three leaves; each change walks up to the root, so n symbols take O(n log n).
        """
        raw = piece.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n = len(ids)
        if n == 1:
            return ids
        rank, into = self.rank.get, self.into
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [_NEVER] * (2 * size)
        for i in range(n - 1):
            r = rank(ids[i] << 20 | ids[i + 1])
            if r is not None:
                tree[size + i] = r * size + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (least := tree[1]) != _NEVER:
            i = least & (size - 1)
            j = after[i]
            ids[i] = into[least // size]
            ids[j] = -1
            k = after[i] = after[j]
            changed = [(j, _NEVER)] if j < n - 1 else []
            if k < n:
                before[k] = i
                r = rank(ids[i] << 20 | ids[k])
                changed.append((i, _NEVER if r is None else r * size + i))
            else:
                changed.append((i, _NEVER))
            if (h := before[i]) >= 0:
                r = rank(ids[h] << 20 | ids[i])
                changed.append((h, _NEVER if r is None else r * size + h))
            for leaf, key in changed:
                at = leaf + size
                tree[at] = key
                while at > 1:
                    at >>= 1
                    a, b = tree[2 * at], tree[2 * at + 1]
                    least = a if a < b else b
                    if tree[at] == least:
                        break
                    tree[at] = least
        return [x for x in ids if x >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, -1 for those that don't merge."""
        keys = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merged_together(self, pieces: list[bytes], size: int) -> list[list[int]]:
        """merged() for many pieces at once, each with a segment tree of size leaves, a power of two, as a row of one table.

        Every turn takes the root of each tree that has a mergeable pair left, and walks its three changed leaves up.
        """
        n, width = len(pieces), size + 2
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size + 1, b"\0") for p in pieces), np.uint8).reshape(n, size + 1)
        column = np.arange(size + 1)
        ids = np.full((n, width), -1, np.int64)
        ids[:, : size + 1] = np.where(column < lengths[:, None], np.where(column == lengths[:, None] - 1, self.last_ids[raw], self.inner_ids[raw]), -1)
        end = size + 1  # the column that stands for no symbol
        after = np.where(np.arange(width) + 1 < lengths[:, None], np.arange(width) + 1, end)
        before = np.tile(np.arange(width) - 1, (n, 1))
        tree = np.full((n, 2 * size), _NEVER, np.int64)
        ranks = np.where(ids[:, 1 : size + 1] >= 0, self._ranks(np.maximum(ids[:, :size], 0), np.maximum(ids[:, 1 : size + 1], 0)), -1)
        tree[:, size:] = np.where(ranks >= 0, ranks * size + column[:size], _NEVER)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] < _NEVER)
        while len(rows):
            root = tree[rows, 1]
            i = root & (size - 1)
            j = after[rows, i]
            k, h = after[rows, j], before[rows, i]
            new = self.results[root // size]
            ids[rows, i], ids[rows, j] = new, -1
            after[rows, i] = k
            before[rows, k] = i
            has_left = h >= 0
            right = np.where(k < end, self._ranks(new, np.maximum(ids[rows, k], 0)), -1)
            left = np.where(has_left, self._ranks(np.maximum(ids[rows, np.maximum(h, 0)], 0), new), -1)
            inside = j < size
            tree[rows[inside], size + j[inside]] = _NEVER
            tree[rows, size + i] = np.where(right >= 0, right * size + i, _NEVER)
            tree[rows[has_left], size + h[has_left]] = np.where(left >= 0, left * size + h, _NEVER)[has_left]
            at = np.stack([np.where(inside, j, i), i, np.where(has_left, h, i)]) + size
            while at[0, 0] > 1:
                at >>= 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            rows = rows[tree[rows, 1] < _NEVER]
        live = ids[:, : size + 1] >= 0
        flat, ends = ids[:, : size + 1][live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def piece(self, piece: str) -> list[int]:
        return self.merged(piece)

    def cut(self, word: str) -> list[str]:
        """Pieces of a run without white space; special tokens are pieces of their own."""
        out: list[str] = []
        for part in self.specials.split(word) if self.specials else (word,):
            if part in self.special:
                out.append(part)
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part)
                    part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
                else:
                    part = part.lower()
                out += self.pattern.findall(part)
        return out

    def word(self, word: str) -> list[int]:
        # No piece of the pattern holds a whole special token, so that names tell them apart.
        parts = [[self.special[p]] if p in self.special else self.pieces[p] for p in self.cut(word)]
        return parts[0] if len(parts) == 1 else [i for p in parts for i in p]

    def learn(self, words: Iterable[str]) -> None:
        """Remember the pieces of all words that aren't known yet, merged together by size."""
        cut = {w: self.cut(w) for w in self.words.unknown(words)}
        groups: dict[int, list[str]] = {}
        for p in self.pieces.unknown({p for parts in cut.values() for p in parts if p not in self.special}):
            n = len(p.encode("utf-8", "surrogatepass"))
            if n <= LONGEST_TOGETHER:
                groups.setdefault(1 << (max(n - 2, 0)).bit_length(), []).append(p)
        made = {p: ids for size, group in groups.items() for p, ids in zip(group, self.merged_together([p.encode("utf-8", "surrogatepass") for p in group], size), strict=True)}
        for p, ids in made.items():
            self.pieces.keep(p, ids)
        for w, parts in cut.items():
            found = [made.get(p) or ([self.special[p]] if p in self.special else self.pieces[p]) for p in parts]
            self.words.keep(w, found[0] if len(found) == 1 else [i for f in found for i in f])

    def forget(self) -> None:
        """Free what was remembered: a task's words are learned within its first few thousand rows, and workers outlive tasks."""
        for memory in (self.words, self.pieces):
            memory.old = {}
            memory.clear()

    def _split(self, text: str) -> list[str]:
        return [w for w in _SPACE.split(text) if w] if _OTHERS.search(text) else text.split()

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        split = [self._split(t) for t in texts]
        self.learn(set().union(*split))
        words = self.words
        for ws in split:
            yield list(chain.from_iterable([words[w] for w in ws]))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def listed(self, ids: list[int]) -> str:
        """ids as decimal numbers joined by one space."""
        return " ".join(map(self.numbers.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Without a decoder of its own, a vocabulary's tokens are joined by one space; special ones stay, ids outside the vocabulary don't."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join([self.tokens[i] for i in ids if i in self.tokens])


_made: dict[str, Bpe] = {}


def _of(described: str) -> Bpe:
    """One tokenizer for each vocabulary in a worker."""
    key = hashlib.sha256(described.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = Bpe(described)
    return _made[key]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _load(spark: SparkSession, vocabulary: str | None) -> Broadcast:
    """The vocabulary's description, at most a few MB, sent to the workers as text."""
    return spark.sparkContext.broadcast(Path(vocabulary or default_vocabulary()).read_text("utf-8"))


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every whole text. Null and empty texts have no ids; null ids of documents stay null; rows are independent, so repeated rows repeat."""
    described = _load(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(described.value)
        for keys, texts in slices(batches, TOGETHER):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(list(bpe.encode_all(texts)), pa.list_(pa.int32()))], names=["doc_id", "ids"])
        bpe.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and decoded, the text of ids. Null ids decode to the empty text; ids outside the vocabulary are skipped."""
    described = _load(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(described.value)
        for keys, ids in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([bpe.decode(i or []) for i in ids], pa.string())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded string")


def encode_decode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text that decoding these ids gives, in one pass and without keeping either.

    Null and empty texts have no ids; null ids of documents stay null; rows are independent, so repeated rows repeat; other columns are ignored.
    """
    described = _load(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(described.value)
        for keys, texts in slices(batches, TOGETHER):
            made = [(len(ids), _sha(bpe.listed(ids)), _sha(bpe.decode(ids))) for ids in bpe.encode_all(texts)]
            columns = [pa.array(c, t) for c, t in zip((keys, *zip(*made, strict=True)), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents"))
