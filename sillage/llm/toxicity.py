"""Toxicity by a support vector machine over a gapped subsequence kernel, with Nystrom landmarks.

A piece is a token, or two neighbouring tokens with a gap between them. It is the weighted set of its subsequences of three
letters that lie within SPAN places, each weighing DECAY for each place it takes up; letters in between, or characters that are
no letters, cost weight but don't hide the subsequence. So the kernel of an insult and of the insult with inserted characters, a
missing letter or another ending stays high. A sentence's similarity to a landmark is that of its most similar piece: tokens
count for all landmarks, pairs of tokens where both resemble the words of a landmark of two words. Nystrom's map turns
similarities to the landmarks into coordinates, and a linear machine is trained on labelled sentences in these.

Counts of pieces, and the similarities of sentences, are made by the executors; the driver gets landmarks and a bounded number
of sentences.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sillage.llm.common import forget, read, slices, stored, whole

#: Subsequences: letters, the places they may lie within, weight for each place.
SPAN, DECAY = 6, 0.6
#: Tokens are cut to pieces of so many characters, which overlap by half.
LONGEST = 24
#: Landmarks from toxic sentences, of one word and of two, and from clean ones; similarity below FLOOR counts as none.
TOXIC_MARKS, PHRASE_MARKS, CLEAN_MARKS, FLOOR = 96, 16, 32, 0.35
#: Similarity from which a token may stand for a word of a landmark of two words, and from which landmarks are too alike to have both.
PART, ALIKE = 0.6, 0.8
#: Toxic documents that a landmark of one word is in at least, and the share of them that one of two words is in.
LEAST_SEEN, LEAST_PHRASE = 2, 0.05
#: Labelled documents of each label that training uses at most, chosen by hash of their id, and their characters. This bounds the sample.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 2000, 4000, 40_000_000
#: Sentences that the machine is trained on at most: of clean documents those that resemble a toxic landmark, of toxic ones those that hold one.
MOST_NEGATIVES, MOST_POSITIVES = 8000, 8000
#: Times that the machine is trained, from the second on with the clean sentences that it took for the most toxic.
ROUNDS = 3
#: How far the rarer label is made up for where the score is calibrated: 0 not at all, 1 so that both labels weigh the same.
BALANCE = 0.3
#: Similarity, above FLOOR, from which a sentence of a toxic document is taken to be one of those that make it so.
HOLDS = 0.6
#: Tokens whose verdict a worker remembers, in two generations.
REMEMBERED = 400_000
#: Landmarks that share one bound when tokens are screened, and the machine's costs of a toxic sentence missed and of a clean one taken.
SCREENED_TOGETHER, COST, COST_CLEAN = 8, 0.6, 0.5
SEED = 5

_LETTERS = 30  # 0 for no letter, a to z, start, end, and one more for letters of other alphabets
_EDGES = bytes([27]), bytes([28])
#: The codes that letters of other alphabets are spread over: neighbours in an alphabet get different ones.
_OTHERS = [*range(1, 27), 29]
_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_MAYBE_SPACED = re.compile(r" [^\W\d_] [^\W\d_] [^\W\d_](?!\S)")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_] ){3,}[^\W\d_](?!\S)")


class _Codes(dict):
    """Code points to the characters of their codes, as str.translate() takes them; only letters of a few alphabets are remembered."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        base = "s" if c == "ß" else unicodedata.normalize("NFKD", _LIKE.get(c, c).lower())[:1]
        letter = c if "\uac00" <= c <= "\ud7a3" else base  # a syllable of Hangul is more than its first letter
        code = chr(ord(base) - 96 if "a" <= base <= "z" else _OTHERS[ord(letter) % len(_OTHERS)] if letter.isalpha() else 0)
        if len(self) < 100_000:
            self[point] = code
        return code


_CODES = _Codes()


def letters(token: str) -> bytes:
    """A token as codes, without what is no letter at its ends."""
    return token.translate(_CODES).encode("latin-1").strip(b"\0")


def codes(token: str) -> list[bytes]:
    """A token as codes with a start and an end; long ones as overlapping pieces; none of one letter."""
    got = letters(token)
    if len(got) < 2:
        return []
    got = _EDGES[0] + got + _EDGES[1]
    if len(got) <= LONGEST:
        return [got]
    return [got[k : k + LONGEST] for k in range(0, len(got) - LONGEST // 2, LONGEST // 2)]


def phrase(one: bytes, two: bytes) -> bytes | None:
    """Two tokens' letters as one piece with a gap; none where they are too long, or one of them has no letter."""
    return _EDGES[0] + one + b"\0" + two + _EDGES[1] if one and two and len(one) + len(two) + 3 <= LONGEST else None


def _table(tokens: list[bytes]) -> np.ndarray:
    """Codes of tokens of one length as rows."""
    return np.frombuffer(b"".join(tokens), np.uint8).reshape(len(tokens), -1).astype(np.int32)


_places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}


def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if n not in _places:
        found = [(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))]
        i, j, k = np.array(found).reshape(-1, 3).T
        _places[n] = i, j, k, DECAY ** (k - i + 1).astype(np.float32)
    return _places[n]


def subsequences(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens of one length: ids of their subsequences (0 where one holds no letter), and their weights over the token's norm."""
    c = _table(tokens)
    i, j, k, w = _triples(c.shape[1])
    ids = (c[:, i] * _LETTERS + c[:, j]) * _LETTERS + c[:, k]
    ids[(c[:, i] == 0) | (c[:, j] == 0) | (c[:, k] == 0)] = 0
    order = np.argsort(ids, axis=1)
    sorted_ids = np.take_along_axis(ids, order, 1)
    sums = np.cumsum(np.where(sorted_ids > 0, w[order], 0), axis=1)
    last = np.ones(ids.shape, bool)
    last[:, :-1] = sorted_ids[:, 1:] != sorted_ids[:, :-1]
    row, column = np.nonzero(last)
    total = sums[row, column]
    before = np.where(np.concatenate([[True], row[1:] != row[:-1]]), 0, np.concatenate([[0], total[:-1]]))
    norm = np.sqrt(np.bincount(row, weights=(total - before) ** 2, minlength=len(tokens)))
    return ids, (np.where(ids > 0, w, 0) / np.maximum(norm, 1e-9)[:, None]).astype(np.float32)


def embedded(tokens: list[bytes]) -> np.ndarray:
    """A dense column of weights by subsequence for each of a few tokens."""
    out = np.zeros((_LETTERS**3, len(tokens)), np.float32)
    for t, token in enumerate(tokens):
        ids, weights = subsequences([token])
        np.add.at(out[:, t], ids[0], weights[0])
    out[0] = 0
    return out


def bounds(marks: np.ndarray) -> np.ndarray:
    """Columns that are at least as great as each of SCREENED_TOGETHER neighbouring landmarks."""
    return np.stack([marks[:, k : k + SCREENED_TOGETHER].max(axis=1) for k in range(0, marks.shape[1], SCREENED_TOGETHER)], axis=1)


def promising(tokens: list[bytes], above: np.ndarray) -> np.ndarray:
    """Places of tokens whose kernel with some landmark may reach FLOOR: none that does is missing, since the norm is taken too small."""
    out = []
    by_length: dict[int, list[int]] = {}
    for t, token in enumerate(tokens):
        by_length.setdefault(len(token), []).append(t)
    for n, places in by_length.items():
        i, j, k, w = _triples(n)
        for at in range(0, len(places), 4096):
            part = np.array(places[at : at + 4096])
            c = _table([tokens[t] for t in part.tolist()])
            got, norm = np.zeros((len(part), above.shape[1]), np.float32), np.zeros(len(part), np.float32)
            gap = c == 0
            for x, y, z, weight in zip(i.tolist(), j.tolist(), k.tolist(), w.tolist(), strict=True):
                ids = (c[:, x] * _LETTERS + c[:, y]) * _LETTERS + c[:, z]
                real = ~(gap[:, x] | gap[:, y] | gap[:, z])
                got += above[np.where(real, ids, 0)] * weight
                norm += real * (weight * weight)
            out.append(part[got.max(axis=1) >= FLOOR * np.sqrt(norm) * 0.999])
    return np.concatenate(out) if out else np.zeros(0, int)


def similarity(tokens: list[bytes], marks: np.ndarray) -> np.ndarray:
    """The kernel, 0 to 1, of every token with every landmark (columns of marks)."""
    out = np.zeros((len(tokens), marks.shape[1]), np.float32)
    by_length: dict[int, list[int]] = {}
    for t, token in enumerate(tokens):
        by_length.setdefault(len(token), []).append(t)
    for places in by_length.values():
        for at in range(0, len(places), 2048):
            part = places[at : at + 2048]
            ids, weights = subsequences([tokens[t] for t in part])
            got = np.zeros((len(part), marks.shape[1]), np.float32)
            for column in range(ids.shape[1]):
                got += weights[:, column, None] * marks[ids[:, column]]
            out[part] = got
    return out


def floored(k: np.ndarray) -> np.ndarray:
    return np.maximum(0, (k - FLOOR) / (1 - FLOOR))


@dataclass
class Model:
    """Landmarks as dense columns, toxic ones first, the words of those of two words (first ones, then second ones), the Nystrom
    map, the machine's weights, and the logistic curve of its margin."""

    marks: np.ndarray
    n_toxic: int
    map: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    parts: tuple[list[bytes], list[bytes]] = field(default_factory=lambda: ([], []))

    def margins(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.map @ self.weights + self.bias

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def tokens_of(text: str) -> list[str]:
    found = text.split()
    if _MAYBE_SPACED.search(text):
        found += [m[0].replace(" ", "") for m in _SPACED.finditer(text)]
    return found


class Scorer:
    """Scores texts by a model; remembers the tokens' similarities, None for those that resemble no toxic landmark."""

    def __init__(self, model: Model, remembered: int = REMEMBERED) -> None:
        self.model, self.remembered, self.now, self.old = model, remembered, {}, {}
        self.above = bounds(model.marks[:, : model.n_toxic])
        self.none = model.score(float(model.margins(np.zeros((1, model.marks.shape[1]), np.float32))[0]))
        #: Tokens that may be a first, or a second word of a landmark of two; the similarities of pairs of such tokens.
        self.sides: tuple[set[str], set[str]] = set(), set()
        self.pairs: dict[tuple[str, str], np.ndarray | None] = {}
        self.words = [embedded(p) for p in model.parts] if model.parts[0] else []

    def learn(self, tokens: set[str]) -> None:
        now, old = self.now, self.old
        new = [t for t in tokens if t not in now]
        if len(now) + len(new) > self.remembered:
            self.old = old = now
            self.now = now = {}
            new = list(tokens)
            self.pairs.clear()
            self.sides = tuple({t for t in side if t in old} for side in self.sides)
        pieces, owner = [], []
        for t in new:
            if t in old:
                now[t] = old[t]
            else:
                now[t] = None
                for p in codes(t):
                    pieces.append(p)
                    owner.append(t)
        near = promising(pieces, self.above).tolist()
        if near:
            found = floored(similarity([pieces[k] for k in near], self.model.marks))
            toxic = found[:, : self.model.n_toxic].any(axis=1)
            for row in np.flatnonzero(toxic).tolist():
                t, values = owner[near[row]], found[row].copy()  # a view would keep the whole table
                now[t] = values if now[t] is None else np.maximum(now[t], values)
        for side, words in zip(self.sides, self.words, strict=False):
            may = promising(pieces, bounds(words)).tolist()
            if may:
                alike = similarity([pieces[k] for k in may], words).max(axis=1) >= PART
                side.update(owner[may[row]] for row in np.flatnonzero(alike).tolist())

    def together(self, one: str, two: str) -> np.ndarray | None:
        """Similarities of two neighbouring tokens as one piece."""
        if (one, two) not in self.pairs:
            got = phrase(letters(one), letters(two))
            values = floored(similarity([got], self.model.marks))[0] if got else None
            self.pairs[one, two] = values if values is not None and values[: self.model.n_toxic].any() else None
        return self.pairs[one, two]

    def pooled(self, text: str, tokens: list[str]) -> list[np.ndarray]:
        """Of each sentence that resembles a toxic landmark at all, its greatest similarity to each landmark."""
        now, (first, second) = self.now, self.sides
        joined = bool(first) and not first.isdisjoint(tokens) and not second.isdisjoint(tokens)
        if not joined and not any([now[t] is not None for t in tokens]):
            return []
        out = []
        for sentence in _SENTENCE.split(text):
            of = tokens_of(sentence)
            found = [v for t in of if (v := now.get(t)) is not None]
            if joined:
                found += [v for a, b in zip(of, of[1:], strict=False) if a in first and b in second and (v := self.together(a, b)) is not None]
            if found:
                out.append(np.maximum.reduce(found) if len(found) > 1 else found[0])
        return out

    def bags(self, texts: list[str]) -> list[list[np.ndarray]]:
        found = [tokens_of(t) for t in texts]
        self.learn(set().union(*found))
        return [self.pooled(t, ts) for t, ts in zip(texts, found, strict=True)]

    def most(self, texts: list[str]) -> list[float | None]:
        """Of each text the greatest margin of a sentence, None where no sentence resembles a toxic landmark."""
        pooled = self.bags(texts)
        flat = [v for p in pooled for v in p]
        margins = self.model.margins(np.array(flat, np.float32)) if flat else np.zeros(0)
        ends = np.cumsum([0, *map(len, pooled)]).tolist()
        return [float(margins[a:b].max()) if b > a else None for a, b in zip(ends, ends[1:], strict=False)]

    def scores(self, texts: list[str]) -> list[float]:
        return [self.none if m is None else max(self.model.score(m), self.none) for m in self.most(texts)]


def _train_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear machine by dual coordinate descent; y is -1 or 1, cost bounds each row's multiplier."""
    rng = np.random.default_rng(SEED)
    x1 = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1).astype(np.float64)
    norms, alpha, w = (x1**2).sum(axis=1), np.zeros(len(x1)), np.zeros(x1.shape[1])
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(x1)):
            old = alpha[i]
            alpha[i] = min(max(old - (y[i] * (w @ x1[i]) - 1) / norms[i], 0), cost[i])
            if alpha[i] != old:
                w += (alpha[i] - old) * y[i] * x1[i]
                most = max(most, abs(alpha[i] - old))
        if most < 1e-3:
            break
    return w[:-1], float(w[-1])


def _logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over weighted margins, by Newton's method, with a little weight on slope 1."""
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        r, v = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * margin).sum() + 0.1 * (a - 1), r.sum() + 0.01 * b])
        h = np.array([[(v * margin * margin).sum() + 0.1, (v * margin).sum()], [(v * margin).sum(), v.sum() + 0.01]])
        step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def pieces_of(text: str) -> set[bytes]:
    """The distinct pieces of a text's tokens."""
    return {p for t in set(tokens_of(text)) for p in codes(t)}


def pairs_of(text: str) -> set[tuple[bytes, bytes]]:
    """The distinct pairs of neighbouring tokens in a text's sentences that make a piece."""
    pairs: set[tuple[bytes, bytes]] = set()
    for sentence in _SENTENCE.split(text):
        got = [letters(t) for t in sentence.split()]
        pairs.update(zip(got, got[1:], strict=False))
    return {p for p in pairs if phrase(*p)}


def spread(candidates: list[bytes], most: int, alike: float = ALIKE) -> list[bytes]:
    """Of candidates, the best first, those that are not alike one taken before, most of them at most."""
    taken: list[bytes] = []
    columns = np.zeros((_LETTERS**3, most), np.float32)
    for t in candidates:
        if len(taken) == most:
            break
        ids, weights = subsequences([t])
        if not taken or float((weights[0][:, None] * columns[ids[0], : len(taken)]).sum(axis=0).max()) < alike:
            columns[:, len(taken)] = embedded([t])[:, 0]
            taken.append(t)
    return taken


def landmarks(telling: list[bytes], phrases: list[tuple[bytes, bytes]], frequent: list[bytes]) -> Model:
    """A model without weights from toxic tokens and pairs, the most telling first, and frequent clean tokens."""
    words = spread(telling, TOXIC_MARKS)
    by_piece = {phrase(*p): p for p in phrases}
    pairs = spread(list(by_piece), PHRASE_MARKS)
    # In order of their letters, so that neighbours are alike and share close bounds.
    picked = sorted(words) + sorted(pairs)
    n_toxic = len(picked)
    # Clean tokens most like the toxic landmarks, so that the machine learns where the likeness ends.
    if picked and frequent:
        near = similarity(frequent, embedded(picked)).max(axis=1)
        picked += spread([frequent[k] for k in np.argsort(-near, kind="stable")], CLEAN_MARKS)
    if not picked:
        picked, n_toxic = [_EDGES[0] + bytes([1, 1, 1]) + _EDGES[1]], 1
    marks = embedded(picked)
    values, vectors = np.linalg.eigh((marks.T @ marks).astype(np.float64))
    onto = (vectors / np.sqrt(np.maximum(values, 1e-3))).astype(np.float32)
    parts = tuple([_EDGES[0] + by_piece[p][side] + _EDGES[1] for p in sorted(pairs)] for side in (0, 1))
    return Model(marks, n_toxic, onto, np.zeros(len(picked)), 0.0, 1.0, 0.0, parts)


def constant(share: float) -> Model:
    """A model that scores every text by the share of toxic ones."""
    share = float(np.clip(share, 1e-6, 1 - 1e-6))
    return Model(np.zeros((_LETTERS**3, 1), np.float32), 1, np.eye(1, dtype=np.float32), np.zeros(1), 0.0, 1.0, float(np.log(share / (1 - share))))


def held_out(id_col: str = "doc_id"):  # noqa: ANN201
    """Whether a document is kept from training; rows without an id are."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the labelled documents that training uses, held-out ones apart, in the shared folder.

    Documents of each label come in order of a hash of their id, SAMPLE_TOXIC and SAMPLE_CLEAN at most, and while their whole texts
    come to no more than half of SAMPLE_CHARS. Of an id that has both labels the toxic one counts, of one that has several texts the greatest.
    """
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    draw = F.xxhash64("doc_id")
    parts = [known.where(f"toxic = {c}").orderBy(draw, "doc_id").limit(n) for c, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN ids.
    few = F.broadcast(parts[0].union(parts[1]))
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).join(few, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text")), "labelled")
    before = F.sum("n").over(Window.partitionBy("toxic").orderBy(draw, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = rows.select("doc_id", "toxic", F.length("text").alias("n")).withColumn("sum", before).where(f"sum <= {SAMPLE_CHARS // 2}").select("doc_id")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    kept = stored(rows.join(F.broadcast(fits), "doc_id").repartition(2 * cores, "doc_id"), "sample")
    forget(rows)
    return kept


def _counted(sample: DataFrame) -> DataFrame:
    """a, n_toxic, n_clean: in how many documents of each label a piece is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for labels, texts in slices(batches, 16):
            for label, text in zip(labels, texts, strict=True):
                got = list(pieces_of(text))
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), pa.array([label] * len(got), pa.int32())], names=["a", "toxic"])

    rows = sample.select("toxic", "text").mapInArrow(run, "a binary, toxic int")
    return rows.groupBy("a").agg(F.sum("toxic").alias("n_toxic"), F.sum(1 - F.col("toxic")).alias("n_clean"))


def _paired(sample: DataFrame, only: set[tuple[bytes, bytes]] | None = None) -> DataFrame:
    """a, b, n: in how many documents a pair of neighbouring tokens is; of some pairs, or of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in slices(batches, 16):
            got = [p for t in texts for p in (pairs_of(t) if only is None else pairs_of(t) & only)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in got], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return sample.select("text").mapInArrow(run, "a binary, b binary").groupBy("a", "b").agg(F.count("*").alias("n"))


def _phrases(sample: DataFrame, counted: DataFrame, n_toxic: int, n_clean: int) -> list[tuple[bytes, bytes]]:
    """Pairs of neighbouring tokens that tell more than either word alone, the most telling first.

    Candidates come from the toxic documents, the most frequent 4096 at most; only those are looked for in the clean ones.
    """
    often = _paired(sample.where("toxic = 1")).where(F.col("n") >= max(2, LEAST_PHRASE * n_toxic)).orderBy(F.desc("n"), "a", "b").limit(4096)
    toxic = {(bytes(r["a"]), bytes(r["b"])): r["n"] for r in often.collect()}
    if not toxic:
        return []
    clean = {(bytes(r["a"]), bytes(r["b"])): r["n"] for r in _paired(sample.where("toxic = 0"), set(toxic)).collect()}
    words = [_EDGES[0] + w + _EDGES[1] for w in {w for p in toxic for w in p}]
    alone = {bytes(r["a"])[1:-1]: r["evidence"] for r in counted.where(F.col("a").isin([bytearray(w) for w in words])).select("a", "evidence").collect()}
    evidence = {p: n / n_toxic - 3 * clean.get(p, 0) / n_clean for p, n in toxic.items()}
    return sorted((p for p, e in evidence.items() if e > 0 and e > 2 * max(alone.get(w, 0) for w in p)), key=lambda p: (-evidence[p], p))[: 40 * PHRASE_MARKS]


def _sentences(sample: DataFrame, model: Model) -> DataFrame:
    """doc_id, toxic, v, near of every sentence of the sample that resembles a toxic landmark: its similarities, and the greatest of them to such."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value, REMEMBERED // 4)
        for ids, labels, texts in slices(batches, 32):
            rows = [(i, y, v) for i, y, bag in zip(ids, labels, scorer.bags(texts), strict=True) for v in bag]
            if rows:
                near = [float(v[: scorer.model.n_toxic].max()) for _, _, v in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].tobytes() for r in rows], pa.binary()), pa.array(near, pa.float32())], names=["doc_id", "toxic", "v", "near"])

    return sample.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, v binary, near float")


def _margins(sentences: DataFrame, model: Model) -> DataFrame:
    """sentences with margin."""
    sent = sentences.sparkSession.sparkContext.broadcast((model.map @ model.weights, model.bias))
    at, schema = sentences.columns.index("v"), T.StructType([*sentences.schema, T.StructField("margin", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        onto, bias = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                vs = part.column(at).to_pylist()
                margins = np.frombuffer(b"".join(vs), np.float32).reshape(len(vs), -1) @ onto + bias
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(margins, pa.float64())], names=[*part.schema.names, "margin"])

    return sentences.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labels (doc_id, toxic) and docs (doc_id, text), held-out rows apart, from a bounded sample (see _sample).

    A toxic document's sentences that hold a toxic landmark are taken to be toxic, or else the one that is most like one, since it needs
    one such sentence only. Without documents of both labels every score is the share of toxic ones (0 without any).
    """
    sample = _sample(docs, labels)
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        forget(sample)
        return constant(n_toxic / max(n_toxic + n_clean, 1))
    counted = stored(_counted(sample).withColumn("evidence", F.col("n_toxic") / n_toxic - 3 * F.col("n_clean") / n_clean), "pieces")
    best = counted.where(f"n_toxic >= {LEAST_SEEN} and evidence > 0 and length(a) > 4").orderBy(F.desc("evidence"), "a").limit(40 * TOXIC_MARKS)
    common = counted.where("n_clean >= 2 and evidence < 0").orderBy(F.desc("n_clean"), "a").limit(20_000)
    telling, frequent = ([bytes(r["a"]) for r in rows.select("a").collect()] for rows in (best, common))
    model = landmarks(telling, _phrases(sample, counted, n_toxic, n_clean), frequent)
    sentences = stored(_sentences(sample, model), "sentences")
    draw = F.xxhash64("doc_id", "v")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("near"), "v")) == 1
    positive = sentences.where("toxic = 1").withColumn("first", first).where(f"first or near >= {HOLDS}").orderBy(F.desc("first"), draw, "doc_id", "v").limit(MOST_POSITIVES)
    clean = sentences.where("toxic = 0")
    nothing = np.zeros((1, model.marks.shape[1]), np.float32)

    def table(rows: DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(bytes(r["v"]) for r in rows.select("v").collect()), np.float32).reshape(-1, model.marks.shape[1])

    positives, negatives = table(positive), np.concatenate([nothing, table(clean.orderBy(draw, "doc_id", "v").limit(MOST_NEGATIVES // 2))])
    hardest = negatives[:0]
    for turn in range(ROUNDS):
        if turn:
            hardest = table(_margins(clean, model).orderBy(F.desc(F.round("margin", 4)), draw, "doc_id", "v").limit(MOST_NEGATIVES // 2))
        x = np.concatenate([positives, negatives, hardest])
        toxic = np.arange(len(x)) < len(positives)
        model.weights, model.bias = _train_svm(x @ model.map, np.where(toxic, 1.0, -1.0), np.where(toxic, COST, COST_CLEAN))
    # Documents without a sentence have the margin of nothing.
    ends = [(r["toxic"], r["margin"]) for r in _margins(sentences, model).groupBy("doc_id", "toxic").agg(F.max("margin").alias("margin")).collect()]
    least = float(model.margins(nothing)[0])
    ends += [(c, least) for c, total in ((1, n_toxic), (0, n_clean)) for _ in range(total - sum(y == c for y, _ in ends))]
    y = np.array([float(y) for y, _ in ends])
    # Toxic documents are rare: one counts for as many clean ones as there are to it, to the power of BALANCE.
    model.slope, model.offset = _logistic(np.array([m for _, m in ends]), y, np.where(y > 0, (n_clean / n_toxic) ** BALANCE, 1.0))
    forget(sample, counted, sentences)
    return model


def rated(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. Null texts are empty and score as the empty text; rows are independent."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for ids, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scorer.scores(texts), pa.float64())], names=["doc_id", "score"])

    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model scores 0.5 or more; all columns stay, and null texts are judged as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                yield part.filter(pa.array([s < 0.5 for s in scorer.scores([t or "" for t in part.column(at).to_pylist()])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return rated(docs, train(docs, read(spark, sf_dir, "labels")))
