"""Secret scans: fixed patterns, and strings that a primed zstandard cannot shorten in a sensitive context."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from math import inf, log2

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.llm.common import read, slices, whole

#: Kinds of spans in the order in which equal starts are listed; the last is found by novelty.
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: What makes a context sensitive, lower case, and how far before or after a candidate it may stand.
SENSITIVE = ("passw", "secret", "token", "key", "auth", "bearer", "credential", "private", "signature", "session", "cookie", "pwd")
_SENSITIVE = re.compile("(?ai)" + "|".join(SENSITIVE))
NEAR = 48
#: Candidates: so many characters at least; each must cost so many bytes for each of its own. Those of letters and digits are told from
#: prose by that alone. Those of one of them alone must cost more, as must those before a sensitive word, or where one is only near.
LEAST_LENGTH, LEAST_NOVELTY, LEAST_OF_ONE_KIND, LEAST_BEFORE = 16, 0.6, 0.8, 0.8
#: From so many characters on, and among prose for letters of one case, the compressor codes characters by their frequency: a random value then costs no
#: more than its alphabet asks for.
CODED = 30
#: Letters alone: words that the dictionary lacks cost much as well, so such a value also has capitals that start no word of three letters or
#: more, so many for each letter, or so many pairs of neighbours, of all its pairs, that no two identifiers of the dictionary have.
LEAST_CAPITALS, LEAST_ODD_PAIRS = 0.12, 0.5
#: Digits alone: dates, numbers of cards and times in microseconds have fewer, a key of 64 bits has more.
LEAST_DIGITS = 19
#: Values with other signs, which stand in quotes: so many neighbours, of all, are of different kinds (small, capital, digit, sign), unlike in paths and code.
LEAST_CHANGES = 0.45
_CHARS = "A-Za-z0-9+/_-"
_PADDED = rf"[{_CHARS}]{{{LEAST_LENGTH},}}(?:={{1,2}}(?![={_CHARS}]))?"
#: A value, which may follow '='; a value joined to a sensitive word by a separator; a run with any '=' inside.
_VALUE = re.compile(rf"(?<![{_CHARS}]){_PADDED}")
_JOINED = re.compile(rf"[+/_-]+({_PADDED})")
_RUN = re.compile(rf"(?<![={_CHARS}])[={_CHARS}]{{{LEAST_LENGTH},}}")
_NAME = re.compile("[A-Za-z+/_-]+=+")
_QUOTED = re.compile(rf"""["'`]([!#-&(-_a-~]{{{LEAST_LENGTH},}})["'`]""")
_CHANGES = re.compile("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]")
#: Code and text around a candidate that prime the compressor.
AROUND = 256
#: What programs and settings call things: the identifier dictionary.
IDENTIFIERS = """
access account address admin api application args array assert async authorization await aws base64 bearer begin bool branch break
bucket buffer build byte cache case catch char class client cloud code column command commit config connection console const
content context continue cookie count create credential cursor data database date debug default define delete description dict
digest directory docker document domain double elif else email enable encode encoding endpoint endswith enum environment error
event except exception export expires extends false field file filter final float for format from function generate get github
global group handler hash header headers host http https identifier import include index init input insert instance int interface
internal issuer item join json key label lambda length level library license limit line list load local localhost log login
main map master match message method model module name namespace new none null number object offset option options origin output
package param parameter password path payload port post prefix print private process project property protected provider proxy
public python query raise random read redirect refresh region register release remove repository request response result return
role root router sample schema scope script secret select self sequence server service session setting signature size source
split sql staging start startswith state static status storage store stream string struct suffix super switch table tag target
template test text thread throw time timeout timestamp token true type update upload url user username utf8 value var variable
vector version void while width with world write xml yaml yield
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ ================ ---------------- ________________
""".encode()

_compressor: list[zstandard.ZstdCompressor] = []
_seen = Counter(a + b for name in re.findall("[a-z]{2,}", IDENTIFIERS.decode().split("0123456789")[0]) for a, b in pairwise(name))
#: Pairs of letters that two identifiers have, or one has twice.
_PAIRS = frozenset(pair for pair, n in _seen.items() if n > 1)


def _size(data: bytes) -> int:
    if not _compressor:
        _compressor.append(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False))
    return len(_compressor[0].compress(data))


def novelty(before: str, candidate: str, after: str) -> float:
    """Compressed bytes that the candidate adds to its surroundings, for each byte of its own; the compressor knows the identifiers."""
    a, c, b = (x.encode("utf-8", "surrogatepass") for x in (before, candidate, after))
    return (_size(a + b + c) - _size(a + b)) / len(c)


def base_spans(text: str, lowered: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; a pattern is run only where its literals occur."""
    found = []
    if any(k in lowered for k in ("passw", "secret", "token", "key")):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


def _candidates(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether a sensitive word stands before) of what stands near a sensitive word; each once or, on both sides of such words, twice.

    A value may start anywhere after '=', or at a separator behind the word itself; of words in one value only the first and the
    last count, so that no text is read again for each of its words.
    """
    words = [(m.start(), m.end()) for m in _SENSITIVE.finditer(text)]
    tried: set[tuple[re.Pattern[str], int]] = set()
    until = 0
    for k, (at, after) in enumerate(words):
        if at >= until or k + 1 == len(words) or words[k + 1][0] >= until:
            m = _JOINED.match(text, after)
            if m:
                until = m.end()
                yield *m.span(1), True
        # A candidate that starts in time shows by then; it is taken to its own end, wherever the window ends.
        for pattern in (_VALUE, _RUN):
            for m in pattern.finditer(text, after, after + NEAR + LEAST_LENGTH):
                if (pattern, m.start()) not in tried:
                    tried.add((pattern, m.start()))
                    yield *pattern.match(text, m.start()).span(), True
    if words:
        # Before a word: one pass over the text, each value against the next word that begins after it.
        nth = 0
        for m in _VALUE.finditer(text):
            while nth < len(words) and words[nth][0] < m.end():
                nth += 1
            if nth == len(words):
                break
            if words[nth][0] - m.end() <= NEAR and (_VALUE, m.start()) not in tried:
                yield *m.span(), False


def _novel_letters(word: str) -> bool:
    """Whether letters follow one another as in no name: capitals inside, and before fewer than two small letters, or pairs that no names have."""
    odd = len(re.findall("(?<=[A-Za-z])[A-Z](?![a-z]{2})", word))
    if re.search("[a-z]", word) and odd >= LEAST_CAPITALS * len(word):
        return True
    pairs = [a + b for a, b in pairwise(word.lower()) if a.isalpha() and b.isalpha()]
    return len(pairs) >= LEAST_LENGTH // 2 and sum(p not in _PAIRS for p in pairs) >= LEAST_ODD_PAIRS * len(pairs)


def _least(word: str, behind: bool) -> float:
    """The novelty from which a candidate is a secret, by its alphabet and length; without bound where its characters tell it for a name or a number."""
    digits, letters = sum(c.isdigit() for c in word), sum(c.isalpha() for c in word)
    if digits and letters:
        return LEAST_NOVELTY if behind else max(LEAST_NOVELTY, LEAST_BEFORE)
    if digits < LEAST_DIGITS if digits else not _novel_letters(word):
        return inf
    one_case = not digits and (word == word.lower() or word == word.upper())
    asked = log2(10 if digits else 26 if one_case else 52) / 8
    return min(LEAST_OF_ONE_KIND, asked) if one_case or len(word) >= CODED else LEAST_OF_ONE_KIND


def _quoted(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of values with signs that stand in quotes, at most NEAR characters after a sensitive word: one pass over the text."""
    ends = [m.end() for m in _SENSITIVE.finditer(text)]
    for m in _QUOTED.finditer(text):
        start, end = m.span(1)
        at = bisect.bisect_right(ends, start)
        if at and start - ends[at - 1] <= NEAR and not _VALUE.fullmatch(text, start, end) and len(_CHANGES.findall(text, start, end)) >= LEAST_CHANGES * (end - start):
            yield start, end


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Where spans lie, as stretches that don't overlap, in order."""
    out: list[tuple[int, int]] = []
    for start, _, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def novel_spans(text: str, lowered: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates outside the known spans that stand near a sensitive word and that the primed compressor cannot shorten.

    Every candidate is measured; how much it must cost depends on its alphabet and length. Of candidates in one another the longest counts, without a name and '=' before a novel value.
    """
    if not any(k in lowered for k in SENSITIVE):
        return []
    novel = set()
    taken = _joined(known)

    def measured(start: int, end: int) -> float:
        return novelty(text[max(0, start - AROUND) : start], text[start:end], text[end : end + AROUND])

    for start, end, behind in _candidates(text):
        if (start, end) in novel or ((at := bisect.bisect_left(taken, (end, 0))) and taken[at - 1][1] > start):
            continue
        if (least := _least(text[start:end], behind)) < inf and measured(start, end) >= least:
            novel.add((start, end))
    for start, end in _quoted(text):
        # A fixed pattern may end at the value's first sign: the rest is no less of a secret.
        if not ((at := bisect.bisect_left(taken, (end, 0))) and taken[at - 1][1] >= end) and measured(start, end) >= LEAST_OF_ONE_KIND:
            novel.add((start, end))
    found: list[tuple[int, int, int]] = []
    for start, end in sorted(novel, key=lambda s: (s[0], -s[1])):
        if not found or start >= found[-1][2]:
            found.append((start, 3, end))
        elif _NAME.fullmatch(text, found[-1][0], start):
            found[-1] = start, 3, max(end, found[-1][2])
    return found


def scan(text: str) -> list[tuple[int, int, int]]:
    """All spans (start, kind, end) of a whole text by start, then kind; code points, end exclusive."""
    lowered = text.lower()
    base = base_spans(text, lowered)
    return sorted(base + novel_spans(text, lowered, base))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span replaced; spans that overlap are replaced together."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


_NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in slices(batches):
        found = [scan(t) for t in texts]
        counts = [pa.array([sum(s[1] == k for s in f) for f in found], pa.int64()) for k in range(len(KINDS))]
        base = [hashlib.sha256(listed([s for s in f if s[1] < 3]).encode()).hexdigest() for f in found]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *counts, pa.array(base), pa.array([listed(f) for f in found])], names=_NAMES)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans for every row of docs.

    Null texts are empty and have no spans; null ids stay null; repeated rows repeat; other columns are ignored. Each row
    is independent of all others, so nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of its texts replaced by a mark; all columns stay, null texts stay null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                texts = [None if t is None else redacted(t, scan(t)) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(read(spark, sf_dir, "documents"))
