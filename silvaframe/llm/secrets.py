"""Secret scans: key patterns, and guess costs of values that stand where credentials stand."""

from __future__ import annotations

import base64
import math
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, short_batches

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "guess")

# The base patterns.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Where a credential may follow, more widely than the base patterns. A quoted value (2 or 3) runs to its closing quote on the
#: same line, past escaped ones if that leaves a closing one; any other (4) to white space.
CONTEXT = re.compile(
    r"""(?ai:pass(?:word|wd|phrase|code)|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|auth(?:orization)?)s?["']?\x20*(?:=>|:=|:|=)\x20*"""
    r"""(?:(?ai:bearer|basic)\x20+)?(?:(["'`])(?:(?ai:bearer|basic)\x20+)?(?:((?:\\[^\r\n]|(?!\1)[^\\\r\n])*+)\1|((?:(?!\1)[^\r\n])*+)\1)|["'`]?(?:(?ai:bearer|basic)\x20+)?(\S++))"""
)
#: Characters of the shortest value; what is no part of an unquoted value at its end.
SHORTEST, TRAILING = 6, ".,;:)]}>\"'`"
STEMS = ("pass", "pwd", "secret", "token", "api", "access", "private", "credential", "auth")
_LOWER = {c: c + 32 for c in range(65, 91)}

#: A ranked vocabulary: a file of byte pairs "base64 rank" by line, in the order in which they were found to be common.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Words that people take for passwords, from the most common one on; they come before the vocabulary's.
COMMON = (
    "password love admin welcome monkey dragon master hello login letme secret shadow sunshine princess football baseball superman batman "
    "pass key token test guest user root access change default demo example sample temp placeholder redacted hidden name value none null"
).split()
# Rows of a keyboard without and with shift; the first key of the upper row stands alone to the left.
ROWS, SHIFTED = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./"), ("~!@#$%^&*()_+", " QWERTYUIOP{}|", ' ASDFGHJKL:"', " ZXCVBNM<>?")
LEET = str.maketrans("013457@$!", "oieastasi")
#: Bits of a switch of span, of a turn on the keyboard and of a key in the same direction, of a repeated character.
SWITCH, TURN, STRAIGHT, AGAIN = 1.0, math.log2(6), 0.5, 0.02
PERIODS = 8

_PLACE = {c: (x, y) for rows in (ROWS, SHIFTED) for y, row in enumerate(rows) for x, c in enumerate(row) if c != " "}
_KEYS = math.log2(sum(len(r.strip()) for r in ROWS))
_DATES = (
    re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"),
    re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d"),
    re.compile(r"(?:19|20)\d\d()"),
)
_CLASS = [(str.isdigit, math.log2(10)), (str.islower, math.log2(26)), (str.isupper, math.log2(26))]


def read_words(path: str | None = VOCABULARY) -> dict[str, int]:
    """Rank of each word: COMMON, then the words of three letters or more of a vocabulary file (none without a path)."""
    words = dict.fromkeys(COMMON)
    if path:
        with open(path, "rb") as f:
            for line in f:
                word = base64.b64decode(line.split()[0]).decode("utf-8", "ignore").strip().lower()
                if len(word) > 2 and word.isalpha():
                    words[word] = None
    return {w: k for k, w in enumerate(words, 1)}


def _char_bits(c: str) -> float:
    return next((bits for test, bits in _CLASS if test(c)), math.log2(33) if c < "\x80" else 12.0)


def _way(a: str, b: str) -> tuple[int, int] | None:
    """The direction from a key to a neighbour of it, in any row; (0, 0) for the key itself."""
    if a not in _PLACE or b not in _PLACE:
        return None
    (x, y), (p, q) = _PLACE[a], _PLACE[b]
    dx, dy = p - x, q - y
    # each row lies half a key to the right of the one above, so below a key are its place and the one before
    near = abs(dx) <= 1 and not dy or dy == 1 and dx in (0, -1) or dy == -1 and dx in (0, 1)
    return (dx, dy) if near else None


class Guesser:
    """What values cost to guess, with a ranked dictionary."""

    def __init__(self, words: dict[str, int]):
        self.bits = {w: math.log2(k) for w, k in words.items()}
        self.longest = max(map(len, words), default=0)
        self.heads = {w[:3] for w in words}
        self.cached = lru_cache(maxsize=4096)(self.guess_bits)

    def __reduce__(self):
        return Guesser, ({w: k for k, w in enumerate(self.bits, 1)},)

    def word_bits(self, value: str, low: str, plain: str) -> float | None:
        """A word by its rank; capitals and look-alike digits double it."""
        bits = self.bits.get(plain)
        return None if bits is None else SWITCH + bits + (value != low) + (low != plain)

    def guess_bits(self, value: str) -> float:
        """log2 of the guesses that the cheapest segmentation of the value takes.

        best[i] is the least cost of value[:i]. A span is a word (`word_bits`), a date or year, characters that repeat
        those of 1 to PERIODS places before, a walk over neighbouring keys, or a character of brute force; every
        span but the last kind costs a switch. Walks and repeats add up key by key, so one number for each of
        them that is under way is enough, and time follows the length.
        """
        low = value.translate(_LOWER)
        plain = low.translate(LEET)
        n = len(value)
        best = [0.0] + [math.inf] * n
        walk, ways = math.inf, (None, None)  # least cost up to here with a walk under way; the last two directions
        again = [math.inf] * (PERIODS + 1)
        for i in range(n):
            at = best[i]
            cost = at + _char_bits(value[i])
            # a walk of three keys or more that ends here
            way = _way(value[i - 1], value[i]) if i else None
            if way is None:
                walk = math.inf
            else:
                step = STRAIGHT if way == ways[1] else TURN
                walk += step
                if i >= 2 and ways[1] is not None:
                    walk = min(walk, best[i - 2] + SWITCH + _KEYS + TURN + step)
                cost = min(cost, walk)
            ways = ways[1], way
            # repeats that end here
            for p in range(1, min(PERIODS, i) + 1):
                again[p] = min(again[p], at + SWITCH + math.log2(PERIODS)) + AGAIN if value[i] == value[i - p] else math.inf
                cost = min(cost, again[p])
            best[i + 1] = min(best[i + 1], cost)
            # words that start here
            if plain[i : i + 3] in self.heads:
                for k in range(3, min(self.longest, n - i) + 1):
                    bits = self.word_bits(value[i : i + k], low[i : i + k], plain[i : i + k])
                    if bits is not None:
                        best[i + k] = min(best[i + k], at + bits)
            # dates and years that start here
            if value[i].isdigit():
                for date in _DATES:
                    if m := date.match(value, i):
                        best[m.end()] = min(best[m.end()], at + date_bits(m))
        return best[n]


def date_bits(m: re.Match) -> float:
    return SWITCH + math.log2(119 * (365 if len(m[0]) > 4 else 1)) + 2 * len(m[1])


def values(text: str):
    """[start, end) of each value of SHORTEST characters or more in a credential context, whole."""
    for m in CONTEXT.finditer(text):
        k = m.lastindex
        start = m.start(k)
        end = start + len(m[k].rstrip(TRAILING)) if k == 4 else m.end(k)
        if end - start >= SHORTEST:
            yield start, end


def scan(text: str | None, least_bits: float, guesser: Guesser) -> tuple[list[tuple[str, int, int]], float | None]:
    """All spans (kind, start, end) of a text, in code points, and the highest cost of a value in context.

    Base spans are whole matches. A value whose guessing takes 2^least_bits or more adds a span of kind
    guess, unless it lies within a base span.
    """
    if not text:
        return [], None
    spans, most = [], None
    low = text.translate(_LOWER) if text.isascii() is False else text.lower()
    credentials = any(s in low for s in STEMS)
    if credentials:
        spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if credentials:
        covered = Cover([(a, b) for _, a, b in spans])
        for start, end in values(text):
            bits = (guesser.cached if end - start < 200 else guesser.guess_bits)(text[start:end])
            most = bits if most is None else max(most, bits)
            if bits >= least_bits and not covered.end_of_those_before(start + 1) >= end:
                spans.append(("guess", start, end))
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans, most


class Cover:
    """Spans by start, with the furthest end up to each."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts, self.ends = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def end_of_those_before(self, place: int) -> int:
        """The furthest end of the spans that start before a place."""
        k = bisect_left(self.starts, place)
        return self.ends[k - 1] if k else -1


SPANS = "array<struct<kind:string,start:long,end:long>>"


def read_guesser(spark, words: str | None):
    """The dictionary, read once on the driver and broadcast: a vocabulary file is of fixed size."""
    short_batches(spark)
    return spark.sparkContext.broadcast(Guesser(read_words(words)))


def scan_secrets(documents: DataFrame, least_bits: float = 40.0, id_col: str = "doc_id", text_col: str = "text", words: str | None = VOCABULARY) -> DataFrame:
    """(doc_id, spans, max_bits), a row per document: spans array<struct<kind, start, end>> in code points.

    words: a vocabulary file whose ranks price ordinary words. Row by row over whole texts. Null and empty texts have no spans; max_bits is null where no value
    stands in a credential context. Repeated rows are scanned alike; other columns are not read.
    """
    import pyarrow as pa

    guesser = read_guesser(documents.sparkSession, words)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, len(batch), 512)):
                found = [scan(t, least_bits, guesser.value) for t in part.column(1).to_pylist()]
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s, _ in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind), pa.array([m for _, m in found], pa.float64())], ["doc_id", "spans", "max_bits"])

    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(frugal(run), f"doc_id {documents.schema[id_col].dataType.simpleString()}, spans {SPANS}, max_bits double")


def _joined(spans) -> "F.Column":
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(documents: DataFrame, **params) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, max_bits) from the operator's spans."""
    out = scan_secrets(documents, **params)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return out.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        count("guess").alias("n_guess"),
        "max_bits",
    )


def redact(text: str | None, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with the union of the spans replaced by a mark each."""
    if not text or not spans:
        return text
    out, at, end = [], 0, 0
    for a, b in sorted(spans):
        if a >= end:
            out += [text[at:a], mark]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def clean(text: str | None, least_bits: float, guesser: Guesser) -> str | None:
    """The text without its secrets. A value of which a base span is a part goes as a whole, whatever it costs to guess."""
    spans = [(a, b) for _, a, b in scan(text, least_bits, guesser)[0]]
    if spans:
        found = Cover(spans)
        spans += [(a, b) for a, b in values(text) if found.end_of_those_before(b) > a]
    return redact(text, spans)


def redact_documents(documents: DataFrame, least_bits: float = 40.0, text_col: str = "text", words: str | None = VOCABULARY) -> DataFrame:
    """The documents with their secrets replaced by [SECRET]; all columns stay, only the text changes."""
    import pyarrow as pa

    guesser = read_guesser(documents.sparkSession, words)
    docs = documents.withColumn(text_col, F.col(text_col).cast("string"))
    at = docs.columns.index(text_col)

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, len(whole), 256)):
                texts = [clean(t, least_bits, guesser.value) for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]], batch.schema.names)

    return docs.mapInArrow(frugal(run), docs.schema)
