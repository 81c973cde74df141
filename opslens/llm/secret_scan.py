"""Secrets: fixed patterns, and strings that stay incompressible next to what is known.

The patterns find assignments, access keys and long hex runs.  The method then looks at other long
strings on the lines around a sensitive word, before and after it: it compresses their surroundings on both sides
with and without them, with a dictionary of the corpus's own identifiers, and reports those whose
marginal size is close to their length: neither the surrounding code nor the identifiers explain them.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.store import batch

KINDS = ("assign", "access", "hex", "novel")
#: Identifiers in the dictionary, and bytes on either side of a string that count as its surroundings.
IDENTIFIERS = 2000
AROUND = 160
#: Strings are looked for on the line of a sensitive word and this many lines before and after it.
LINES = 2
MIN_NOVEL = 16
#: Marginal compressed bytes per byte of the string.
LEAST_NOVELTY = 0.7
#: The same for strings of words, where each known word still costs some bytes.
LEAST_WORDS = 0.85

# The patterns of the contract.
_ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_MIN_ASSIGN, _MIN_ACCESS = 6, 20

_SENSITIVE = re.compile(rb"passw|secret|token|api.?key|credential|private|bearer|auth|login", re.IGNORECASE)
#: Printable characters without blanks, quotes, brackets, commas and semicolons.
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=.!@&#$%%^*~?:|\\-]{%d,}" % MIN_NOVEL)
#: What stands around the value in such a run: names with = or :, and punctuation.
_NAMED = re.compile(rb"(?:[A-Za-z_][A-Za-z0-9_.-]*[=:]+)*")
_MARKS = b".:?|"
#: Addresses are judged by their parts.
_ADDRESS = re.compile(rb".*[A-Za-z][A-Za-z0-9+.-]*://|[A-Za-z0-9._+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,6}[^A-Za-z0-9@]*$")
_PART = re.compile(rb"[A-Za-z0-9+_=%%-]{%d,}" % MIN_NOVEL)
_LETTER = re.compile(rb"[A-Za-z]")
_IDENTIFIER = re.compile(rb"[A-Za-z_][A-Za-z0-9_]{4,}")
#: Words inside a long identifier.
_PIECE = re.compile(rb"(?<![A-Za-z])[A-Za-z][a-z]{4,14}(?![a-z])|(?<=[a-z])[A-Z][a-z]{4,14}(?![a-z])")

#: Words of two letters or more in one case, or with a capital, and marks between them: names of paths, constants, classes.
_WORDS = re.compile(rb"[^A-Za-z0-9]*(?:(?:[A-Z]?[a-z]{2,15}|[A-Z]{2,15}(?![a-z]))[^A-Za-z0-9]*)+$")
_WORD = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

Span = tuple[int, str, int]


def base_spans(text: bytes) -> list[Span]:
    """Spans ``(start, kind, end)`` of the fixed patterns, in bytes; leftmost and apart within a kind."""
    found = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _MIN_ASSIGN]
    found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= _MIN_ACCESS]
    return found + [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]


def novelty(string: bytes, before: bytes, packer: zstandard.ZstdCompressor, after: bytes = b"") -> float:
    """Compressed bytes that ``string`` adds to what stands around it, per byte; copies of itself don't explain it."""
    known = after.replace(string, b" ") + b"\n" + before.replace(string, b" ")
    return (len(packer.compress(known + string)) - len(packer.compress(known))) / len(string)


def _regions(text: bytes) -> Iterator[tuple[int, int]]:
    """Stretches of the lines around sensitive words; apart, in order."""
    start = end = line = 0
    for word in _SENSITIVE.finditer(text):
        if word.start() < line:
            continue  # the line of the word before
        line = text.find(b"\n", word.end()) + 1 or len(text)
        first, last = word.start(), word.end()
        for _ in range(LINES + 1):
            first = max(text.rfind(b"\n", 0, first), 0)
            last = text.find(b"\n", last) + 1 or len(text) + 1
        if first > end:
            yield start, end
            start = first
        end = max(end, min(last, len(text)))
    yield start, end


def _candidates(text: bytes) -> Iterator[tuple[int, int]]:
    for start, end in _regions(text):
        for m in _CANDIDATE.finditer(text, start, end):
            if _ADDRESS.match(m[0]):
                yield from (part.span() for part in _PART.finditer(text, *m.span()))
                continue
            value = _NAMED.match(m[0]).end()
            size = len(m[0].rstrip(_MARKS))
            if size - value >= MIN_NOVEL:
                yield m.start() + value, m.start() + size
            elif size >= MIN_NOVEL and not m[0][value:size].strip(b"=:"):
                yield m.start(), m.start() + size


def novel_spans(text: bytes, base: list[Span], packer: zstandard.ZstdCompressor) -> list[Span]:
    if not _SENSITIVE.search(text):
        return []
    found = []
    for start, end in _candidates(text):
        if not _LETTER.search(text, start, end) or any(s < end and start < e for s, _, e in base):
            continue
        string, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
        least = LEAST_NOVELTY
        if _WORDS.match(string):  # told by its words, whatever their case
            string, before, after = (b" ".join(_WORD.findall(t)).lower() for t in (string, before, after))
            least = LEAST_WORDS
        if novelty(string, before, packer, after) >= least:
            found.append((start, "novel", end))
    return found


def written(spans: list[Span], text: bytes) -> str:
    """``kind:start:end`` of spans in code points, by start and kind."""
    if not spans:
        return ""
    if text.isascii():
        place = range(len(text) + 1)
    else:
        begins = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        place = np.concatenate([[0], np.cumsum(begins)])
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))
    return ",".join(f"{kind}:{place[start]}:{place[end]}" for start, kind, end in ordered)


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in b["text"].cast(pa.binary()).to_pylist()]


def _identifiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of identifiers on lines with a sensitive word; none that could be a secret itself, so no long ones."""
    for b in batches:
        counts: Counter[bytes] = Counter()
        for text in _texts(b):
            end = 0
            for word in _SENSITIVE.finditer(text):
                if word.start() >= end:
                    start = text.rfind(b"\n", 0, word.start()) + 1
                    end = text.find(b"\n", word.end())
                    end = len(text) if end < 0 else end
                    found = _IDENTIFIER.findall(text, start, end)
                    counts.update(p for w in found for p in (_PIECE.findall(w) if len(w) >= MIN_NOVEL else [w]))
                    named = (w for w in found if _WORDS.match(w))
                    counts.update(p.lower() for w in named for p in _WORD.findall(w) if len(p) > 3)
        if counts:
            yield pa.RecordBatch.from_pydict(
                {"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())}
            )


def identifier_dictionary(docs: DataFrame) -> bytes:
    """The most frequent identifiers of sensitive lines, most frequent last; at most ``IDENTIFIERS``."""
    parts = docs.select(F.col("text").cast("string")).mapInArrow(_identifiers, "word binary, n long")
    counts = parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.length("word") <= 64)
    top = counts.orderBy(F.desc("n"), "word").limit(IDENTIFIERS).collect()
    return b" ".join(bytes(r["word"]) for r in reversed(top))


_FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_assign", pa.int64()),
        ("n_access", pa.int64()),
        ("n_hex", pa.int64()),
        ("n_novel", pa.int64()),
        ("base_sha256", pa.string()),
        ("spans", pa.string()),
    ]
)
_FOUND_DDL = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"


def _scan(known: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        primed = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(known) > 8 else None
        packer = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), _texts(b), strict=True):
                base = base_spans(text)
                every = base + novel_spans(text, base, packer)
                counts = Counter(kind for _, kind, _ in every)
                digest = hashlib.sha256(written(base, text).encode()).hexdigest()
                rows.append((doc_id, *[counts[k] for k in KINDS], digest, written(every, text)))
            if rows:
                yield batch(dict(zip(_FOUND.names, zip(*rows, strict=True), strict=True)), _FOUND)

    return run


def secrets(docs: DataFrame) -> DataFrame:
    """Counts and spans of the secrets in every row of ``docs`` (doc_id, text).

    Null text is empty and holds none; rows that repeat an id are scanned apart; an empty table gives no rows.
    """
    known = identifier_dictionary(docs)
    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return picked.mapInArrow(_scan(known), _FOUND_DDL)
