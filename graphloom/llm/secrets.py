"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty.

Base spans are those of three patterns.  Beyond them, a string in a sensitive
context (a word such as *token* or *auth* shortly before it) is measured by its
marginal compressed size: the surrounding text is compressed with and without
the string, by a compressor primed with a dictionary of identifiers.  Code,
words and repeated values cost few extra bytes; a string that costs nearly its
own entropy's worth is reported as ``novel``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, slices, text_or_empty
from .textbuf import word_spans

# The base patterns, their least lengths, in the order of listing.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "novel")
#: Words of a sensitive context, lower case.
CONTEXT_WORDS = ("password", "passwd", "passphrase", "secret", "token", "key", "auth", "bearer", "credential", "private", "signature", "cookie", "session")
#: A candidate follows a context word by so many characters at most and has so many itself at least.
CONTEXT_REACH, CANDIDATE_LEAST = 48, 16
#: Longer candidates are measured in pieces of so many characters.
EACH_LENGTH = 1024
#: Text on either side of a candidate against which it is measured.
SURROUNDING = 512
#: Marginal bytes per character from which a candidate is novel: random base64 costs some 0.75, hex 0.5, words 0.4 and less.
NOVELTY, HEX_NOVELTY = 0.62, 0.48
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % CANDIDATE_LEAST)
_CONTEXT = re.compile("|".join(CONTEXT_WORDS), re.IGNORECASE | re.ASCII)
_HEX_BYTES = np.array([48 <= b <= 57 or 97 <= b <= 102 for b in range(256)])
#: Identifiers and phrases of code and configuration, most common last, as a compressor wants them.
DICTIONARY = " ".join(
    [
        f"{a}{s}{b}"
        for s in ("_", "-", ".", "")
        for a in ("client", "user", "service", "session", "request", "response", "config", "default", "public", "private", "access", "refresh", "database", "server", "application", "environment")
        for b in ("name", "value", "type", "path", "token", "secret", "password", "key", "id", "url", "version", "string", "manager", "provider", "handler", "controller")
    ]
    + "import return function class static public const None True False null undefined example.com localhost username password authorization bearer".split()
).encode()

_measure: tuple[zstandard.ZstdCompressor] | None = None


def _compressor() -> zstandard.ZstdCompressor:
    global _measure
    if _measure is None:
        primed = zstandard.ZstdCompressionDict(DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _measure = (zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False),)
    return _measure[0]


def compressed_size(data: bytes) -> int:
    return len(_compressor().compress(data))


def marginal_bytes(text: str, start: int, end: int) -> int:
    """What text[start:end] adds to the compressed size of its surroundings."""
    before, after = text[max(0, start - SURROUNDING) : start].encode("utf-8", "replace"), text[end : end + SURROUNDING].encode("utf-8", "replace")
    return compressed_size(before + after + text[start:end].encode()) - compressed_size(before + after)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping per kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]{%d,}" % HEX_LEAST, text)]
    return sorted(out)


class _Run:
    """One run of candidate characters, and what its pieces of ``EACH_LENGTH`` characters, counted from its end, add to those before."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text, self.start, self.end, self.last, self.reported = text, start, end, -1, False
        self._borders: list[int] | None = None
        self._sizes: list[int] = []

    def marginal(self, start: int) -> int:
        """What the candidate from ``start`` to the run's end adds to its surroundings: its whole pieces' bytes, each measured once, and those of its own first part."""
        if self.end - start <= EACH_LENGTH:
            return marginal_bytes(self.text, start, self.end)
        if self._borders is None:
            first = self.start + (self.end - self.start) % EACH_LENGTH
            self._borders = list(range(first, self.end + 1, EACH_LENGTH))
            size = _compressor().compressobj()
            size.compress(self.text[max(0, self.start - SURROUNDING) : first].encode("utf-8", "replace"))
            size.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)
            self._sizes = [0]
            for at in self._borders[:-1]:
                piece = size.compress(self.text[at : at + EACH_LENGTH].encode()) + size.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)
                self._sizes.append(self._sizes[-1] + len(piece))
        k = bisect_left(self._borders, start)
        head = marginal_bytes(self.text, start, self._borders[k]) if start < self._borders[k] else 0
        return head + self._sizes[-1] - self._sizes[k]

    def limit(self, start: int) -> float:
        return HEX_NOVELTY if self.hex_from <= start else NOVELTY

    @cached_property
    def hex_from(self) -> int:
        """Where the hex digits begin that the run ends with."""
        at = self.end
        while at > self.start and self.text[at - 1] in "0123456789abcdefABCDEF":
            at -= 1
        return at


def novel_spans(text: str) -> list[tuple[int, int, int]]:
    """Incompressible strings that follow a sensitive word.

    Every candidate in a word's reach is measured, once.  A word within a run of
    candidate characters makes what follows it in the run a candidate of its own,
    unless the run was reported by then, which covers it.  So that a long run of
    sensitive words does not take quadratic time, candidates above ``EACH_LENGTH``
    characters are measured in pieces, which those of one run share.
    """
    out: list[tuple[int, int, int]] = []
    runs: list[_Run] = []
    for word in _CONTEXT.finditer(text):
        at, last = word.end(), min(len(text), word.end() + CONTEXT_REACH + CANDIDATE_LEAST)
        while (m := _CANDIDATE.search(text, at, last)) and m.start() - word.end() <= CONTEXT_REACH:
            start = m.start()
            run = next((r for r in reversed(runs[-CONTEXT_REACH:]) if r.start <= start < r.end), None)
            if run is None:
                runs.append(run := _Run(text, start, _CANDIDATE.match(text, start).end()))
            at = run.end
            if run.reported or start <= run.last:
                continue
            run.last = start
            if run.marginal(start) >= run.limit(start) * (run.end - start):
                out.append((start, 3, run.end))
                run.reported = True
    return sorted(out)


def _flagged(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts in which some pattern could match: a context word, AKIA, or a long run of hex digits."""
    flags = np.zeros(len(off) - 1, bool)
    if not len(buf):
        return flags
    raw = buf.tobytes()
    lower = raw.lower()
    at: list[int] = []
    for data, word in [(raw, b"AKIA")] + [(lower, w.encode()) for w in CONTEXT_WORDS]:
        p = data.find(word)
        while p >= 0:
            d = int(np.searchsorted(off, p, side="right")) - 1
            at.append(d)
            p = data.find(word, p + 1)
    start, end, first = word_spans(buf, off, _HEX_BYTES)
    long = np.flatnonzero(end - start >= HEX_LEAST)
    flags[np.searchsorted(first, long, side="right") - 1] = True
    flags[at] = True
    return flags


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``base`` and ``novel`` as arrays of (kind, start, end) in code points, in order of start, then kind.

    A null or empty text has no spans; rows that repeat stay; an empty table
    gives an empty result; other columns are not read.
    """
    span = pa.list_(pa.struct({"kind": pa.string(), "start": pa.int64(), "end": pa.int64()}))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = part.column("text")
            found: list[tuple[list, list]] = [([], [])] * len(texts)
            for i in np.flatnonzero(_flagged(*bytes_of(texts))).tolist():
                text = texts[i].as_py()
                found[i] = (base_spans(text), novel_spans(text))
            columns = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f[j]] for f in found], span) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "base", "novel"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return arrow_map(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, base {kind}, novel {kind}")
