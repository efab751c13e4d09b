"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of its last bytes has a fixed pattern, so
documents that share a passage share its chunks whatever stands around it.
Documents that begin alike are brought to one task, next to each other
(``gather``), unless they are so many that the task is split; a worker keeps the
last ``CACHE_CHUNKS`` chunks that it encoded, and so encodes what they share
once.  A chunk that documents of other beginnings hold is encoded again on
another worker, or after so many others.  Chunk joins are then repaired: text
from the left chunk's last certain word start is encoded again, with ever more of
the right chunk, until both encodings agree on a word start; from there the right
chunk's ids hold.  The tokenizer splits words left to right with at most
``LOOKAHEAD`` characters of lookahead, so ids after a common word start are those
of the whole text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bytes_of, slices, text_or_empty
from .textbuf import stream

# Tasks are the unit of parallelism: a worker's own threads would only contend for its core.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A cut is made where so many bits of the rolling hash are 0: every 2,048 bytes on average.
CUT_BITS, LEAST_CHUNK = 11, 512
#: Bytes that a split into words may look ahead: three characters of four bytes.
LOOKAHEAD = 12
#: Chunks held by a worker, and word starts remembered of each.
CACHE_CHUNKS, HEAD_STARTS = 2000, 16
#: How a byte-level tokenizer splits words, and the characters about which all Unicode versions agree in it.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
UNCOMMON = re.compile("[^\x20-\x7e\n\t\r\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]")
#: A place before which a word surely ends, whatever stands further left, and the last characters among which one is looked for.
SURE, TAIL = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])"), 72
#: Bytes of a right chunk that are encoded first to find where it agrees.
FIRST_BRIDGE = 32
_GEAR = (stream(41, 256) >> np.uint64(32)).astype(np.uint32)


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's characters: printable Latin-1 bytes stand for themselves, the others for 256 and up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def cuts(buf: np.ndarray) -> np.ndarray:
    """Positions before which a chunk may end: the rolling hash of 16 bytes fits and no character is split."""
    h = _GEAR[buf]
    for width in (1, 2, 4, 8):
        older = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += older
    ends = np.flatnonzero(h[:-1] >> np.uint32(32 - CUT_BITS) == 0) + 1
    return ends[(buf[ends] & 0xC0) != 0x80]


@dataclass
class Chunk:
    ids: np.ndarray
    #: token index by byte offset of the first word starts
    starts: dict[int, int]
    #: first word start that more text could change: token index and byte offset
    safe: tuple[int, int]


def _whole(data: bytes, at: int, most: int) -> int:
    """The next place from ``at``, up to ``most``, that splits no character."""
    while at < most and data[at] & 0xC0 == 0x80:
        at += 1
    return at


class Encoder:
    """One tokenizer with its chunk cache."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens that take their surroundings are not supported")
        self.special = sorted(((t.content.encode(), i) for i, t in added.items()), key=lambda x: -len(x[0]))
        alphabet, special = byte_alphabet(), {i: c for c, i in self.special}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = special[i] if i in special else bytes(alphabet[c] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.cache: OrderedDict[bytes, Chunk] = OrderedDict()
        self.encoded_bytes = self.reused_bytes = 0
        pattern = json.loads(self.tokenizer.to_str())["pre_tokenizer"]
        self.splits_words = pattern.get("type") == "ByteLevel" and pattern.get("use_regex", False) and not pattern.get("add_prefix_space", False)
        self.quick = self._quick(vocabulary, special)

    def _quick(self, vocabulary: dict[str, int], special: dict[int, bytes]):
        """The same merges in a faster library, which merges by the ids of the results alone; None if that may differ.

        It gives the tokenizer's own ids if ids are in the order of the merges
        and every token's bytes, alone, merge to that token: just before a merge
        to t, no token crosses the ends of t's bytes, so they have merged as they
        do alone, and the pair that gives t is the tokenizer's.
        """
        import tiktoken

        model = json.loads(self.tokenizer.to_str())["model"]
        ranks = {self.bytes[i]: i for i in vocabulary.values() if i not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        made = [vocabulary.get(a + b, -1) for a, b in pairs]
        if not self.splits_words or model.get("type") != "BPE" or made != sorted(set(made)) or len(ranks) != len(pairs) + 256 or any(len(b) == 1 and i > min(made) for b, i in ranks.items()):
            return None
        if any(len(self.tokenizer.model.tokenize(token)) != 1 for token, i in vocabulary.items() if i not in special):
            return None
        return tiktoken.Encoding("own", pat_str=WORD.pattern, mergeable_ranks=ranks, special_tokens={})

    def _measure(self, encoding, size: int) -> Chunk:
        """A chunk whose word starts are the tokenizer's own."""
        ids = np.array(encoding.ids, np.uint32)
        word = np.array(encoding.word_ids, np.int64)
        first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1]) if len(ids) else np.zeros(0, np.int64)
        at = (np.cumsum(self.lengths[ids]) - self.lengths[ids])[first] if len(ids) else first
        starts = dict(zip(at[:HEAD_STARTS].tolist(), first[:HEAD_STARTS].tolist(), strict=True))
        return Chunk(ids, starts, self._safe(first.tolist(), at.tolist(), size))

    @staticmethod
    def _safe(first: list[int], at: list[int], size: int) -> tuple[int, int]:
        """The first of the last words that could look beyond the chunk's end."""
        safe, end = (0, 0), size
        for token, byte in zip(reversed(first), reversed(at), strict=True):
            if byte + LOOKAHEAD <= size and end < size:
                break
            safe, end = (token, byte), byte
        return safe

    def _edges(self, text: str, size: int) -> Chunk | None:
        """A chunk whose word starts are found near its two ends only; None if there is no sure place near its end."""
        tail = max(0, len(text) - TAIL)
        sure = next(SURE.finditer(text, tail, max(tail, len(text) - 2 * LOOKAHEAD)), None) if tail else None
        if tail and sure is None:
            return None
        ids = self.quick.encode_to_numpy(text, disallowed_special=())
        sums = np.cumsum(self.lengths[ids])
        # The head's last word may be cut short by the end of what is looked at, and so its end is no start.
        head = [m.start() for m in WORD.finditer(text, 0, min(len(text), 4 * HEAD_STARTS))][:HEAD_STARTS]
        head = head if len(text) <= 4 * HEAD_STARTS else head[:-3]
        at = head if text.isascii() else [len(text[:c].encode()) for c in head]
        first = np.searchsorted(sums, at, side="right").tolist()
        begin = sure.start() if sure else 0
        base = size - len(text[begin:].encode())
        last = [base + len(text[begin : m.start()].encode()) for m in WORD.finditer(text, begin)]
        last_first = np.searchsorted(sums, last, side="right").tolist()
        return Chunk(ids, dict(zip(at, first, strict=True)), self._safe(last_first, last, size))

    def encode_chunks(self, chunks: list[bytes]) -> list[Chunk]:
        texts = [c.decode() for c in chunks]
        out = [None if self.quick is None or UNCOMMON.search(t) else self._edges(t, len(c)) for t, c in zip(texts, chunks, strict=True)]
        slow = [k for k, c in enumerate(out) if c is None]
        for k, encoding in zip(slow, self.tokenizer.encode_batch([texts[k] for k in slow], add_special_tokens=False), strict=True):
            out[k] = self._measure(encoding, len(chunks[k]))
        return out  # type: ignore[return-value]

    def fill(self, chunks: list[bytes]) -> dict[bytes, Chunk]:
        """The given chunks' encodings, each distinct one of the call encoded once and cached ones not at all."""
        found: dict[bytes, Chunk] = {}
        missing = []
        for c in chunks:
            if c in found:
                self.reused_bytes += len(c)
                continue
            if (old := self.cache.get(c)) is not None:
                self.cache.move_to_end(c)
                self.reused_bytes += len(c)
                found[c] = old
            else:
                missing.append(c)
                found[c] = None  # type: ignore[assignment]
        self.encoded_bytes += sum(map(len, missing))
        for c, chunk in zip(missing, self.encode_chunks(missing), strict=True):
            found[c] = self.cache[c] = chunk
        while len(self.cache) > CACHE_CHUNKS:
            self.cache.popitem(last=False)
        return found

    def bridges(self, texts: list[tuple[bytes, list[int]]], found: dict[bytes, Chunk]) -> dict[bytes, Chunk]:
        """Encodings of the first bridge over every join, made in one call."""
        spans = set()
        for data, ends in texts:
            start = 0
            for end, after in zip(ends, ends[1:], strict=False):
                spans.add(data[start + found[data[start:end]].safe[1] : _whole(data, min(end + FIRST_BRIDGE, after), after)])
                start = end
        spans_ = list(spans)
        return dict(zip(spans_, self.encode_chunks(spans_), strict=True))

    def join(self, data: bytes, ends: list[int], found: dict[bytes, Chunk], bridges: dict[bytes, Chunk]) -> np.ndarray:
        """The ids of ``data``, cut at ``ends``, from its chunks' encodings."""
        start, out = 0, []
        pending = 0  # ids are certain before this byte
        for end in ends:
            chunk = found[data[start:end]]
            more = FIRST_BRIDGE
            first = 0
            while pending < start:
                stop = _whole(data, min(start + more, end), end)
                bridge = bridges.get(data[pending:stop]) or self.encode_chunks([data[pending:stop]])[0]
                sure = bridge.safe[1] + pending
                agreed = next((p for p in bridge.starts if start <= p + pending <= sure and p + pending - start in chunk.starts), None)
                if agreed is not None:
                    out.append(bridge.ids[: bridge.starts[agreed]])
                    pending += agreed
                    first = chunk.starts[pending - start]
                elif stop == end:  # the whole chunk is part of the bridge
                    out.append(bridge.ids[: bridge.safe[0]])
                    pending = sure
                    break
                more *= 2
            if pending >= start and first <= chunk.safe[0] and pending - start in chunk.starts and pending - start <= chunk.safe[1]:
                last = end == len(data)  # nothing follows that could change its last words
                out.append(chunk.ids[chunk.starts[pending - start] : None if last else chunk.safe[0]])
                pending = end if last else start + chunk.safe[1]
            start = end
        if pending < len(data):
            out.append(self.encode_chunks([data[pending:]])[0].ids)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string column; null is empty."""
        buf, off = bytes_of(column)
        raw = buf.tobytes()
        may = cuts(buf) if len(buf) else np.zeros(0, np.int64)
        units: list[list[tuple[int, int] | int]] = []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            units.append(self._units(raw, a, b))
        plans = {}
        for spans in units:
            for span in spans:
                if not isinstance(span, int):
                    a, b = span
                    ends, last = [], a
                    for c in may[np.searchsorted(may, a, "right") : np.searchsorted(may, b)].tolist():
                        if c - last >= LEAST_CHUNK:
                            ends.append(c - a)
                            last = c
                    plans[span] = [*ends, b - a]
        found = self.fill([raw[a + s : a + e] for (a, _), ends in plans.items() for s, e in zip([0, *ends], ends, strict=False)])
        bridges = self.bridges([(raw[a:b], ends) for (a, b), ends in plans.items() if len(ends) > 1], found)
        out = []
        for spans in units:
            parts = [np.array([s], np.uint32) if isinstance(s, int) else self.join(raw[s[0] : s[1]], plans[s], found, bridges) for s in spans]
            out.append(np.concatenate(parts) if parts else np.zeros(0, np.uint32))
        return out

    def _units(self, raw: bytes, a: int, b: int) -> list[tuple[int, int] | int]:
        """Spans of ordinary text, and ids of the special strings between them."""
        out: list[tuple[int, int] | int] = []
        while a < b:
            hits = [(p, -len(c), i, len(c)) for c, i in self.special if (p := raw.find(c, a, b)) >= 0]
            if not hits:
                out.append((a, b))
                break
            p, _, i, n = min(hits)
            if p > a:
                out.append((a, p))
            out.append(i)
            a = p + n
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids, special ones included; invalid UTF-8 becomes replacement characters."""
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def gather(rows: DataFrame) -> DataFrame:
    """``rows(text, ...)`` with those that begin alike next to each other: a first chunk is at least that long.

    A rebalanced exchange splits what would be a large task, so that a beginning
    of very many rows is dealt out.
    """
    start = F.xxhash64(F.substring("text", 1, LEAST_CHUNK))
    return rows.withColumn("_start", start).hint("rebalance", F.col("_start")).sortWithinPartitions("_start").drop("_start")


def encode(docs: DataFrame, tokenizer_path: str, carry: list[str], text_col: str = "text", together: bool = True) -> DataFrame:
    """The columns ``carry`` of each row with ``n_tokens`` and ``ids``; a null or empty text has no ids.

    Repeated rows and ids stay; an empty table gives an empty result.  Without
    ``together`` rows stay where they are, which suits texts without copies.
    """
    kinds = dict(docs.dtypes)
    names = [f"c{k}" for k in range(len(carry))]
    rows = docs.select(*[docs[c].alias(k) for c, k in zip(carry, names, strict=True)], text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ids = encoder(tokenizer_path).encode(part.column("text"))
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            flat = pa.array(np.concatenate(ids).view(np.int32))
            columns = [pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + columns, names=[*names, "n_tokens", "ids"])

    fields = [f"{k} {kinds[c]}" for c, k in zip(carry, names, strict=True)] + ["n_tokens long", "ids array<int>"]
    return arrow_map(gather(rows) if together else rows, run, ", ".join(fields)).toDF(*carry, "n_tokens", "ids")


def decode(rows: DataFrame, tokenizer_path: str, carry: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns ``carry`` of each row with ``text``; null or empty ids give an empty text."""
    kinds = dict(rows.dtypes)
    names = [f"c{k}" for k in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [encoder(tokenizer_path).decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(texts, pa.string())], names=[*names, "text"])

    plain = rows.select(*[rows[c].alias(k) for c, k in zip(carry, names, strict=True)], rows[ids_col].alias("ids"))
    return arrow_map(plain, run, ", ".join([f"{k} {kinds[c]}" for c, k in zip(carry, names, strict=True)] + ["text string"])).toDF(*carry, "text")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, together: bool = True) -> DataFrame:
    """Encode, then decode, each text in one pass: id, ``n_tokens``, digests of the ids and of the decoded text, and the ``ids`` if asked for.

    A null or empty text has no ids; rows that repeat stay; an empty table gives an empty result.
    Without ``together`` rows stay where they are, which suits texts without copies.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = gather(rows) if together else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            own = encoder(tokenizer_path)
            ids = own.encode(part.column("text"))
            columns = [
                part.column("doc_id"),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ]
            if with_ids:
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(ids).view(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return arrow_map(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
