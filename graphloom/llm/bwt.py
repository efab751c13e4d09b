"""Burrows-Wheeler transforms of shards, merged by interleave refinement.

The transforms of shards are merged without sorting their suffixes again: an
interleaving of the shards' rows that is right for the first k symbols becomes
right for k + 1 by dealing the rows out, stably, by the symbol before each.
Adjacent rows that part at pass k have a common prefix of k symbols, so after
``length`` passes the rows still together are the repeated strings.

``merge`` touches every row in each pass.  ``repeated_rows`` goes on only with
rows that are still together: what parts them parts all rows before them, too.  A
repeat of n bytes takes n passes in both, so this is for collections that one
task can hold; ``repeats`` does the same for a corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Symbols: bytes are moved up by one, and 0 ends every text.
END = 0


@dataclass
class Transform:
    """Of the suffixes of a shard's texts in order: the symbol before each, and where it starts (text, offset)."""

    before: np.ndarray
    text: np.ndarray
    offset: np.ndarray


def transform(texts: list[bytes], first: int = 0) -> Transform:
    """The transform of one shard, by sorting its suffixes; ``first`` is the number of its first text."""
    rows = sorted((t[o:], k, o) for k, t in enumerate(texts) for o in range(len(t) + 1))
    before = [texts[k][o - 1] + 1 if o else END for _, k, o in rows]
    return Transform(np.array(before, np.uint16), np.array([first + k for _, k, _ in rows], np.int64), np.array([o for *_, o in rows], np.int64))


def merge(shards: list[Transform], length: int) -> tuple[Transform, np.ndarray]:
    """One transform of all shards, in the order of the first ``length`` symbols, and each row's common prefix with the row before it, up to ``length``."""
    sizes = [len(s.before) for s in shards]
    before, text, offset = (np.concatenate([getattr(s, f) for s in shards]) if shards else np.zeros(0, np.int64) for f in ("before", "text", "offset"))
    n = len(before)
    shard = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    prefix, block, symbol = np.full(n, length, np.int64), np.zeros(n, np.int64), np.empty(n, before.dtype)
    for k in range(length):
        symbol[np.argsort(shard, kind="stable")] = before  # each shard's rows stand in its own order
        dealt = np.argsort(symbol, kind="stable")
        ahead, group = symbol[dealt], block[dealt]
        parts = np.ones(n, bool)
        parts[1:] = (ahead[1:] != ahead[:-1]) | (group[1:] != group[:-1]) | (ahead[1:] == END)  # two ends are never alike
        prefix[parts & (prefix == length)] = k
        shard, block = shard[dealt], np.cumsum(parts)
    row = np.empty(n, np.int64)
    row[np.argsort(shard, kind="stable")] = np.arange(n)
    return Transform(before[row], text[row], offset[row]), prefix


def repeated_rows(shards: list[Transform], length: int) -> tuple[np.ndarray, int]:
    """Rows, of all shards put end to end, whose first ``length`` symbols occur elsewhere too, and the number of rows touched.

    Row r's suffix preceded by one more symbol is a row of the same shard, found
    by counting equal symbols before r (last-to-first mapping).  Rows together
    after k symbols give those together after k + 1: they are dealt out by that
    symbol, stably, and split where symbol or block change.
    """
    before = np.concatenate([s.before for s in shards]) if shards else np.zeros(0, np.uint16)
    n, at, touched = len(before), 0, 0
    ahead = np.empty(n, np.int64)
    for s in shards:
        ahead[at + np.argsort(s.before, kind="stable")] = at + np.arange(len(s.before))
        at += len(s.before)
    row, block = np.arange(n), np.zeros(n, np.int64)
    for _ in range(length):
        touched += len(row)
        has = before[row] != END
        row, block = row[has], block[has]
        dealt = np.argsort(before[row], kind="stable")
        row, block = row[dealt], block[dealt]
        symbol = before[row]
        parts = np.ones(len(row) + 1, bool)
        parts[1:-1] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        together = ~(parts[:-1] & parts[1:])
        block = np.cumsum(parts[:-1])[together]
        row = ahead[row[together]]
    return np.sort(row), touched


def repeated_strings(shards: list[list[bytes]], length: int) -> list[tuple[int, int]]:
    """(text, offset), in order, of all strings of ``length`` bytes that start anywhere else too; texts are numbered through the shards."""
    made, first = [], 0
    for texts in shards:
        made.append(transform(texts, first))
        first += len(texts)
    found = repeated_rows(made, length)[0]
    text, offset = (np.concatenate([getattr(t, f) for t in made]) if made else np.zeros(0, np.int64) for f in ("text", "offset"))
    return sorted(zip(text[found].tolist(), offset[found].tolist(), strict=True))
