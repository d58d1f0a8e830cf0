"""Words and fingerprints of whole batches of texts, worked out on the UTF-8 bytes with numpy.

A word is a run of bytes other than space and 0x09-0x0D, so splitting bytes is splitting code
points. A word's fingerprint is 64 bits wide; sequences of words are compared by 64-bit
fingerprints of the words' fingerprints. Work arrays are bounded by SPAN bytes of text at a time,
so a very long text costs a few bytes per byte of its own and no more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPAN = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_STEP = 0xD1342543DE82EF95
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, SPAN + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), SPAN + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all others."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


@dataclass
class Bytes:
    """Texts as one byte array; text i is data[at[i]:at[i + 1]]."""

    data: np.ndarray
    at: np.ndarray


def text_bytes(texts: pa.Array) -> Bytes:
    """A null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return Bytes(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, values = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if values is not None else np.zeros(0, np.uint8)
    return Bytes(data, at - at[0])


def batches(batch: pa.RecordBatch, column: str = "text", most: int = SPAN, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text and at most `rows` rows each, one row at least."""
    at = text_bytes(batch.column(batch.schema.get_field_index(column))).at
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, min(first + rows, int(np.searchsorted(at, at[first] + most, side="right")) - 1))
        yield batch.slice(first, last - first)
        first = last


@dataclass
class Words:
    """start, end: byte places of each word; first: number of each text's first word, and the end."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def find_runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True that end at the borders `at`: starts, ends, and the first run after each border."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    inner = at[(at > 0) & (at < len(inside))]
    begins[inner] = inside[inner]
    ends[inner - 1] = inside[inner - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, at)


def find_words(texts: Bytes) -> Words:
    return Words(*find_runs(~SPACE[texts.data], texts.at))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit fingerprints of the byte spans, which are in order and don't overlap."""
    out = np.empty(len(start), np.uint64)
    done = 0
    while done < len(start):
        low = start[done]
        stop = int(np.searchsorted(end, low + SPAN, side="right"))
        if stop <= done:  # one span longer than SPAN
            body = data[low : end[done]]
            body = _LOWER[body] if lower else body
            out[done] = int.from_bytes(hashlib.blake2b(body.tobytes(), digest_size=8).digest(), "little")
            done += 1
            continue
        s, e = start[done:stop] - low, end[done:stop] - low
        body = data[low : low + e[-1]]
        values = _BYTE[_LOWER[body] if lower else body]
        values *= _POW[: len(values)]
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        out[done:stop] = mix((sums[e] - sums[s]) * _INV[s] + (e - s).astype(np.uint64))
        done = stop
    return out


def hash_runs(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of every `size` consecutive words, across texts too; see `inside`."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total, length, power, width = None, 0, words, 1
    step = _STEP
    rest = size
    while rest:
        if rest & 1:
            if total is None:
                total, length = power[:count].copy(), width
            else:
                shifted = power[length : length + count]
                total = total * np.uint64(pow(_STEP, width, 1 << 64)) + shifted
                length += width
        rest >>= 1
        if rest:
            power = power[: len(power) - width] * np.uint64(step) + power[width:]
            width *= 2
            step = pow(step, 2, 1 << 64)
    return mix(total)


def inside(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of `size` words that lie within one text, and the text of each."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    skipped = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - skipped[text] + first[:-1][text], text


def code_points(data: np.ndarray) -> np.ndarray:
    """True for the first byte of each character."""
    return (data & 0xC0) != 0x80


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of flags (or numbers) over the texts."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]
