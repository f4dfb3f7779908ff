"""Words and chunks of whole text columns as numpy arrays, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: What separates words: `[\x20\x09-\x0D]`.
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: Base of the polynomial hash modulo 2**64 and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SLICE = 1 << 17
#: Codes that are gathered at a time.
GATHERED = 1 << 17

BYTE_VALUES = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[ord("A") : ord("Z") + 1] = BYTE_VALUES[ord("a") : ord("z") + 1]

_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64: spreads every bit of a 64-bit number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, … modulo 2**64, n of them at least."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, SLICE + 1)
        factors = np.full(size, base, dtype=np.uint64)
        factors[0] = 1
        known = _powers[base] = np.multiply.accumulate(factors)
        if size > 4 * SLICE:
            del _powers[base]
    return known


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and where each text begins (and the last ends)."""
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _slices(data: np.ndarray, size: int):
    """Ranges of about ``size`` bytes that end after a blank, so that no word is cut."""
    begin, n = 0, len(data)
    while begin < n:
        end = min(n, begin + size)
        while end < n:
            blanks = np.flatnonzero(IS_BLANK[data[begin:end]])
            if len(blanks):
                end = begin + int(blanks[-1]) + 1
                break
            end = min(n, end + size)
        yield begin, end
        begin = end


def word_spans(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word of all texts, and where each text's words begin.

    A word is a run of bytes other than blanks.  Its hash comes from differences of running
    polynomial sums: a few passes of numpy over the bytes.
    """
    data, offsets = buffers(column)
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[offsets] = True
    values = FOLDED_VALUES if fold else BYTE_VALUES
    hashes, starts, ends = [], [], []
    for begin, end in _slices(data, SLICE):
        part = data[begin:end]
        word = ~IS_BLANK[part]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | begins[begin + 1 : end]
        last[:-1] &= ~word[1:] | begins[begin + 1 : end]
        at, stop = np.flatnonzero(first), np.flatnonzero(last)
        if not len(at):
            continue
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(values[part] * powers(BASE, len(part))[: len(part)], out=sums[1:])
        raw = (sums[stop + 1] - sums[at]) * powers(INVERSE, len(part))[at]
        hashes.append(mixed(raw + (stop - at).astype(np.uint64)))
        starts.append(at + begin)
        ends.append(stop + begin + 1)
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    first = np.concatenate(starts)
    return np.concatenate(hashes), first, np.concatenate(ends), np.searchsorted(first, offsets)


def word_hashes(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (A-Z lower-cased) of all texts, and where each text's words begin."""
    hashes, _, _, offsets = word_spans(column, fold)
    return hashes, offsets


def byte_slices(column: pa.Array, size: int):
    """Slices of a string array that hold about ``size`` bytes each, one text at least."""
    _, offsets = buffers(column)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1)
        yield begin, column.slice(begin, end - begin)
        begin = end


def gathered(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The entries ``codes`` of a ragged table (flat, starts, lengths), one after the other.

    Positions are made for some codes at a time: they take several times the room of the entries.
    """
    ends = np.cumsum(lengths[codes])
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=flat.dtype)
    done = 0
    for first in range(0, len(codes), GATHERED):
        some = codes[first : first + GATHERED]
        sizes, until = lengths[some], ends[first : first + GATHERED] - done
        n = int(until[-1])
        np.take(flat, np.repeat(starts[some] - (until - sizes), sizes) + np.arange(n), out=out[done : done + n])
        done += n
    return out
