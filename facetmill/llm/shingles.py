"""Sets of word shingles as sorted 64-bit hashes, and their fast similarity sketches.

Words are runs of anything but space and tab to carriage return, with A-Z in lower case. A text's
set holds its distinct runs of ``width`` words; a shorter text has its whole sequence as one
shingle; a text without words has the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_SLICE_BYTES = 8 << 20
_U = np.uint64
#: Odd multipliers, one for each word of a shingle, and those of the mixer.
_WORD_AT = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose result looks random (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _M1
        x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the bounds of each text's."""
    plain = pc.ascii_lower(pc.replace_substring_regex(texts, r"[\x09-\x0D]", " "))
    lists = pc.split_pattern(plain, " ")
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    code = coded.indices.to_numpy(zero_copy_only=False)
    bounds = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).astype(np.int64)
    blank = np.fromiter((not w for w in words), bool, len(words))
    if blank.any():
        full = ~blank[code]
        bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
        code = code[full]
    return hashes[code], bounds


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles in order, repeats included, and the bounds of each text's."""
    words, bounds = _words(texts)
    n = np.diff(bounds)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(words) - width + 1, 0), np.uint64)
        for k in range(width):
            rolled += words[k : k + len(rolled)] * _WORD_AT[k]
        rolled = mix(rolled)
        short = np.flatnonzero((n > 0) & (n < width))
        # A whole short sequence: its words at the same places, and its length, which no full shingle has.
        lone = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = n[short] > k
            lone[has] += words[bounds[short[has]] + k] * _WORD_AT[k]
        lone = mix(lone + n[short].astype(np.uint64) * _M1)
    full = np.maximum(n - width + 1, 0)
    many = full.copy()
    many[short] = 1
    out_bounds = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(int(out_bounds[-1]), np.uint64)
    place = np.arange(len(out)) - np.repeat(out_bounds[:-1], many)
    from_roll = np.repeat(full > 0, many)
    start = np.repeat(bounds[:-1], many)
    out[from_roll] = rolled[(start + place)[from_roll]]
    out[out_bounds[short]] = lone
    return out, out_bounds


def distinct(hashes: np.ndarray) -> np.ndarray:
    hashes = np.sort(hashes)
    return hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])] if len(hashes) else hashes


def sets(texts: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First text and the sorted sets of bounded slices of the texts; null has the empty set."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64)
    lo = 0
    while lo < len(texts):
        base = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, base + _SLICE_BYTES, "right")))
        hashes, bounds = shingle_hashes(texts.slice(lo, hi - lo), width)
        yield lo, [distinct(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        lo = hi


def sketches(groups: list[np.ndarray], size: int) -> np.ndarray:
    """Fast similarity sketches, a row of ``size`` coordinates for each non-empty set.

    In each of ``size`` rounds every element goes into one hashed bin; a coordinate keeps the
    smallest (round, hash) of its bin. In ``size`` further rounds each bin takes all elements in
    turn, so every coordinate fills. A set takes part until its bins are full, which for larger
    sets is after one to three rounds. Two coordinates agree with the sets' similarity as
    probability, and the share that agrees is concentrated as for independent samples.
    """
    out = np.full((len(groups), size), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    n = np.array([len(g) for g in groups], np.int64)
    active = np.arange(len(groups))
    elements, owner = (np.concatenate(groups) if len(groups) else np.empty(0, np.uint64)), np.repeat(active, n)
    bits = int(size).bit_length() - 1
    assert size == 1 << bits, "a power of two"
    for k in range(2 * size):
        with np.errstate(over="ignore"):
            x = mix(elements + _U(k + 1) * _WORD_AT[0])
        bins = (x >> _U(64 - bits)).astype(np.int64) if k < size else np.int64(k - size)
        value = (_U(k) << _U(48)) | (x & _U((1 << 48) - 1))
        np.minimum.at(flat, owner * size + bins, value)
        open_ = (out[active] == np.iinfo(np.uint64).max).any(axis=1)
        if not open_.any():
            break
        if not open_.all():
            active = active[open_]
            waits = np.zeros(len(groups), bool)
            waits[active] = True
            stay = waits[owner]
            elements, owner = elements[stay], owner[stay]
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A signed 64-bit key for each run of ``rows`` coordinates, which no other band shares."""
    n, size = sketch.shape
    bands = size // rows
    parts = sketch[:, : bands * rows].reshape(n, bands, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _M2
        for k in range(rows):
            key = mix(key + parts[:, :, k] * _WORD_AT[k])
    return key.view(np.int64)
