"""Whole-batch text work on UTF-8 bytes with numpy: word bounds, 64-bit word hashes and word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = []


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text. Offsets start at 0."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(20, int(n).bit_length())
        for at, base in ((0, _P), (1, _P_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _powers[at : at + 1] = [table]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and first-word index per document of the words [^\\x20\\x09-\\x0D]+; a word never spans two documents."""
    n = len(raw)
    space = _SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = True
    before[1:] = space[:-1]
    after = np.empty(n, bool)
    after[-1:] = True
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z folded to a-z where asked, as differences of one running polynomial sum."""
    up, down = _power_tables(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[raw] if lower else raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] ^ ((ends - starts).astype(np.uint64) << np.uint64(56)))


class RunHash:
    """64-bit digests of runs of words, each from two entries of one running polynomial sum of word hashes."""

    def __init__(self, words: np.ndarray):
        up, self.down = _power_tables(len(words))
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words) * up[: len(words)], out=self.sums[1:])

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The digest of the words low to high (exclusive) of each run; its length counts too."""
        return mix((self.sums[high] - self.sums[low]) * self.down[low] ^ ((high - low).astype(np.uint64) << np.uint64(48)))


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's runs of `width` words, and where each document's begin; fewer words make one run, none none."""
    counts = np.diff(first)
    n = len(words)
    whole = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(whole)] + np.uint64(k + 1))
    per = np.where(counts >= width, counts - width + 1, np.where(counts > 0, 1, 0))
    out_first = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(len(counts)), per)
    at = np.arange(out_first[-1]) - out_first[doc] + first[:-1][doc]
    out = np.zeros(out_first[-1], np.uint64)
    long = counts[doc] >= width
    out[long] = whole[at[long]]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        h = np.full(1, counts[i], np.uint64)
        for w in words[first[i] : first[i + 1]]:
            h = mix(h * np.uint64(0xA0761D6478BD642F) + w)
        out[out_first[i]] = h[0]
    return out, out_first


def per_document(values: np.ndarray, first: np.ndarray, op: np.ufunc = np.add) -> np.ndarray:
    """op.reduceat over each document's run of values; 0 for an empty run."""
    out = np.zeros(len(first) - 1, values.dtype if values.dtype != bool else np.int64)
    full = np.diff(first) > 0
    if full.any():
        out[full] = op.reduceat(values.astype(out.dtype, copy=False), first[:-1][full])
    return out
