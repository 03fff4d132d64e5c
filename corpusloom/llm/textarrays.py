"""Words, rolling hashes and local minima of a batch of texts, as numpy arrays over Arrow's own buffers.

All hashes are 64-bit polynomials modulo 2**64 over an odd base, finalised with a multiply-xorshift mix, so that
equal content gives equal hashes on every executor. `chunks` bounds the memory: each step holds a few arrays of
eight bytes for each byte of a chunk, whatever the batch is."""

import ctypes
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 18

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i in 0..n-1."""
    if len(_powers[0]) < n:
        size = 1 << max(18, (n - 1).bit_length())
        for at, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[at] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] the polynomial of values[i:j] times BASE**i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def rolling_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values; empty if there are fewer."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(values)
    n = len(values) - k + 1
    return mix((sums[k:] - sums[:-k]) * powers(n)[1])


def sliding(a: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """pick over each run of `width` values, by doubling."""
    have, out = 1, a
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


class Chunk:
    """Some texts as one byte array: bytes data[bounds[i]:bounds[i + 1]] are those of row rows[i] of the batch."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.data, self.bounds, self.first = data, bounds, first
        self.size = len(bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def words(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word (runs of bytes other than 0x20 and 0x09-0x0D), and word offsets by text."""
        data = self.data
        if lower:
            data = data + (((data - np.uint8(65)) < 26).astype(np.uint8) << np.uint8(5))
        inside = ~((data == 32) | ((data - np.uint8(9)) < 5))
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        at = self.bounds[(self.bounds > 0) & (self.bounds < len(data))]
        begins[at] = inside[at]
        ends[at - 1] = inside[at - 1]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        hashes = spans_hash(prefix_sums(data.astype(np.uint64) + np.uint64(1)), starts, stops)
        return hashes, np.searchsorted(starts, self.bounds)


def chunks(column: pa.Array) -> Iterator[Chunk]:
    """The texts of a column in order (null: empty), about CHUNK_BYTES at a time and never part of a text."""
    column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        last = min(last, len(column))
        yield Chunk(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first)
        first = last


def _released(batches, work: Callable):
    try:
        yield from work(batches)
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # only glibc has it
            pass


def released(work: Callable, **options) -> Callable:
    """work(batches, **options) whose worker gives freed memory back to the system at its end; workers outlive their tasks."""
    return partial(_released, work=partial(work, **options))


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each item the number of the text that it belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def local_minima(values: np.ndarray, bounds: np.ndarray, gram: int, window: int):
    """Winnowing. Over items in texts at `bounds`: the hash of each run of `gram` items, the least such hash of each run
    of `window` items that lies in one text (0: none does), and which grams are that least one for some window. Two equal
    windows have the same least hash, so texts that share a window share a chosen gram."""
    grams = rolling_hash(values, gram)
    grams |= np.uint64(1)
    width = window - gram + 1
    least = sliding(grams, width)
    if not len(least):
        return grams, least, np.zeros(len(grams), bool)
    owner = owners(bounds)
    least = np.where(owner[: len(least)] == owner[window - 1 :][: len(least)], least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    chosen = sliding(np.concatenate([pad, least, pad]), width, np.maximum) == grams
    return grams, least, chosen


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
