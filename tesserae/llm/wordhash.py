"""64-bit hashes of white-space words and of runs of words, vectorised over Arrow string columns.

A word is [^\\x20\\x09-\\x0D]+ in UTF-8.  Its hash mixes its bytes in, eight at a
time; a run's hash is a polynomial over its words' hashes, taken as a difference
of prefix sums and mixed.  Both depend on the words alone, not on where they stand.
A polynomial modulo 2^64 must not be taken over more than a few dozen terms:
Thue-Morse sequences of 1,024 and more have equal values whatever the base.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes hashed at a time, so that memory does not follow the length of a text or a batch.
CHUNK = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUN_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose result bits all depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Low bytes of a lane of eight, by how many of them belong to the word.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of up to so many bytes are hashed by lanes, all words at once; longer ones one by one.
LANED = 64


def _hashed(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the given byte ranges: lanes of eight bytes are mixed in one after the other, so that no two lanes cancel out."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    size = ends - begins
    h = mixed((lanes[begins] & _LOW[np.minimum(size, 8)]) + size.astype(np.uint64) * _RUN_BASE)
    more, done = np.flatnonzero((size > 8) & (size <= LANED)), 8
    while len(more):
        h[more] = mixed((lanes[begins[more] + done] & _LOW[np.minimum(size[more] - done, 8)]) + h[more] * _BASE)
        done += 8
        more = more[size[more] > done]
    for i in np.flatnonzero(size > LANED).tolist():
        h[i] = xxhash.xxh64_intdigest(memoryview(data[begins[i] : ends[i]]))
    return h


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    up, down = np.full(n, base, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class _Powers:
    """Powers of a base and of its inverse modulo 2^64, made as far as needed."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.up, self.down = base, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, max(n, 1 << 16))
        return self.up, self.down


_word_powers = _Powers(_RUN_BASE)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without nulls, offsets from 0."""
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return at - at[0], whole[at[0] : at[-1]]


#: Text bytes that operators work on at a time; a single longer text is one part.
PART_BYTES = 2 << 20


def parts(batch: pa.RecordBatch, *columns: str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts in the given columns take about most bytes, since hashing takes many times as much."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        sizes += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > lo and held + s > most:
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += s
    if lo < batch.num_rows:
        yield batch.slice(lo)


def released(run: Callable) -> Callable:
    """A mapInArrow function after which its worker, which Spark keeps for later tasks, gives free memory back to the system."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def _word_end(data: np.ndarray, at: int, end: int) -> int:
    """The first white space from at on, before end."""
    for lo in range(at, end, CHUNK):
        spaces = np.flatnonzero(_SPACE[data[lo : min(lo + CHUNK, end)]])
        if len(spaces):
            return lo + int(spaces[0])
    return end


def _cuts(offsets: np.ndarray, data: np.ndarray) -> list[int]:
    """Places at which no word is cut, at most CHUNK apart unless a single word is longer."""
    cuts, size = [0], len(data)
    while cuts[-1] < size:
        at = cuts[-1] + CHUNK
        if at >= size:
            cuts.append(size)
            break
        k = int(offsets[np.searchsorted(offsets, at, "right") - 1])
        if k <= cuts[-1]:  # within one long text
            spaces = np.flatnonzero(_SPACE[data[cuts[-1] + 1 : at]])
            k = cuts[-1] + 1 + int(spaces[-1]) if len(spaces) else _word_end(data, at, int(offsets[np.searchsorted(offsets, at, "left")]))
        cuts.append(k)
    return cuts


class Places:
    """The words of a string column: byte range and row of each, and each row's first word and word count."""

    def __init__(self, column: pa.Array) -> None:
        self.offsets, self.data = string_bytes(column)
        starts, ends = [], []
        cuts = _cuts(self.offsets, self.data)
        for lo, hi in zip(cuts, cuts[1:]):
            s, e = self._bounds(lo, hi)
            starts.append(s)
            ends.append(e)
            self._chunk(lo, hi, s, e)
        self.start, self.end = _joined(starts, np.int64), _joined(ends, np.int64)
        self.first = np.searchsorted(self.start, self.offsets[:-1], "left")
        self.count = np.searchsorted(self.start, self.offsets[1:], "left") - self.first
        self.row = np.repeat(np.arange(len(self.count)), self.count)

    def _bounds(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        space = _SPACE[self.data[lo:hi]]
        inner = self.offsets[np.searchsorted(self.offsets, lo, "left") : np.searchsorted(self.offsets, hi, "right")] - lo
        edge = np.zeros(hi - lo + 1, dtype=bool)  # between bytes: a text or the chunk begins or ends
        edge[inner] = edge[0] = edge[-1] = True
        after, before = edge[:-1].copy(), edge[1:].copy()
        after[1:] |= space[:-1]
        before[:-1] |= space[1:]
        return np.flatnonzero(~space & after) + lo, np.flatnonzero(~space & before) + 1 + lo

    def _chunk(self, lo: int, hi: int, starts: np.ndarray, ends: np.ndarray) -> None:
        """What a subclass does with the words of a chunk."""

    def joined(self, words: np.ndarray) -> bytes:
        """The given words, each followed by a space."""
        sizes = self.end[words] - self.start[words] + 1
        ends = np.cumsum(sizes)
        index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[words] - (ends - sizes), sizes)
        out = self.data[np.minimum(index, len(self.data) - 1)]
        out[ends - 1] = 0x20
        return out.tobytes()

    def numbered(self) -> tuple[np.ndarray, pa.Array]:
        """(number of each word, distinct words): equal words, and only these, have one number."""
        ends = np.concatenate([[0], np.cumsum(self.end - self.start)]).astype(np.int64)
        letters = self.data[~_SPACE[self.data]]
        column = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters))]).dictionary_encode()
        return column.indices.to_numpy().astype(np.int64), column.dictionary


def _joined(arrays: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.empty(0, kind)


class Words(Places):
    """Places of words with a hash of each."""

    def __init__(self, column: pa.Array, lower: bool = False) -> None:
        self.lower, self.hashes = lower, []
        super().__init__(column)
        self.hash = _joined(self.hashes, np.uint64)
        del self.hashes

    def _chunk(self, lo: int, hi: int, starts: np.ndarray, ends: np.ndarray) -> None:
        data = self.data[lo:hi]
        self.hashes.append(_hashed(_LOWER[data] if self.lower else data, starts - lo, ends - lo))

    def same(self, other: np.ndarray) -> np.ndarray:
        """Whether each word has the bytes of another one, given by number, whose hash it has.

        The last lane of a word follows from its hash and the lanes before, as
        mixing is a bijection; so only these and the size are compared.
        """
        size = self.end - self.start
        out = size == size[other]
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        lanes = np.ndarray(len(self.data) + 1, "<u8", padded, 0, (1,))
        more, done = np.flatnonzero(out & (size > 8) & (size <= LANED)), 0
        while len(more):
            out[more] &= lanes[self.start[more] + done] == lanes[self.start[other[more]] + done]
            done += 8
            more = more[size[more] > done + 8]
        for i in np.flatnonzero(out & (size > LANED)).tolist():
            j = int(other[i])
            out[i] = np.array_equal(self.data[self.start[i] : self.end[i]], self.data[self.start[j] : self.end[j]])
        return out

    def runs(self, places: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
        """Hashes of the runs of n words that begin at the given words (each within its row)."""
        if not len(places):
            return np.empty(0, np.uint64)
        total = len(self.hash)
        up, down = _word_powers.of(total + 1)
        sums = np.empty(total + 1, np.uint64)
        sums[0] = 0
        own = self.hash if not seed else mixed(self.hash + np.uint64(seed))
        np.cumsum(own * up[:total], out=sums[1:])
        return mixed((sums[places + n] - sums[places]) * down[places] + np.uint64(n + seed))
