"""Whole Arrow text columns in numpy: word positions, word hashes, line positions.

No Python string is made for a word here; a column's UTF-8 bytes are looked at
as they lie in the Arrow buffer. Bytes from 0x80 belong to characters outside
ASCII, so byte classes decide word borders exactly.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = (0x20, *range(0x09, 0x0E))
_draw = np.random.default_rng(0x5EED)
#: Random 64-bit value of each byte, multiplier of a word's polynomial.
BYTE_VALUES = _draw.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def give_back():
    """Returns free memory of this worker to the system: idle workers share their executor's memory with busy ones."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """A task function over batches that gives its memory back at its end."""

    def tidied(rows):
        try:
            yield from run(rows)
        finally:
            give_back()

    return tidied


def byte_values(lower: bool = False) -> np.ndarray:
    """A value for each byte; with lower, A-Z have the values of a-z."""
    values = BYTE_VALUES.copy()
    if lower:
        values[65:91] = values[97:123]
    return values


def space_class() -> np.ndarray:
    """True for bytes of words, where words are runs without ASCII white space."""
    inside = np.ones(256, bool)
    inside[list(SPACES)] = False
    return inside


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"", column.type))
    wide = pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary()
    column = column.cast(wide)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one more at the end)."""
    word = inside[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = offsets[1:] > offsets[:-1]
    first[offsets[:-1][full]] = word[offsets[:-1][full]]
    last[offsets[1:][full] - 1] = word[offsets[1:][full] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, block: int = 1 << 19) -> np.ndarray:
    """64-bit hash of each span of bytes; spans are in order and do not overlap.

    The work goes in blocks of bytes, so that its memory does not grow with the column.
    """
    full = ends > starts
    if not full.all():
        out = np.zeros(len(starts), np.uint64)
        out[full] = hashes(data, starts[full], ends[full], values, block)
        return out
    out = np.zeros(len(starts), np.uint64)
    power = powers(int((ends - starts).max(initial=0)) + 1, int(STEP))
    top = np.int64(len(power) - 1)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, side="right")))
        low, high = starts[i], ends[j - 1]
        at = starts[i:j] - low
        run = np.diff(at, append=high - low)
        place = np.arange(high - low) - np.repeat(at, run)
        value = values[data[low:high]]
        value[place >= np.repeat(ends[i:j] - starts[i:j], run)] = 0
        out[i:j] = np.add.reduceat(value * power[np.minimum(place, top)], at)
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * STEP)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values: one fewer than n shorter than the input."""
    size = max(0, len(words) - n + 1)
    out = np.zeros(size, np.uint64)
    for k, factor in enumerate(powers(n + 1, 0xD6E8FEB86659FD93)[1:]):
        out += words[k : k + size] * factor
    return mix(out)


def parts(batch, text: str, size: int = 2 << 20):
    """The batch in runs of rows with about so many bytes of text each; a row is never cut."""
    if batch.num_rows:
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b
