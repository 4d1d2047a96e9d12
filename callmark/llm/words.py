"""Words of whole texts as 64-bit hashes, computed on the bytes of an Arrow column, many texts at once.

Words are what stands between ASCII white space.  The hash of a word of at most SHORT bytes is the sum of a number
per byte times a power of an odd base, mixed with the length: all of a stretch come from one running sum over its
bytes.  In long words such sums meet for some texts whatever the base, so that these are hashed one by one (XXH3).
Nulls count as empty texts.  What is held at a time is bounded by STEP and by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from callmark.llm.common import forget

#: Bytes looked at in one step, and bytes of text (of several documents, or of one that is longer) handled together.
STEP, TOGETHER = 1 << 17, 1 << 20
#: Bytes of a word up to which its hash is a sum.
SHORT = 16
BASE = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
NUMBER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
LOWERED = NUMBER[np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))]


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(STEP - 1, base, np.uint64)]))


POWER, INVERSE = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))



def _closed(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mixed(sums + sizes.astype(np.uint64) * np.uint64(0x165667B19E3779F9))


def _stretch(data: np.ndarray, bounds: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of at most STEP bytes; words end at bounds as well."""
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    first[bounds], last[bounds - 1] = word[bounds], word[bounds - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last)
    sums = np.cumsum(numbers[data] * POWER[: len(data)])
    sizes = stops + 1 - starts
    own = _closed((sums[stops] - np.where(starts > 0, sums[starts - 1], np.uint64(0))) * INVERSE[starts], sizes)
    long = np.flatnonzero(sizes > SHORT)
    if len(long):
        whole = (LOWER[data] if numbers is LOWERED else data).tobytes()
        own[long] = np.array([xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(starts[long].tolist(), (stops[long] + 1).tolist())], np.uint64)
    return starts, own


def _long_word(data: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    state = xxhash.xxh3_64()
    for at in range(0, len(data), STEP):
        part = data[at : at + STEP]
        state.update((LOWER[part] if numbers is LOWERED else part).tobytes())
    return np.array([state.intdigest()], np.uint64)


def hashed(data: np.ndarray, bounds: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """data: UTF-8 bytes; bounds: where each text begins, and the end.  Hashes of all words, and where each text's begin, and the end."""
    numbers, found, values = LOWERED if lower else NUMBER, [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    at, end = int(bounds[0]), int(bounds[-1])
    while at < end:
        stop = min(at + STEP, end)
        if stop < end:  # back to a border of words
            spaces = np.flatnonzero(SPACE[data[at:stop]])
            border = max(at + int(spaces[-1]) + 1 if len(spaces) else at, int(bounds[np.searchsorted(bounds, stop, "right") - 1]))
            if border <= at:  # one word reaches beyond
                limit = int(bounds[np.searchsorted(bounds, stop, "right")])
                while stop < limit:
                    spaces = np.flatnonzero(SPACE[data[stop : min(stop + STEP, limit)]])
                    if len(spaces):
                        stop += int(spaces[0])
                        break
                    stop = min(stop + STEP, limit)
                found.append(np.array([at]))
                values.append(_long_word(data[at:stop], numbers))
                at = stop
                continue
            stop = border
        inner = bounds[np.searchsorted(bounds, at, "right") : np.searchsorted(bounds, stop)] - at
        starts, h = _stretch(data[at:stop], inner, numbers)
        found.append(starts + at)
        values.append(h)
        at = stop
    return np.concatenate(values), np.searchsorted(np.concatenate(found), bounds)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the bounds of its values (one more than rows); nulls are empty."""
    column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def word_hashes(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For stretches of rows: the first row, the hashes of all words, where each row's begin (and the end)."""
    forget()  # operators on words remember nothing between tasks
    data, bounds = bytes_of(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + TOGETHER, "right")) - 1)
        h, at = hashed(data, bounds[row : stop + 1], lower)
        yield row, h, at
        row = stop


def sequences(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on, put together from powers of two."""
    n = len(h) - k + 1
    out, done, power, width = np.full(max(n, 0), k, np.uint64), 0, h, 1
    if n <= 0:
        return out
    while True:
        if k & width:
            out = mixed(out * np.uint64(BASE) + power[done : done + n])
            done += width
        if done == k:
            return out
        power = mixed(power[: len(power) - width] * np.uint64(0xC2B2AE3D27D4EB4F) + power[width:])
        width *= 2


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of every whole text, in order; A-Z count as a-z; fewer words are one shingle, none an empty set."""
    for row, h, at in word_hashes(column, lower=True):
        all_ = sequences(h, words)
        for i, (lo, hi) in enumerate(zip(at.tolist(), at[1:].tolist())):
            n = hi - lo
            own = all_[lo : hi - words + 1] if n >= words else sequences(h[lo:hi], n) if n else h[:0]
            own = np.sort(own)
            yield row + i, own[np.concatenate([[True], own[1:] != own[:-1]])] if n > words else own
