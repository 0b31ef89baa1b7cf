"""Word shingles as sparse rows: document-frequency sketch, rarest-first prefixes, size-derived bounds, packed blocks.

The bounds are those of Jaccard similarity ``t`` between two sets of ``a`` and ``b`` shingles: such sets share at least
``ceil(t / (1 + t) * (a + b))`` shingles.  All of them are lossless: whatever order the shingles are put in, two similar
sets share at least ``least`` shingles among their first ``a - needed + least`` and ``b - needed + least`` ones.
"""

from __future__ import annotations

import math

import numpy as np

from .words import mix, runs, split_words

#: Least and most bits of a slot of the frequency sketch (4 to 32 MB when coded), and characters of the input for a slot.
SKETCH_BITS, SLOT_CHARS = (22, 25), 24
#: Entries of one column (or of a run of words) beyond which it is cut up, where the sketch can tell such columns.
HOT = 20_000
TOKEN_BITS = 44
_ONE = np.uint64(1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as byte planes, so that the shuffle's compression removes unused high bytes."""
    return b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    widths = [np.dtype(t).itemsize for t in dtypes]
    n = len(blob) // sum(widths)
    flat, at, out = np.frombuffer(blob, np.uint8), 0, []
    for width, dtype in zip(widths, dtypes, strict=True):
        out.append(np.ascontiguousarray(flat[at : at + n * width].reshape(width, n).T).view(dtype).reshape(n))
        at += n * width
    return out


def unpack_all(blobs: list[bytes], *dtypes) -> list[np.ndarray]:
    parts = [unpack(b, *dtypes) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate(dtypes)]


def needed(a, b, threshold: float):
    """Least number of common elements of sets of sizes a and b with at least that Jaccard similarity."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9).astype(np.int64)


def similar(common, a, b, threshold: float):
    return common >= threshold * (a + b - common) - 1e-9


def shingle_sets(texts: list[str | None], size: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, shingle hash) of the distinct shingles of the texts with enough words, in both orders sorted."""
    words = split_words(texts)
    hashes, begin = runs(words, size)
    long_enough = np.diff(words.first) >= max(least_words, size)
    doc = np.repeat(np.arange(len(texts)), np.diff(begin))
    if not long_enough.all():
        keep = long_enough[doc]
        doc, hashes = doc[keep], hashes[keep]
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    if len(doc):
        first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])])
        doc, hashes = doc[first], hashes[first]
    return doc, hashes


def sketch_size(chars: int) -> int:
    """Slots of the sketch for texts of so many characters: a power of two that grows with them between two bounds."""
    return 1 << min(SKETCH_BITS[1], max(SKETCH_BITS[0], math.ceil(math.log2(chars / SLOT_CHARS + 1))))


def hot_from(chars: int, hot: int = HOT) -> int:
    """Count from which a column is hot: well above what the slots hold on average, so that no usual one is taken for it."""
    return max(hot, 4 * (chars // 6) // sketch_size(chars))


class Sketch:
    """Counters of one byte, with a list for what goes beyond: 32 MB a task at most."""

    def __init__(self, count: int):
        self.low, self.over = np.zeros(count, np.uint8), {}

    def add(self, at: np.ndarray) -> None:
        at, more = np.unique(at, return_counts=True)
        total = self.low[at] + more
        self.low[at] = total % 255
        for slot, n in zip(at[total >= 255].tolist(), (total[total >= 255] // 255 * 255).tolist(), strict=True):
            self.over[slot] = self.over.get(slot, 0) + n

    def blocks(self, size: int):
        """(number, counters) of each block of ``size`` slots that isn't empty."""
        slot, n = (np.array(list(x), np.int64) for x in (self.over.keys(), self.over.values()))
        for k in range(len(self.low) // size):
            part = self.low[k * size : (k + 1) * size].astype(np.uint32)
            mine = slot // size == k
            part[slot[mine] - k * size] += n[mine].astype(np.uint32)
            if part.any():
                yield k, part


def slots(hashes: np.ndarray, count: int) -> np.ndarray:
    return (hashes >> np.uint64(65 - int(count).bit_length())).astype(np.int64)


def set_hashes(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each document present: its index, the size of its set and two hashes of the whole set."""
    if not len(doc):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    sizes = np.diff(np.concatenate([start, [len(doc)]]))
    one = mix(np.add.reduceat(mix(hashes), start))
    two = mix(np.add.reduceat(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), start))
    return doc[start], sizes, one.view(np.int64), two.view(np.int64)


def coded(counts: np.ndarray) -> np.ndarray:
    """Counts of the sketch on a logarithmic scale of one byte; 0 means none or one."""
    return np.minimum(255, np.round(6 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def decoded(code: np.ndarray) -> np.ndarray:
    return np.exp2(code.astype(np.float64) / 6)


def prefixes(doc, hashes, codes, threshold: float, least: int):
    """Rarest-first prefix of each set: (document index, token, code, position, size of the set), one row per shingle."""
    code = codes[slots(hashes, len(codes))]
    token = hashes >> np.uint64(64 - TOKEN_BITS)
    key = (doc.astype(np.uint64) << np.uint64(52)) | (code.astype(np.uint64) << np.uint64(TOKEN_BITS)) | token
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([start, [len(doc)]])).astype(np.int64)
    size = np.repeat(sizes, sizes)
    position = np.arange(len(doc)) - np.repeat(start, sizes)
    keep = position < size - np.ceil(threshold * size - 1e-9).astype(np.int64) + least
    code = code[order][keep]
    return order[keep], doc[keep], key[keep] & np.uint64((1 << TOKEN_BITS) - 1), code, position[keep], size[keep]


def spans_of_pairs(group, size, position, threshold: float, least: int):
    """Sorted by (group, size): how many of the following members of its group each member is compared with."""
    reach = np.floor((size - position + least - 1) * (1 + threshold) / threshold - size + 1e-9)
    reach = np.minimum(reach, np.floor(size / threshold + 1e-9)).astype(np.int64)
    wide = np.int64(max(int(size.max(initial=0)), int(reach.max(initial=0))) + 2)
    last = np.searchsorted(group * wide + size, group * wide + np.maximum(reach, 0), side="right")
    return np.maximum(0, np.where(reach >= size, last - np.arange(len(size)) - 1, 0))


def expand(count: np.ndarray, most: int = 4_000_000):
    """Slices of (left, right) index pairs where member i is paired with the ``count[i]`` members after it."""
    total = np.concatenate([[0], np.cumsum(count)])
    i = 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, side="right")) - 1)
        part = count[i:j]
        left = np.repeat(np.arange(i, j), part)
        right = left + 1 + np.arange(len(left)) - np.repeat(total[i:j] - total[i], part)
        yield left, right
        i = j


def partitions_for(rows: float, least: int, each: int = 1_000_000) -> int:
    return max(least, math.ceil(rows / each))
