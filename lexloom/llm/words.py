"""Vectorised word hashing over the bytes of many documents at once.

Words are maximal runs of bytes other than space and 0x09-0x0D.  All
functions work on flat numpy arrays that cover a whole chunk of documents, so
that the per-document cost in Python stays small.  Chunks are cut by bytes, not
by rows, which bounds a worker's memory whatever the Arrow batch size is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S = [np.uint64(k) for k in (30, 27, 31)]
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = (x ^ (x >> _S[0])) * _C1
    x = (x ^ (x >> _S[1])) * _C2
    return x ^ (x >> _S[2])


class Words:
    """Words of a chunk: byte spans, the document each belongs to, and hashes."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = np.frombuffer(b" ".join(texts) + b" " * 9, dtype=np.uint8)
        self.data = _LOWER[data] if lower else data
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.n_docs = len(texts)
        self.doc_at = np.concatenate(([0], np.cumsum(sizes)))
        inside = ~_SPACE[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate(([0], edges))
        self.starts, self.ends = edges[::2], edges[1::2]
        #: first[d] : first[d + 1] are the words of document d.
        self.first = np.searchsorted(self.starts, self.doc_at)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash a word; injective for words of up to eight bytes of one length."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        eight = np.ndarray((len(self.data) - 7,), dtype="<u8", buffer=self.data, strides=(1,))
        left = self.ends - self.starts
        out = mix(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out = mix(out ^ (eight[self.starts] & _MASKS[np.minimum(left, 8)]))
        more, at = np.flatnonzero(left > 8), 8
        while len(more):
            x = eight[self.starts[more] + at] & _MASKS[np.minimum(left[more] - at, 8)]
            out[more] = mix(out[more] * _C2 ^ x)
            at += 8
            more = more[left[more] > at]
        return out


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def grams(h: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of `size` consecutive hashes (runs may span documents; see same_doc)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * _powers(base, len(h)), out=total[1:])
    return mix((total[size:] - total[:-size]) * _powers(pow(base, -1, 1 << 64), n))


def same_doc(doc: np.ndarray, size: int) -> np.ndarray:
    """Whether the run of `size` words from each position lies in one document."""
    if len(doc) < size:
        return np.zeros(0, dtype=bool)
    return doc[: len(doc) - size + 1] == doc[size - 1 :]


def _sliding(x: np.ndarray, w: int, f, fill) -> np.ndarray:
    """f (minimum or maximum) over every w consecutive values, in a few passes."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = np.full(-len(x) % w, fill, dtype=x.dtype)
    blocks = np.concatenate((x, pad)).reshape(-1, w)
    ahead = f.accumulate(blocks, axis=1).ravel()
    behind = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[:n], ahead[w - 1 : w - 1 + n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    return _sliding(x, w, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))


def sliding_max(x: np.ndarray, w: int) -> np.ndarray:
    return _sliding(x, w, np.maximum, np.uint64(0))


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text is a chunk of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def encoded(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def parts(batch, place: int, limit: int = CHUNK_BYTES, texts: bool = True) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of an Arrow batch with about `limit` bytes of text each, and these texts in UTF-8; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = batch.column(place).cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = size = 0
    for i, n in enumerate([*sizes, None]):
        if n is None or (size and size + n > limit):
            if i > start:
                yield start, i, [b"" if t is None else t for t in column.slice(start, i - start).to_pylist()] if texts else []
            start, size = i, 0
        size += (n or 0) + 1
    pa.default_memory_pool().release_unused()  # workers live long, and share an executor's memory
