"""Patched frame-of-reference blocks for token ids.

A shard file holds, in this order: the magic, the blocks, the document table, the block
index and a footer. A block has ``BLOCK`` ids (the last may have fewer): its minimum, the
width in bits that a percentile of the differences needs, the differences packed at this
width, and an exception list with position and full difference of each id that needs more.
The index has the byte offset of every block, so a reader can start at any id.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"PFORIDS1"
BLOCK = 128
#: Share of a block's differences that must fit the packed width.
PERCENTILE = 90

_HEAD = np.dtype([("low", "<u4"), ("count", "u1"), ("width", "u1"), ("exceptions", "u1"), ("spare", "u1")])
_FOOT = struct.Struct("<QQQQQ8s")  # offset of the document table, of the index, documents, blocks, ids


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 0 for 0."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def encode(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """Bytes of the blocks of ``ids`` and each block's offset in them."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    n = -(-len(ids) // BLOCK)
    table = np.full(n * BLOCK, ids[-1], np.uint32)
    table[: len(ids)] = ids
    table = table.reshape(n, BLOCK)
    counts = np.full(n, BLOCK, np.int64)
    counts[-1] = len(ids) - (n - 1) * BLOCK
    low = table.min(axis=1)
    diff = table - low[:, None]
    rank = max(0, -(-BLOCK * percentile // 100) - 1)
    width = _bits(np.partition(diff, rank, axis=1)[:, rank])
    patched = diff >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    patched[-1, counts[-1] :] = False
    exceptions = patched.sum(axis=1)
    words = 2 * width  # 128 values of w bits are 2 w words of 64 bits
    sizes = _HEAD.itemsize + 8 * words + 5 * exceptions
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(offsets[-1], np.uint8)
    head = np.zeros(n, _HEAD)
    head["low"], head["count"], head["width"], head["exceptions"] = low, counts, width, exceptions
    _put(out, offsets[:-1], head.view(np.uint8).reshape(n, -1))
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            _put(out, offsets[rows] + _HEAD.itemsize, _pack(diff[rows], int(w)))
    row, at = np.nonzero(patched)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        base = offsets[row] + _HEAD.itemsize + 8 * words[row]
        out[base + nth] = at
        _put(out, base + exceptions[row] + 4 * nth, diff[row, at].astype("<u4").view(np.uint8).reshape(-1, 4))
    return out.tobytes(), offsets[:-1]


def _put(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    out[at[:, None] + np.arange(rows.shape[1])] = rows


def _pack(diff: np.ndarray, w: int) -> np.ndarray:
    mask = np.uint64((1 << w) - 1)
    columns = np.ascontiguousarray(diff.T).astype(np.uint64) & mask
    words = np.zeros((2 * w, len(diff)), np.uint64)
    for i in range(BLOCK):
        k, s = divmod(i * w, 64)
        words[k] |= columns[i] << np.uint64(s)
        if s + w > 64:
            words[k + 1] |= columns[i] >> np.uint64(64 - s)
    return np.ascontiguousarray(words.T).view(np.uint8)


def _unpack(words: np.ndarray, w: int) -> np.ndarray:
    columns = np.ascontiguousarray(words.T)
    mask = np.uint64((1 << w) - 1)
    diff = np.empty((BLOCK, words.shape[0]), np.uint32)
    for i in range(BLOCK):
        k, s = divmod(i * w, 64)
        value = columns[k] >> np.uint64(s)
        if s + w > 64:
            value = value | (columns[k + 1] << np.uint64(64 - s))
        diff[i] = value & mask
    return diff.T


def decode(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at ``offsets`` in ``data``."""
    n = len(offsets)
    if not n:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    offsets = np.asarray(offsets, np.int64)
    head = np.ascontiguousarray(raw[offsets[:, None] + np.arange(_HEAD.itemsize)]).view(_HEAD).ravel()
    width = head["width"].astype(np.int64)
    diff = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            at = offsets[rows] + _HEAD.itemsize
            packed = np.ascontiguousarray(raw[at[:, None] + np.arange(16 * w)]).view(np.uint64)
            diff[rows] = _unpack(packed, int(w))
    exceptions = head["exceptions"].astype(np.int64)
    if exceptions.any():
        row = np.repeat(np.arange(n), exceptions)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        base = offsets[row] + _HEAD.itemsize + 16 * width[row]
        values = np.ascontiguousarray(raw[(base + exceptions[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
        diff[row, raw[base + nth]] = values
    diff += head["low"][:, None]
    return diff[np.arange(BLOCK) < head["count"][:, None]]


class ShardWriter:
    """Writes one shard; takes the documents' ids in their order and holds few of them."""

    def __init__(self, out, percentile: int = PERCENTILE, flush: int = 1 << 20):
        self.out, self.percentile, self.flush = out, percentile, flush
        self.pending: list[np.ndarray] = []
        self.held = self.ids = self.at = 0
        self.docs: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.index: list[np.ndarray] = []
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, docs: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(docs.astype("<i8"))
        self.lengths.append(lengths.astype("<u8"))
        self.pending.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= self.flush:
            self._emit(last=False)

    def _emit(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        keep = 0 if last else len(ids) % BLOCK
        data, offsets = encode(ids[: len(ids) - keep], self.percentile)
        self.index.append(offsets + self.at)
        self._write(data)
        self.pending, self.held = [ids[len(ids) - keep :]], keep

    def close(self) -> tuple[int, int]:
        """Documents and ids of the shard."""
        self._emit(last=True)
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, "<i8")
        lengths = np.concatenate(self.lengths) if self.lengths else np.zeros(0, "<u8")
        index = np.concatenate(self.index).astype("<u8")
        table_at = self.at
        self._write(docs.tobytes() + lengths.tobytes())
        index_at = self.at
        self._write(index.tobytes())
        self._write(_FOOT.pack(table_at, index_at, len(docs), len(index), self.ids, MAGIC))
        return len(docs), self.ids


class ShardReader:
    """Reads a shard from a random-access file; ids come in runs of whole blocks."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - _FOOT.size)
        self.end, index_at, docs, blocks, self.n_ids, magic = _FOOT.unpack(source.read(_FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token shard, or cut short")
        source.seek(self.end)
        self.docs = np.frombuffer(source.read(8 * docs), "<i8")
        self.lengths = np.frombuffer(source.read(8 * docs), "<u8").astype(np.int64)
        source.seek(index_at)
        self.index = np.frombuffer(source.read(8 * blocks), "<u8").astype(np.int64)

    def runs(self, blocks: int = 8192):
        for first in range(0, len(self.index), blocks):
            offsets = self.index[first : first + blocks]
            stop = self.index[first + blocks] if first + blocks < len(self.index) else self.end
            self.source.seek(int(offsets[0]))
            yield decode(self.source.read(int(stop - offsets[0])), offsets - offsets[0])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard, without reading the blocks before them."""
        first, last = start // BLOCK, -(-stop // BLOCK)
        if stop <= start:
            return np.zeros(0, np.uint32)
        offsets = self.index[first:last]
        end = self.index[last] if last < len(self.index) else self.end
        self.source.seek(int(offsets[0]))
        run = decode(self.source.read(int(end - offsets[0])), offsets - offsets[0])
        return run[start - first * BLOCK : stop - first * BLOCK]
