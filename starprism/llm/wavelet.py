"""Wavelet matrix of token ids: one compressed file per shard, with access, rank, select and counting."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections import OrderedDict

import numpy as np
import zstandard

_HEAD = struct.Struct("<8sBQII")
_MAGIC = b"WVMATRX2"
BLOCK_BYTES = 4096
_BLOCK_BITS = 8 * BLOCK_BYTES


class WaveletMatrix:
    """Bit planes from the highest bit down; each next plane holds the codes ordered stably by the planes before. A code is
    an id's place among the shard's ids by falling frequency, so high planes are nearly empty and compress well.

    File: magic, number of planes, number of ids, number of distinct ids, length of ``extra``; extra; the distinct ids
    by code; for each plane its directory (of every block of ``BLOCK_BYTES`` the ones before it and where its bytes
    begin, and last the totals) and its compressed blocks; crc32 of all before. Rank and select read the directory and
    inflate the one block they need; a bounded number of blocks is kept inflated. ``extra`` carries the shard's own columns.
    """

    def __init__(self, data: bytes):
        magic, self.width, self.n, distinct, more = _HEAD.unpack_from(data)
        if magic != _MAGIC or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a whole wavelet matrix file")
        self.data, at = data, _HEAD.size
        self.extra, at = data[at : at + more], at + more
        self.alphabet, at = np.frombuffer(data, "<u4", distinct, at), at + 4 * distinct
        self.blocks = -(-self.n // _BLOCK_BITS)
        self.ones, self.offsets, self.zeros = [], [], []
        for _ in range(self.width):
            ones, offsets = (np.frombuffer(data, "<u8", self.blocks + 1, at + i * 8 * (self.blocks + 1)) for i in (0, 1))
            at += 16 * (self.blocks + 1)
            self.ones.append(ones)
            self.offsets.append(offsets + at)
            self.zeros.append(self.n - int(ones[-1]))
            at += int(offsets[-1])
        self._codes: dict[int, int] | None = None
        self._kept: OrderedDict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = OrderedDict()
        self._inflate = zstandard.ZstdDecompressor()

    @staticmethod
    def build(ids: np.ndarray, extra: bytes = b"") -> bytes:
        """The file's bytes."""
        counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        alphabet = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
        code = np.zeros(len(counts), np.uint32)
        code[alphabet] = np.arange(len(alphabet))
        width = max(1, (len(alphabet) - 1).bit_length()) if len(alphabet) else 1
        now = code[ids].astype(np.uint16 if width <= 16 else np.uint32) if len(ids) else np.zeros(0, np.uint16)
        deflate = zstandard.ZstdCompressor(level=1)
        out = [_HEAD.pack(_MAGIC, width, len(ids), len(alphabet), len(extra)), extra, alphabet.astype("<u4").tobytes()]
        for bit in range(width - 1, -1, -1):
            one = (now & (1 << bit)) != 0
            plane = np.packbits(one)
            parts = [deflate.compress(plane[a : a + BLOCK_BYTES].tobytes()) for a in range(0, len(plane), BLOCK_BYTES)]
            before = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), BLOCK_BYTES), dtype=np.uint64) if len(plane) else np.zeros(0, np.uint64)
            out += [np.concatenate([[0], np.cumsum(before)]).astype("<u8").tobytes(), np.cumsum([0, *map(len, parts)]).astype("<u8").tobytes(), *parts]
            if bit:
                now = np.concatenate([np.compress(~one, now), np.compress(one, now)])
        body = b"".join(out)
        return body + struct.pack("<I", zlib.crc32(body))

    def _block(self, level: int, b: int, most: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """A block's bytes, and the ones before each of them within the block."""
        if (level, b) not in self._kept:
            raw = np.frombuffer(self._raw(level, b), np.uint8)
            self._kept[level, b] = raw, np.concatenate([[0], np.cumsum(np.bitwise_count(raw), dtype=np.int64)])
            if len(self._kept) > most:
                self._kept.popitem(last=False)
        return self._kept[level, b]

    def _raw(self, level: int, b: int) -> bytes:
        return self._inflate.decompress(self.data[int(self.offsets[level][b]) : int(self.offsets[level][b + 1])], BLOCK_BYTES)

    def decode(self) -> np.ndarray:
        """All ids: from the last plane up, each plane's order is undone."""
        out = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for k in range(self.width):
            level = self.width - 1 - k
            plane = np.frombuffer(b"".join(self._raw(level, b) for b in range(self.blocks)), np.uint8)
            one = np.unpackbits(plane, count=self.n).view(bool)
            below, out = out, np.empty_like(out)
            out[np.flatnonzero(~one)] = below[: self.zeros[level]]
            out[np.flatnonzero(one)] = below[self.zeros[level] :] | out.dtype.type(1 << k)
        return self.alphabet[out] if self.n else np.zeros(0, np.uint32)

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place i."""
        b, rest = divmod(i, _BLOCK_BITS)
        found = int(self.ones[level][b])
        if not rest:
            return found
        raw, before = self._block(level, b)
        byte, bit = divmod(rest, 8)
        return found + int(before[byte]) + ((int(raw[byte]) >> (8 - bit)).bit_count() if bit else 0)

    def access(self, i: int) -> int:
        return int(self.access_many(np.array([i]))[0])

    def access_many(self, places: np.ndarray) -> np.ndarray:
        """The ids at these places: at each plane their bits are read and the places move by rank. Blocks are taken one
        after another for all places in them."""
        if len(places) and not (0 <= places.min() and places.max() < self.n):
            raise IndexError("place outside the shard")
        at, code = places.astype(np.int64), np.zeros(len(places), np.int64)
        for level in range(self.width):
            block, rest = at // _BLOCK_BITS, at % _BLOCK_BITS
            order = np.argsort(block, kind="stable")
            heads = np.flatnonzero(np.diff(block[order], prepend=-1))
            bit, ones = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            for a, b in zip(heads, [*heads[1:], len(order)], strict=True):
                own = order[a:b]
                raw, before = self._block(level, int(block[own[0]]))
                byte, shift = rest[own] >> 3, rest[own] & 7
                value = raw[byte].astype(np.int64)
                bit[own] = value >> (7 - shift) & 1
                ones[own] = int(self.ones[level][int(block[own[0]])]) + before[byte] + np.bitwise_count(value >> (8 - shift))
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
            code = code << 1 | bit
        return self.alphabet[code] if len(code) else np.zeros(0, np.uint32)

    def _code(self, token: int) -> int | None:
        if self._codes is None:
            self._codes = {int(t): i for i, t in enumerate(self.alphabet)}
        return self._codes.get(token)

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        code = self._code(token)
        if code is None:
            return 0, 0
        for level in range(self.width):
            x, y = self._rank1(level, a), self._rank1(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if code >> (self.width - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often the token occurs at places from start to before stop."""
        a, b = self._range(token, start, self.n if stop is None else stop)
        return b - a

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit: a search of the directory, then of one block."""
        ones = self.ones[level]
        before = (lambda b: int(ones[b])) if bit else (lambda b: min(b * _BLOCK_BITS, self.n) - int(ones[b]))
        b = bisect_right(range(self.blocks), k, key=before) - 1
        raw, inside = self._block(level, b)
        k -= before(b)
        in_byte = (lambda i: int(inside[i])) if bit else (lambda i: 8 * i - int(inside[i]))
        byte = bisect_right(range(len(raw)), k, key=in_byte) - 1
        bits = np.flatnonzero(np.unpackbits(raw[byte : byte + 1]) == bit)
        return b * _BLOCK_BITS + 8 * byte + int(bits[k - in_byte(byte)])

    def select(self, token: int, k: int) -> int:
        """Place of the token's k-th occurrence, from 0."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i, code = a + k, self._code(token)
        for level in range(self.width - 1, -1, -1):
            bit = code >> (self.width - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]
