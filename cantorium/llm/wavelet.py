"""Token ids as wavelet matrices: succinct bit planes that answer access, rank, select and count.

A shard is one compressed file, here the binary payload of one row of a Parquet table, so that Spark's commit protocol
covers it on any store: a header; the places of its frames; a frame with the doc_ids and lengths of its documents and the
shard's own ids in ascending order; and a frame for each block of at most BLOCK symbols, the ids' places in that order.
Frames are compressed one by one, so a question about a token opens the blocks that it needs and no other.

A block holds a plane of bits for each bit of a symbol, highest first; each plane orders the ids as the plane before sorts
them by its bit, stably. With each plane goes its rank directory, the ones before each superblock of 512 bits.

Documents go to shards in ascending order of doc_id, then of their texts' hash (a range partitioning by both, so that no id
is one task's alone, sorted within partitions), null ids first.
Defined results: a null or empty text is the end id alone; repeated rows are stored each on its own, equal ids in
order of their texts' hash; an empty table gives no shards; further columns of any name are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantorium.llm.tokens import END, encoder
from cantorium.session import materialize

MAGIC = b"CWMX0002"
BLOCK = 1 << 17
SHARD_TOKENS = 1 << 21
_SUPER = 512
#: Magic, documents, those without an id (they come first), symbols, tokens.
_HEAD = struct.Struct("<8sIIIQ")


class WaveletMatrix:
    """A sequence of ids below 2**bits over packed bit planes."""

    def __init__(self, n: int, bits: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray] | None = None):
        self.n, self.bits, self.planes, self.zeros = n, bits, planes, zeros
        self.ranks = ranks if ranks is not None else [self._directory(p) for p in planes]

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each superblock of a plane."""
        padded = np.zeros(-(-max(len(plane), 1) // (_SUPER // 8)) * (_SUPER // 8), np.uint8)
        padded[: len(plane)] = plane
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, _SUPER // 64).sum(1, dtype=np.uint32)
        return np.concatenate([[0], np.cumsum(ones)]).astype("<u4")

    @classmethod
    def load(cls, n: int, bits: int, body: bytes) -> WaveletMatrix:
        """From what dump() gave."""
        size, supers = -(-n // 8), -(-max(-(-n // 8), 1) // (_SUPER // 8)) + 1
        zeros, at = np.frombuffer(body, "<u4", bits).tolist(), 4 * bits
        planes, ranks = [], []
        for _ in range(bits):
            planes.append(np.frombuffer(body, np.uint8, size, at))
            ranks.append(np.frombuffer(body, "<u4", supers, at + size))
            at += size + 4 * supers
        return cls(n, bits, planes, zeros, ranks)

    def dump(self) -> bytes:
        parts = [np.array(self.zeros, "<u4").tobytes()]
        for plane, ranks in zip(self.planes, self.ranks):
            parts += [plane.tobytes(), ranks.tobytes()]
        return b"".join(parts)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        now = np.ascontiguousarray(ids, np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for bit in range(bits - 1, -1, -1):
            ones = (now & now.dtype.type(1 << bit)) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            at_one = np.flatnonzero(ones)
            at_zero = np.flatnonzero(np.logical_not(ones, out=ones))
            zeros.append(len(at_zero))
            nxt = np.empty_like(now)
            now.take(at_zero, out=nxt[: len(at_zero)], mode="clip")
            now.take(at_one, out=nxt[len(at_zero) :], mode="clip")
            now = nxt
        return cls(len(ids), bits, planes, zeros)

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        block, rest = divmod(i, _SUPER)
        at = block * (_SUPER // 8)
        got = int(self.ranks[level][block])
        whole, part = divmod(rest, 8)
        got += int(np.bitwise_count(self.planes[level][at : at + whole]).sum())
        if part:
            got += (int(self.planes[level][at + whole]) & ((1 << part) - 1)).bit_count()
        return got

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        got = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            got = got << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return got

    def _interval(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before position i."""
        if token >> self.bits:
            return 0
        lo, hi = self._interval(token, 0, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence, from 0."""
        lo, hi = (0, 0) if token >> self.bits else self._interval(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            want = at - self.zeros[level] if one else at
            left, right = 0, self.n
            while left < right:  # the first position with more than `want` such bits up to and with it
                mid = (left + right) // 2
                ones = self._rank1(level, mid + 1)
                if (ones if one else mid + 1 - ones) > want:
                    right = mid
                else:
                    left = mid + 1
            at = left
        return at

    def locate(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids at once, by undoing the sorts from the last plane to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            zeros, was = self.zeros[level], np.empty(self.n, kind)
            was[np.flatnonzero(ones)] = now[zeros:] | kind(1 << (self.bits - 1 - level))
            was[np.flatnonzero(np.logical_not(ones, out=ones))] = now[:zeros]
            now = was
        return now


class Shard:
    """The file of one shard, opened from its bytes; blocks are decompressed when they are asked for."""

    def __init__(self, payload: bytes):
        magic, docs, unnamed, symbols, self.n = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        frames = -(-self.n // BLOCK) + 1
        self._ends = np.frombuffer(payload, "<u8", frames + 1, _HEAD.size).tolist()
        self._payload, self._opened, self.bits = payload, {}, _bits(symbols)
        body = self._frame(0)
        self.unnamed = unnamed  # so many documents, the first ones, have no id; 0 stands for it
        self.doc_ids = np.frombuffer(body, "<i8", docs)
        self.lengths = np.frombuffer(body, "<i8", docs, 8 * docs)
        self.symbols = np.frombuffer(body, "<u4", symbols, 16 * docs)

    def _frame(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._payload[self._ends[k] : self._ends[k + 1]])

    def block(self, k: int) -> WaveletMatrix:
        if k not in self._opened:
            self._opened[k] = WaveletMatrix.load(min(BLOCK, self.n - k * BLOCK), self.bits, self._frame(k + 1))
        return self._opened[k]

    @property
    def blocks(self) -> range:
        return range(-(-self.n // BLOCK))

    @staticmethod
    def dump(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
        """Documents without an id come first."""
        present = np.zeros(int(ids.max(initial=0)) + 1, bool)
        present[ids] = True
        symbols = np.flatnonzero(present)
        place = np.cumsum(present) - 1
        codes, bits = place.astype(np.uint16 if len(symbols) <= 1 << 16 else np.uint32)[ids], _bits(len(symbols))
        named = np.array([d or 0 for d in doc_ids], "<i8")
        parts = [named.tobytes() + np.array(lengths, "<i8").tobytes() + symbols.astype("<u4").tobytes()]
        parts += [WaveletMatrix.build(codes[first : first + BLOCK], bits).dump() for first in range(0, len(ids), BLOCK)]
        frames = [zstandard.ZstdCompressor(1).compress(p) for p in parts]
        ends = _HEAD.size + 8 * (len(frames) + 1) + np.concatenate([[0], np.cumsum([len(f) for f in frames])])
        head = _HEAD.pack(MAGIC, len(doc_ids), sum(d is None for d in doc_ids), len(symbols), len(ids))
        return b"".join([head, ends.astype("<u8").tobytes(), *frames])

    def _symbol(self, token: int) -> int | None:
        at = int(np.searchsorted(self.symbols, token))
        return at if at < len(self.symbols) and self.symbols[at] == token else None

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.symbols[self.block(i // BLOCK).access(i % BLOCK)])

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before position i."""
        symbol, whole = self._symbol(token), min(i, self.n) // BLOCK
        if symbol is None:
            return 0
        rest = min(i, self.n) - whole * BLOCK
        return sum(self.block(k).count(symbol) for k in range(whole)) + (self.block(whole).rank(symbol, rest) if rest else 0)

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence, from 0."""
        symbol, left = self._symbol(token), k
        if symbol is None or k < 0:
            raise IndexError(k)
        for at in self.blocks:
            here = self.block(at).count(symbol)
            if left < here:
                return at * BLOCK + self.block(at).select(symbol, left)
            left -= here
        raise IndexError(k)

    def locate(self, token: int) -> list[int]:
        symbol = self._symbol(token)
        return [] if symbol is None else [k * BLOCK + at for k in self.blocks for at in self.block(k).locate(symbol)]

    def decode(self) -> np.ndarray:
        """All ids, as little-endian unsigned 32-bit numbers."""
        return self.symbols[np.concatenate([self.block(k).decode() for k in self.blocks])] if self.n else np.zeros(0, "<u4")


def _bits(symbols: int) -> int:
    return max(1, (symbols - 1).bit_length())


_SHARDS = "part long, shard long, part_start long, n_docs long, n_tokens long, payload binary"


def write_shards(docs: DataFrame, shard_tokens: int = SHARD_TOKENS, tokenizer: str | None = None) -> DataFrame:
    """Tokenise all documents and write them as shards; returns the table of shards, read back lazily.

    A shard ends with the document that takes it to shard_tokens ids, so its size is bounded by that and one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        part, shard = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        start = n = 0

        def flush() -> pa.RecordBatch:
            row = {"part": part, "shard": shard, "part_start": start, "n_docs": len(doc_ids), "n_tokens": n}
            columns = {k: pa.array([v], pa.int64()) for k, v in row.items()}
            return pa.RecordBatch.from_pydict(columns | {"payload": pa.array([Shard.dump(doc_ids, lengths, np.concatenate(held))], pa.binary())})

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids = np.frombuffer(encode(text.as_py()) + END, "<u4")
                doc_ids.append(doc)
                lengths.append(len(ids))
                held.append(ids)
                n += len(ids)
                if n >= shard_tokens:
                    yield flush()
                    doc_ids, lengths, held, start, n, shard = [], [], [], start + n, 0, shard + 1
        if doc_ids:
            yield flush()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    place = F.xxhash64("text")
    ordered = own.repartitionByRange("doc_id", place).sortWithinPartitions("doc_id", place)
    return materialize(ordered.mapInArrow(run, _SHARDS), "wavelet-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """Decode shards: doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit) of every document.

    A shard knows the ids before it in its part, the range of doc_ids that one task wrote. The parts' totals, as many
    as there are shuffle partitions, are summed on the driver and sent along.
    """
    before, total = {}, 0
    for part, n in sorted(shards.groupBy("part").agg(F.sum("n_tokens")).collect()):
        before[part] = total
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, payload in zip(*(batch.column(i) for i in range(3))):
                shard = Shard(payload.as_py())
                raw = shard.decode().tobytes()
                ends = np.cumsum(shard.lengths)
                at = before[part.as_py()] + start.as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64(), mask=np.arange(len(shard.doc_ids)) < shard.unnamed),
                        pa.array(at + ends - shard.lengths, pa.int64()),
                        pa.array([raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), shard.lengths.tolist())], pa.binary()),
                    ],
                    ["doc_id", "start", "ids"],
                )

    return shards.select("part", "part_start", "payload").mapInArrow(run, "doc_id long, start long, ids binary")
