"""Token ids in compressed wavelet-matrix files.

A shard holds whole documents in ascending id.  Its ids are split into bit
planes, the highest first; behind each plane the ids with a 0 come before those
with a 1.  With the number of ones before each block, rank and select answer
from a few bits of each plane: the token at a place, how often a token occurs,
and where.  A file is one value of frames that are compressed one by one: a
header with the documents' ids and first places, then for each plane its block
counts and its bits.  Opening it inflates the header and the counts alone; a
plane is inflated when first asked for.  Executors can't write to a
store that only Spark reaches, so files travel as rows of a Parquet table, one
row for each shard.

Documents are ordered by a range exchange on the id; a partition's shards and
the counts inside it are known to the task that writes them, and only one total
for each partition is summed up afterwards.  Null ids come first; equal ids are
ordered by their text.  Null and empty texts hold the end token alone; a very long one makes
a long shard.  An empty
table gives no shard.  Other columns aren't read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import column, id_and_text, slices, strings, written
from tessella.llm.encoding import encoder

#: Tokens of a shard, about: it ends with the document that fills it.  Bits between two rank counts.
SHARD_TOKENS, BLOCK = 250_000, 512
MAGIC = b"TWM2"

FILES = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("tokens", pa.int64()), ("file", pa.binary())])
FILE_COLUMNS = "part int, shard int, first long, tokens long, file binary"


def _blocks(plane: np.ndarray) -> np.ndarray:
    """A packed plane as a row of 64-bit words for each block, filled up with zeros."""
    return np.concatenate((plane, np.zeros(-len(plane) % (BLOCK // 8), np.uint8))).view("<u8").reshape(-1, BLOCK // 64)


def block_counts(plane: np.ndarray) -> np.ndarray:
    """The ones before each block of a packed plane, and all of them at last."""
    return np.concatenate(([0], np.cumsum(np.bitwise_count(_blocks(plane)).sum(axis=1, dtype=np.int64))))


class WaveletMatrix:
    """Bit planes of a sequence of unsigned numbers, the highest bit's first."""

    def __init__(self, n: int, planes: list[np.ndarray], ones: list[np.ndarray] | None = None):
        self.n, self.planes = n, planes  # packed, lowest bit first
        self.ones = [block_counts(p) for p in planes] if ones is None else ones

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> "WaveletMatrix":
        now = values.astype(np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for level in range(bits - 1, -1, -1):
            one = (now & np.array(1 << level, now.dtype)).astype(bool)
            planes.append(np.packbits(one, bitorder="little"))
            now = np.concatenate((now.take(np.flatnonzero(~one)), now.take(np.flatnonzero(one))))  # much faster than masks
        return cls(len(values), planes)

    def values(self) -> np.ndarray:
        """The whole sequence, from the last plane up."""
        bits = len(self.planes)
        kind = np.uint16 if bits <= 16 else np.uint32
        now = np.zeros(self.n, dtype=kind)
        for level, plane in enumerate(reversed(self.planes)):
            one = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            zeros, ones = np.flatnonzero(~one), np.flatnonzero(one)
            before = np.empty_like(now)
            before[zeros] = now[: len(zeros)]
            before[ones] = now[len(zeros) :] | np.array(1 << level, kind)
            now = before
        return now

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        block, plane = i // BLOCK, self.planes[level]
        raw = int.from_bytes(plane[block * BLOCK // 8 : -(-i // 8)].tobytes(), "little")
        return int(self.ones[level][block]) + (raw & ((1 << (i - block * BLOCK)) - 1)).bit_count()

    def access(self, i: int) -> int:
        out = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[i >> 3]) >> (i & 7) & 1
            ones = self._rank1(level, i)
            i = self.n - self._rank1(level, self.n) + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def access_all(self, places: np.ndarray) -> np.ndarray:
        """The tokens at many places, plane by plane for 4,096 of them at once."""
        if len(places) > 4096:
            return np.concatenate([self.access_all(places[i : i + 4096]) for i in range(0, len(places), 4096)])
        at, out = places.astype(np.int64), np.zeros(len(places), dtype=np.int64)
        words = np.arange(BLOCK // 64)
        for plane, ones in zip(self.planes, self.ones):
            block, word, bit = at // BLOCK, at % BLOCK // 64, (at % 64).astype(np.uint64)
            row = _blocks(plane)[block]
            own = row[np.arange(len(at)), word]
            # the block's whole words before the place's own, and of that one the bits below
            seen = (np.bitwise_count(row) * (words < word[:, None])).sum(axis=1, dtype=np.int64)
            rank = ones[block] + seen + np.bitwise_count(own & ((np.uint64(1) << bit) - np.uint64(1)))
            one = (own >> bit & np.uint64(1)).astype(np.int64)
            at = np.where(one == 1, self.n - int(ones[-1]) + rank, at - rank)
            out = out << 1 | one
        return out

    def _range(self, value: int, begin: int, end: int) -> tuple[int, int]:
        """Where the value's occurrences within [begin, end) stand behind the last plane."""
        for level in range(len(self.planes)):
            a, b = self._rank1(level, begin), self._rank1(level, end)
            if value >> (len(self.planes) - 1 - level) & 1:
                zeros = self.n - self._rank1(level, self.n)
                begin, end = zeros + a, zeros + b
            else:
                begin, end = begin - a, end - b
        return begin, end

    def count(self, value: int, begin: int = 0, end: int | None = None) -> int:
        if not 0 <= value < 1 << len(self.planes):
            return 0
        a, b = self._range(value, begin, self.n if end is None else end)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of a plane's k-th bit of a kind, from 0."""
        ones = self.ones[level]
        counts = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(counts, k, side="right")) - 1
        raw = self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8]
        found = np.flatnonzero(np.unpackbits(raw, bitorder="little") == bit)
        return block * BLOCK + int(found[k - int(counts[block])])

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence of a value, from 0."""
        begin, end = self._range(value, 0, self.n) if 0 <= value < 1 << len(self.planes) else (0, 0)
        if not 0 <= k < end - begin:
            raise IndexError("no such occurrence")
        at = begin + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - level) & 1
            zeros = self.n - self._rank1(level, self.n)
            at = self._select(level, bit, at - zeros if bit else at)
        return at


class _Planes:
    """A file's planes, each inflated when first asked for."""

    def __init__(self, frames: list[bytes]):
        self.frames: list = list(frames)

    def __len__(self) -> int:
        return len(self.frames)

    def __getitem__(self, level: int) -> np.ndarray:
        if isinstance(self.frames[level], bytes):
            self.frames[level] = np.frombuffer(zstandard.decompress(self.frames[level]), np.uint8)
        return self.frames[level]

    def __iter__(self):
        return (self[level] for level in range(len(self)))

    def __reversed__(self):
        return (self[level] for level in range(len(self) - 1, -1, -1))


def to_file(values: np.ndarray, bits: int, docs: list, starts: np.ndarray) -> bytes:
    w = WaveletMatrix.build(values, bits)
    known = np.array([d is not None for d in docs], dtype=np.uint8)
    ids = np.array([d or 0 for d in docs], dtype="<i8")
    head = [np.array([len(values), bits, len(docs)], dtype="<i8"), ids, known, starts.astype("<i8"), *(x.astype("<i8") for x in w.ones)]
    pack = zstandard.ZstdCompressor(level=1).compress
    frames = [pack(b"".join(x.tobytes() for x in head)), *(pack(p.tobytes()) for p in w.planes)]
    return MAGIC + np.array([len(frames), *map(len, frames)], dtype="<i8").tobytes() + b"".join(frames)


class File:
    """An opened shard: ``docs``, ``starts`` and the ``matrix``."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        parts = int(np.frombuffer(raw, "<i8", 1, 4)[0])
        ends = 12 + 8 * parts + np.cumsum(np.frombuffer(raw, "<i8", parts, 12))
        frames = [raw[a:b] for a, b in zip([12 + 8 * parts, *ends[:-1].tolist()], ends.tolist())]
        head = zstandard.decompress(frames[0])
        n, bits, docs = np.frombuffer(head, dtype="<i8", count=3).tolist()
        at = 24
        ids = np.frombuffer(head, "<i8", docs, at).tolist()
        known = np.frombuffer(head, np.uint8, docs, at + 8 * docs).tolist()
        self.docs = [i if k else None for i, k in zip(ids, known)]
        self.starts = np.frombuffer(head, "<i8", docs, at + 9 * docs)
        ones = np.frombuffer(head, "<i8", -1, at + 17 * docs).reshape(bits, -1)
        self.matrix = WaveletMatrix(n, _Planes(frames[1:]), list(ones))


def write_files(docs: DataFrame, tokenizer: str, end_id: int, bits: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, append ``end_id``, and write shards; gives the written table, one row for each file.

    Every id has to be under 2 to the power of ``bits``.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        shard = first = size = 0
        held: list[np.ndarray] = []
        ids: list = []
        end = np.array([end_id], dtype="<u4").tobytes()

        def file():
            nonlocal shard, first, size
            values = np.concatenate(held)
            if values.max() >> bits:
                raise ValueError(f"an id needs more than {bits} bits")
            sizes = np.array([len(x) for x in held])
            raw = to_file(values, bits, ids, np.cumsum(sizes) - sizes)
            row = [part, shard, first, len(values), raw]
            shard, first, size = shard + 1, first + len(values), 0
            held.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, FILES)], schema=FILES)

        for some in slices(batches):
            for doc, raw in zip(column(some, "id").to_pylist(), encoder(tokenizer).encode(strings(some, "text"))):
                held.append(np.frombuffer(raw + end, dtype="<u4"))
                ids.append(doc)
                size += len(held[-1])
                if size >= SHARD_TOKENS:
                    yield file()
        if held:
            yield file()

    ordered = id_and_text(docs, id_col, text_col).repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    return written(ordered.mapInArrow(run, FILE_COLUMNS), "wavelet")


def read_files(files: DataFrame) -> DataFrame:
    """A row for each document of written files: id, start, n_tokens, ids_crc32 (of little-endian 32-bit ids), last_id.

    All ids are read plane by plane; the last one comes by rank, so it checks the block counts too.
    """
    schema = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("last_id", pa.int64())])

    def run(batches):
        for batch in batches:
            for part, first, raw in zip(*(column(batch, c).to_pylist() for c in ("part", "first", "file"))):
                f = File(raw)
                values = memoryview(f.matrix.values().astype("<u4")).cast("B")
                ends = np.append(f.starts[1:], f.matrix.n)
                crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(f.starts.tolist(), ends.tolist())]
                rows = ([part] * len(crc), f.docs, (f.starts + first).tolist(), (ends - f.starts).tolist(), crc, f.matrix.access_all(ends - 1).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(rows, schema)], schema=schema)

    rows = files.select("part", "first", "file").mapInArrow(run, "part int, id long, first long, n_tokens long, ids_crc32 long, last_id long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition of the exchange
    parts = files.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(parts), "part").select("id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "last_id")


def count_tokens(files: DataFrame, tokens: list[int]) -> DataFrame:
    """How often each token occurs, by rank: columns token, n."""

    def run(batches):
        for batch in batches:
            for raw in column(batch, "file").to_pylist():
                m = File(raw).matrix
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([m.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return files.select("file").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_token(files: DataFrame, token: int) -> DataFrame:
    """Every occurrence of a token, by select: columns id, place (in the document)."""

    def run(batches):
        for batch in batches:
            for raw in column(batch, "file").to_pylist():
                f = File(raw)
                at = np.array([f.matrix.select(token, k) for k in range(f.matrix.count(token))], dtype=np.int64)
                doc = np.searchsorted(f.starts, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array([f.docs[d] for d in doc], pa.int64()), pa.array(at - f.starts[doc])], names=["id", "place"])

    return files.select("file").mapInArrow(run, "id long, place long")


def tokens_read_back(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write and read again: doc_id, start, n_tokens, ids_crc32, last_id (the end token's)."""
    return read_files(write_files(docs, tokenizer, end_id)).withColumnRenamed("id", "doc_id")
