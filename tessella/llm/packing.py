"""Vector bin packing of token sequences.

Examples are vectors (tokens, one segment, loss-bearing tokens); a sequence is
a bin with a limit in each dimension.  A bin takes, again and again, the
waiting example whose demand has the largest dot product with what the bin has
left, both in shares of the limits.  When nothing that waits fits any more, the
best example is cut so that it fills the bin exactly.  A bin that can't be
filled, such as a partition's last, is dealt out to sequences of a power of two
tokens, which need no padding.

Each partition packs its own rows in one pass with a bounded number of waiting
examples: there is no shuffle, and a lost task is simply run again.  Sequence
ids hold the partition number, so they are unique and repeatable.

Null or empty texts are one end token; very long ones fill as many sequences as
they need; of examples with equal products the one that has waited in front is
taken; repeated rows are packed as often as they occur; an empty table gives no
rows.  Columns other than the named ones
are not read, so they can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import column, id_and_text, slices, strings
from tessella.llm.encoding import encoder

PIECES = "id long, start long, length long, doc_tokens long, loss_tokens long, sequence_id long, offset long, ids binary"
ARROW = pa.schema([(n, pa.binary() if t == "binary" else pa.int64()) for n, t in (x.split() for x in PIECES.split(", "))])

#: Examples that wait in a task at most, and sequences of one partition at most (a power of two).
WAITING, PER_PARTITION = 1024, 2**36


@dataclass(frozen=True)
class Limits:
    """Of one sequence: tokens, segments, loss-bearing tokens."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("every limit must be 1 at least")


class Example:
    """One document's ids, and how many loss-bearing tokens stand before each position."""

    __slots__ = ("doc", "ids", "losses", "n")

    def __init__(self, doc, ids: np.ndarray, losses: np.ndarray):
        self.doc, self.ids, self.losses, self.n = doc, ids, losses, len(ids)


class Packer:
    """Packs examples as they come; ``add`` and ``finish`` give finished sequences, lists of (example, start, end)."""

    def __init__(self, limits: Limits, waiting: int = WAITING):
        self.limits, self.most = limits, waiting
        self.full = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
        self.items: list[tuple[Example, int]] = []
        self.need = np.zeros((waiting + 1, 3))

    def _loss(self, e: Example, a: int, b: int) -> int:
        return int(e.losses[b] - e.losses[a])

    def _fitting(self, e: Example, start: int, tokens: int, loss: int) -> int:
        """Tokens from ``start`` that fit in what is left."""
        end = min(e.n, start + tokens)
        if self._loss(e, start, end) > loss:
            end = int(np.searchsorted(e.losses, e.losses[start] + loss, side="right")) - 1
        return max(0, end - start)

    def add(self, e: Example) -> Iterator[list]:
        start = 0
        while (n := self._fitting(e, start, self.limits.tokens, self.limits.loss)) < e.n - start:
            yield [(e, start, start + n)]  # more than one sequence holds: cut off as much as one takes
            start += n
        if start < e.n:
            self.need[len(self.items)] = (e.n - start, 1, self._loss(e, start, e.n))
            self.items.append((e, start))
        while len(self.items) > self.most:
            yield self._bin()

    def finish(self) -> Iterator[list]:
        while self.items:
            yield self._bin()

    def _drop(self, i: int) -> None:
        self.items[i] = self.items[-1]
        self.need[i] = self.need[len(self.items) - 1]
        self.items.pop()

    def _bin(self) -> list:
        left, out = self.full.copy(), []
        while self.items and left.min() >= 1:
            need = self.need[: len(self.items)]
            score = (need / self.full) @ (left / self.full)
            i = int(np.argmax(np.where((need <= left).all(axis=1), score, -1.0)))
            last = left[1] == 1 and len(self.items) > 1
            if (need[i] > left).any() or last and need[i, 0] < left[0]:
                i = int(np.argmax(score))  # nothing fits, or the last segment: cut the best one
            e, start = self.items[i]
            n = self._fitting(e, start, int(left[0]), int(left[2]))
            if not n:
                break
            taken = (n, 1, self._loss(e, start, start + n))
            out.append((e, start, start + n))
            left -= taken
            if start + n == e.n:
                self._drop(i)
            else:
                self.items[i] = (e, start + n)
                self.need[i] = (e.n - start - n, 1, self.need[i, 2] - taken[2])
        return out


def in_powers(pieces: list, most: int) -> Iterator[list]:
    """Deal out a sequence that isn't full to sequences of a power of two tokens."""
    total = sum(b - a for _, a, b in pieces)
    if total == most:
        yield pieces
        return
    rest = list(reversed(pieces))
    while total:
        room = size = 1 << (total.bit_length() - 1)
        out = []
        while room:
            e, a, b = rest.pop()
            n = min(room, b - a)
            out.append((e, a, a + n))
            if a + n < b:
                rest.append((e, a + n, b))
            room -= n
        yield out
        total -= size


def _rows(sequences: Iterator[list], base: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for number, pieces in enumerate(sequences):
        offset = 0
        for e, a, b in pieces:
            held.append((e.doc, a, b - a, e.n, int(e.losses[b] - e.losses[a]), base + number, offset, e.ids[a:b].tobytes()))
            offset += b - a
        size += offset
        if size > 250_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), ARROW)], schema=ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), ARROW)], schema=ARROW)


def _packed(examples: Iterator[Example], limits: Limits) -> Iterator[pa.RecordBatch]:
    packer = Packer(limits)

    def sequences():
        for e in examples:
            yield from packer.add(e)
        yield from packer.finish()

    yield from _rows((x for s in sequences() for x in in_powers(s, limits.tokens)), TaskContext.get().partitionId() * PER_PARTITION)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", word_bytes: int | None = None) -> DataFrame:
    """Encode whole texts, append ``end_id`` and pack.  Every token but a document's first bears loss.  ``word_bytes`` as in ``encoder``.

    Returns a row per piece: id, start and length in the document's ids,
    doc_tokens, loss_tokens, sequence_id, offset, ids (little-endian 32 bits).
    """

    def run(batches):
        end = np.array([end_id], dtype="<u4").tobytes()

        def examples():
            for part in slices(batches):
                for doc, ids in zip(column(part, "id").to_pylist(), encoder(tokenizer, word_bytes).encode(strings(part, "text"))):
                    ids = np.frombuffer(ids + end, dtype="<u4")
                    yield Example(doc, ids, np.maximum(np.arange(-1, len(ids)), 0))

        yield from _packed(examples(), limits)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, PIECES)


def pack_examples(examples: DataFrame, limits: Limits = Limits(), id_col: str = "id", ids_col: str = "ids", loss_col: str = "loss") -> DataFrame:
    """Pack token arrays with a loss mask, as of instruction data: ``ids`` array of int, ``loss`` array of boolean.

    A null array is empty, and so is packed nowhere; a mask that is null or too
    short counts as true where it is missing.
    """

    def run(batches):
        def rows():
            for batch in batches:
                for doc, ids, loss in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    mask = np.ones(len(ids), dtype=np.int64)
                    given = loss[: len(ids)]
                    mask[: len(given)] = [x is not False for x in given]
                    yield Example(doc, np.array(ids, dtype="<u4"), np.concatenate(([0], np.cumsum(mask))))

        yield from _packed(rows(), limits)

    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    return examples.select(F.col(id_col).cast("long"), empty(ids_col, "array<bigint>").cast("array<bigint>"), empty(loss_col, "array<boolean>")).mapInArrow(run, PIECES)


def packed_pieces(docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits(), word_bytes: int | None = None) -> DataFrame:
    """``pack_documents`` with a checksum in place of the ids."""
    return pack_documents(docs, tokenizer, end_id, limits, word_bytes=word_bytes).select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens"
    )


__all__ = ["Limits", "Packer", "pack_documents", "pack_examples", "packed_pieces"]
