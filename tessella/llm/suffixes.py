"""Sampled suffixes, front-coded sorted runs, and their merge by loser trees.  Used by ``suffix_dedup``."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard

#: Bytes of a repeated string; of the prefix that samples suffixes; positions among which one is sampled.
LENGTH, PREFIX = 50, 24
REACH = LENGTH - PREFIX + 1
LEFT = REACH - 1


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """The least or largest of each ``width`` neighbours, by doubling."""
    n = 1
    while 2 * n <= width:
        x = pick(x[:-n], x[n:])
        n *= 2
    rest = width - n
    return pick(x[:-rest], x[rest:]) if rest else x


def sampled(buffer: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 56-bit prefix hashes of the sampled suffixes of documents laid end to end.

    In each string of LENGTH bytes that crosses no document, the prefixes of
    least hash are sampled; so equal strings sample suffixes at equal places.
    """
    a = np.frombuffer(buffer, dtype=np.uint8)
    if len(a) < LENGTH:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    u = np.lib.stride_tricks.sliding_window_view(a, 8).copy().view("<u8").ravel()
    n = len(a) - PREFIX + 1
    h = np.zeros(n, dtype=np.uint64)
    for at in range(0, PREFIX, 8):
        h = (h ^ u[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    short = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _slide(short, REACH, np.minimum)
    crossing = np.zeros(len(a) + 1, dtype=np.int32)
    ends = starts[1:]
    np.add.at(crossing, np.maximum(0, ends - LENGTH + 1), 1)
    np.add.at(crossing, ends, -1)
    least[np.cumsum(crossing)[: len(least)] > 0] = 0
    pad = np.zeros(REACH - 1, dtype=np.uint32)
    at = np.flatnonzero(short == _slide(np.concatenate((pad, least, pad)), REACH, np.maximum)[:n])
    h = h[at]  # the least of many: mixed again, so that shares by the highest bits are alike
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return at, (h ^ (h >> np.uint64(32))) >> np.uint64(8)


@dataclass
class Suffixes:
    """Sampled suffixes with what stands left of them.

    right: LENGTH bytes from each; left: LEFT bytes before it, nearest first;
    low, high: how far left the strings may begin that lie inside the document;
    order: the document's place among all; doc: its number here; at: the position in it.
    """

    right: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray
    order: np.ndarray
    doc: np.ndarray
    at: np.ndarray

    def take(self, i) -> "Suffixes":
        return Suffixes(*(x[i] for x in vars(self).values()))

    def __len__(self) -> int:
        return len(self.at)


def cut_out(buffer: bytes, starts: np.ndarray, orders: np.ndarray, at: np.ndarray) -> Suffixes:
    """The suffixes at ``at`` of documents laid end to end; bytes outside their document are zero and never compared alone."""
    ends = np.append(starts[1:], len(buffer))
    doc = np.searchsorted(ends, at, side="right")  # an empty document holds no position
    padded = np.frombuffer(b"\0" * LEFT + buffer + b"\0" * LENGTH, dtype=np.uint8)
    around = np.lib.stride_tricks.sliding_window_view(padded, LEFT + LENGTH)[at]
    right, left = around[:, LEFT:].copy(), around[:, :LEFT][:, ::-1].copy()
    room, before = ends[doc] - at, at - starts[doc]
    right[np.arange(LENGTH)[None, :] >= room[:, None]] = 0
    left[np.arange(LEFT)[None, :] >= before[:, None]] = 0
    low, high = np.maximum(0, LENGTH - room), np.minimum(LEFT, before)
    return Suffixes(right, left, low.astype(np.uint8), high.astype(np.uint8), orders[doc], doc.astype(np.int32), before.astype(np.int32))


def _words(b: np.ndarray) -> list[np.ndarray]:
    """A byte matrix's rows as big-endian 64-bit columns, for sorting."""
    wide = np.zeros((len(b), -(-b.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : b.shape[1]] = b
    return list(wide.view(">u8").astype(np.uint64).T)


def _common(b: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before; 0 for the first."""
    out = np.zeros(len(b), dtype=np.int16)
    if len(b) > 1:
        differ = b[1:] != b[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), b.shape[1])
    return out


def settle_copies(s: Suffixes) -> tuple[Suffixes, Suffixes]:
    """Of suffixes with the same surroundings keep those of the first document; the others are settled: every string around them is a repeat."""
    if not len(s):
        return s, s
    kind = np.concatenate((s.right, s.left, s.low[:, None], s.high[:, None]), axis=1)
    by = np.lexsort([s.order, *_words(kind)[::-1]])
    s, kind = s.take(by), kind[by]
    new = np.concatenate(([True], (kind[1:] != kind[:-1]).any(axis=1)))
    first = s.order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return s.take(s.order == first), s.take(s.order > first)


def pack_run(s: Suffixes) -> bytes:
    """A sorted run, front-coded: of each right side only what differs from the one before."""
    s = s.take(np.lexsort(_words(s.right)[::-1]))
    shared = _common(s.right)
    rest = s.right[np.arange(LENGTH)[None, :] >= shared[:, None]]
    docs, doc = np.unique(s.doc, return_inverse=True)
    orders = s.order[np.unique(doc, return_index=True)[1]]
    parts = [
        np.array([len(s), len(rest), len(docs)], dtype=np.int64), shared.astype(np.uint8), rest, s.left.ravel(), s.low, s.high,
        s.at.astype(np.int32), doc.astype(np.int32), docs.astype(np.int32), orders.astype(np.int64),
    ]
    return zstandard.compress(b"".join(x.tobytes() for x in parts), 1)


def open_run(block: bytes) -> tuple[np.ndarray, bytes, Suffixes]:
    """A run's shared lengths, rest bytes, and suffixes whose right sides are left out."""
    raw, at = zstandard.decompress(block), 24
    n, rest, docs = np.frombuffer(raw, dtype=np.int64, count=3).tolist()

    def part(kind, count):
        nonlocal at
        out = np.frombuffer(raw, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    shared, tail = part(np.uint8, n), part(np.uint8, rest).tobytes()
    left, low, high = part(np.uint8, n * LEFT).reshape(n, LEFT), part(np.uint8, n), part(np.uint8, n)
    pos, doc, names, orders = part(np.int32, n), part(np.int32, n), part(np.int32, docs), part(np.int64, docs)
    return shared, tail, Suffixes(np.zeros((n, 0), dtype=np.uint8), left, low, high, orders[doc], names[doc], pos)


def unfold(shared: np.ndarray, tail: bytes) -> list[bytes]:
    """The keys of a front-coded run."""
    out, key, at = [], b"", 0
    for n in shared.tolist():
        end = at + LENGTH - n
        key = key[:n] + tail[at:end]
        out.append(key)
        at = end
    return out


def merge(runs: list[tuple[list[int], list[bytes]]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs of (shared lengths, keys): the run of each output, and what it shares with the output before.

    A loser keeps how many bytes it shares with the key that beat it.  Of two
    contenders the one that shares more with the last output is smaller; only
    if they share as much are their bytes looked at, from there on.
    """
    runs = runs or [([], [])]
    size = 1
    while size < len(runs):
        size *= 2
    at = [0] * size
    ends = [len(k) for _, k in runs] + [0] * (size - len(runs))
    head = [runs[r][1][0] if r < len(runs) and ends[r] else b"" for r in range(size)]
    known = [0 if ends[r] else -1 for r in range(size)]  # -1: the run is at its end
    losers = [0] * size

    def beats(a: int, b: int) -> bool:
        """Whether head a comes first, at equal known lengths; notes what the loser shares with the winner."""
        n = known[a]
        if n < 0:
            return True
        x, y = head[a][n:], head[b][n:]
        if x == y:
            known[max(a, b)] = LENGTH
            return a < b
        same = len(x) - (((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) >> 3)
        if x < y:
            known[b] = n + same
            return True
        known[a] = n + same
        return False

    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        nxt = []
        for i in range(level):
            a, b = winners[2 * i], winners[2 * i + 1]
            if known[a] > known[b] or known[a] == known[b] and beats(a, b):
                nxt.append(a)
                losers[level + i] = b
            else:
                nxt.append(b)
                losers[level + i] = a
        winners = nxt
    best = winners[0]
    out_run, out_shared = [], []
    while known[best] >= 0:
        out_run.append(best)
        out_shared.append(known[best])
        k = at[best] = at[best] + 1
        if k < ends[best]:
            shared, keys = runs[best]
            head[best], known[best] = keys[k], shared[k]
        else:
            known[best] = -1
        node, now = (size + best) >> 1, best
        while node:
            other = losers[node]
            if known[other] > known[now] or known[other] == known[now] and not beats(now, other):
                losers[node], now = now, other
            node >>= 1
        best = now
    return out_run, out_shared


def repeats(s: Suffixes, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in merged order: how far left the first and the last repeated string begins; -1 if there is none.

    A string that begins j bytes left of a suffix is known by its j left bytes
    and its LENGTH - j right ones.  Suffixes fall into classes by both; the
    first document of a class owns the string, and for later ones it is a
    repeat.  All strings around one suffix hold its prefix, so they join up.
    """
    n = len(s)
    least, most = np.full(n, LEFT + 1, dtype=np.int16), np.full(n, -1, dtype=np.int16)
    by = np.lexsort(_words(s.left)[::-1])
    near = _common(s.left[by])
    for j in range(LEFT + 1):
        some = np.flatnonzero((s.low <= j) & (j <= s.high))
        if len(some) < 2:
            continue
        of_left = np.empty(n, dtype=np.int64)
        of_left[by] = np.cumsum(near < j)
        kind = (np.cumsum(shared < LENGTH - j) * (n + 1) + of_left)[some]
        sort = np.argsort(kind, kind="stable")
        kind, i = kind[sort], some[sort]
        new = np.concatenate(([True], kind[1:] != kind[:-1]))
        first = np.minimum.reduceat(s.order[i], np.flatnonzero(new))[np.cumsum(new) - 1]
        again = i[s.order[i] > first]
        least[again] = np.minimum(least[again], j)
        most[again] = j
    return least, most
