"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece the last token of its encoding is stored.  A token
may end a prefix only if the two tokens that meet at its start are what merging
would leave side by side, and exactly one token does; so the table is filled
from left to right, at each place backwards along a trie of the reversed
vocabulary, and the encoding is read off from the end.  An append goes on where
the table ends; new pieces are encoded in order, each as an append to what it
shares with the one before.  An edit fills the table anew from the edit to where
it rejoins the old one: once as many places in a row agree as the longest token
has bytes, the rest agrees too.

A text is split by the pre-token pattern, each match is encoded separately and
looked up in a bounded worker cache.  Letters and numbers are what the tiktoken
library takes for them: characters of a later Unicode than its own, which the
regex library knows, count as neither.  Null and empty texts have no tokens.
Very long texts and pieces are encoded whole.  Repeated rows are encoded as
often as they occur; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Cache, column, id_and_text, kept, slices, strings
from tessella.llm.encoding import SIMPLE, as_re

#: Bytes of a worker's cache of pre-tokens; entries of that of joints of two tokens, which is emptied when full.
WORD_BYTES, MOST_JOINTS = 256_000_000, 500_000


class PrefixBPE:
    """An encoder from merge ranks: bytes of a token to its id, lower merged first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._grow_trie()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._joints: dict[int, bool] = {}

    def _grow_trie(self) -> None:
        """Of reversed tokens.  ``steps``: the node behind a node and a byte; ``ends``: the token that a node completes."""
        self.steps: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for raw, token in self.ranks.items():
            node = 0
            for byte in reversed(raw):
                at = node << 8 | byte
                if at not in self.steps:
                    self.steps[at] = len(self.ends)
                    self.ends.append(-1)
                node = self.steps[at]
            self.ends[node] = token

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; itself twice for a single byte; None if merging never makes it."""
        if token not in self._halves:
            raw = self.bytes_of[token]
            if len(raw) == 1:
                self._halves[token] = (token, token)
            else:
                parts = self._merged(raw, token)
                self._halves[token] = tuple(parts) if len(parts) == 2 else None
        return self._halves[token]

    def _merged(self, raw: bytes, below: int) -> list[int]:
        """Plain merging with the tokens under a rank; only for the vocabulary's own entries."""
        ranks, parts = self.ranks, [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, i = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves these two side by side, and makes the second at all.

        Undo the merges of both, the later one first: at no time may the pair
        at the joint merge before the undone merge would have happened.
        """
        if len(self._joints) >= MOST_JOINTS:
            self._joints.clear()
        known = self._joints[left << 32 | right] = self.halves(right) is not None and (left < 0 or self._fits(left, right))
        return known

    def _fits(self, left: int, right: int) -> bool:
        ranks, text = self.ranks, self.bytes_of
        bound, strict = None, False  # a joint's merge must not come before this one
        while True:
            made = ranks.get(text[left] + text[right])
            if made is not None and (bound is None or made < bound or made == bound and strict):
                return False
            # of two equal ranks the left one merged first, so the right one is undone first
            can_left, can_right = len(text[left]) > 1, len(text[right]) > 1
            if not can_left and not can_right:
                return True
            if can_right and (not can_left or right >= left):
                bound, strict = right, True
                right = self.halves(right)[0]
            else:
                bound, strict = left, False
                left = self.halves(left)[1]

    def _fill(self, raw: bytes, places: range, last: list[int], start: list[int]):
        """Append the entries of places that follow the table; yields each place behind its entry."""
        steps, ends, joints = self.steps.get, self.ends, self._joints.get
        for place in places:
            node, begin = 0, place
            while begin:
                begin -= 1
                if (node := steps(node << 8 | raw[begin])) is None:
                    break
                if (token := ends[node]) >= 0:
                    if (known := joints(last[begin] << 32 | token)) is None:
                        known = self.fits(last[begin], token)
                    if known:
                        last.append(token)
                        start.append(begin)
                        break
            if len(last) == place:
                raise ValueError("the vocabulary lacks single bytes")
            yield place

    def extend(self, raw: bytes, last: list[int], start: list[int]) -> None:
        """Fill the table on to the end of ``raw``: ``last[e]`` is the token that ends the prefix of e bytes, from ``start[e]``."""
        for _ in self._fill(raw, range(len(last), len(raw) + 1), last, start):
            pass

    def table(self, raw: bytes) -> tuple[list[int], list[int]]:
        last, start = [-1], [0]
        self.extend(raw, last, start)
        return last, start

    @staticmethod
    def read(last: list[int], start: list[int]) -> list[int]:
        out, at = [], len(last) - 1
        while at:
            out.append(last[at])
            at = start[at]
        return out[::-1]

    def encode_piece(self, raw: bytes) -> list[int]:
        """One pre-token; a piece that is a token as a whole is that token."""
        found = self.ranks.get(raw)
        return [found] if found is not None else self.read(*self.table(raw))

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, list[int]]:
        """Several pieces, each appended to the table of what it shares with the one before in order."""
        out: dict[bytes, list[int]] = {}
        last, start, before = [-1], [0], b""
        for raw in sorted(pieces):
            if (found := self.ranks.get(raw)) is not None:
                out[raw] = [found]
                continue
            same = 0
            for x, y in zip(raw, before):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], start[same + 1 :]
            self.extend(raw, last, start)
            out[raw], before = self.read(last, start), raw
        return out

    def append(self, raw: bytes, last: list[int], start: list[int], more: bytes) -> bytes:
        """Grow an encoded piece's table for appended bytes, in place; gives the whole piece."""
        raw += more
        self.extend(raw, last, start)
        return raw

    def edited(self, raw: bytes, last: list[int], start: list[int], at: int, removed: int, put: bytes) -> tuple[bytes, int]:
        """Replace ``removed`` bytes of an encoded piece from byte ``at`` by ``put`` and mend its table, in place.

        Gives the edited piece and how many entries were filled anew.
        """
        more, old_last, old_start = len(put) - removed, last[at + 1 :], start[at + 1 :]
        raw = raw[:at] + put + raw[at + removed :]
        del last[at + 1 :], start[at + 1 :]
        same = 0
        for place in self._fill(raw, range(at + 1, len(raw) + 1), last, start):
            if place > at + len(put):
                k = place - more - at - 1
                same = same + 1 if last[place] == old_last[k] else 0
                if same > self.longest:
                    last += old_last[k + 1 :]
                    start += [x + more for x in old_start[k + 1 :]]
                    return raw, place - at
        return raw, len(raw) - at

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Texts:
    """Whole texts through a worker's cache of pre-tokens."""

    def __init__(self, path: str, pattern: str):
        self.bpe, self.pattern, self.known = PrefixBPE(ranks_of(path)), regex.compile(pattern), Cache(WORD_BYTES)
        self.simple, self._later = as_re(pattern), None
        self.digits = {i: str(i) for i in self.bpe.bytes_of}

    def later(self) -> regex.Pattern:
        """Characters that regex takes for letters or numbers and the library doesn't, as their Unicode is later."""
        if self._later is None:
            import tiktoken

            every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
            ours = "".join(regex.findall(r"[\p{L}\p{N}]+", every))
            library = tiktoken.Encoding("classes", pat_str=r"[\p{L}\p{N}]+", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            theirs = set(b"".join(library.decode_bytes(library.encode_ordinary(ours[k : k + 20_000])) for k in range(0, len(ours), 20_000)).decode())
            self._later = regex.compile("[" + "".join(c for c in ours if c not in theirs) + "]")
        return self._later

    def split(self, text: str) -> list[str]:
        if SIMPLE.fullmatch(text):
            return self.simple.findall(text)
        if self.later().search(text):  # a sign that is neither stands in for each, so that places stay
            return [text[m.start() : m.end()] for m in self.pattern.finditer(self.later().sub("\x01", text))]
        return self.pattern.findall(text)

    def words(self, texts: list[str]) -> list[list[tuple]]:
        """Of each text's pre-tokens: the decimals of their ids, joined by commas, and the bytes that the ids decode to."""
        self.known.turn()
        get, out, missing = self.known.young.get, [], []
        for text in texts:
            words = self.split(text)
            found = list(map(get, words))
            if None in found:
                missing += [w for w, x in zip(words, found) if x is None]
                out.append(words)
            else:
                out.append(found)
        digits = self.digits.__getitem__
        new = {w.encode(): w for w in self.known.recall(missing)}
        for raw, ids in self.bpe.encode_pieces(list(new)).items():
            self.known.add(new[raw], (",".join(map(digits, ids)), self.bpe.decode(ids)), 150 + 6 * len(ids) + len(raw))
        known = self.known.young.__getitem__
        return [list(map(known, x)) if x and isinstance(x[0], str) else x for x in out]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.words([text])[0] for i in ids.split(",")]


def opened(path: str, pattern: str) -> Texts:
    held = kept(f"prefix_bpe {path}")
    if pattern not in held:
        held[pattern] = Texts(path, pattern)
    return held[pattern]


TOKENS = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id and ids (array of int)."""

    def run(batches):
        texts = opened(path, pattern)
        for part in slices(batches):
            ids = [texts.encode(t) for t in strings(part, "text")]
            yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array(ids, pa.list_(pa.int32()))], schema=TOKENS)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>")


def decode_texts(tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with a column ``decoded`` (binary); a null array decodes to nothing."""
    @F.pandas_udf("binary")
    def decoded(ids: pd.Series) -> pd.Series:
        bpe = opened(path, "").bpe
        return ids.map(lambda x: b"" if x is None else bpe.decode(x))

    return tokens.withColumn("decoded", decoded(ids_col))


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode again and digest both, without sending ids back to the JVM."""

    def run(batches):
        texts = opened(path, pattern)
        for part in slices(batches):
            n, a, b = [], [], []
            for found in texts.words(strings(part, "text")):
                decimals, raw = zip(*found) if found else ((), ())
                ids = ",".join(decimals)
                n.append(ids.count(",") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                b.append(hashlib.sha256(b"".join(raw)).hexdigest())
            yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], schema=DIGESTS)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
