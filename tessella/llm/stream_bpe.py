"""Byte-level BPE as a transducer with bounded lookahead, and decoding as a byte-to-text state machine.

The merge list itself says how far what follows can reach back.  Compare the
encodings of a prefix and of any text that goes on from it: after the merges of
each rank both agree up to some token's end, which moves back over one token
only when a merge of that rank takes the last agreed token in one of them and
not in the other.  The next such merge has a higher rank, and the token on its
right begins with the token moved over, on the left side of its own merges.  So
the longest chain of merges of that kind, weighted by the bytes of their left
tokens, bounds the way back: ``Merges.lookahead``, computed once from the list.
A token that ends so many bytes before the last byte read is emitted, whatever
follows; what is behind it waits in a buffer of bounded size.

Texts are read in chunks, and no state grows with a text.  A pre-token is given
on once the characters behind it settle its end; one that is longer than
LONG_CHARS runs through the transducer while it is being read.  Short ones are
looked up in a worker cache of bounded bytes, which the transducer fills.

Special strings count as the library's default has it: their own id, and a text
is split there.  Letters, numbers and white space are what the library takes
for them.  Null and empty texts have no tokens and decode to an empty text.
Very long texts and pre-tokens are encoded whole.  Repeated rows give repeated
rows, rows are independent of each other, so ties mean nothing; an empty table
gives no rows; columns besides id and text aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import Cache, column, id_and_text, kept, quiet_tokenizers, slices, strings
from tessella.llm.encoding import SIMPLE, as_re, signs

#: Characters of a text that are read at a time, and of a pre-token from which it is encoded while it is read.
CHUNK_CHARS, LONG_CHARS = 65_536, 4096
#: Bytes of a worker's cache of pre-tokens.
WORD_BYTES = 256_000_000
#: Tokens from which a heap finds the next merge.
HEAP_FROM = 40

#: How a byte-level vocabulary splits a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Merges:
    """A merge list over tokens: pairs by rank, the lowest merged first and from left to right."""

    def __init__(self, base: list[int], merges: list[tuple[int, int, int]], size: dict[int, int]):
        """``base``: the token of each byte; ``merges``: left, right and made token in order; ``size``: bytes of a token."""
        self.base, self.merges, self.size = base, merges, size
        made = set(base)
        for a, b, ab in merges:
            if a not in made or b not in made:
                raise ValueError("a merge comes before those that make its parts")
            made.add(ab)
        self.pairs = {a << 32 | b: (rank, ab) for rank, (a, b, ab) in enumerate(merges)}
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """The most bytes before the end of what was read at which a token may still change."""
        left: dict[int, list[int]] = {}  # the merges' left tokens that make a token
        for a, _, ab in self.merges:
            left.setdefault(ab, []).append(a)
        begins: dict[int, tuple[int, ...]] = {}

        def beginnings(token: int) -> tuple[int, ...]:
            """Tokens that the token begins with on the left side of its merges, itself too."""
            if token not in begins:
                found, waiting = {token}, [token]
                while waiting:
                    for a in left.get(waiting.pop(), ()):
                        if a not in found:
                            found.add(a)
                            waiting.append(a)
                begins[token] = tuple(found)
            return begins[token]

        longest: dict[int, int] = {}  # over merges of higher rank whose right token begins with this one
        reach = 0
        for a, b, _ in reversed(self.merges):
            way = self.size[a] + longest.get(a, 0)
            reach = max(reach, way)
            for t in beginnings(b):
                if longest.get(t, 0) < way:
                    longest[t] = way
        return reach

    def merged(self, raw: bytes) -> list[int]:
        """The tokens of a string of bytes by itself."""
        base = self.base
        ids = [base[x] for x in raw]
        if len(ids) >= HEAP_FROM:
            return self._by_heap(ids)
        get, none = self.pairs.get, (1 << 40, 0)
        while len(ids) > 1:
            found = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
            rank, made = best = min(found)
            if best is none:
                break
            out, i, n = [], 0, len(found)
            while i < n:
                if found[i][0] == rank:
                    out.append(made)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            if i == n:
                out.append(ids[n])
            ids = out
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        get, n = self.pairs.get, len(ids)
        before, behind = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*p, i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, made, i, a, b = heapq.heappop(heap)
            j = behind[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], behind[i] = made, -1, behind[j]
            if behind[i] >= 0:
                before[behind[i]] = i
            for x, y in ((before[i], i), (i, behind[i])):
                if x >= 0 and y >= 0 and (p := get(ids[x] << 32 | ids[y])):
                    heapq.heappush(heap, (*p, x, ids[x], ids[y]))
        return [t for t in ids if t >= 0]


class Piece:
    """The transducer of one pre-token: bytes in, stable tokens out; it holds a few times the lookahead at most."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, b""
        self.most = 4 * merges.lookahead + 64

    def feed(self, raw: bytes) -> list[int]:
        out: list[int] = []
        for k in range(0, len(raw), self.most):
            self.held += raw[k : k + self.most]
            if len(self.held) > self.most:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        """Tokens that end at least a lookahead before the last byte held.  Where one ends, the rest is encoded by itself."""
        tokens, size = self.merges.merged(self.held), self.merges.size
        end, n, limit = 0, 0, len(self.held) - self.merges.lookahead
        while (more := end + size[tokens[n]]) <= limit:
            end, n = more, n + 1
        self.held = self.held[end:]
        return tokens[:n]

    def finish(self) -> list[int]:
        out, self.held = self.merges.merged(self.held), b""
        return out


class ByteToText:
    """Bytes in, text out as soon as characters are whole; at most three bytes wait.  What is no UTF-8 becomes U+FFFD."""

    def __init__(self):
        self.held = b""

    def feed(self, raw: bytes) -> str:
        raw = self.held + raw
        cut = len(raw)
        for back in range(1, min(3, len(raw)) + 1):
            byte = raw[-back]
            if byte >= 0xC0:  # begins a character of so many bytes
                if back < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4):
                    cut -= back
                break
            if byte < 0x80:
                break
        self.held = raw[cut:]
        return raw[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


class Classes(dict):
    """For str.translate: characters beyond ASCII become one of their class, as the library has it, for PATTERN's sake."""

    def __init__(self):
        super().__init__({c: chr(c) for c in range(128)})
        quiet_tokenizers()
        from tokenizers import Regex, pre_tokenizers

        self.members = [(sign, pre_tokenizers.Split(Regex(f"[^{x}]"), "removed")) for sign, x in (("z", r"\p{L}"), ("0", r"\p{N}"), ("\n", r"\s"))]

    def __missing__(self, code: int) -> str:
        sign = next((s for s, only in self.members if only.pre_tokenize_str(chr(code))), "!")
        self[code] = sign
        return sign


#: Of translated texts: the first character that doesn't go on a run of the same class.
RUN_ENDS = {"z": re.compile(r"[^A-Za-z]"), "0": re.compile(r"[^0-9]"), "\n": re.compile(r"[^ \t-\r]"), "!": re.compile(r"[ \t-\rA-Za-z0-9]")}


def _kind(sign: str) -> str:
    return next(k for k, end in RUN_ENDS.items() if not end.match(sign))


class StreamBPE:
    """Encoder and decoder of a byte-level tokenizer file, shared by all texts of a Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        vocab, byte = model["vocab"], signs()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.bytes_of = {i: bytes(map(byte.__getitem__, t)) for t, i in vocab.items() if all(c in byte for c in t)}
        base = {b: vocab[c] for c, b in byte.items()}
        self.merges = Merges([base[b] for b in range(256)], [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], {i: len(b) for i, b in self.bytes_of.items()})
        if len(spec["added_tokens"]) > 1 or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError(f"{path} has special strings of another kind")
        self.special, self.special_id = next(((x["content"], np.array(x["id"], dtype="<u4").tobytes()) for x in spec["added_tokens"]), ("", b""))
        self.bytes_of |= {x["id"]: bytes(byte.get(c, 0) for c in x["content"]) if all(c in byte for c in x["content"]) else x["content"].encode() for x in spec["added_tokens"]}
        self.known, self.classes = Cache(WORD_BYTES), Classes()
        self.simple = as_re(PATTERN)
        self.translated = re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"), re.ASCII)

    def split(self, text: str) -> list[str]:
        if SIMPLE.fullmatch(text):
            return self.simple.findall(text)
        out, at = [], 0
        for x in self.translated.findall(text.translate(self.classes)):
            out.append(text[at : at + len(x)])
            at += len(x)
        return out

    def kind(self, char: str) -> str:
        return _kind(char.translate(self.classes))

    def run_end(self, text: str, kind: str) -> int:
        """Where a run of a class that the text goes on with ends; -1 if it doesn't."""
        found = RUN_ENDS[kind].search(text.translate(self.classes))
        return found.start() if found else -1

    def encoded(self, words: list[str]) -> bytes:
        """Ids of whole pre-tokens, as little-endian unsigned 32-bit integers."""
        get = self.known.young.get
        found = list(map(get, words))
        if None in found:
            for w in self.known.recall(w for w, x in zip(words, found) if x is None):
                ids = self.as_bytes(self.merges.merged(w.encode()))
                self.known.add(w, ids, len(ids))
            known = self.known.young.__getitem__
            found = [known(w) if x is None else x for w, x in zip(words, found)]
        return b"".join(found)

    @staticmethod
    def as_bytes(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def decoded(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class Encoding:
    """One text on its way through: ``feed`` gives the ids that are certain by then."""

    def __init__(self, bpe: StreamBPE):
        self.bpe, self.held = bpe, ""
        self.piece: Piece | None = None
        self.kind = ""

    def feed(self, text: str, last: bool = False) -> bytes:
        """Ids of what no further text can change; of everything, if this is the last of the text."""
        text, out, special = self.held + text, [], self.bpe.special
        wait = 0
        if special:
            *parts, text = text.split(special)
            for p in parts:
                out += [self._segment(p, True), self.bpe.special_id]
            if not last:  # characters that may begin a special string
                wait = next((k for k in range(min(len(special) - 1, len(text)), 0, -1) if special.startswith(text[-k:])), 0)
        out.append(self._segment(text[: len(text) - wait], last))
        self.held += text[len(text) - wait :]
        return b"".join(out)

    def _segment(self, text: str, last: bool) -> bytes:
        """What stands between special strings; leaves in ``held`` what has to wait."""
        bpe, out = self.bpe, []
        self.held = ""
        if self.piece:
            end = bpe.run_end(text, self.kind)
            if end < 0 and not last:
                keep = 1 if self.kind == "\n" else 0
                out.append(bpe.as_bytes(self.piece.feed(text[: len(text) - keep].encode())))
                self.held = text[len(text) - keep :]
                return b"".join(out)
            # a run's last white space belongs to what follows
            end = len(text) if end < 0 else end - (self.kind == "\n")
            out.append(bpe.as_bytes(self.piece.feed(text[:end].encode()) + self.piece.finish()))
            self.piece, text = None, text[end:]
        words = bpe.split(text)
        if not last:
            tail = 0  # characters whose pre-tokens the next ones may change
            while words and tail < 3:
                tail += len(words.pop())
            # the one before ends for certain: the character behind it is known, and any contraction that begins it
            self.held = text[len(text) - tail :]
        if any(len(w) > LONG_CHARS for w in words):
            for w in words:
                piece = Piece(bpe.merges)
                out.append(bpe.encoded([w]) if len(w) <= LONG_CHARS else bpe.as_bytes(piece.feed(w.encode()) + piece.finish()))
        else:
            out.append(bpe.encoded(words))
        if len(self.held) > LONG_CHARS:
            out.append(self._open())
        return b"".join(out)

    def _open(self) -> bytes:
        """Hand a pre-token that has no end yet to a transducer of its own."""
        words = self.bpe.split(self.held)
        if len(words[-1]) <= LONG_CHARS:
            return b""
        done, run = self.bpe.encoded(words[:-1]) if len(words) > 1 else b"", words[-1]
        self.kind, self.piece = self.bpe.kind(run[-1]), Piece(self.bpe.merges)
        keep = 1 if self.kind == "\n" else 0
        self.held = run[len(run) - keep :]
        return done + self.bpe.as_bytes(self.piece.feed(run[: len(run) - keep].encode()))


def opened(path: str) -> StreamBPE:
    held = kept(f"stream_bpe {path}")
    if not held:
        held["bpe"] = StreamBPE(path)
    return held["bpe"]


def emitted(bpe: StreamBPE, text: str):
    """Ids of a text, part by part."""
    now = Encoding(bpe)
    for k in range(0, len(text), CHUNK_CHARS):
        yield now.feed(text[k : k + CHUNK_CHARS], k + CHUNK_CHARS >= len(text))


TOKENS = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def stream_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id and ids (array of int)."""

    def run(batches):
        bpe = opened(path)
        for part in slices(batches):
            bpe.known.turn()
            ids = [np.frombuffer(b"".join(emitted(bpe, t)), dtype="<u4").astype(np.int32) for t in strings(part, "text")]
            yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array(ids, pa.list_(pa.int32()))], schema=TOKENS)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>")


def stream_decode(tokens: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """A row for each one of ``tokens``: id and text; a null array decodes to an empty text."""

    def run(batches):
        bpe = opened(path)
        for part in batches:
            out = []
            for ids in column(part, "ids").to_pylist():
                now, text = ByteToText(), []
                for k in range(0, len(ids or ()), CHUNK_CHARS):
                    text.append(now.feed(b"".join(map(bpe.bytes_of.__getitem__, ids[k : k + CHUNK_CHARS]))))
                out.append("".join(text) + now.finish())
            yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array(out, pa.string())], schema=pa.schema([("id", pa.int64()), ("text", pa.string())]))

    return tokens.selectExpr(f"cast(`{id_col}` as long) as id", f"`{ids_col}` as ids").mapInArrow(run, "id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode what is emitted at once, and digest both: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches):
        bpe = opened(path)
        for part in slices(batches):
            bpe.known.turn()
            n, a, b = [], [], []
            for text in strings(part, "text"):
                count, ids_hash, text_hash, back = 0, hashlib.sha256(), hashlib.sha256(), ByteToText()
                for ids in emitted(bpe, text):
                    count += len(ids) // 4
                    ids_hash.update(ids)
                    text_hash.update(back.feed(bpe.decoded(ids)).encode())
                text_hash.update(back.finish().encode())
                n.append(count)
                a.append(ids_hash.hexdigest())
                b.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], schema=DIGESTS)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
