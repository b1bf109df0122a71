"""Exact token ids from the tokenizers library through bounded worker caches.

Both vocabularies split a text into pre-tokens that are encoded one by one.  A
text of common characters is split here, by the vocabulary's own pattern; each
pre-token is looked up once, and new ones are encoded by the library in one call
per slice of rows, through a pipeline without the steps that were done here.  Of any other text the library gets whole white-space pieces
where a cut there is proven safe, and else the whole text.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict

import numpy as np

from tessella.llm.common import Cache, kept, quiet_tokenizers

#: Bytes of a worker's two caches, of pre-tokens and of other white-space pieces.
WORD_BYTES, PIECE_BYTES = 256_000_000, 24_000_000

#: Characters whose only normalisation is lower-casing, and whose classes re and the library agree on.
SIMPLE = re.compile(r"[\t\n\r\x20-\x7e¡-±´-¸º»¿-į]*")
#: Separators on which str.split and the library may differ.
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\u180e\u200b\ufeff]")
#: A space that may be part of a longer run of white space.
RUN = re.compile(r"[^\S ] [^\S ]| \Z|[\x1c-\x1f\x85\u180e]")
#: No text holds a lone surrogate; it marks a text's first piece.
FIRST = "\ud800"


def encoder(path: str, word_bytes: int | None = None) -> "WordEncoder | ByteEncoder":
    """The encoder of a tokenizer file, one for each Python worker; its cache of pre-tokens holds ``word_bytes``, or WORD_BYTES."""
    word_bytes = word_bytes or WORD_BYTES
    held = kept(f"encoding {path} {word_bytes}")
    if not held:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        held["encoder"] = (ByteEncoder if spec["pre_tokenizer"]["type"] == "ByteLevel" else WordEncoder)(path, spec, word_bytes)
    return held["encoder"]


class Known(dict):
    """Byte strings by key; a key it lacks gets an empty one in ``lacking``, the same each time, to be filled later."""

    def __init__(self):
        super().__init__()
        self.lacking: dict = defaultdict(bytearray)

    def __missing__(self, key):
        return self.lacking[key]


class _Encoder:
    #: What of the file's settings is left out for pre-tokens.
    shortened: dict = {}

    def __init__(self, path: str, spec: dict, word_bytes: int):
        quiet_tokenizers()
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.plain_model = Tokenizer.from_str(json.dumps(spec | self.shortened))
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.pieces, self.words = Cache(PIECE_BYTES), Cache(word_bytes, Known)

    def whole(self, text: str) -> bytes:
        """What the library gives for the text as it is."""
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _ids(self, text: str) -> np.ndarray:
        """Ids of pre-tokens that need no normalisation, side by side."""
        return np.array(self.plain_model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(texts)
        waiting: list[tuple[int, list]] = []
        self.words.turn()
        self.pieces.turn()
        known = self.words.young
        get, lacking = known.__getitem__, known.lacking
        for i, text in enumerate(texts):
            if not SIMPLE.fullmatch(text) or any(s in text for s in self.specials):
                out[i] = self._by_pieces(text)
            else:
                waiting.append((i, list(map(get, self.pre_tokens(text)))))
        try:
            if new := self.words.recall(lacking):
                self.words.add_all(self.encode_words(new))
            for w, ids in lacking.items():
                ids += known.get(w)
        finally:
            lacking.clear()
        for i, found in waiting:
            out[i] = b"".join(found)
        return out

    def _by_pieces(self, text: str) -> bytes:
        parts = self.cut(text)
        if parts is None:
            return self.whole(text)
        known = self.pieces
        for p in known.recall(p for p in parts if p not in known.young):
            ids = self.whole(self.as_text(p))
            known.add(p, ids, len(ids))
        return b"".join(map(known.young.__getitem__, parts))

    def _apart(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> dict[str, bytes]:
        """Ids of several words, cut behind the given positions."""
        if len(ends) != len(words):  # not as expected: one by one
            return {w: self.whole(w) for w in words}
        raw, cuts = ids.tobytes(), [0, *(4 * (ends + 1)).tolist()]
        return {w: raw[a:b] for w, a, b in zip(words, cuts, cuts[1:])}


#: The letters among the SIMPLE characters.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-į"


def as_re(pattern: str) -> re.Pattern:
    """A pre-token pattern for re, which finds the same in texts of SIMPLE characters.

    No other alternative can begin where a run of letters does, so that one is tried first.
    """
    parts = pattern.split("|")
    parts.sort(key=lambda p: not p.endswith(r"\p{L}+") and not p.endswith(r"[\p{L}]+"))
    pattern = "|".join(parts)
    for theirs, ours in ((r"[^\s\p{L}\p{N}]", rf"[^\s{LETTERS}0-9]"), (r"[\p{L}]", f"[{LETTERS}]"), (r"\p{L}", f"[{LETTERS}]"), (r"[\p{N}]", "[0-9]"), (r"\p{N}", "[0-9]")):
        pattern = pattern.replace(theirs, ours)
    return re.compile(pattern)


class WordEncoder(_Encoder):
    """Lower-casing BPE with word ends: white space separates and is dropped."""

    shortened = {
        "normalizer": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    }

    def __init__(self, path: str, spec: dict, word_bytes: int):
        super().__init__(path, spec, word_bytes)
        self.pattern = as_re(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocab.values()) + 1, dtype=bool)
        suffix = spec["model"]["end_of_word_suffix"]
        self.is_end[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def cut(self, text: str) -> list[str] | None:
        return None if ODD_SPACE.search(text) else text.split()

    def as_text(self, piece: str) -> str:
        return piece

    def pre_tokens(self, text: str) -> list[str]:
        return self.pattern.findall(text.lower())

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        ids = self._ids(" ".join(words))
        return self._apart(words, ids, np.flatnonzero(self.is_end[ids]))


def signs() -> dict[str, int]:
    """The byte of each sign that byte-level vocabularies write: printable ones stand for themselves, others for 256 and on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


#: The sign that byte-level vocabularies write for each byte.
SIGNS = np.array([ord(c) for c, _ in sorted(signs().items(), key=lambda x: x[1])], dtype="<u2")


class ByteEncoder(_Encoder):
    """Byte-level BPE whose pre-tokens take one leading space with them."""

    #: Pre-tokens are cut already, and ``in_signs`` writes their bytes.
    shortened = {"pre_tokenizer": {"type": "WhitespaceSplit"}}

    def __init__(self, path: str, spec: dict, word_bytes: int):
        super().__init__(path, spec, word_bytes)
        import public_tokenizers

        self.pattern = as_re(public_tokenizers.PATTERN)
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.sentinel = spec["added_tokens"][0]["id"]
        self.starts = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.starts[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.plain = re.compile(r" [^\W\d_]+")

    def cut(self, text: str) -> list[str] | None:
        if "  " in text or RUN.search(text):
            return None
        if not text:
            return []
        first, *rest = text.split(" ")
        return [FIRST + first, *rest] if first else rest

    def as_text(self, piece: str) -> str:
        """Pieces follow a space; the text's first piece, which doesn't, is marked by FIRST."""
        return piece[1:] if piece.startswith(FIRST) else " " + piece

    def pre_tokens(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    @staticmethod
    def in_signs(text: str) -> str:
        """A text's bytes as the vocabulary writes them, without white space."""
        return SIGNS[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        plain, rest, is_plain = [], [], self.plain.fullmatch
        for w in words:
            (plain if is_plain(w) else rest).append(w)
        out: dict[str, bytes] = {}
        if plain:
            ids = self._ids(self.in_signs("".join(plain)).replace("Ġ", " Ġ"))
            begins = np.flatnonzero(self.starts[ids])
            out = self._apart(plain, ids, np.append(begins[1:], len(ids)) - 1)
        if rest:
            # no text of SIMPLE characters holds a zero
            ids = self._ids(self.in_signs("".join(w + "\0" for w in rest)).replace(self.in_signs("\0"), self.specials[0]))
            marks = np.flatnonzero(ids == self.sentinel)
            if len(marks) == len(rest):
                raw, begin = ids.tobytes(), 0
                for w, end in zip(rest, marks.tolist()):
                    out[w] = raw[4 * begin : 4 * end]
                    begin = end + 1
            else:
                out |= {w: self.whole(w) for w in rest}
        return out
