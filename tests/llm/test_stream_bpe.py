"""The transducer against the library, its lookahead against plain merging over random merge lists, and the decoder."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessella.llm import stream_bpe as S
from tests.llm.test_llm import BYTE, fuzz

LIBRARY = Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def bpe():
    return S.StreamBPE(BYTE)


def ids(raw: bytes) -> list[int]:
    return np.frombuffer(raw, dtype="<u4").tolist()


def fed(bpe, text: str, sizes) -> list[int]:
    now, out, k = S.Encoding(bpe), b"", 0
    while k < len(text):
        n = next(sizes)
        out += now.feed(text[k : k + n])
        k += n
    return ids(out + now.feed("", True))


def library(text: str) -> list[int]:
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_any_chunks_give_the_library_s_ids(bpe):
    rng = random.Random(1)
    texts = [*fuzz(4000, 7), "", "<|endof", "x<|endoftext|><|endoftext|> y", " <|endoftext|>  "]
    sizes = iter(lambda: rng.randrange(1, 9), None)
    assert [t for t in texts if fed(bpe, t, sizes) != library(t)] == []
    assert [t for t in texts if ids(b"".join(S.emitted(bpe, t))) != library(t)] == []


def test_long_pre_tokens_are_emitted_while_they_are_read(bpe, monkeypatch):
    monkeypatch.setattr(S, "LONG_CHARS", 30)
    rng = random.Random(2)
    sizes = iter(lambda: rng.randrange(1, 300), None)
    for run in ["a" * 5000, " " * 700 + "x", " " * 700, "\n" * 90 + " y", "-" * 3000 + "'s", "é" * 900, "1" * 999 + "b", "".join(rng.choice("abtheons") for _ in range(6000)), "你" * 500 + "<|endoftext|>" + "=" * 777]:
        for text in (run, "one two " + run, run + " three's " + run):
            assert fed(bpe, text, sizes) == library(text)


def test_memory_stays_constant(bpe):
    now, most = S.Encoding(bpe), 0
    for _ in range(300):
        now.feed("".join(["tion"] * 500))
        most = max(most, len(now.held) + (len(now.piece.held) if now.piece else 0))
    assert now.piece and most <= S.LONG_CHARS + now.piece.most and bpe.merges.lookahead < 1000


@pytest.mark.parametrize("seed", range(40))
def test_lookahead_is_sufficient(seed):
    """Over random merge lists of two letters: what ends before the lookahead never changes, however the text goes on."""
    rng = random.Random(seed)
    spelt, size, made, merges = {0: "a", 1: "b"}, {0: 1, 1: 1}, [0, 1], []
    for _ in range(rng.randrange(1, 14)):
        a, b = rng.choice(made), rng.choice(made)
        if spelt[a] + spelt[b] not in spelt.values():
            new = len(spelt)
            spelt[new], size[new] = spelt[a] + spelt[b], size[a] + size[b]
            made.append(new)
            merges.append((a, b, new))
    m = S.Merges([0, 1] + [0] * 254, merges, size)

    def plain(raw: bytes) -> list[int]:
        out = list(raw)
        for a, b, ab in merges:
            i, new = 0, []
            while i < len(out):
                both = out[i : i + 2] == [a, b]
                new.append(ab if both else out[i])
                i += 1 + both
            out = new
        return out

    for _ in range(60):
        raw = bytes(rng.randrange(2) for _ in range(rng.randrange(1, 80)))
        full, n, end = plain(raw), rng.randrange(len(raw) + 1), 0
        assert m.merged(raw) == full
        for x, y in zip(plain(raw[:n]), full):
            end += size[x]
            if end > n - m.lookahead:
                break
            assert x == y
        piece = S.Piece(m)
        piece.most = m.lookahead + 3
        assert [t for k in range(0, len(raw), 7) for t in piece.feed(raw[k : k + 7])] + piece.finish() == full


def test_merges_in_a_wrong_order_are_an_error():
    with pytest.raises(ValueError):
        S.Merges([0, 1] + [0] * 254, [(2, 0, 3), (0, 1, 2)], {0: 1, 1: 1, 2: 2, 3: 3})


def test_classes_of_all_characters(bpe):
    rng = random.Random(3)
    points = [c for c in range(0x32000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 50):
        text = "".join(chr(c) + rng.choice(["a", " ", "1", "", "\n", "'s"]) for c in points[k : k + 50])
        assert ids(b"".join(S.emitted(bpe, text))) == library(text)


def test_bytes_to_text(bpe):
    rng = random.Random(4)
    for _ in range(3000):
        some = [rng.choice([rng.randrange(50257), rng.randrange(94, 260)]) for _ in range(rng.randrange(20))]
        now = S.ByteToText()
        assert "".join(now.feed(bpe.bytes_of[i]) for i in some) + now.finish() == LIBRARY.decode(some, skip_special_tokens=False)


def test_round_trip(spark):
    rows = [*enumerate(fuzz(300, 8)), (900, None), (901, ""), (901, ""), (None, "no id"), (902, "word " * 60_000), (903, "q" * 200_000)]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, ids string")
    got = collections.Counter(map(tuple, S.round_trip(docs, BYTE).collect()))

    def want(i, text):
        found = library(text)
        return i, len(found), hashlib.sha256(np.array(found, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(found, skip_special_tokens=False).encode()).hexdigest()

    assert got == collections.Counter(want(i, t or "") for i, t in rows)
    back = S.stream_decode(S.stream_encode(docs, BYTE), BYTE).collect()
    assert collections.Counter((r.id, r.text) for r in back) == collections.Counter((i, t or "") for i, t in rows)
    assert S.round_trip(docs.limit(0), BYTE).count() == 0
