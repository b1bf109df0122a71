"""How often the encoder looks pre-tokens up, and what it leaves to the library."""

import json

import pytest

from tessella.llm import encoding
from tests.llm.test_llm import BYTE, WORD


@pytest.fixture
def fresh():
    """Encoders with empty caches, before and after."""
    encoding.kept("another")
    yield encoding.encoder
    encoding.kept("another")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pre_tokens_are_looked_up_once(fresh, path):
    """Of a text with new pre-tokens, the known ones aren't looked up again."""
    e = fresh(path)
    e.encode(["the first and the second"])
    asked = []

    class Counting(type(e.words.young)):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    young = Counting()
    young.update(e.words.young)
    e.words.young = young
    text = "the first and the second" + " and the first" * 50 + " unheardof unheardof"
    assert e.encode([text]) == [e.whole(text)]
    assert len(asked) <= len(e.pre_tokens(text)) + 2


def test_new_words_go_through_a_short_pipeline(fresh):
    """The library neither cuts pre-tokens again nor writes their bytes; ids are the same, side by side and alone."""
    e = fresh(BYTE)
    assert "ByteLevel" not in json.dumps(json.loads(e.plain_model.to_str())["pre_tokenizer"])
    words = [" naïve", "ÿ", " ¡", "\n", "\n\n", "   ", "\t", " ", "'s", " 12", "...", " įæ", "¬®", "Ġ", " Ġx", " the", "the", "#", " {}", " " + "x" * 5000]
    assert e.encode_words(words) == {w: e.whole(w) for w in words}
    assert [e.encode_words([w]) for w in words] == [{w: e.whole(w)} for w in words]


def test_a_slice_that_fails_leaves_nothing_behind(fresh, monkeypatch):
    e, texts = fresh(BYTE), ["some new words", "new words, new words"]

    def fail(words):
        raise RuntimeError

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(e, "encode_words", fail)
        e.encode(texts)
    assert e.encode(texts) == [e.whole(t) for t in texts]
