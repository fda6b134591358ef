import public_tokenizers
import pytest

from trialkit.llm.tokens import BLANKS, TokenIds, read_tokenizer, token_ids

SPEC = read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


class Model:
    def __init__(self, model):
        self.model, self.calls = model, 0

    def tokenize(self, text):
        self.calls += 1
        return self.model.tokenize(text)


def test_parts_of_words_are_encoded_together_and_once(monkeypatch):
    tokens = TokenIds(SPEC, "spaces")
    model = Model(tokens.tokenizer.model)
    text = " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}," for i in range(100))

    class Tokenizer:
        def __init__(self, tokenizer):
            self.model, self.encode_batch_fast = model, tokenizer.encode_batch_fast

    plain = tokens.tokenizer.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(tokens, "tokenizer", Tokenizer(tokens.tokenizer))
    first = tokens.encode([text])
    assert model.calls < 20
    assert list(memoryview(first[0]).cast("I")) == plain
    calls = model.calls
    assert tokens.encode([text, text]) == first * 2
    assert model.calls == calls


def test_tasks_of_a_worker_share_their_words():
    assert token_ids(SPEC, "spaces") is token_ids(SPEC, "spaces")
    assert token_ids(SPEC, "spaces") is not token_ids(SPEC, "spaces", special=True)


def test_blanks_are_those_that_python_splits_at():
    import re

    assert {c for c in map(chr, range(0x10000)) if c.isspace()} == {c for c in map(chr, range(0x10000)) if re.match(f"[{BLANKS} \n]", c)}


@pytest.mark.parametrize(("file", "kind"), [("byte_bpe_50k.json", "spaces"), ("word_bpe_49k.json", "words")])
def test_odd_texts_have_the_ids_of_whole_texts(file, kind):
    tokens = TokenIds(read_tokenizer(public_tokenizers.path(file)), kind, special=True)
    texts = ["", None, " a", "a ", "a  b", "\n", "a\x00b c", "a᠎b", "a\tb", "a\xa0b c", "12 | x|y <|endoftext|> q", "é ü ß'", "x\n y", "ab--!! cd", "\x1c", "ab cd\nef"]
    for text, got in zip(texts, tokens.encode(texts), strict=True):
        assert list(memoryview(got).cast("I")) == tokens.tokenizer.encode(text or "", add_special_tokens=False).ids
