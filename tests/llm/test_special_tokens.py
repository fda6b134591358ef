"""Texts that hold the strings of special tokens have the ids of the library's plain call."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trialkit.llm.id_files import read_ids, write_ids
from trialkit.llm.packing import pack
from trialkit.llm.tokens import TokenIds, read_tokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "The", "É", "|", "<", "x|y", ".,", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "  ", "\n", "\t", "'s", "漢"]


@pytest.mark.parametrize("path, kind", [(WORDS, "words"), (BYTES, "spaces")])
def test_ids_are_those_of_the_plain_call(path, kind):
    rng, plain = random.Random(4), Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", *["".join(rng.choices(PARTS, k=rng.randint(0, 12))) for _ in range(2000)]]
    for text, got in zip(texts, TokenIds(read_tokenizer(path), kind, special=True).encode(texts), strict=True):
        assert list(np.frombuffer(got, "<u4")) == plain.encode(text, add_special_tokens=False).ids, text


def test_packing_and_id_files_use_them(spark, tmp_path):
    text = "a <|endoftext|> b"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (piece,) = pack(docs, WORDS, window=4, with_ids=True).collect()
    assert list(np.frombuffer(piece["ids"], "<u4"))[:-1] == [320, 49407, 321]
    write_ids(docs, str(tmp_path / "files"), BYTES, 50_257)
    (row,) = read_ids(spark, str(tmp_path / "files"), with_ids=True).collect()
    assert list(np.frombuffer(row["ids"], "<u4"))[:-1] == [64, 220, 50256, 275]
