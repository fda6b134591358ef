import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trialkit.llm.packing import SumOfSquares, pack
from trialkit.llm.token_counts import LongestMatch, count_tokens, read_pieces
from trialkit.llm.tokens import TokenIds, read_tokenizer, text_runs

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def whole(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


KINDS = [(WORDS, "words"), (BYTES, "spaces")]
PLAIN = {path: whole(path) for path, _ in KINDS}
STORES = {path: TokenIds(read_tokenizer(path), kind) for path, kind in KINDS}
PARTS = ["a", "the", "Über", "ªµº", "×", ".,", "#*$", "don't", "|", "x|y", "0", " ", "  ", "\n", "\t", "'s", "é", "É", "é", "́", " ", "12", "!!", "<|endoftext|>", "\x00", " ", "ß", "Σ", "漢", "\r\n", "ΑΣ"]


@pytest.mark.parametrize("path", [WORDS, BYTES])
@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.sampled_from(PARTS), max_size=12))
def test_word_by_word_gives_the_ids_of_the_whole_text(path, parts):
    text = "".join(parts)
    (got,) = STORES[path].encode([text])
    assert list(np.frombuffer(got, "<u4")) == PLAIN[path](text)


def test_text_runs_cover_all():
    texts = ["x" * n for n in (0, 5, 30, 2, 0, 9)] + [None]
    assert [t for _, run in text_runs(texts, 10) for t in run] == texts
    assert [first for first, _ in text_runs(texts, 10)] == [0, 3, 6]


def naive_level(counts, size, n):
    def squares(c):
        return sum(v * v for v in c.values())

    best, found = None, None
    for level in sorted((k for k, v in counts.items() if v and k + n <= size), reverse=True) + [0]:
        after = dict(counts)
        if level:
            after[level] -= 1
        if level + n < size:
            after[level + n] = after.get(level + n, 0) + 1
        if best is None or squares(after) < best:
            best, found = squares(after), level
    return found


def test_level_is_the_one_with_the_least_sum_of_squares():
    rng = random.Random(3)
    packer = SumOfSquares(32)
    for i in range(600):
        n = rng.randint(1, 31)
        counts = {k: int(v) for k, v in enumerate(packer.levels) if v}
        assert packer._level(n) == naive_level(counts, 32, n)
        for window in packer.place((i, 0, bytes(4 * n), n)):
            assert sum(len(p[2]) for p in window) == 4 * 32
    ends = [sum(len(p[2]) // 4 for p in w) for w in packer.close()]
    assert all(n == 32 or n & (n - 1) == 0 for n in ends)


def test_too_many_open_windows_are_cut_together():
    packer, taken, given_ = SumOfSquares(32, most_open=4), 0, 0
    for i in range(200):
        n = 17 + i % 3
        given_ += n
        taken += sum(len(p[2]) // 4 for w in packer.place((i, 0, bytes(4 * n), n)) for p in w)
        assert packer.n_open <= 5
    taken += sum(len(p[2]) // 4 for w in packer.close() for p in w)
    assert taken == given_


def test_pieces_give_back_every_document(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "gamma,", "x9"]) for _ in range(rng.choice([0, 3, 50, 900])))) for i in range(150)]
    rows += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = pack(docs, WORDS, window=256, with_ids=True).collect()
    want = {i: [*PLAIN[WORDS](t), 2] for i, t in rows}
    for i, ids in want.items():
        pieces = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["start"])
        got = b"".join(r["ids"] for r in pieces)
        assert list(np.frombuffer(got, "<u4")) == ids
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(r["ids"]) for r in pieces)
        assert [r["start"] for r in pieces] == list(np.cumsum([0, *[r["length"] for r in pieces]])[:-1])
    for s in {r["sequence_id"] for r in out}:
        mine = sorted((r for r in out if r["sequence_id"] == s), key=lambda r: r["offset"])
        assert [r["offset"] for r in mine] == list(np.cumsum([0, *[r["length"] for r in mine]])[:-1])
        n = sum(r["length"] for r in mine)
        assert n == 256 or (n < 256 and n & (n - 1) == 0)


def greedy(word, pieces):
    n = i = 0
    while i < len(word):
        for j in range(len(word), i, -1):
            if (word[i:j], False) in pieces or (j == len(word) and (word[i:j], True) in pieces):
                break
        else:
            return -1
        n, i = n + 1, j
    return n


@settings(max_examples=300, deadline=None)
@given(
    st.sets(st.tuples(st.text("abc", min_size=1, max_size=4).map(str.encode), st.booleans()), max_size=12),
    st.lists(st.text("abcd", max_size=9).map(str.encode), max_size=8),
)
def test_automaton_counts_greedy_pieces(pieces, words):
    automaton = LongestMatch(pieces)
    for word in words:
        assert automaton.count(word) == greedy(word, pieces)


def test_token_counts_of_documents(spark):
    rows = [(1, "The the THE  unbelievable\nÉtude  x"), (2, None), (3, ""), (4, "a" * 200)]
    pieces = set(read_pieces(WORDS))
    got = {r["doc_id"]: r for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), WORDS).collect()}
    for i, text in rows:
        words = [w.encode() for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\n", " ").split(" ") if w]
        counts = [greedy(w, pieces) for w in words]
        assert (got[i]["n_words"], got[i]["n_tokens"], got[i]["n_unknown"]) == (len(words), sum(counts), 0)
        assert got[i]["most_tokens"] == max(counts, default=0)
