import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trialkit.llm import id_coder
from trialkit.llm.id_coder import decode_block, encode_block


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2000), st.integers(1, 60000), st.integers(0, 2**32 - 1))
def test_round_trip(n, alphabet, seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    ids = np.minimum(rng.geometric(rng.uniform(0.0005, 0.9), n) - 1, alphabet - 1)
    assert list(decode_block(encode_block(ids, alphabet))) == list(ids)


def test_repetition_is_learned():
    rng = np.random.Generator(np.random.PCG64(1))
    ids = np.tile(rng.integers(0, 50_000, 300), 200)
    assert len(encode_block(ids, 50_257)) * 8 / len(ids) < 2


def test_damage_is_found():
    block = bytearray(encode_block(np.arange(3000) % 50, 64))
    with pytest.raises(ValueError):
        decode_block(bytes(block[:-2]))
    with pytest.raises(ValueError):
        decode_block(b"")
    block[len(block) // 2] ^= 4
    with pytest.raises(ValueError):
        decode_block(bytes(block))


def test_alphabet_has_a_bound():
    with pytest.raises(ValueError):
        encode_block(np.zeros(3), 1 << 20)


def test_frequencies_are_counted_once_in_several_steps(monkeypatch):
    calls, recount = [], id_coder._Model.recount
    monkeypatch.setattr(id_coder._Model, "recount", lambda model: (calls.append(1), recount(model))[1])
    encode_block(np.arange(256 * 20) % 700, 1000)
    assert len(calls) < 256 // 4


def test_ids_beyond_the_alphabet_are_refused():
    with pytest.raises(ValueError):
        encode_block(np.array([1, 9]), 9)
