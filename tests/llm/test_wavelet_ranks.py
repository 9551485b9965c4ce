import numpy as np
import pytest

from evidenta.llm import wavelet


@pytest.mark.parametrize("n", [1, 63, 64, 511, 512, 513, 1024, 40_000])
def test_ones_before_every_position_in_one_pass(n, monkeypatch):
    """The ones before all positions of a plane, at the edges of bytes, words and blocks, by one count of whole words."""
    tokens = np.random.default_rng(n).integers(0, 2, size=n)
    matrix = wavelet.WaveletMatrix.build(np.append(tokens, [0, 1]))
    bits = np.unpackbits(matrix.planes[0], count=n + 2)
    calls, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: calls.append(x.size) or count(x))
    at = np.arange(min(n + 3, wavelet.RANK_STEP))
    assert (matrix._ones(0, at) == np.concatenate([[0], np.cumsum(bits)])[at]).all()
    assert len(calls) == 1
    assert (matrix._ones(0, np.array([n + 2])) == bits.sum()).all()


def test_more_positions_than_a_step(monkeypatch):
    monkeypatch.setattr(wavelet, "RANK_STEP", 7)
    tokens = np.random.default_rng(1).integers(0, 50, size=3000)
    matrix = wavelet.WaveletMatrix.build(tokens)
    at = np.arange(3000)
    assert (matrix.access(at) == tokens).all()
    assert (matrix.rank(7, at) == np.cumsum(tokens == 7) - (tokens == 7)).all()
