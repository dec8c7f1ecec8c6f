"""Token-ID files: what a segment takes, and the encoder's memory."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import idfile, rangecoder, tokens


def word_ids(n: int) -> np.ndarray:
    """Ids of 4,600 words, frequent ones as in texts, spread over the vocabulary."""
    rng = np.random.default_rng(4)
    share = 1 / np.arange(3, 4603)
    return rng.permutation(50257)[rng.choice(4600, n, p=share / share.sum())].astype(np.uint32)


def test_segment_is_smaller_than_zlib():
    """Blocks that learn from nothing take more."""
    ids = word_ids(80_000)
    data = idfile.make_segment(np.array([1, 2]), np.array([30_000, 50_000]), ids)
    assert len(data) < len(zlib.compress(ids.astype("<u2").tobytes()))
    docs, counts, got = next(idfile.read_segments(data + b"\n"))
    assert docs.tolist() == [1, 2] and counts.tolist() == [30_000, 50_000] and np.array_equal(got, ids)
    with pytest.raises(rangecoder.Corrupt):
        list(idfile.read_segments(data[:200] + bytes([data[200] ^ 1]) + data[201:] + b"\n"))


def test_blocks_decode_alone_with_the_prior():
    ids = word_ids(9000)
    freq = rangecoder.prior(ids)
    assert int(freq.sum()) == 1 << rangecoder.PRIOR and (freq[ids] > 0).all()
    blocks = rangecoder.encode(ids, freq)
    assert [b[0] for b in blocks] == [4096, 4096, 808]
    for i, b in enumerate(blocks):
        assert np.array_equal(rangecoder.decode([b], freq), ids[4096 * i : 4096 * i + b[0]])
    with pytest.raises(ValueError, match="prior"):
        rangecoder.encode(np.append(ids, np.flatnonzero(freq == 0)[0]), freq)


def test_encoder_forgets_the_later_half(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 200)
    e = tokens.Encoder(tokens.default_path())
    rnd = random.Random(8)
    for _ in range(12):
        texts = ["".join(rnd.choice([" ", "\n", "é", "!"]) + "".join(rnd.choices("abcdefgh", k=rnd.choice([1, 2, 5] * 10 + [80]))) for _ in range(40)) for _ in range(3)]
        ids, offsets = e.encode(pa.array(texts))
        want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == want
    before = len(e.known)
    e._forget()
    assert 50 < len(e.known) == len(e.places) <= 100 < before


def test_carries_ripple_through_full_words():
    """Ids whose code is a word, words of zeros and any words: on the way low has words of ones, which a carry turns."""
    rng = np.random.default_rng(2)
    freq = rangecoder.prior(word_ids(9000))
    codes = [np.concatenate([rng.integers(1, 1 << 31, 1), np.zeros(k % 4), rng.integers(0, 1 << 32, 40)]).astype("<u4") for k in range(64)]
    sizes = np.full(64, 100)
    ids = rangecoder._decode_lanes(codes, sizes, freq)
    got = [np.frombuffer(c, "<u4") for c in rangecoder._encode_lanes(ids, sizes, freq)]
    # the zeros are there again, so carries went through whole words of ones; a few codes fall where rounding leaves a gap, as no encoder's do
    assert sum(not c[1 : 1 + k % 4].any() and c[0] == w[0] for k, (c, w) in enumerate(zip(got, codes, strict=True))) >= 60
    assert np.array_equal(rangecoder._decode_lanes(got, sizes, freq), ids)
