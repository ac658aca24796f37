import sys

import numpy as np
import pytest

from quillspark.llm import flac


def test_codes_are_found_without_a_call_for_each():
    samples = np.frombuffer(b"Words, as they come in texts; some of them are long. " * 1500, np.uint8).astype(np.int64) - 128
    samples = samples + np.random.default_rng(1).integers(-9, 9, len(samples))
    media, calls = flac.encode(samples.clip(-128, 127)), [0]

    def count(_, event, __):
        calls[0] += event == "c_call"

    sys.setprofile(count)
    try:
        _, found = flac.decode(media)
    finally:
        sys.setprofile(None)
    assert (found[0] == samples.clip(-128, 127)).all()
    assert calls[0] < len(samples) / 4


def test_long_unary_parts_and_a_short_end():
    bits = np.zeros(5000, np.uint8)
    bits[[3, 4000, 4999]] = 1
    assert flac._stops(bits, 3, 0).tolist() == [3, 4000, 4999] and flac._stops(bits, 4, 0) is None
    r = flac._Reader(np.packbits(bits).tobytes(), 0, 1000)
    assert r.rice(3, 0).tolist() == [-2, 1998, 499] and r.at == 5000
    with pytest.raises(flac.FlacError):
        r.rice(1, 2)
