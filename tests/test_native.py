"""The kernels in C give what the plain forms give, and the plain forms run without them."""

import random

import pyarrow as pa
import pytest

from weftlink.functions import native, udfs


def texts():
    r = random.Random(5)
    out = ["", "a", "b", "ab", "alpha beta", "é क्ष 😀 a", "x" * 64, "x" * 65, "ab" * 64]
    return out + ["".join(r.choice("abcde fé😀") for _ in range(r.randrange(200))) for _ in range(40)]


@pytest.mark.parametrize("most", [None, 40])
@pytest.mark.parametrize("prefix", ["run", "any"])
def test_jaro_winkler(most, prefix):
    both = [(a, b) for a in texts() for b in texts()]
    got = native.jaro_winkler(*(pa.array(c) for c in zip(*both)), most, prefix)
    assert got is None or got.tolist() == [udfs.jaro_winkler_of(a, b, most, prefix) for a, b in both]


def test_subsequences():
    both = [(a, b) for a in texts() for b in texts()]
    got = native.lcs(*(pa.array(c) for c in zip(*both)))
    if got is not None:
        assert [list(map(int, x)) for x in zip(*got)] == [[udfs.lcs_length(a, b), len(a), len(b)] for a, b in both]
        assert native.lcs(pa.array(["zz", None, "ab"]).slice(1), pa.array(["a", "b", "b"]).slice(1))[0].tolist() == [0, 1]
