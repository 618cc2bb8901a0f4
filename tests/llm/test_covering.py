"""What anchor-point covering with the perfect Golay code would cost problem 2: the figures of the README, on made sets."""

import numpy as np
import pytest

from quarryline.llm import near_duplicates as nd

LENGTH, RADIUS = 23, 3


@pytest.fixture(scope="module")
def code():
    generator = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
    words = set()
    for m in range(1 << 12):
        c = 0
        for i in range(12):
            if m >> i & 1:
                c ^= generator << i
        words.add(c)
    return np.array(sorted(words), np.uint32)


def distances(parts, code):
    return np.bitwise_count(parts[:, None] ^ code[None])


def test_the_code_is_perfect(code):
    assert len(code) == 4096 and np.bitwise_count(code[1:]).min() == 2 * RADIUS + 1
    points = np.random.default_rng(0).integers(0, 1 << LENGTH, 2000).astype(np.uint32)
    assert ((distances(points, code) <= RADIUS).sum(axis=1) == 1).all()
    for allowed in (1, 2):
        spread, _ = nd.code_cost(allowed)
        assert abs((distances(points, code) <= RADIUS + allowed).sum(axis=1).mean() - spread) < 0.1 * spread


def made_pairs(similarity, n, bits, rng):
    """One-bit minimum hashes of pairs of sets: bits agree with probability (1 + similarity) / 2."""
    a = rng.integers(0, 2, (n, bits))
    return a, np.where(rng.random((n, bits)) < (1 - similarity) / 2, 1 - a, a)


def packed(bits):
    return [(bits[:, i : i + LENGTH] << np.arange(LENGTH)).sum(axis=1).astype(np.uint32) for i in range(0, bits.shape[1], LENGTH)]


def meet(a, b, code, allowed):
    """Whether one lies at the other's own anchor, in some part."""
    met = np.zeros(len(a[0]), bool)
    for x, y in zip(a, b):
        dx, dy = distances(x, code), distances(y, code)
        rows = np.arange(len(x))
        met |= (dy[rows, dx.argmin(axis=1)] <= RADIUS + allowed) | (dx[rows, dy.argmin(axis=1)] <= RADIUS + allowed)
    return met


def test_guarantee_and_cost(code):
    rng = np.random.default_rng(4)
    a, b = made_pairs(0.6, 1500, 9 * LENGTH, rng)
    pa, pb = packed(a), packed(b)
    for allowed in (0, 1, 2):
        near = np.min([np.bitwise_count(x ^ y) for x, y in zip(pa, pb)], axis=0) <= allowed
        assert meet(pa, pb, code, allowed)[near].all()  # what the covering guarantees
    # As many anchors a record as p2_found has lines: nine parts of one bit allowed, some 48 anchors.
    spread, share = nd.code_cost(1)
    assert 47 < 9 * spread < 49
    found = meet(pa, pb, code, 1).mean()
    assert found < 0.97 < 1 - nd.miss_rate(0.6)
    strangers = meet(pa, packed(rng.integers(0, 2, (1500, 9 * LENGTH))), code, 1).mean()
    assert strangers > 0.01  # of all pairs of unrelated records, which p2_found has next to none of
