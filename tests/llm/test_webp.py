"""Lossless WebP: round trips of every part, and files built bit by bit from the format."""

import struct

import numpy as np
import pytest

from loomtext.llm import webp

OPTIONS = [
    {}, {"subtract": True}, {"cache_bits": 1}, {"cache_bits": 10}, {"cross": (9, -20, 77)}, {"palette": True}, {"palette": True, "cache_bits": 4},
    *({"predictor": p} for p in range(16)), {"predictor": tuple(range(16))}, {"predictor": (1, 12), "cross": (-5, 5, 1), "subtract": True, "cache_bits": 3},
]


@pytest.mark.parametrize("options", OPTIONS, ids=str)
def test_round_trip(options):
    rng = np.random.default_rng(8)
    for shape in ((1, 1), (1, 90), (5, 40), (23, 17), (40, 16)):
        few = rng.choice(rng.integers(0, 2**32, 20, dtype=np.uint32), shape)
        tiled = np.resize(rng.integers(0, 2**32, 37, dtype=np.uint32), shape)
        for pixels in (few, tiled, *([] if options.get("palette") else [rng.integers(0, 2**32, shape, dtype=np.uint32)])):
            wide = -(-shape[1] >> webp.palette_bits(len(np.unique(pixels)))) if options.get("palette") else shape[1]
            blocks = rng.integers(0, 3, (-(-shape[0] >> 3), -(-wide >> 3)))
            for groups in (None, (3, blocks)):
                assert np.array_equal(webp.decode(webp.encode(pixels, **options, groups=groups)), pixels)


def test_back_references_reach_near_and_far_pixels():
    rng = np.random.default_rng(9)
    row = rng.integers(0, 2**32, 16, dtype=np.uint32)
    pixels = np.concatenate([row, rng.integers(0, 2**32, 3000, dtype=np.uint32), row, row, rng.integers(0, 2**32, 16 * 9 - 8, dtype=np.uint32)])
    found = webp.repeats(pixels)
    assert [(size, distance) for _, size, distance in found] == [(16, 3016), (16, 16)]
    assert webp.distance_codes(16)[16] == 1 and webp.distance_codes(16)[1] == 2 and webp.distance_codes(16)[17] in (3, 4)
    plane = np.resize(pixels, (-(-len(pixels) // 16), 16))
    assert np.array_equal(webp.decode(webp.encode(plane)), plane)


def test_the_fast_path_reads_what_the_slow_one_reads():
    rng = np.random.default_rng(10)
    for _ in range(10):
        pixels = np.resize(rng.choice(rng.integers(0, 2**32, 50, dtype=np.uint32), rng.integers(70, 900)), (64, 16))
        stored = webp.encode(pixels)
        fast, webp.read_fast = webp.read_fast, lambda bits, width, n, codes: webp.read_slowly(bits, width, n, [codes], lambda x, y: 0, 0)
        try:
            slow = webp.decode(stored)
        finally:
            webp.read_fast = fast
        assert np.array_equal(slow, webp.decode(stored)) and np.array_equal(slow, pixels)


def test_every_choice_of_the_store_is_used():
    seen = set()
    for rows in range(1, 30):
        payload = webp.payload_of((b"some text, row %d. " % rows * 200)[: 64 * rows])
        chosen = webp.chosen(np.frombuffer(payload, "<u4").reshape(-1, 16))
        seen |= {k for k, v in chosen.items() if v is not False}
        assert webp.load(webp.store(payload), len(payload)) == payload
    assert {"palette", "cache_bits", "predictor", "cross", "subtract", "groups"} <= seen


def test_the_choice_does_not_go_by_the_size():
    """Every kind is met among images of one size, small or large."""
    rng = np.random.default_rng(11)
    for rows in (2, 10, 18, 60):
        seen = set()
        for _ in range(400):
            plane = rng.choice(rng.integers(0, 2**32, 40, dtype=np.uint32), (rows, 16))
            seen |= {k for k, v in webp.chosen(plane).items() if v is not False} or {"plain"}
            if rows == 60:
                assert webp.load(webp.store(plane.tobytes()), plane.nbytes) == plane.tobytes()
        assert seen >= {"palette", "cache_bits", "predictor", "cross", "groups"} and seen & {"subtract", "plain"}


@pytest.mark.parametrize("options", [{"cache_bits": 6}, {"cache_bits": 1, "groups": 3}, {"groups": 2}, {"groups": 4}, {"groups": 5}], ids=str)
def test_the_fast_path_reads_groups_and_caches_as_the_slow_one(options, monkeypatch):
    rng = np.random.default_rng(12)
    for _ in range(5):
        pixels = np.resize(rng.choice(rng.integers(0, 2**32, 50, dtype=np.uint32), rng.integers(70, 900)), (64, 16))
        groups = (3, rng.permutation(np.arange(16) % options["groups"]).reshape(8, 2)) if "groups" in options else None
        stored = webp.encode(pixels, cache_bits=options.get("cache_bits", 0), groups=groups)
        with monkeypatch.context() as m:
            m.setattr(webp, "_GROUPS", 0)
            slow = webp.decode(stored)
        assert np.array_equal(slow, pixels) and np.array_equal(webp.decode(stored), pixels)
        with monkeypatch.context() as m:
            m.setattr(webp, "_BLOCK", 64)
            assert np.array_equal(webp.decode(stored), pixels)


class Plain:
    """A file written field by field, with fixed-length codes, by the format alone."""

    def __init__(self, width, height):
        self.bits = []
        for value, size in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
            self.put(value, size)

    def put(self, value, size):
        self.bits += [value >> i & 1 for i in range(size)]

    def simple(self, *symbols):
        self.put(1, 1)
        self.put(len(symbols) - 1, 1)
        self.put(1, 1)
        for s in symbols:
            self.put(s, 8)

    def flat(self, alphabet, symbols):
        """A code in which each of four symbols has two bits; lengths are 0 or 2, one bit each."""
        assert len(symbols) == 4
        self.put(0, 1)
        order = (17, 18, 0, 1, 2)
        self.put(1, 4)
        for s in order:
            self.put(1 if s in (0, 2) else 0, 3)
        self.put(0, 1)
        for s in range(alphabet):
            self.put(1 if s in symbols else 0, 1)
        self.codes = {s: i for i, s in enumerate(sorted(symbols))}

    def symbol(self, codes, s):
        for i in (1, 0):  # a code's first bit is its highest
            self.put(codes[s] >> i & 1, 1)

    def file(self):
        bits = self.bits + [0] * (-len(self.bits) % 16)
        data = bytes(sum(b << i for i, b in enumerate(bits[at : at + 8])) for at in range(0, len(bits), 8))
        return b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


def test_a_file_of_another_make():
    """Two literals, a copy of one pixel above (distance code 1), a run to the left (code 2)."""
    f = Plain(4, 3)
    f.put(0, 1)  # no transform
    f.put(0, 1)  # no cache
    f.put(0, 1)  # one group
    f.flat(280, (7, 9, 256 + 2, 256 + 0))
    green = f.codes
    f.simple(1)
    f.simple(2)
    f.simple(255)
    f.simple(0, 1)  # distance prefixes 0 and 1: codes 1 and 2
    f.symbol(green, 7)
    f.symbol(green, 9)
    f.symbol(green, 256 + 2)  # length 3
    f.put(1, 1)  # the pixel to the left: 9 9 9
    f.symbol(green, 256 + 0)  # length 1
    f.put(0, 1)  # the pixel above, (1, 1): 9
    for _ in range(2):
        f.symbol(green, 7)
    f.symbol(green, 256 + 2)
    f.put(0, 1)  # three pixels above, from (0, 2): row 1 is 9 9 7 7
    f.symbol(green, 9)
    rows = np.array([[7, 9, 9, 9], [9, 9, 7, 7], [9, 9, 7, 9]], np.uint32)
    assert np.array_equal(webp.decode(f.file()), 0xFF000000 | 1 << 16 | rows << 8 | 2)


def test_a_file_with_subtract_green_and_cache():
    f = Plain(3, 1)
    f.put(1, 1)
    f.put(2, 2)  # subtract green
    f.put(0, 1)
    f.put(1, 1)
    f.put(1, 4)  # a cache of two colours
    f.put(0, 1)
    pixel = 0xFF000000 | 5 << 16 | 9 << 8 | 6  # as stored: red 5, green 9, blue 6
    slot = (0x1E35A7BD * pixel & 0xFFFFFFFF) >> 31
    f.flat(282, (9, 3, 280, 281))
    green = f.codes
    f.simple(5)
    f.simple(6)
    f.simple(255)
    f.simple(0)
    f.symbol(green, 9)
    f.symbol(green, 280 + slot)
    f.symbol(green, 9)
    assert np.array_equal(webp.decode(f.file()), np.full((1, 3), 0xFF000000 | 14 << 16 | 9 << 8 | 15, np.uint32))


@pytest.mark.parametrize("damage", [b"", b"RIFF", b"\0" * 40])
def test_what_is_no_file_is_refused(damage):
    with pytest.raises(ValueError):
        webp.decode(damage)
