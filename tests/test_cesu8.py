"""Modified UTF-8 against an independent grammar."""

import itertools
import random

import pytest

from tagloom.functions import cesu8
from tagloom.functions.errors import DocumentError

ACCEPTED = ["", "6162", "C3A9E697A5E69CAC", "C080", "78C08079", "EDA081EDB081", "4DE697A5EDA081EDB0817F", "EFBFBF"]
REFUSED = "00 610062 F09F9880 78F09F988079 C0 C081 C180 80 EDA081 EDA08141 EDA081EDA081 EDB081EDA081 E08080 E09FBFC080 EDBFBFC080 C241C080 F4908080 00C080 C080F09F9880 FF".split()
EDGES = bytes.fromhex("00417F808F909FA0BFC0C1C2DFE0EDEEEFF0F4F5FF")


def grammar(data: bytes) -> bool:
    at, half = 0, False
    while at < len(data):
        a = data[at]
        more = 0 if 1 <= a <= 0x7F else 1 if a == 0xC0 or 0xC2 <= a <= 0xDF else 2 if 0xE0 <= a <= 0xEF else None
        if more is None or at + more >= len(data):
            return False
        rest = data[at + 1 : at + 1 + more]
        if any(not 0x80 <= b <= 0xBF for b in rest) or a == 0xC0 and rest != b"\x80":
            return False
        low = False
        if more == 2:
            point = (a & 15) << 12 | (rest[0] & 63) << 6 | rest[1] & 63
            if point < 0x800:
                return False
            low = 0xDC00 <= point <= 0xDFFF
            if low != half:
                return False
            half = 0xD800 <= point <= 0xDBFF
        elif half:
            return False
        at += more + 1
    return not half


@pytest.mark.parametrize("data", ACCEPTED)
def test_accepted(data):
    data = bytes.fromhex(data)
    assert cesu8.encode(cesu8.decode(data)) == data


@pytest.mark.parametrize("data", REFUSED)
def test_refused(data):
    with pytest.raises(DocumentError):
        cesu8.decode(bytes.fromhex(data))


def test_exhaustive_edges():
    for n in (1, 2, 3):
        for data in map(bytes, itertools.product(EDGES, repeat=n)):
            assert cesu8.valid(data) == grammar(data), data.hex()


def test_random_spellings():
    rng = random.Random(7)
    pieces = [b"\xed\xa0\x81", b"\xed\xb0\x81", b"\xc0\x80", b"a", "é".encode(), "日".encode(), b"\x80", b"\xf0"]
    for _ in range(20_000):
        data = b"".join(rng.choice(pieces) for _ in range(rng.randrange(8)))
        assert cesu8.valid(data) == grammar(data), data.hex()
    for _ in range(5_000):
        text = "".join(chr(rng.choice((0, 65, 0x7FF, 0x800, 0xFFFF, 0x10000, 0x10FFFF, 0x1F980))) for _ in range(rng.randrange(9)))
        assert cesu8.decode(cesu8.encode(text)) == text
