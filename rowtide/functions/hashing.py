"""The public FarmHash Fingerprint64 (MIT licence), which stored computed shard columns are made with.

Its constants and the order of its steps are fixed by the values it must give.

Spark has no built-in for it; it runs over Arrow batches, on all values of one length at
once, in 64-bit arithmetic that wraps around.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the published algorithm.
_K0, _K1, _K2 = (np.uint64(k) for k in (0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F))

#: Numbers of 64 bits, one for each value; ``Bytes`` has a row for each value.
Words = np.ndarray
Bytes = np.ndarray
#: Bytes that are worked on at once.
SLICE = 8 << 20


def _const(n: int) -> np.uint64:
    return np.uint64(n % (1 << 64))


def _number(s: Bytes, i: int, width: int = 8) -> Words:
    return np.ascontiguousarray(s[:, i : i + width]).view(f"<u{width}")[:, 0].astype(np.uint64)


def _turn(x: Words, n: int) -> Words:
    return x >> np.uint64(n) | x << np.uint64(64 - n)


def _fold(x: Words) -> Words:
    return x ^ x >> np.uint64(47)


def _join(u: Words, v: Words, mul: Words) -> Words:
    a = _fold((u ^ v) * mul)
    return _fold((v ^ a) * mul) * mul


def _lane(s: Bytes, i: int, a: Words, b: Words) -> tuple[Words, Words]:
    w, x, y, z = (_number(s, i + k) for k in (0, 8, 16, 24))
    a = a + w
    b = _turn(b + a + z, 21)
    c = a
    a = a + x + y
    return a + z, b + _turn(a, 44) + c


def _same_length(s: Bytes) -> Words:
    n = s.shape[1]
    if n <= 16:
        return _short(s, n)
    if n <= 64:
        mul = _const(int(_K2) + n * 2)
        first = _number(s, 0) * (_K1 if n <= 32 else _K2)
        b, c, d = _number(s, 8), _number(s, n - 8) * mul, _number(s, n - 16) * _K2
        y = _turn(first + b, 43) + _turn(c, 30) + d
        z = first + _turn(b + _K2, 18) + c
        if n <= 32:
            return _join(y, z, mul)
        z = _join(y, z, mul)
        e, f = _number(s, 16) * mul, _number(s, 24)
        g, h = (y + _number(s, n - 32)) * mul, (z + _number(s, n - 24)) * mul
        return _join(_turn(e + f, 43) + _turn(g, 30) + h, e + _turn(f + first, 18) + g, mul)
    return _long(s, n)


def _short(s: Bytes, n: int) -> Words:
    mul = _const(int(_K2) + n * 2)
    if n >= 8:
        a, b = _number(s, 0) + _K2, _number(s, n - 8)
        return _join(_turn(b, 37) * mul + a, (_turn(a, 25) + b) * mul, mul)
    if n >= 4:
        return _join(np.uint64(n) + (_number(s, 0, 4) << np.uint64(3)), _number(s, n - 4, 4), mul)
    if n:
        at = lambda i: s[:, i].astype(np.uint64)
        y, z = at(0) + (at(n >> 1) << np.uint64(8)), np.uint64(n) + (at(n - 1) << np.uint64(2))
        return _fold(y * _K2 ^ z * _K0) * _K2
    return np.full(len(s), _K2)


def _block(s: Bytes, at: int, state: tuple, mul: Words, times: int) -> tuple:
    """Takes 64 bytes into (x, y, z, v, w)."""
    x, y, z, v, w = state
    many = np.uint64(times)
    x = _turn(x + y + v[0] + _number(s, at + 8), 37) * mul
    y = _turn(y + v[1] + _number(s, at + 48), 42) * mul
    x = x ^ w[1] * many
    y = y + v[0] * many + _number(s, at + 40)
    z = _turn(z + w[0], 33) * mul
    v = _lane(s, at, v[1] * mul, x + w[0])
    w = _lane(s, at + 32, z + w[1], y + _number(s, at + 16))
    return z, y, x, v, w


def _long(s: Bytes, n: int) -> Words:
    none, y = np.zeros(len(s), np.uint64), np.full(len(s), _const(81 * int(_K1) + 113))
    state = (_const(81 * int(_K2)) + _number(s, 0), y, _fold(y * _K2 + np.uint64(113)) * _K2, (none, none), (none, none))
    for at in range(0, (n - 1) // 64 * 64, 64):
        state = _block(s, at, state, _K1, 1)
    # The last 64 bytes once more, with another factor.
    x, y, z, v, w = state
    mul = _K1 + ((z & np.uint64(0xFF)) << np.uint64(1))
    low = w[0] + np.uint64(n - 1 & 63)
    first = v[0] + low
    x, y, z, v, w = _block(s, n - 64, (x, y, z, (first, v[1]), (low + first, w[1])), mul, 9)
    return _join(_join(v[0], w[0], mul) + _fold(y) * _K0 + z, _join(v[1], w[1], mul) + x, mul)


def fingerprints(values: pa.Array) -> np.ndarray:
    """Signed 64-bit fingerprints of binary values that are not null."""
    n = len(values)
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = values.buffers()[2]
    data, lens, found = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8), np.diff(offsets), np.zeros(n, np.uint64)
    for size in np.unique(lens).tolist():
        own, step = np.flatnonzero(lens == size), max(1, SLICE // max(1, size))
        for at in (own[i : i + step] for i in range(0, len(own), step)):
            found[at] = _same_length(data[offsets[at][:, None] + np.arange(size)].reshape(len(at), size))
    return found.view(np.int64)


def fingerprint64(s: bytes) -> int:
    """Signed 64-bit fingerprint of one value."""
    return int(fingerprints(pa.array([s], pa.binary()))[0])


def farm_fingerprint(c: Column) -> Column:
    """Fingerprint of a string or binary column; null for null."""

    @F.arrow_udf("long")
    def run(values: pa.Array) -> pa.Array:
        there = values.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(len(values), np.int64)
        out[there] = fingerprints(values.drop_null())
        return pa.array(out, mask=~there)

    return run(c.cast("binary"))
