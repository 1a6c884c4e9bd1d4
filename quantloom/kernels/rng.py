"""Reproducible random streams: PCG-64 XSL-RR, xoshiro256** and a polar Gaussian sampler. No Spark."""

from __future__ import annotations

import math

import numpy as np

_64, _128 = (1 << 64) - 1, (1 << 128) - 1

# The multiplier and default increment of PCG's 128-bit generator, SplitMix64's constants, xoshiro256's jump polynomial.
PCG_MULTIPLIER = 47026247687942121848144207491837523525
PCG_INCREMENT = 117397592171526113268558934119004209487
SPLITMIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
XOSHIRO_JUMP = (0x180EC6D33CFD0ABA, 0xD5A61266F0C9392C, 0xA9582618E03FC9AA, 0x39ABDC4529B1661C)


class Source:
    """Draws built on next_u64()."""

    def next_u64(self) -> int:
        raise NotImplementedError

    def next_u32(self) -> int:
        return self.next_u64() >> 32

    def next_double(self) -> float:
        """Uniform on [0, 1) with 53 bits."""
        return (self.next_u64() >> 11) * 2.0**-53

    def next_int(self, n: int) -> int:
        """Uniform on 0..n-1 by multiply-shift on 32 bits, with rejection."""
        if n <= 0:
            raise ValueError("n must be positive")
        m = self.next_u32() * n
        if (m & 0xFFFFFFFF) < n:
            floor = (1 << 32) % n
            while (m & 0xFFFFFFFF) < floor:
                m = self.next_u32() * n
        return m >> 32

    def ints(self, count: int, n: int) -> np.ndarray:
        return np.fromiter((self.next_int(n) for _ in range(count)), np.int64, count)


class Pcg64(Source):
    """128-bit linear congruential state; a number comes from the state before the step. stream 0 is the default stream."""

    def __init__(self, seed: int, stream: int = 0):
        self.step = PCG_INCREMENT if stream == 0 else ((stream << 1) | 1) & _128
        self.state = (self.step + (seed & _64)) & _128
        self.state = (self.state * PCG_MULTIPLIER + self.step) & _128

    def next_u64(self) -> int:
        s = self.state
        self.state = (s * PCG_MULTIPLIER + self.step) & _128
        folded, turn = ((s >> 64) ^ s) & _64, s >> 122
        return ((folded >> turn) | (folded << (64 - turn))) & _64 if turn else folded


class Xoshiro(Source):
    """xoshiro256**, seeded by SplitMix64; jump() goes 2**128 steps ahead."""

    def __init__(self, seed: int):
        z, self.s = seed & _64, []
        for _ in range(4):
            z = (z + SPLITMIX[0]) & _64
            x = ((z ^ (z >> 30)) * SPLITMIX[1]) & _64
            x = ((x ^ (x >> 27)) * SPLITMIX[2]) & _64
            self.s.append(x ^ (x >> 31))

    def next_u64(self) -> int:
        turn = lambda x, k: ((x << k) | (x >> (64 - k))) & _64
        a, b, c, d = self.s
        out = (turn((b * 5) & _64, 7) * 9) & _64
        c, d = c ^ a, d ^ b
        self.s = [a ^ d, b ^ c, c ^ ((b << 17) & _64), turn(d, 45)]
        return out

    def jump(self) -> None:
        total = [0, 0, 0, 0]
        for word in XOSHIRO_JUMP:
            for bit in range(64):
                if word >> bit & 1:
                    total = [x ^ y for x, y in zip(total, self.s, strict=True)]
                self.next_u64()
        self.s = total


class Gaussian:
    """Marsaglia's polar method; the second of each pair is kept for the next call."""

    def __init__(self, source: Source):
        self.source, self.spare = source, None

    def next(self, mean: float = 0.0, sd: float = 1.0) -> float:
        if self.spare is None:
            while True:
                u, v = 2 * self.source.next_double() - 1, 2 * self.source.next_double() - 1
                s = u * u + v * v
                if 0 < s < 1:
                    break
            f = math.sqrt(-2 * math.log(s) / s)
            z, self.spare = u * f, v * f
        else:
            z, self.spare = self.spare, None
        return mean + sd * z

    def batch(self, n: int) -> np.ndarray:
        return np.fromiter((self.next() for _ in range(n)), float, n)
