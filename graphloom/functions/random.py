"""Arithmetic random numbers that every SQL engine with 64-bit integers reproduces."""

from __future__ import annotations

MODULUS = 2147483647


def uniform(a: str, b: str = "0", seed: int = 1) -> str:
    """A SQL expression in [0, 1) for integer expressions a and b: three rounds of two multiplications modulo a prime."""
    x = str((seed * 48271 + 12345) % MODULUS)
    for z in (f"cast({a} as bigint)", f"cast({b} as bigint)", "7"):
        x = f"((({x} + {z} * cast(69621 as bigint) + 1) % {MODULUS}) * (({x} + {z} * cast(40692 as bigint) + 3) % {MODULUS}) % {MODULUS})"
    return f"(cast({x} as double) / cast({MODULUS} as double))"
