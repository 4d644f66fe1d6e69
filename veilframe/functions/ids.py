"""Subject ids and replacement uids as expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Four distinct letters then four distinct digits: 26*25*24*23 * 10*9*8*7 codes.
RADICES = (26, 25, 24, 23, 10, 9, 8, 7)
CODES = 26 * 25 * 24 * 23 * 10 * 9 * 8 * 7
_HALF = 42_525  # its square is the least one that holds all codes, so almost every number is one
_WALK = 3
ROUNDS = 4


def _feistel(n: Column, secret: str) -> Column:
    """A keyed permutation of the numbers below _HALF squared. Rounds are a fold, so each half is worked out once."""
    start = F.struct(F.floor(n / _HALF).cast("long").alias("left"), F.pmod(n, F.lit(_HALF)).cast("long").alias("right"))

    def step(a: Column, i: Column) -> Column:
        key = F.sha2(F.concat(F.lit(f"{secret}|"), i.cast("string"), F.lit("|"), a["right"].cast("string")), 256)
        return F.struct(a["right"].alias("left"), F.pmod(a["left"] + F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(_HALF)).alias("right"))

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, step, lambda a: a["left"] * _HALF + a["right"])


def unrank(p: Column) -> Column:
    """The code of number p in [0, CODES): digits of p in falling radices pick what is left of the letters, then of the figures."""
    return F.get(F.transform(F.array(p), _code), F.lit(0))  # so p is worked out once


def _code(p: Column) -> Column:
    rest, digits = p, []
    for r in reversed(RADICES):
        digits.append(F.pmod(rest, F.lit(r)))
        rest = F.floor(rest / r).cast("long")
    digits = F.array(*[d.cast("int") for d in reversed(digits)])

    def pick(alphabet: str, some: Column) -> Column:
        start = F.struct(F.lit(alphabet).alias("left"), F.lit("").alias("out"))

        def step(acc: Column, d: Column) -> Column:
            taken = F.substr(acc["left"], d + 1, F.lit(1))
            return F.struct(F.concat(F.substr(acc["left"], F.lit(1), d), F.substr(acc["left"], d + 2)).alias("left"), F.concat(acc["out"], taken).alias("out"))

        return F.aggregate(some, start, step, lambda a: a["out"])

    return F.concat(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", F.slice(digits, 1, 4)), pick("0123456789", F.slice(digits, 5, 4)))


def rank(code: str) -> int:
    """The number of a code; the inverse of unrank, on the driver."""
    letters, figures, out = list("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), list("0123456789"), 0
    for r, ch in zip(RADICES, code):
        left = letters if r > 10 else figures
        out = out * r + left.index(ch)
        left.remove(ch)
    return out


def permuted(n: Column, secret: str) -> Column:
    """A keyed permutation of [0, CODES): numbers that leave the range, about one in 76,000, walk on. Null past three steps; callers leave such numbers out."""
    out = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), _feistel(n, secret), lambda a, _: F.when(a < CODES, a).otherwise(_feistel(a, secret)))
    return F.when(out < CODES, out)


def new_uid(secret: str, *parts: Column) -> Column:
    """A uid below 2.25 of two 60-bit halves of a keyed hash; the same inputs give the same uid in every attempt."""
    h = F.sha2(F.concat_ws("|", F.lit(secret), *parts), 256)
    half = lambda at: F.conv(F.substring(h, at, 15), 16, 10)
    return F.concat(F.lit("2.25."), half(1), F.lpad(half(16), 19, "0"))


def permuted_number(n: int, secret: str) -> int:
    """permuted() on the driver, for tests."""
    x = n
    for _ in range(_WALK + 1):
        left, right = x // _HALF, x % _HALF
        for i in range(ROUNDS):
            left, right = right, (left + int(hashlib.sha256(f"{secret}|{i}|{right}".encode()).hexdigest()[:8], 16)) % _HALF
        x = left * _HALF + right
        if x < CODES:
            return x
    raise ValueError("no step stayed in the range")
