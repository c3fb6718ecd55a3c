"""Random choices that depend on a seed and the row's key only, so reruns and other partitionings agree."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws are whole numbers below this.
TOP = 2**60


def draw(seed: str, *key: Column) -> Column:
    """A whole number from 0 to 2^60 - 1 from the seed and the key's text."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key])), 1, 15), 16, 10).cast("long")


def crop(wave: Column, length: int, drawn: Column) -> Column:
    """``length`` samples (doubles) from a place that the draw names; shorter waves get zeros at their end."""
    spare = F.size(wave) - length
    start = F.pmod(drawn, F.greatest(spare, F.lit(0)).cast("long") + 1).cast("int")
    padded = F.concat(wave, F.array_repeat(F.lit(0.0), F.greatest(-spare, F.lit(0))))
    return F.slice(padded, start + 1, F.lit(length))


def augmentation(seed: str, key: Column, probability: float, names: list[str]) -> Column:
    """One of ``names`` with equal chances, for a share ``probability`` of keys; null for the rest."""
    some = draw(f"{seed}-whether", key) < int(probability * TOP)
    return F.when(some, F.get(F.array(*[F.lit(n) for n in names]), F.pmod(draw(f"{seed}-which", key), F.lit(len(names))).cast("int")))


def crop_set(wave: Column, length: int, whole: int, halves: int, seed: str, *key: Column) -> Column:
    """A struct of ``whole`` crops of ``length`` samples and ``halves`` of half that, from different places each, in drawn order.

    A wave without room for ``whole`` places gets zeros at its end, as many as make it.
    """
    padded = F.concat(wave, F.array_repeat(F.lit(0.0), F.greatest(length - F.size(wave) + whole, F.lit(0))))

    def places(name: str, n: int, size: int) -> Column:
        # n sorted draws below room - n + 1, each moved on by its rank, are n different places below room
        room = F.size(padded) - size
        drawn = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pmod(draw(f"{seed}-{name}", *key, i), F.greatest(room - n + 1, F.lit(1)).cast("long")))
        spread = F.transform(F.array_sort(drawn), lambda d, i: (d + i).cast("int"))
        mixed = F.array_sort(F.transform(spread, lambda p, i: F.struct(draw(f"{seed}-{name}-order", *key, i).alias("o"), p.alias("p"))))
        return F.transform(mixed, lambda x: F.slice(padded, x["p"] + 1, F.lit(size)))

    return F.struct(places("whole", whole, length).alias("whole"), places("halves", halves, length // 2).alias("halves"))


def normal(seed: str, *key: Column) -> Column:
    """A standard normal number from the seed and the key: Box and Muller's transform of two draws."""
    u, v = ((draw(f"{seed}-{name}", *key) + 0.5) / float(TOP) for name in ("radius", "angle"))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def dithered(wave: Column, amount: float, seed: str, *key: Column) -> Column:
    """``wave`` with ``amount`` times normal noise added to each sample."""
    return wave if not amount else F.transform(wave, lambda x, i: x + amount * normal(seed, *key, i))
