"""Morton codes as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits per axis: 32-bit codes in 2-D, 30-bit codes in 3-D.
BITS = {2: 16, 3: 10}


def quantize(x: Column, lo: Column, hi: Column, bits: int) -> Column:
    """The bin of a coordinate inside bounds, clamped; 0 where the bounds have no extent."""
    bins = 1 << bits
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))
    return F.when(hi > lo, F.least(F.floor(unit * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")


def spread(v: Column, bits: int, dims: int) -> Column:
    """The bits of ``v`` with ``dims - 1`` zeros between neighbours, by doubling gaps."""
    width = 1
    while width < bits:
        width *= 2
    while width > 1:
        width //= 2
        block = (1 << width) - 1
        mask = sum(block << (dims * width * k) for k in range(-(-bits // width)))
        v = (v.bitwiseOR(F.shiftleft(v, (dims - 1) * width))).bitwiseAND(F.lit(mask))
    return v


def morton_code(x: Sequence[Column], lo: Sequence[Column], hi: Sequence[Column]) -> Column:
    """Interleaved bins; the first axis has bit 0."""
    dims, bits = len(x), BITS[len(x)]
    parts = (F.shiftleft(spread(quantize(c, a, b, bits), bits, dims), k) for k, (c, a, b) in enumerate(zip(x, lo, hi, strict=True)))
    return reduce(lambda s, t: s.bitwiseOR(t), parts)
