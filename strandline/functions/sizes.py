"""Column functions on sizes: bytes with a unit, powers of two and four."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = "BKMGT"


def byte_size(text: Column) -> Column:
    """Bytes of a size such as 10, 1.5K, 2 M or 3g (binary units up to T). An empty text, a unit alone and a negative size are 0; other text and null give null."""
    t = F.upper(F.trim(F.translate(text, "\t\r\n", "   ")))
    unit = F.instr(F.lit(_UNITS), F.right(t, F.lit(1)))
    unit = F.when(t == "", 0).otherwise(unit)
    number = F.trim(F.when(unit > 0, F.left(t, F.length(t) - 1)).otherwise(t))
    scale = F.pow(F.lit(1024.0), F.greatest(unit - 1, F.lit(0)))
    value = F.when(number.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(E[+-]?[0-9]+)?$"), number.try_cast("double"))
    return F.when(number == "", F.lit(0).cast("long")).otherwise(F.floor(F.greatest(value, value * 0) * scale).cast("long"))


def next_power_of_two(n: Column) -> Column:
    """The least power of two that is n or more; 1 for n below 1; n is 2**62 at most."""
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n - 1))).cast("long"))


def is_power_of_four(n: Column) -> Column:
    return (n > 0) & (F.bit_count(n) == 1) & (n % 3 == 1)
