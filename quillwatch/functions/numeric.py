"""Exact decimal rounding of doubles, and tolerant number coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW_BITS = (1 << 30) - 1


def _scaled_units(x: Column, digits: int, shift: int) -> Column:
    """``x * 10**digits`` rounded half-even, where ``x * 2**shift`` is a long integer.

    Scaling by a power of two is exact, so the product with ``10**digits`` can be
    formed exactly from two 30-bit halves without leaving long arithmetic.
    """
    mantissa = (x * F.lit(2.0**shift)).cast("long")
    ten = F.lit(10**digits)
    high = F.shiftright(mantissa, 30) * ten
    low = mantissa.bitwiseAND(F.lit(_LOW_BITS)) * ten
    top = high + F.shiftright(low, 30)
    rest = low.bitwiseAND(F.lit(_LOW_BITS))
    bits = shift - 30
    half = 1 << (bits - 1)
    up = F.shiftright(top + F.lit(half), bits)
    # an exact tie above an even step was rounded up and has to stay down
    even_tie = (top.bitwiseAND(F.lit((1 << (bits + 1)) - 1)) == half) & (rest == 0)
    return up - even_tie.cast("bigint")


def unit_interval_units(x: Column, digits: int = 4) -> Column:
    """Half-even count of ``10**-digits`` steps in the exact value of ``x`` (0 <= x <= 1).

    Spark's own ``round``/``bround`` go through the shortest decimal text of the
    double and are off by one step on some products of weights.
    """
    if not 0 < digits <= 4:
        raise ValueError("digits must be between 1 and 4")
    return (
        # a double of at least 2**-8 has no bits below 2**-60
        F.when(x >= 2.0**-8, _scaled_units(x, digits, 60))
        # down to 2**-16 none below 2**-68; anything smaller rounds to zero
        .when(x >= 2.0**-16, _scaled_units(x, digits, 68))
        .otherwise(F.lit(0).cast("long"))
    )


def round_unit(x: Column, digits: int = 4) -> Column:
    """Correctly rounded ``x`` for values in [0, 1]."""
    return unit_interval_units(x, digits) / F.lit(float(10**digits))


def fixed_text(x: Column, digits: int) -> Column:
    """``x`` in [0, 1] with exactly ``digits`` decimals, half-even on the exact double."""
    units = unit_interval_units(x, digits)
    scale = 10**digits
    return F.concat(
        (units / scale).cast("long").cast("string"),
        F.lit("."),
        F.lpad((units % scale).cast("string"), digits, "0"),
    )


def clamp_unit(value: Column) -> Column:
    """Number or numeric text clamped to [0, 1]; anything else is 0."""
    number = F.coalesce(value.try_cast("double"), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))


def positive_long(value: Column, default: Column | int = 1, text_allowed: bool = True) -> Column:
    """A positive integer, or the default for nulls, unparsable, zero and negative input.

    With ``text_allowed`` integer text such as ``"7"`` counts; otherwise only a column
    that already holds whole numbers should be passed in.
    """
    fallback = default if isinstance(default, Column) else F.lit(default)
    number = value.try_cast("long") if text_allowed else value
    return F.when(number > 0, number).otherwise(fallback).cast("long")
