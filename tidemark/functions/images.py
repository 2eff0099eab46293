"""Order-preserving long images of numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.arrays import let

FRACTION = 1 << 52
INFINITE = 2047 * FRACTION
LOWEST_EXPONENT = -1022
LONG_DIGITS = 18


def double_image(value: Column) -> Column:
    """A long that orders as doubles do: equal values share one, NaN comes last.

    The exponent is estimated by a logarithm and put right by comparison with
    exact powers of two; the fraction is then a whole number.  The result is the
    number's bit pattern, with the sign applied to it.
    """

    def power(exponent: Column) -> Column:
        return F.pow(F.lit(2.0), exponent)

    def finite(size: Column) -> Column:
        def fixed(guess: Column) -> Column:
            exact = F.when(power(guess) > size, guess - 1).when(power(guess + 1) <= size, guess + 1).otherwise(guess)
            return let(F.greatest(exact, F.lit(LOWEST_EXPONENT)), packed)

        def packed(exponent: Column) -> Column:
            fraction = size * power(-exponent) * float(FRACTION)
            return (exponent - LOWEST_EXPONENT).cast("long") * F.lit(FRACTION) + fraction.cast("long")

        # held inside the range whose powers are doubles
        guess = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(LOWEST_EXPONENT))
        return let(guess, fixed)

    def signed(x: Column) -> Column:
        infinite = F.abs(x) == float("inf")
        size = F.when(F.isnan(x), F.lit(INFINITE + 1)).when(x == 0, F.lit(0)).when(infinite, F.lit(INFINITE))
        image = size.otherwise(let(F.abs(x), finite))
        return let(image, lambda i: F.when(x < 0, -i).otherwise(i))

    return F.when(value.isNotNull(), let(value.cast("double"), signed))


def long_image(value: Column, kind: T.DataType) -> Column | None:
    """The image of a number of type ``kind``, or None where 64 bits cannot hold it."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return value.cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return double_image(value)
    if isinstance(kind, T.DecimalType) and kind.precision <= LONG_DIGITS:
        return (value.cast(T.DecimalType(38, kind.scale)) * 10**kind.scale).cast("long")
    return None
