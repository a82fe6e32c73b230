"""Numbers as text, rounded as C's printf does it: the nearest to the value the double holds, not to its short form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits after the point at most; integer parts up to 2^53 are exact in a double anyway.
MOST_DIGITS = 4


def _let(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c written and evaluated once however often `use` names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _ticks(part: Column, digits: int) -> Column:
    """round(part * 10^digits), ties to even, of a double part in [0, 1), from all of its bits.

    The part is scaled by a power of two, which loses nothing, to a whole number of at most 62 bits; halves are added
    and told from it as whole numbers. Parts below 2^-18 have bits beyond that and are below any half.
    """
    large = part >= 2.0**-8
    power = lambda *n: F.when(large, F.lit(str(2 ** n[0])).cast("decimal(30,0)")).otherwise(F.lit(str(2 ** n[1])).cast("decimal(30,0)"))
    bits = (part * F.when(large, 2.0**62).otherwise(2.0**70)).cast("long").cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(5,0)")
    of = lambda v: F.struct(v.alias("v"), (v % power(62, 70)).alias("rest"))
    up = lambda x: F.struct(((x["v"] - x["rest"]) / power(62, 70)).cast("long").alias("n"), (x["rest"] == 0).alias("tie"))
    even = lambda x: x["n"] - F.when(x["tie"] & (x["n"] % 2 == 1), 1).otherwise(0)
    return _let(bits + power(61, 69), lambda v: _let(of(v), lambda x: _let(up(x), even)))


def fixed(c: Column, digits: int) -> Column:
    """A double with `digits` after the point, as printf("%.<digits>f") gives it; null stays null.

    Exact for values below 2^53, NaN and infinities as "nan", "inf" and "-inf"; larger values keep their short form.
    """
    if not 0 <= digits <= MOST_DIGITS:
        raise ValueError(f"digits from 0 to {MOST_DIGITS}")
    scale = 10**digits

    def text(x: Column) -> Column:
        whole, ticks = x["whole"], x["ticks"]
        if digits == 0:  # a half goes to the even whole number, which ticks of 0 and 1 can't tell
            half = x["part"] == 0.5
            return (whole + F.when((x["part"] > 0.5) | (half & (whole % 2 == 1)), 1).otherwise(0)).cast("string")
        return F.concat((whole + F.when(ticks >= scale, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((ticks % scale).cast("string"), digits, "0"))

    def signed(v: Column) -> Column:
        size = F.abs(v)
        whole = F.floor(size)
        body = _let(F.struct(whole.alias("whole"), (size - whole).alias("part")), lambda x: _let(F.struct(x["whole"].alias("whole"), x["part"].alias("part"), _ticks(x["part"], digits).alias("ticks")), text))
        shown = F.when(size == float("inf"), "inf").when(size >= 2.0**53, F.format_string(f"%.{digits}f", size)).otherwise(body)
        return F.when(F.isnan(v), "nan").when(v.isNotNull(), F.concat(F.when((v < 0) | (v.cast("string") == "-0.0"), "-").otherwise(""), shown))

    return _let(c.cast("double"), signed)
