"""Numbers read and written as Python does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's float() takes, NaN aside (fixed values).
_DIGITS = r"\d+(?:_\d+)*"
FLOAT = rf"(?i)^\s*[+-]?(?:(?:{_DIGITS})(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?\s*$|^\s*[+-]?(?:inf|infinity)\s*$"
NAN = r"(?i)^\s*[+-]?nan\s*$"


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), make), 1)


def to_float(text: Column) -> Column:
    """The number that Python's float() reads; null where it fails."""
    plain = F.trim(F.regexp_replace(text, "_", ""))
    infinite = F.when(plain.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    number = F.when(F.lower(plain).contains("inf"), infinite).otherwise(plain.try_cast("double"))
    return F.when(text.rlike(NAN), F.lit(float("nan"))).when(text.rlike(FLOAT), number)


def float_text(number: Column) -> Column:
    """A double as Python's str() writes it: the fewest digits that give the same double."""
    size = F.abs(number)
    tries = [F.format_string(f"%.{k}e", size) for k in (14, 15, 16)]
    shown = F.coalesce(*[F.when(t.try_cast("double") == size, t) for t in tries], tries[-1])

    def parts(text: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(F.substring_index(text, "e", 1), r"\.", ""), "(?<=.)0+$", "")
        return F.struct(digits.alias("digits"), F.substring_index(text, "e", -1).cast("int").alias("power"))

    def written(part: Column) -> Column:
        digits, power = part["digits"], part["power"]
        rest = F.substr(digits, power + 2)
        large = F.concat(F.rpad(F.substr(digits, F.lit(1), power + 1), power + 1, F.lit("0")), F.lit("."), F.when(F.length(rest) > 0, rest).otherwise(F.lit("0")))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        mantissa = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(F.lit("")))
        scientific = F.concat(mantissa, F.lit("e"), F.when(power < 0, F.lit("-")).otherwise(F.lit("+")), F.format_string("%02d", F.abs(power)))
        return F.when(power.between(0, 15), large).when(power.between(-4, -1), small).otherwise(scientific)

    sign = F.when(number.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    plain = let(let(shown, parts), written)
    return F.when(F.isnan(number), F.lit("nan")).when(size == float("inf"), F.concat(sign, F.lit("inf"))).when(number.isNotNull(), F.concat(sign, plain))


def literal_value(text: Column) -> Column:
    """A literal as number or, where it is none, as text: ``struct<num, str>``."""
    return let(to_float(text), lambda number: F.struct(number.alias("num"), F.when(number.isNull(), text).alias("str")))
