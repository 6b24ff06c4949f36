"""Number handling that must agree with Python's own rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.dimensions import SENSOR_FAULT_BITS

# --- fixed values -----------------------------------------------------------
REFERENCE_OHM = 430.0
NOMINAL_OHM = 100.0
CALLENDAR_A = 3.9083e-3
CALLENDAR_B = -5.775e-7
# Polynomial in ohms (scaled to a 100 ohm sensor) for temperatures below zero.
BELOW_ZERO = (-242.02, 2.2228, 2.5859e-3, -4.8260e-6, -2.8183e-8, 1.5243e-10)
CODE_SPAN = 32768.0

INT_TEXT = r"^[\s\x1c-\x1f]*[-+]?[0-9]+(_[0-9]+)*[\s\x1c-\x1f]*$"
FLOAT_TEXT = (
    r"^[\s\x1c-\x1f]*[-+]?("
    r"([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][-+]?[0-9]+(_[0-9]+)*)?"
    r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])[\s\x1c-\x1f]*$"
)
# --- end of fixed values ----------------------------------------------------


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\x1c-\x1f_]", "")


def py_int(text: Column) -> Column:
    """The integer a text spells, or NULL where Python's ``int`` would refuse it."""
    return F.when(text.rlike(INT_TEXT), _bare(text).try_cast("long"))


def py_float(text: Column) -> Column:
    """The float a text spells, or NULL where Python's ``float`` would refuse it."""
    return F.when(text.rlike(FLOAT_TEXT), _bare(text).try_cast("double"))


def read_int(values: Column, *keys: str, default: int | None = None) -> Column:
    """First key of a text map that parses as an integer, else ``default``."""
    parsed = [py_int(F.try_element_at(values, F.lit(k))) for k in keys]
    return F.coalesce(*parsed, F.lit(default).cast("long"))


def py_round(value: Column, digits: int) -> Column:
    """Round a double to ``digits`` decimals exactly as Python does.

    Python rounds the exact binary value, so multiplying by a power of ten and rounding
    is wrong near ties. The product's rounding error is recovered with a split multiply
    and decides the tie.
    """
    scale = float(10 ** digits)
    product = value * F.lit(scale)
    split = value * F.lit(134217729.0)
    high = split - (split - value)
    error = (high * F.lit(scale) - product) + (value - high) * F.lit(scale)
    floor = F.floor(product).cast("double")
    beyond_half = ((product - floor) - F.lit(0.5)) + error
    return (
        F.when(beyond_half > 0, floor + 1)
        .when(beyond_half < 0, floor)
        .otherwise(F.rint(product))
    ) / F.lit(scale)


def half_even(value: Column) -> Column:
    """Nearest whole number, ties to even, as a long."""
    return F.rint(value).cast("long")


def c_to_f(celsius: Column) -> Column:
    return celsius * F.lit(9.0) / F.lit(5.0) + F.lit(32.0)


def resistance(code: Column) -> Column:
    return code.cast("double") * F.lit(REFERENCE_OHM) / F.lit(CODE_SPAN)


def temperature(ohm: Column) -> Column:
    """Platinum-sensor temperature: the quadratic from 0 C up, the polynomial below."""
    discriminant = (F.lit(CALLENDAR_A * CALLENDAR_A)
                    - F.lit(4 * CALLENDAR_B) * (F.lit(1.0) - ohm / F.lit(NOMINAL_OHM)))
    warm = (F.sqrt(discriminant) - F.lit(CALLENDAR_A)) / F.lit(2 * CALLENDAR_B)
    ratio = ohm / F.lit(NOMINAL_OHM) * F.lit(100.0)
    cold = F.lit(BELOW_ZERO[-1])
    for coefficient in reversed(BELOW_ZERO[:-1]):
        cold = cold * ratio + F.lit(coefficient)
    return F.when(warm >= 0, warm).otherwise(cold)


def sensor_fault_names(fault: Column) -> Column:
    """Names of the set fault bits joined by a bar, highest bit first; empty for no fault."""
    names = [F.when(fault.bitwiseAND(F.lit(bit)) != 0, F.lit(name))
             for bit, name in SENSOR_FAULT_BITS]
    return F.concat_ws("|", *names)


def plain_number(value: Column, decimals: int = 4) -> Column:
    """Shortest plain decimal text of a double that has at most ``decimals`` decimals."""
    fixed = value.cast(f"decimal(18,{decimals})").cast("string")
    return F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", ".0")
