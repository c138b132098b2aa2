"""Stateless arithmetic."""

from __future__ import annotations

import operator
import statistics
from decimal import Context, Decimal
from typing import Any

from evalmill.operators.simulated.core import Service, require

# Metres of each length unit, and factors between imperial and metric units.
METRES = {"km": 1000, "m": 1, "cm": 0.01, "mm": 0.001, "um": 1e-6, "nm": 1e-9}
FACTORS = {("cm", "in"): 0.393701, ("in", "cm"): 2.54, ("m", "ft"): 3.28084, ("ft", "m"): 0.3048, ("m", "yd"): 1.09361, ("yd", "m"): 0.9144, ("km", "miles"): 0.621371, ("miles", "km"): 1.60934, ("kg", "lb"): 2.20462, ("lb", "kg"): 0.453592}

maths = Service()


def _numbers(*values: Any) -> None:
    require(all(isinstance(v, int | float) for v in values), "numbers only")


def _binary(name: str, fn) -> None:
    @maths.operation(name=name)
    def run(s, a, b):
        _numbers(a, b)
        return {"result": fn(a, b)}


for _name, _fn in {"add": operator.add, "subtract": operator.sub, "multiply": operator.mul}.items():
    _binary(_name, _fn)


def _of_list(name: str, fn) -> None:
    @maths.operation(name=name)
    def run(s, numbers):
        require(numbers, "the list is empty")
        _numbers(*numbers)
        return {"result": fn(numbers)}


for _name, _fn in {"mean": lambda x: sum(x) / len(x), "standard_deviation": statistics.pstdev, "min_value": min, "max_value": max, "sum_values": sum}.items():
    _of_list(_name, _fn)


@maths.operation()
def divide(s, a, b):
    _numbers(a, b)
    require(b != 0, "division by zero")
    return {"result": a / b}


@maths.operation()
def power(s, base, exponent):
    _numbers(base, exponent)
    return {"result": base**exponent}


@maths.operation()
def percentage(s, part, whole):
    _numbers(part, whole)
    require(whole != 0, "the whole is zero")
    return {"result": part / whole * 100}


@maths.operation()
def absolute_value(s, number):
    _numbers(number)
    return {"result": abs(number)}


@maths.operation()
def round_number(s, number, decimal_places=0):
    _numbers(number)
    return {"result": round(number, decimal_places)}


@maths.operation()
def square_root(s, number, precision):
    """Correct to ``precision`` digits, as a decimal."""
    _numbers(number)
    require(number >= 0, "the number is negative")
    return {"result": Context(prec=precision).sqrt(Decimal(number))}


@maths.operation()
def logarithm(s, value, base, precision):
    _numbers(value, base)
    require(value > 0 and base > 0 and base != 1, "no logarithm")
    c = Context(prec=precision)
    return {"result": c.divide(c.ln(Decimal(value)), c.ln(Decimal(base)))}


@maths.operation()
def si_unit_conversion(s, value, unit_in, unit_out):
    _numbers(value)
    require(unit_in in METRES and unit_out in METRES, f"no conversion from {unit_in} to {unit_out}")
    return {"result": value * METRES[unit_in] * (1 / METRES[unit_out])}


@maths.operation()
def imperial_si_conversion(s, value, unit_in, unit_out):
    _numbers(value)
    if unit_in == unit_out:
        return {"result": value}
    if (unit_in, unit_out) == ("celsius", "fahrenheit"):
        return {"result": value * 1.8 + 32}
    if (unit_in, unit_out) == ("fahrenheit", "celsius"):
        return {"result": (value - 32) * (5 / 9)}
    require((unit_in, unit_out) in FACTORS, f"no conversion from {unit_in} to {unit_out}")
    return {"result": value * FACTORS[unit_in, unit_out]}
