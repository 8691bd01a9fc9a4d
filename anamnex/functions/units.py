"""Units: spellings, dimensions and affine conversion. Lab units have a dimension each and never convert."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeezed

#: Unit -> (dimension, factor, offset), base = value * factor + offset.
UNITS: dict[str, tuple[str, float, float]] = {
    "kg": ("mass", 1.0, 0.0),
    "g": ("mass", 0.001, 0.0),
    "mg": ("mass", 0.000001, 0.0),
    "ug": ("mass", 0.000000001, 0.0),
    "ng": ("mass", 0.000000000001, 0.0),
    "pg": ("mass", 0.000000000000001, 0.0),
    "lb": ("mass", 0.45359237, 0.0),
    "oz": ("mass", 0.028349523125, 0.0),
    "cm": ("length", 1.0, 0.0),
    "mm": ("length", 0.1, 0.0),
    "m": ("length", 100.0, 0.0),
    "in": ("length", 2.54, 0.0),
    "ft": ("length", 30.48, 0.0),
    "degC": ("temperature", 1.0, 0.0),
    "degF": ("temperature", 5.0 / 9.0, -160.0 / 9.0),
    "mmHg": ("pressure", 1.0, 0.0),
    "/min": ("rate", 1.0, 0.0),
    "%": ("ratio", 1.0, 0.0),
}
#: Lab units, each a dimension of its own.
LAB_UNITS = (
    "mg/dL", "g/dL", "mg/L", "g/L", "mg/mL", "ug/dL", "ug/L", "ug/mL", "ng/dL", "ng/mL",
    "ng/L", "pg/mL", "mmol/L", "umol/L", "nmol/L", "pmol/L", "mEq/L", "mOsm/kg", "U/L", "U/mL",
    "IU/L", "IU/mL", "mIU/L", "mIU/mL", "uIU/mL", "mU/L", "K/uL", "M/uL", "/uL", "/HPF",
    "/LPF", "fL", "mm/hr", "mL/min", "mL/min/1.73m2", "mg/g", "sec",
)
UNITS |= {u: (f"lab:{u}", 1.0, 0.0) for u in LAB_UNITS}

#: Other spellings in lower case; every unit's own name in lower case is one too.
SPELLINGS = {
    "lb": ("lbs", "pound", "pounds"), "kg": ("kgs", "kilogram", "kilograms"), "g": ("gram", "grams"), "oz": ("ounce", "ounces"),
    "mg": ("milligram", "milligrams"), "ug": ("microgram", "micrograms"), "ng": ("nanogram", "nanograms"), "pg": ("picogram", "picograms"),
    "cm": ("centimeter", "centimeters", "centimetre", "centimetres"), "mm": ("millimeter", "millimeters"), "m": ("meter", "meters", "metre", "metres"),
    "in": ("inch", "inches", '"'), "ft": ("foot", "feet", "'"),
    "degF": ("f", "deg f", "°f", "° f"), "degC": ("c", "deg c", "°c", "° c"),
    "mmHg": ("mm[hg]", "mm hg"), "/min": ("per min", "per minute", "bpm", "breaths/min", "beats/min"), "%": ("percent", "pct"),
    "g/dL": ("gm/dl", "gms/dl", "grams/dl"),
    "K/uL": ("k/mm3", "k/cumm", "thousand/ul", "thousands/ul", "x10e3/ul", "10e3/ul", "10^3/ul", "10*3/ul", "10^3/mm^3", "10*3/mm3", "10e3/mm3"),
    "M/uL": ("mil/ul", "million/ul", "millions/ul", "x10e6/ul", "10e6/ul", "10^6/ul", "10*6/ul", "m/mm3", "10^6/mm^3"),
    "/uL": ("cells/ul", "per ul", "/mm3", "cells/mm3", "/cumm"),
    "fL": ("cu microns", "cu_microns", "cubic microns", "um3", "um^3"),
    "mm/hr": ("mm/h", "mm hr", "mm/hour", "mm/1hr"),
    "mL/min/1.73m2": ("ml/min/1.73", "ml/min/1.73 m2", "ml/min/1.73m^2", "ml/min/1.73sqm"),
    "sec": ("secs", "seconds"),
}
#: Units that may be spelt with either micro sign.
MICRO = ("ug", "ug/dL", "ug/L", "ug/mL", "umol/L", "uIU/mL", "K/uL", "M/uL", "/uL")
ALIASES: dict[str, str] = {s: u for u, own in SPELLINGS.items() for s in own} | {u.lower(): u for u in UNITS}
ALIASES |= {u.lower().replace("u", sign, 1): u for u in MICRO for sign in ("µ", "μ")}


def known_units(include_lab: bool = True) -> tuple[str, ...]:
    return tuple(sorted(u for u, spec in UNITS.items() if include_lab or not spec[0].startswith("lab:")))


def _map(pairs) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs for x in kv))


def canonical_unit(text: Column) -> Column:
    """The unit that a spelling stands for; null if none is known."""
    return F.element_at(_map(sorted(ALIASES.items())), F.lower(squeezed(text)))


def dimension_of(unit: Column) -> Column:
    return F.element_at(_map((u, s[0]) for u, s in UNITS.items()), unit)


def convert(value: Column, text: Column, to_unit: Column, source: Column | None = None) -> Column:
    """value in to_unit; null unless both units are known and of one dimension. source: the unit of text, if it is at hand."""
    source = canonical_unit(text) if source is None else source
    factor, offset = _map((u, s[1]) for u, s in UNITS.items()), _map((u, s[2]) for u, s in UNITS.items())
    base = value * F.element_at(factor, source) + F.element_at(offset, source)
    moved = (base - F.element_at(offset, to_unit)) / F.element_at(factor, to_unit)
    return F.when(source == to_unit, value).when(dimension_of(source) == dimension_of(to_unit), moved)


def display(value: Column, text: Column, target: Column, source: Column | None = None) -> Column:
    """Struct (value, unit, converted): in the target unit, rounded to two places, if it can be; else as stored."""
    source = canonical_unit(text) if source is None else source
    moved = F.when(source != target, convert(value, text, target, source))
    done = moved.isNotNull()
    return F.struct(F.when(done, F.round(moved, 2)).otherwise(value).alias("value"), F.when(done, target).otherwise(text).alias("unit"), F.coalesce(done, F.lit(False)).alias("converted"))


def in_target(text: Column, target: Column) -> Column:
    return F.coalesce(canonical_unit(text) == target, F.lit(False))
