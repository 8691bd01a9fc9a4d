"""Medication names for display: words in title case, salts, release forms and strengths in their fixed spelling."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import Dictionary, norm

#: Spellings of words by their lower case.
SPELT = {"hcl": "HCl", "hbr": "HBr", "er": "ER", "xr": "XR", "xl": "XL", "sr": "SR", "dr": "DR", "odt": "ODT", "mg": "mg", "ml": "mL", "mcg": "mcg", "g": "g", "mg/ml": "mg/mL", "mcg/ml": "mcg/mL", "%": "%"}
LABEL = "Common brand(s):"
_LABEL = re.compile(r"common\s+brand\(s\):", re.IGNORECASE)
_WORD = re.compile(r"^([(\[]*)(.*?)([)\],;:]*)$", re.DOTALL)
_STRENGTH = re.compile(r"^(\d+(?:[.,]\d+)?)(.+)$")


def word_cased(word: str) -> str:
    head, core, tail = _WORD.match(word).groups()
    low = core.lower()
    if low in SPELT:
        return head + SPELT[low] + tail
    if (m := _STRENGTH.match(core)) and m[2].lower() in SPELT:
        return head + m[1] + SPELT[m[2].lower()] + tail
    parts = re.split(r"([-/])", core)
    return head + "".join(SPELT.get(p.lower(), p[:1].upper() + p[1:].lower()) for p in parts) + tail


def cased(name: str) -> str:
    if not name.strip():
        return name
    segments = _LABEL.split(name)
    return LABEL.join("".join(w if w.isspace() or not w else word_cased(w) for w in re.split(r"(\s+)", s)) for s in segments)


@F.pandas_udf(T.StringType())
def display_name(names: pd.Series) -> pd.Series:
    return names.map({n: cased(n) for n in names.dropna().unique()})  # names repeat


def shown_name(name: Column, overrides: Dictionary = None, dictionary: Dictionary = None) -> Column:
    """An override by the name's family, or the cased name."""
    if not overrides:
        return display_name(name)
    known = F.create_map(*(F.lit(x) for kv in sorted(overrides.items()) for x in kv))
    return F.coalesce(F.element_at(known, norm(name, dictionary)), display_name(name))
