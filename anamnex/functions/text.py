"""Names as identity tokens: collapse, qualifiers, synonyms, enumerations. All are Column expressions.

A dictionary is a plain dict of synonym -> canonical name. It becomes one map literal; lookups stay in the plan.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .plan import let

Dictionary = Mapping[str, str] | None


def _no_text() -> Column:
    return F.lit("")


#: White space of Unicode, as (?U)\s has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """No white space (Unicode) at the ends; a plain function, much cheaper than a pattern."""
    return F.btrim(text, F.lit(WHITE))


def squeezed(text: Column) -> Column:
    """White-space runs (Unicode) become a space; none at the ends. Single spaces are no match, so most texts are not built anew."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s&&[^ ]]\s*| \s+", " "))


def collapse(value: Column) -> Column:
    """Lower case, underscores as spaces, single spaces, no padding inside parentheses."""
    plain = squeezed(F.replace(F.lower(value), F.lit("_"), F.lit(" ")))
    return F.regexp_replace(F.regexp_replace(plain, r"\(\s+", "("), r"\s+\)", ")")


def strip_qualifiers(value: Column) -> Column:
    return squeezed(F.regexp_replace(value, r"\([^)]*\)", " "))


def qualifier_text(value: Column) -> Column:
    return squeezed(F.array_join(F.regexp_extract_all(value, F.lit(r"\(([^)]*)\)"), 1), " "))


def _looked_up(dictionary: Dictionary, token: Column) -> Column:
    if not dictionary:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*(F.lit(x) for kv in sorted(dictionary.items()) for x in kv)), token)


def identity(value: Column, dictionary: Dictionary = None) -> Column:
    """Struct of the canonical name and its meaningful qualifier (or ''). A declared full label has no qualifier, nor has a redundant alias."""

    def qualified(full: Column, stem: Column, inner: Column) -> Column:
        declared = _looked_up(dictionary, full)
        canonical = F.coalesce(declared, _looked_up(dictionary, stem), stem, _no_text())
        named = F.when(declared.isNotNull() | (inner == ""), _no_text()).otherwise(F.coalesce(_looked_up(dictionary, inner), inner, _no_text()))
        return let(F.struct(canonical.alias("canonical"), named.alias("named")), lambda t: F.struct(t["canonical"].alias("canonical"), F.when(t["named"] == t["canonical"], _no_text()).otherwise(t["named"]).alias("qualifier")))

    def parts(full: Column) -> Column:
        return let(F.struct(full.alias("full"), strip_qualifiers(full).alias("stem"), qualifier_text(full).alias("inner")), lambda p: qualified(p["full"], p["stem"], p["inner"]))

    return let(collapse(value), parts)


#: What makes a name more than words between single spaces: other characters than ASCII's printable ones, parentheses, runs of spaces.
_NOT_PLAIN = r"[^ -'*-~]|[ _]{2}"


def _if_plain(value: Column, dictionary: Dictionary, otherwise: Column) -> Column:
    """The canonical name of plain words, which have no qualifier, without the patterns; what identity() makes of all others."""
    full = F.trim(F.replace(F.lower(value), F.lit("_"), F.lit(" ")))
    return F.when(~value.rlike(_NOT_PLAIN), F.coalesce(_looked_up(dictionary, full), full) if dictionary else full).otherwise(otherwise)


def norm(value: Column, dictionary: Dictionary = None) -> Column:
    """The family: canonical name without qualifier."""
    return _if_plain(value, dictionary, identity(value, dictionary)["canonical"])


def key_token(value: Column, dictionary: Dictionary = None) -> Column:
    """The identity: canonical name, and the qualifier in parentheses if it means something."""

    def token(i: Column) -> Column:
        c, q = i["canonical"], F.coalesce(i["qualifier"], _no_text())
        return F.when(q == "", c).when(c == "", q).otherwise(F.concat(c, F.lit(" ("), q, F.lit(")")))

    return _if_plain(value, dictionary, let(identity(value, dictionary), token))


def enum_token(value: Column) -> Column:
    return F.replace(F.coalesce(collapse(value), _no_text()), F.lit(" "), F.lit("-"))


def loose(token: Column) -> Column:
    return F.replace(token, F.lit("_"), F.lit(" "))


def is_blank(value: Column) -> Column:
    return value.isNull() | value.rlike(r"(?U)^\s*$")


def filled(value: Column) -> Column:
    """False for null and the empty string."""
    return F.coalesce(value, _no_text()) != ""


def loose_unit(value: Column) -> Column:
    return F.lower(F.coalesce(stripped(value), _no_text()))


def alnum(text: Column) -> Column:
    """Lower case, all but letters and digits of ASCII as spaces, a space at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^0-9a-z]+", " ")), F.lit(" "))


def invisible_trim(text: Column) -> Column:
    """No white space, format or control characters at the ends."""
    return F.regexp_replace(text, r"(?U)^[\s\p{Cf}\p{Cc}]+|[\s\p{Cf}\p{Cc}]+$", "")


def number_text(value: Column) -> Column:
    """Doubles as a person writes them: 7.0, 0.0001, 10000000.0."""
    wide = F.regexp_replace(F.format_string("%.12f", value), r"0+$", "")
    return F.when(value.isNull(), None).otherwise(F.when(wide.endswith("."), F.concat(wide, F.lit("0"))).otherwise(wide))


#: Suffixes that are no part of a name (fixed values).
NAME_NOISE = ("jr", "sr", "ii", "iii", "iv", "md", "do", "phd")


def name_tokens(full_name: Column) -> Column:
    """Words of a name; none unless there are two, all of three letters or more."""
    words = F.split(F.trim(alnum(full_name)), " ")
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*NAME_NOISE))
    return F.when((F.size(kept) < 2) | F.exists(kept, lambda w: F.length(w) < 3), F.array().cast("array<string>")).otherwise(kept)


def split_components(text: Column) -> Column:
    """Parts between commas and slashes that stand outside parentheses."""
    parts = F.split(text, r"[,/](?![^(]*\))")
    return F.filter(F.transform(parts, squeezed), lambda p: p != "")


def declared_analyte(text: Column, dictionary: Dictionary) -> Column:
    return norm(text, dictionary) != norm(text) if dictionary else F.lit(False)


def order_tokens(value: Column, noise: tuple[str, ...], dictionary: Dictionary = None) -> Column:
    """Tokens of an order: of the whole, or of each component; none if a component can't be read."""
    parts = split_components(value)
    whole = key_token(value, dictionary)

    def token(part: Column) -> Column:
        words = F.filter(F.split(part, " "), lambda w: ~F.lower(w).isin(*noise))
        return key_token(F.when(part.contains("("), part).otherwise(F.array_join(words, " ")), dictionary)

    each = F.transform(parts, token)
    none = F.array().cast("array<string>")
    single = F.when(whole == "", none).otherwise(F.array(whole))
    return F.when(is_blank(value), none).when((F.size(parts) <= 1) | declared_analyte(value, dictionary), single).when(F.exists(each, lambda t: t == ""), none).otherwise(F.array_distinct(each))


def routine_pattern(patterns) -> str | None:
    """One Java pattern that finds any of the words, with no letter or digit beside it."""
    cleaned = list(dict.fromkeys(p for p in patterns or () if p))
    return rf"(?<![a-z0-9])(?:{'|'.join(map(re.escape, cleaned))})(?![a-z0-9])" if cleaned else None


def python_collapse(value: str) -> str:
    """collapse() for the driver: dictionaries are normalised as they are read."""
    plain = re.sub(r"\s+", " ", value.lower().replace("_", " ")).strip()
    return re.sub(r"\(\s+", "(", re.sub(r"\s+\)", ")", plain))


def load_dictionary(path: str | None) -> dict[str, dict | tuple]:
    """synonyms, routine (procedures) and medication_display of a TOML file; empty if there is none."""
    found: dict = {}
    if path:
        try:
            with open(path, "rb") as f:
                found = tomllib.load(f)
        except FileNotFoundError:
            pass
    synonyms = {python_collapse(str(k)): str(v).strip() for k, v in found.get("synonyms", {}).items()}
    routine = tuple(dict.fromkeys(c for p in found.get("procedures", {}).get("routine", ()) if (c := python_collapse(str(p)))))
    display = {python_collapse(str(k)): str(v).strip() for k, v in found.get("medication_display", {}).items() if str(v).strip()}
    return {"synonyms": synonyms, "routine": routine, "medication_display": display}
