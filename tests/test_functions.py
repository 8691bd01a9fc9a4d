import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from anamnex.functions import dates, identity, names, text, units


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


DICTIONARY = {"m-spike (spep)": "m_spike", "hgb": "hemoglobin", "serum protein electrophoresis": "spep"}


@pytest.mark.parametrize(
    "raw, token, family",
    [
        ("  Blood_Pressure ", "blood pressure", "blood pressure"),
        ("Albumin ( SPEP )", "albumin (spep)", "albumin"),
        ("Albumin (Serum Protein Electrophoresis)", "albumin (spep)", "albumin"),
        ("Hemoglobin (HGB)", "hemoglobin", "hemoglobin"),
        ("_M-Spike ( SPEP)", "m_spike", "m_spike"),
        ("(SPEP)", "spep", ""),
        ("A B", "a b", "a b"),
        (None, "", ""),
    ],
)
def test_identity_tokens(spark, raw, token, family):
    assert one(spark, text.key_token(F.col("v"), DICTIONARY), v=raw) == token
    assert one(spark, text.norm(F.col("v"), DICTIONARY), v=raw) == family


@pytest.mark.parametrize("raw, token", [("Unable to Assess", "unable-to-assess"), ("family_history", "family-history"), (None, "")])
def test_enum_token(spark, raw, token):
    assert one(spark, text.enum_token(F.col("v")), v=raw) == token


@pytest.mark.parametrize(
    "value, good",
    [
        ("2026", True), ("0000", False), ("2026-03", True), ("2026-13", False), ("2026-3", False), ("2026-03-15", True), ("2026-02-30", False), ("2026-03-15T09:30Z", True),
        ("2026-03-15 09:30:11+02:00", True), ("2026-03-15T25:00", False), ("2026-03T09:00", False), ("06/15/2026", False), ("not-a-date", False),
    ],
)
def test_iso_dates(spark, value, good):
    assert one(spark, dates.is_iso_date(F.col("v")), v=value) is good


@pytest.mark.parametrize("value, day", [("2024", "2024-12-31"), ("2024-02", "2024-02-29"), ("2024-02-03T10:00", "2024-02-03"), ("soon", None), ("2024-13", None)])
def test_end_of_period(spark, value, day):
    assert one(spark, dates.end_of_period(F.col("v")).cast("string"), v=value) == day


def test_small_date_functions(spark):
    assert one(spark, dates.doc_date(F.col("v")), v=" 2024-01-05\n") == "2024-01-05"
    assert one(spark, dates.doc_date(F.col("v")), v="2024-01") is None
    assert one(spark, dates.compact_date(F.col("v")), v="20240105x") == "2024-01-05"
    assert one(spark, dates.leading_digits_date(F.col("v")), v="199805") == "1998-05"
    assert one(spark, dates.months_before(F.lit(dt.date(2024, 3, 31)), 1).cast("string"), v="") == "2024-02-29"
    assert "March 14, 1962" in one(spark, dates.dob_renderings(F.col("v")), v="1962-03-14")
    assert one(spark, dates.has_time(F.col("v")), v="2024-01-01T08:00") is True


@pytest.mark.parametrize("raw, unit", [("LBS", "lb"), ("deg  F", "degF"), ("µg/dL", "ug/dL"), ("μIU/mL", "uIU/mL"), ("x10E3/uL", "K/uL"), ("10", None), (None, None), ("mL/min/1.73 m2", "mL/min/1.73m2")])
def test_unit_spellings(spark, raw, unit):
    assert one(spark, units.canonical_unit(F.col("v")), v=raw) == unit


def test_conversion(spark):
    def moved(value, unit, to):
        return one(spark, units.convert(F.col("n"), F.col("u"), F.lit(to)), n=value, u=unit)

    assert moved(98.6, "F", "degC") == pytest.approx(37.0)
    assert moved(90.0, "kg", "lb") == pytest.approx(198.416, abs=1e-3)
    assert moved(1.0, "mEq/L", "mmol/L") is None
    assert moved(1.0, "kg", "cm") is None
    shown = one(spark, units.display(F.col("n"), F.col("u"), F.lit("kg")), n=196.0, u="lb")
    assert (shown["value"], shown["unit"], shown["converted"]) == (88.9, "kg", True)
    assert len(units.UNITS) == 55 and "mg/dL" not in units.known_units(include_lab=False)


def test_hash_parts(spark):
    expected = "7cb038718f7be0b7c2e03d091b485abbb28b298f79c06689017796e2ce0503b4"
    assert one(spark, identity.hash_parts(F.lit(1), F.lit("glucose"), F.lit("2024-04-01")), v="") == expected
    assert one(spark, identity.hash_parts(F.lit("a"), F.lit(None), F.lit("c")), v="") == hashlib.sha256(b"a||c").hexdigest()
    assert one(spark, identity.occurrence_key(F.lit("b"), F.lit(0)), v="") == "b"


@pytest.mark.parametrize(
    "raw, shown",
    [("ZORBAFEN HCL 10MG TABLET", "Zorbafen HCl 10mg Tablet"), ("zorBAFen er", "Zorbafen ER"), ("ALPHA-BETA/gamma (BRAND)", "Alpha-Beta/Gamma (Brand)"), ("X (COMMON  BRAND(S): FOO)", "X (Common brand(s): Foo)"), ("  ", "  ")],
)
def test_display_names(raw, shown):
    assert names.cased(raw) == shown


def test_order_tokens(spark):
    noise = ("panel", "profile", "extensive")
    assert one(spark, text.order_tokens(F.col("v"), noise), v="CBC, Lipid Panel / TSH (free, total)") == ["cbc", "lipid", "tsh (free, total)"]
    assert one(spark, text.order_tokens(F.col("v"), noise), v="Lipid Panel") == ["lipid panel"]
    assert one(spark, text.order_tokens(F.col("v"), noise), v="CBC, panel") == []


def test_number_text(spark):
    for v, s in ((7.0, "7.0"), (10000000.0, "10000000.0"), (0.0001, "0.0001"), (6.55, "6.55")):
        assert one(spark, text.number_text(F.col("v")), v=v) == s


def test_name_tokens(spark):
    assert one(spark, text.name_tokens(F.col("v")), v="Jane Q. Doe, MD") == ["jane", "doe"]
    assert one(spark, text.name_tokens(F.col("v")), v="Al Doe") == []
