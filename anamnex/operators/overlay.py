"""Human verdicts laid over rows at read time. A verdict on a row beats one on its family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Catalog
from ..specs import APPENDIX

VERDICT = "_curation"
_FIELDS = ("status", "note", "merged_into_base", "attributed_to", "dedup_base", "record_id")


def ruled_types(catalog: Catalog) -> tuple[str, ...]:
    """Record types that have a verdict (at most seven names); asked once for each table of verdicts."""
    if not catalog.has("curation"):
        return ()
    rulings = catalog["curation"]
    if catalog.facts.get("curation") is not rulings:
        found = tuple(sorted(r[0] for r in rulings.select("record_type").where("record_type IS NOT NULL").distinct().collect()))
        catalog.facts.update(curation=rulings, ruled_types=found)
    return catalog.facts["ruled_types"]


def _sides(catalog: Catalog) -> tuple[DataFrame, DataFrame]:
    rulings = catalog["curation"]
    packed = rulings.select("record_type", "dedup_base", "record_id", F.struct(*_FIELDS).alias("v"))
    row = packed.where("record_id > 0").select("record_type", "record_id", F.col("v").alias("row_v"))
    family = packed.where("record_id = 0").select("record_type", "dedup_base", F.col("v").alias("family_v"))
    return row, family


def with_verdict(df: DataFrame, catalog: Catalog, record_type: str | None = None) -> DataFrame:
    """Append the verdict (struct or null). Events carry record_type, record_id and dedup_base; rows of one type their own id.

    Only rows of types that have verdicts meet them; the others pass by, and their bases need not be made for it.
    """
    row, family = _sides(catalog)
    ruled = ruled_types(catalog)
    none = F.lit(None).cast(row.schema["row_v"].dataType).alias(VERDICT)
    if record_type and record_type not in ruled or not ruled:
        return df.select("*", none)
    if record_type:
        row = row.where(F.col("record_type") == record_type).drop("record_type").withColumnRenamed("record_id", f"{record_type}_id")
        family = family.where(F.col("record_type") == record_type).drop("record_type")
        keys, base, passed = [f"{record_type}_id"], ["dedup_base"], None
    else:
        keys, base = ["record_type", "record_id"], ["record_type", "dedup_base"]
        asked = F.coalesce(F.col("record_type").isin(*ruled), F.lit(False))
        df, passed = df.where(asked), df.where(~asked).select("*", none)
    order = df.columns
    out = df.join(row, keys, "left").join(family, base, "left")
    out = out.select(*order, F.coalesce("row_v", "family_v").alias(VERDICT))
    return out if passed is None else out.unionByName(passed)


def is_appendix() -> Column:
    """Whether the verdict moves the row out of its section. Distinct and disputed ones stay."""
    return F.coalesce(F.col(f"{VERDICT}.status").isin(*APPENDIX), F.lit(False))


def visible(df: DataFrame, raw: bool = False) -> DataFrame:
    return df if raw else df.where(~is_appendix())


def hidden_count(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if(is_appendix()).alias("hidden"))


def live(df: DataFrame, catalog: Catalog, record_type: str) -> DataFrame:
    """Rows of one type that no verdict hides, with their verdicts."""
    return visible(with_verdict(df, catalog, record_type))


def describe(verdict: Column) -> Column:
    who = F.concat(F.lit(" ("), verdict["attributed_to"], F.lit(")"))
    return F.concat(verdict["status"], F.coalesce(F.concat(F.lit(" - "), verdict["note"]), F.lit("")), F.coalesce(who, F.lit("")))


def verdict_suffix(raw: bool = False) -> Column:
    v = F.col(VERDICT)
    disputed = F.concat(F.lit("  [DISPUTED: "), F.coalesce(v["note"], F.lit("")), F.lit("]"))
    other = F.concat(F.lit("  ["), describe(v), F.lit("]")) if raw else F.lit("")
    return F.when(v["status"] == "disputed", disputed).when(v.isNotNull(), other).otherwise(F.lit(""))
