"""Diagnosis categories and drug codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chapters of version 9 by half-open code ranges, in canonical order. Fixed values.
CHAPTERS = (
    ("infection", 0, 140), ("neoplasms", 140, 240), ("endocrine", 240, 280), ("blood", 280, 290), ("mental", 290, 319),
    ("nervous", 320, 390), ("circulatory", 390, 460), ("respiratory", 460, 520), ("digestive", 520, 580), ("genitourinary", 580, 630),
    ("pregnancy", 630, 680), ("skin", 680, 710), ("musculoskeletal", 710, 740), ("congenital", 740, 760), ("perinatal", 760, 780),
    ("ill_defined", 780, 800), ("injury", 800, 1000),
)
NAMES = tuple(n for n, _, _ in CHAPTERS) + ("unknown",)


def icd_chapter(code: Column) -> Column:
    """The chapter of a version 9 code by its first three digits; null for supplementary codes (with V or E) and in gaps."""
    n = F.substring(code, 1, 3).try_cast("double")
    out = F.when(code.isNull() | F.lower(code).rlike("[ve]"), F.lit(None).cast("string"))
    for name, a, b in CHAPTERS:
        out = out.when((n >= a) & (n < b), F.lit(name))
    return out


def icd_chapter_sql(code: str) -> str:
    n = f"TRY_CAST(substr({code}, 1, 3) AS DOUBLE)"
    cases = " ".join(f"WHEN {n} >= {a} AND {n} < {b} THEN '{name}'" for name, a, b in CHAPTERS)
    return f"CASE WHEN {code} IS NULL OR regexp_matches(lower({code}), '[ve]') THEN NULL {cases} END"


def ndc_key(code: Column) -> Column:
    """A packed drug code without its package part: padded to 11 digits, the last two dropped."""
    c = code.cast("string")
    return F.substring(F.when(F.length(c) >= 11, c).otherwise(F.lpad(c, 11, "0")), 1, 9)


def ndc_product_key(code: Column) -> Column:
    """A product code `labeler-product` as 5 and 4 digits in a row; longer parts stay."""
    a, b = F.split_part(code, F.lit("-"), F.lit(1)), F.split_part(code, F.lit("-"), F.lit(2))
    pad = lambda c, n: F.when(F.length(c) >= n, c).otherwise(F.lpad(c, n, "0"))
    return F.concat(pad(a, 5), pad(b, 4))


def tagged_parts(c: Column, tag: str = "[EPC]") -> Column:
    """The comma-separated parts that hold a tag, trimmed; null for null."""
    return F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: F.contains(p, F.lit(tag)))
