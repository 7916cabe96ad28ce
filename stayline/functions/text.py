"""Text helpers: sections of reports, last matches, unit stripping, replacement chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headers under which a report sums up, and under which it describes, with their common misspellings. Fixed values.
SUMMARY_HEADERS = (
    "impression", "conclusion", "findings/impression", "impresson", "imprression", "imprssion", "impresion", "imperssion", "mpression",
    "impession", "impressions", "impresions", "conclusions", "impresssion",
)
FINDING_HEADERS = ("findings", "views", "finding", "findins", "findindgs", "findgings", "findngs", "findnings", "finidngs")
HEADER = r"\n([A-Z()/,-]+):\s"


def sections(text: Column) -> Column:
    """Sections of a report in order: ARRAY of (header, body); text before the first header isn't part of any."""
    cut = F.split(F.regexp_replace(text, HEADER, "\u0001$1\u0002"), "\u0001")
    body = F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0)))
    return F.transform(body, lambda s: F.struct(F.lower(F.split_part(s, F.lit("\u0002"), F.lit(1))).alias("header"), F.trim(F.regexp_replace(F.split_part(s, F.lit("\u0002"), F.lit(2)), r"^\s+|\s+$", "")).alias("body")))


#: What the texts of the kidney filtration result are cleared of, in this order. Fixed values.
GFR_LABEL = "Estimated GFR (MDRD equation)"
GFR_UNIT = "mL/min/1.73 m2, <60 = Chronic Kidney Disease, <15 = Kidney Failure"
GFR_PHRASES = [
    ("Using this patient's age, gender, and ", ""),
    (" value of", ":"),
    ("Estimated ", ""),
    ("if African-American (mL/min/1.73 m2)", "else"),
    ("For comparison, ", ""),
    (" (mL/min/1.73 m2)", ""),
    ("GFR<60 = Chronic Kidney Disease, GFR<15 = Kidney Failure.", ""),
]


def one_of_each(text: Column) -> Column:
    """Values packed by commas, each once, in order of first appearance."""
    return F.array_join(F.array_distinct(F.transform(F.split(text, ","), lambda x: F.trim(x))), ", ")


def impression(text: Column) -> Column:
    """The last summary section of a report, else its last findings, else all of it, without outer blanks; null for null."""
    s = sections(text)
    last = lambda names: F.element_at(F.filter(s, lambda x: x["header"].isin(*names)), -1)["body"]
    have = lambda names: F.exists(s, lambda x: x["header"].isin(*names))
    return F.when(have(SUMMARY_HEADERS), last(SUMMARY_HEADERS)).when(have(FINDING_HEADERS), last(FINDING_HEADERS)).otherwise(F.regexp_replace(text, r"^\s+|\s+$", ""))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The last match of a pattern, null if there is none."""
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(F.size(m) > 0, F.element_at(m, -1))


def strip_unit(text: Column) -> Column:
    """Numbers lose a `mm` that follows them; where there is none, a `cm`."""
    mm = F.regexp_replace(text, r"(\d+)mm\b", "$1")
    return F.when(text.rlike(r"\d+mm\b"), mm).otherwise(F.regexp_replace(text, r"(\d+)cm\b", "$1"))


def unit_of(text: Column, unit: Column) -> Column:
    """The unit that a text is in: millimetres if a number in it says so, else centimetres, else the given one."""
    return F.when(text.rlike(r"\d+mm\b"), "mm").when(text.rlike(r"\d+cm\b"), "cm").otherwise(unit)


def is_map(text: Column) -> Column:
    """Whether a text is a written-out map rather than a value; null is none."""
    return F.coalesce(text.rlike(r"^\s*\{.*\}\s*$"), F.lit(False))


def replace_chain(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after another."""
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
