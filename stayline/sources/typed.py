"""Typed reading of delimited files: types follow from column names by rules, times are put on the hour."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.functions.numeric import round_half_even, to_number
from stayline.functions.time import hour_round

Convert = Callable[[Column], Column]


def _int(kind: str) -> Convert:
    """Whole numbers that may be written as decimals; what is no number becomes null."""
    return lambda c: to_number(c).try_cast(kind)


def _time(c: Column) -> Column:
    """A timestamp without its fraction of a second, on the nearest hour (half-even)."""
    t = F.substring(F.replace(F.trim(c), F.lit("T"), F.lit(" ")), 1, 19)
    return hour_round(F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def _day(c: Column) -> Column:
    return F.try_to_timestamp(F.substring(F.trim(c), 1, 10), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")


#: First rule whose pattern matches the whole column name decides; other columns stay text.
RULES: list[tuple[str, Convert]] = [
    (r"order_provider_id|note_id|dicom_id|icd_code|icd_version", F.trim),
    (r"(?:\w+_)?(?:id|itemid)|orderid|linkorderid|poe_seq", _int("int")),
    (r"(?:seq_num|note_seq|\w+_rn|anchor_age|anchor_year|test_seq|isolate_num|\w+_flag)", _int("smallint")),
    (r"warning|field_ordinal", _int("tinyint")),
    (r"gsn|ndc|drg_code", _int("bigint")),
    (r"chartdate|storedate|dod", _day),
    (r"\w*time", _time),
    (r"temperature|heartrate|resprate|o2sat|amount|rate|original\w+|doses_per_24_hrs|ref_range_\w+", lambda c: round_half_even(to_number(c), 2)),
    (r"sbp|dbp", lambda c: F.floor(to_number(c)).try_cast("int")),
    (r"los", lambda c: F.bround(to_number(c), 1).try_cast("smallint")),
]


def typed(df: DataFrame, rules: Sequence[tuple[str, Convert]] = RULES, fill: dict[str, str] | None = None) -> DataFrame:
    """A frame of text columns typed by the rules; ``fill`` gives constants for nulls. An unknown column stays as it is."""
    out = []
    for c in df.columns:
        convert = next((f for p, f in rules if re.fullmatch(p, c)), None)
        col = F.col(f"`{c}`")
        out.append((convert(col) if convert else col).alias(c))
    done = df.select(*out)
    return done.fillna({k: v for k, v in (fill or {}).items() if k in done.columns}) if fill else done


def read_typed(spark: SparkSession, path: str | list[str], rules: Sequence[tuple[str, Convert]] = RULES, sep: str = ",", encoding: str = "UTF-8", fill: dict[str, str] | None = None, split: int | None = None, multi_line: bool | None = None) -> DataFrame:
    """Delimited files with a header, gzipped or not, typed by the rules.

    Values are read as text, so a file needs no second pass for its types. Gzip can't be split; ``split`` spreads the rows over
    so many tasks right behind the scan. Quoted fields may span lines where ``multi_line`` says so, which makes each file one task; by default only those of gzipped files do.
    """
    paths = [path] if isinstance(path, str) else path
    lines = all(p.endswith((".gz", ".bz2")) for p in paths) if multi_line is None else multi_line
    raw = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("quote", '"').option("escape", '"').option("multiLine", lines).csv(path)
    return typed(raw.repartition(split) if split else raw, rules, fill)


def read_mapping(spark: SparkSession, path: str, columns: Sequence[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """A tab-separated code mapping, text only, lower-case headers, the wanted columns, each row once."""
    raw = spark.read.option("header", True).option("sep", "\t").option("encoding", encoding).csv(path)
    return raw.toDF(*[c.strip().lower() for c in raw.columns]).select(*columns).distinct()
