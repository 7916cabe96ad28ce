"""Several values packed in one field: infer the delimiters per source, then split with positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.operators.common import aside, join_dimension, require

#: Candidate delimiters, by name: a regular expression for one occurrence outside quotes.
CANDIDATES = {"slash": r"/", "backslash": r"\\", "pipe": r"\|", "semicolon": r";", "comma": r",", "line": r"[\r\n]+", "over": r"(?i)\s+over\s+", "tab": r"\t", "ampersand": r"&", "and": r"(?i)\s+and\s+", "plus": r"\s\+\s", "to": r"(?i)\s+to\s+"}
#: A piece that is one value: a number, perhaps signed, compared or called approximate, with decimals and a short unit.
PIECE = r"^(?:(?:approx|about|circa|ca|est)\.?\s*)?[<>=~]{0,2}\s*[-+]?\d+(?:[.,]\d+)?\s*(?:%|[a-zA-Z/]{1,6})?$"
#: Least score of a delimiter that is accepted.
ACCEPT = 0.5

#: Private-use characters: a decimal comma in quotes, and a place to cut.
_COMMA, _CUT = "\ue000", "\ue001"


def _guarded(text: Column) -> Column:
    """``text`` with a decimal comma in quotes (around one number) guarded and all quotes taken off, brackets' content dropped."""
    c = F.regexp_replace(text, r"\([^)]*\)", "")
    c = F.regexp_replace(c, r"([\"'])\s*([-+]?\d+),(\d+)\s*\1", "$2" + _COMMA + "$3")
    return F.regexp_replace(c, "[\"'“”‘’]", "")


def _pattern(delimiters: Column) -> Column:
    """One regular expression for all delimiters whose name is in ``delimiters``; one that never matches if there is none."""
    names = F.create_map(*[x for name, p in CANDIDATES.items() for x in (F.lit(name), F.lit(f"(?:{p})"))])
    joined = F.array_join(F.transform(delimiters, lambda d: names[d]), "|")
    return F.when(F.size(delimiters) > 0, joined).otherwise(F.lit(r"(?!)"))


def _pieces(text: Column, pattern: Column) -> Column:
    """The trimmed non-empty pieces of a guarded text, cut where ``pattern`` matches."""
    parts = F.transform(F.split(F.regexp_replace(text, pattern, F.lit(_CUT)), _CUT), lambda p: F.translate(F.regexp_replace(p, r"^\s+|\s+$", ""), _COMMA, ","))
    return F.filter(parts, lambda p: p != "")


def infer_delimiters(df: DataFrame, source: Sequence[str], text: str, accept: float = ACCEPT) -> DataFrame:
    """Per source the accepted delimiters: ``source, delimiters ARRAY, scores MAP``.

    A candidate's score over the rows that hold it is the mean of the share of rows that it cuts into the commonest number of
    pieces, weighed by half, and the share of pieces of regular type (one number, or itself packed by another candidate,
    then one number each). Pieces without a digit are remarks and count for nothing. Aggregation is by source, candidate and piece count, before the shuffle; a source's rows are
    never gathered.
    """
    source, hide, show = aside(source)
    rows = df.where(F.col(text).isNotNull()).select(*hide, _guarded(F.col(text)).alias("t"))
    per = []
    finest = "|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?:{p[4:]})" for p in CANDIDATES.values())
    for name, pattern in CANDIDATES.items():
        bits = F.filter(F.transform(F.split("t", pattern), lambda p: F.trim(p)), lambda p: p.rlike(r"\d"))
        regular = F.filter(bits, lambda p: F.forall(F.filter(F.transform(F.split(p, f"(?i){finest}"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.translate(x, _COMMA, ",").rlike(PIECE)))
        per.append(F.when(F.col("t").rlike(pattern), F.struct(F.lit(name).alias("name"), F.size(bits).alias("n"), F.size(regular).alias("ok"))))
    long = rows.select(*source, F.explode(F.filter(F.array(*per), lambda x: x.isNotNull())).alias("c")).select(*source, "c.*")
    counts = long.groupBy(*source, "name", "n").agg(F.count(F.lit(1)).alias("rows"), F.sum("ok").alias("ok"))
    score = (
        counts.groupBy(*source, "name")
        .agg((F.max("rows") / F.sum("rows")).alias("consistency"), (F.sum("ok") / F.sum(F.greatest("n", F.lit(1)) * F.col("rows"))).alias("regularity"))
        .withColumn("score", (F.col("consistency") * 0.5 + 0.5) * F.col("regularity"))
    )
    done = score.groupBy(*source).agg(
        F.array_sort(F.collect_list(F.when(F.col("score") >= accept, F.col("name")))).alias("delimiters"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.round("score", 4).alias("score"))))).alias("scores"),
    )
    return done.select(*show, "delimiters", "scores")


def split_packed(df: DataFrame, source: Sequence[str], text: str, delimiters: DataFrame | None = None, min_values: int = 1) -> DataFrame:
    """One row per value of every text: all columns of ``df`` plus ``value_pos`` (from 1), ``value_text`` and ``n_values``.

    Texts are cut at the delimiters inferred for their source; a piece that is no value (a remark) gets no row, nor do null,
    empty or wordy texts. A comma in quotes around one number is a decimal comma and stays in ``value_text``. Texts with
    fewer than ``min_values`` values give no rows. Repeated rows are split each; columns of the new names are replaced.
    """
    require(df, [*source, text])
    base = df.drop("value_pos", "value_text", "n_values", "delimiters", "scores")
    known = (delimiters if delimiters is not None else infer_delimiters(base, source, text)).select(*source, _pattern(F.col("delimiters")).alias("__re"))
    named = join_dimension(base, known, source)
    cut = F.filter(_pieces(_guarded(F.col(text)), F.coalesce("__re", F.lit(r"(?!)"))), lambda p: p.rlike(PIECE))
    out = named.withColumn("__v", cut).withColumn("n_values", F.size("__v")).where(F.col("n_values") >= min_values)
    return out.select(*base.columns, "n_values", F.posexplode("__v").alias("__p", "value_text")).withColumn("value_pos", (F.col("__p") + 1).cast("int")).drop("__p")
