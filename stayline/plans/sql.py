"""Pieces of SQL that the checks share."""


def hour(c: str) -> str:
    """Half-even hour of a timestamp."""
    return f"make_timestamp((round_even(epoch_us({c}) / 3600000000.0, 0) * 3600000000)::BIGINT)"


def at(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def num(c: str) -> str:
    return f"(CASE WHEN isfinite(TRY_CAST({c} AS DOUBLE)) THEN TRY_CAST({c} AS DOUBLE) END)"


def text_of(c: str) -> str:
    return f"regexp_replace(printf('%.1f', round_even(({c})::DOUBLE, 1)), '\\.0$', '')"


#: Numeric chart readings on the hour grid.
READINGS = f"""readings AS (SELECT stay_id, itemid, {hour('charttime')} AS hour, charttime, {num('valuenum')} AS v, value
  FROM chartevents WHERE stay_id IS NOT NULL AND charttime IS NOT NULL)"""
