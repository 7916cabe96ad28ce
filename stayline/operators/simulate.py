"""Iterative simulation: roll states forward step by step with a pluggable predictor until each is over."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.functions.nested import nested_text
from stayline.operators import changes as C
from stayline.operators.common import cut_lineage
from stayline.operators.visits import describe_visit


def simulate(states: DataFrame, keys: Sequence[str], predict: Callable[[DataFrame], DataFrame], time: str = "t", value: str = "v", max_steps: int = 24, keep_every: int = 2) -> DataFrame:
    """Final states: ``states`` with ``steps`` and ``ended_by`` (``over`` or ``max_steps``).

    ``predict`` gets the open states and gives, per key, the next ``value`` and ``over`` (null: not over); a key that it leaves
    out is over at once. All states advance together, one join on the keys a step; finished ones leave the loop. Lineage is cut
    every ``keep_every`` steps in the shared checkpoint folder. The driver sees a count per cut, never the states.
    """
    live, done = states.withColumn("steps", F.lit(0)), None
    for k in range(max_steps):
        p = predict(live).select(*keys, F.col(value).alias("__v"), F.coalesce("over", F.lit(False)).alias("__o"))
        j = live.join(p, list(keys), "left")
        said = F.col("__said")
        j = j.withColumn("__said", F.col("__o").isNotNull()).withColumn("__o", F.coalesce("__o", F.lit(True))).withColumn(value, F.when(said, F.col("__v")).otherwise(F.col(value)))
        j = j.withColumn(time, F.when(said, F.col(time) + F.expr("INTERVAL 1 HOUR")).otherwise(F.col(time))).withColumn("steps", F.col("steps") + said.cast("int")).drop("__v", "__said")
        if (k + 1) % keep_every == 0:
            j = cut_lineage(j)
        over = j.where("__o").drop("__o").withColumn("ended_by", F.lit("over"))
        done = over if done is None else done.unionByName(over)
        live = j.where("NOT __o").drop("__o")
        if (k + 1) % keep_every == 0:
            done = cut_lineage(done)
            if live.isEmpty():
                break
    rest = live.withColumn("ended_by", F.lit("max_steps"))
    return rest if done is None else done.unionByName(rest)


def repeat_latest(described: DataFrame) -> DataFrame:
    """A stand-in for a model: the change log that repeats the latest value of every reading that is described; ``visit, timepoint, text``."""
    value = F.regexp_extract("value", r"(?:^|, )[0-9/]+: ([^,]*)$", 1)
    named = F.regexp_replace(F.element_at("path", -1), r" ?\([^()]*\)$", "")
    f = described.where(F.array_contains("path", "Lab Results") | F.array_contains("path", "Chart Events") | F.array_contains("path", "Vital Measurements")).where(value != "")
    f = f.withColumn("path", F.concat(F.slice("path", F.lit(1), F.size("path") - 1), F.array(named)))
    g = f.groupBy("visit", "timepoint").agg(F.array_sort(F.collect_list(F.struct("path", value.alias("value")))).alias("facts"))
    return g.select("visit", "timepoint", nested_text(F.col("facts")).alias("text"))


def simulate_visits(history: DataFrame, points: DataFrame, predict: Callable[[DataFrame], DataFrame] = repeat_latest, trailing: int = 24, level: int = 1, max_steps: int = 24, only_ed: bool = False, only_icu: bool = False) -> tuple[DataFrame, DataFrame]:
    """Roll visits on hour by hour: describe the state, predict the change log as text, read it, test for an end, fold it into the state.

    ``points``: the starting ``visit, timepoint, t``; ``predict``: described facts (of all open visits at once) to ``visit, timepoint, text``. Gives (``visit, steps, ended_by``,
    the history with all predicted rows). A visit ends by its dispositions (:func:`stayline.operators.changes.over`), as ``stalled`` when nothing readable is
    predicted, or by ``max_steps``. Finished visits leave the loop; the state is cut off its lineage in the shared folder each step; the driver sees one count a step.
    """
    state, live, done = history, points.select("visit", "timepoint", "t"), None
    for step in range(1, max_steps + 1):
        described = describe_visit(state.join(live.select("visit"), "visit", "left_semi"), live, trailing, level)
        typed = cut_lineage(C.read_changes(predict(described)))
        nxt = live.withColumn("next_t", F.col("t") + F.expr("INTERVAL 1 HOUR"))
        state, endings = C.fold(state, typed, nxt)
        state = cut_lineage(state)
        ended = C.over(endings, only_ed, only_icu)
        said = typed.select("visit").distinct().withColumn("__said", F.lit(True))
        live = cut_lineage(nxt.join(ended, "visit", "left").join(said, "visit", "left"))
        out = live.withColumn("ended_by", F.coalesce("ended_by", F.when(F.col("__said").isNull(), F.lit("stalled")))).where("ended_by IS NOT NULL").select("visit", F.lit(step).alias("steps"), "ended_by")
        done = out if done is None else done.unionByName(out)
        live = live.where("ended_by IS NULL AND __said").select("visit", (F.col("timepoint") + 1).alias("timepoint"), F.col("next_t").alias("t"))
        if live.isEmpty():
            break
    rest = live.select("visit", F.lit(max_steps).alias("steps"), F.lit("max_steps").alias("ended_by"))
    return (rest if done is None else done.unionByName(rest)), state
