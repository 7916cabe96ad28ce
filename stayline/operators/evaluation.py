"""Evaluation of whole change logs, of simulated series and of task outcomes, each in one grouped result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.numeric import min_max
from stayline.operators import joins as J
from stayline.operators import metrics as M
from stayline.operators.common import join_dimension

_KEY = ["visit", "timepoint", "part", "sub", "section", "category", "label"]



def variable_bounds(history: DataFrame) -> DataFrame:
    """Per reading of a history (:mod:`stayline.operators.visits`) what its numbers range over: ``section, category, label, least, most, p1, p2, p98, p99, low, high``.

    ``low`` and ``high`` are the 1 % and 99 % again, under the names that the scores take. Over all visits; readings without a number have no row.
    """
    v = history.where("kind = 'value' AND num IS NOT NULL").groupBy("section", "category", "label")
    q = v.agg(F.min("num").alias("least"), F.max("num").alias("most"), F.percentile("num", F.array(*[F.lit(x) for x in (0.01, 0.02, 0.98, 0.99)])).alias("q"))
    return q.select("section", "category", "label", "least", "most", *[F.col("q")[i].alias(n) for i, n in enumerate(("p1", "p2", "p98", "p99"))], F.col("q")[0].alias("low"), F.col("q")[3].alias("high"))


def change_metrics(gt: DataFrame, pred: DataFrame, bounds: DataFrame) -> DataFrame:
    """Scores of predicted changes, long: ``level, domain, kind, metric, value``.

    ``gt``, ``pred``: typed facts (:func:`stayline.operators.changes.typed_facts`); ``bounds``: ``section, label, low, high`` (1 % and 99 %). Per domain (part and section): names of events give precision,
    recall and F1; readings that are numbers on the sides that have them give RMSE and MAE, clipped to the bounds and scaled to them, a missing side at the worst bound (a
    missing truth at the lower one; without bounds the pair counts as ``skipped``); words give accuracy, a missing side as a word of its own; hours
    left RMSE and MAE as they are; dispositions accuracy; diagnosis categories precision, recall and F1. ``macro`` is the mean over domains that have a score (0 if none has), ``micro`` of pooled counts.
    """
    domain = F.concat_ws(".", "part", "section").alias("domain")
    side = lambda df, n: df.where("kind IN ('value', 'active', 'each')").groupBy(*_KEY).agg(F.min("num").alias(f"{n}_num"), F.min("text").alias(f"{n}_text"), F.min("kind").alias(f"{n}_kind"))
    j = side(gt, "g").join(side(pred, "p"), _KEY, "full_outer").withColumns({"g": F.col("g_kind").isNotNull(), "p": F.col("p_kind").isNotNull()})
    events = j.select(domain, "g", "p").unionByName(_codes(gt, pred))
    counts = events.groupBy("domain").agg(*[c.alias(n) for n, c in M.confusion(F.col("g"), F.col("p")).items() if n != "tn"])
    p, r, f = M.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    scored = counts.select("domain", F.lit("event").alias("kind"), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))
    one = lambda df, *ms: df.select("domain", "kind", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ms])).alias("x")).select("domain", "kind", "x.metric", "x.value")
    # numbers: whichever side is there is one
    value = F.coalesce("g_kind", "p_kind") == "value"
    num = (F.col("g_num").isNotNull() | ~F.col("g")) & (F.col("p_num").isNotNull() | ~F.col("p"))
    n = join_dimension(j.where(value & num), bounds.select("section", "label", "low", "high").dropDuplicates(["section", "label"]), ["section", "label"])
    n = M.worst_case(n, "g_num", "p_num", "low", "high")
    scale = lambda c: F.coalesce(min_max(F.col(c), F.col("low"), F.col("high")), F.when(F.col("low").isNull() | F.col("high").isNull(), F.col(c)))
    n = n.select(domain, "skipped", F.when(~F.col("skipped"), scale("g_num")).alias("a"), F.when(~F.col("skipped"), scale("p_num")).alias("b"))
    rmse, mae = M.regression(F.col("a"), F.col("b"))
    hours = lambda df, c: df.where("kind = 'los'").groupBy("visit", "timepoint", "part", "sub", "section").agg(F.min("num").alias(c))
    los = hours(gt, "a").join(hours(pred, "b"), ["visit", "timepoint", "part", "sub", "section"]).select(domain, F.lit(False).alias("skipped"), "a", "b")
    num_scores = n.groupBy("domain").agg(F.lit("numerical").alias("kind"), rmse.alias("rmse"), mae.alias("mae"), F.count_if("skipped").alias("skipped"))
    los_scores = los.groupBy("domain").agg(F.lit("los").alias("kind"), rmse.alias("rmse"), mae.alias("mae"), F.lit(0).alias("skipped"))
    # words
    t = j.where(value & ~num).select(domain, F.lit("categorical").alias("kind"), "g_text", "p_text")
    ends = lambda df, c: df.where("kind = 'end'").groupBy("visit", "timepoint", "part", "sub", "section").agg(F.min("text").alias(c))
    end = ends(gt, "g_text").join(ends(pred, "p_text"), ["visit", "timepoint", "part", "sub", "section"], "full_outer").select(domain, F.lit("disposition").alias("kind"), "g_text", "p_text")
    words = t.unionByName(end)
    right = F.count_if(F.coalesce("g_text", F.lit("UNKNOWN")) == F.coalesce("p_text", F.lit("UNKNOWN")))
    word_scores = words.groupBy("domain", "kind").agg((right / F.count(F.lit(1))).alias("accuracy"), right.alias("correct"), F.count(F.lit(1)).alias("total"))
    rows = one(scored, "tp", "fp", "fn", "precision", "recall", "f1").unionByName(one(num_scores, "rmse", "mae", "skipped")).unionByName(one(los_scores, "rmse", "mae")).unionByName(one(word_scores, "accuracy"))
    macro = rows.where("metric NOT IN ('tp', 'fp', 'fn', 'skipped') AND kind IN ('event', 'numerical', 'categorical')").groupBy("kind", "metric").agg(F.coalesce(F.avg(F.nanvl("value", F.lit(None).cast("double"))), F.lit(0.0)).alias("value"))
    micro_e = scored.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.lit("event").alias("kind"), F.lit("all").alias("domain"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    micro_e = micro_e.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})
    micro_n = n.agg(F.coalesce(rmse, F.lit(0.0)).alias("rmse"), F.coalesce(mae, F.lit(0.0)).alias("mae"), F.lit("numerical").alias("kind"), F.lit("all").alias("domain"))
    micro_w = word_scores.where("kind = 'categorical'").agg(F.coalesce(F.sum("correct") / F.sum("total"), F.lit(0.0)).alias("accuracy"), F.lit("categorical").alias("kind"), F.lit("all").alias("domain"))
    micro = one(micro_e, "precision", "recall", "f1").unionByName(one(micro_n, "rmse", "mae")).unionByName(one(micro_w, "accuracy"))
    level = lambda df, name: df.select(F.lit(name).alias("level"), "domain", "kind", "metric", "value")
    return level(rows, "domain").unionByName(level(macro.withColumn("domain", F.lit("all")), "macro")).unionByName(level(micro, "micro"))


def _codes(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Diagnosis categories as events."""
    side = lambda df, n: df.where("kind = 'icd'").select("visit", "timepoint", "part", "section", "text").distinct().withColumn(n, F.lit(True))
    j = side(gt, "g").join(side(pred, "p"), ["visit", "timepoint", "part", "section", "text"], "full_outer")
    return j.select(F.concat_ws(".", "part", "section").alias("domain"), F.coalesce("g", F.lit(False)).alias("g"), F.coalesce("p", F.lit(False)).alias("p"))


def series_metrics(gt: DataFrame, pred: DataFrame, bounds: DataFrame, tol_seconds: int = 3600) -> DataFrame:
    """Scores of predicted series with a tolerance in time, per domain: ``domain, tp, fp, fn, precision, recall, f1, rmse, mae, rmse_scaled, mae_scaled, accuracy``.

    ``gt``, ``pred``: ``visit, domain, label, t, num, text``. An event is hit if the other side has its label within the tolerance, one for many. Numbers are held against the
    nearest value within the tolerance, raw and scaled to the ``bounds`` (``domain, label, low, high``); words are right if one within it is equal. Numbers
    without a partner don't count. Domains without numbers or words have nulls there.
    """
    keys = ["visit", "domain", "label"]
    g, p = (x.select(*keys, "t", "num", "text") for x in (gt, pred))
    count = lambda df, n: df.groupBy("domain").agg(F.count(F.lit(1)).alias(n))
    parts = [
        count(J.tolerant(g, p, keys, "t", tol_seconds, "left_semi"), "tp"),
        count(J.tolerant(g, p, keys, "t", tol_seconds, "left_anti"), "fn"),
        count(J.tolerant(p, g, keys, "t", tol_seconds, "left_anti"), "fp"),
    ]
    near = J.nearest_value(p.where("num IS NOT NULL").select(*keys, "t", "num"), g.where("num IS NOT NULL").select(*keys, "t", "num"), keys, "t", "num", tol_seconds)
    near = join_dimension(near, bounds.select("domain", "label", "low", "high").dropDuplicates(["domain", "label"]), ["domain", "label"])
    a, b = M.regression(F.col("gt_value"), F.col("num"))
    c, d = M.regression(min_max(F.col("gt_value"), F.col("low"), F.col("high")), min_max(F.col("num"), F.col("low"), F.col("high")))
    parts.append(near.groupBy("domain").agg(a.alias("rmse"), b.alias("mae"), c.alias("rmse_scaled"), d.alias("mae_scaled")))
    words = [x.where("num IS NULL AND text IS NOT NULL").select(*keys, "t", M.plain_words(F.col("label"), F.col("text")).alias("text")) for x in (p, g)]
    parts.append(J.any_equal(*words, keys, "t", "text", tol_seconds).groupBy("domain").agg((F.count_if("equal") / F.count(F.lit(1))).alias("accuracy")))
    out = g.select("domain").union(p.select("domain")).distinct()
    for x in parts:
        out = out.join(x, "domain", "left")
    out = out.fillna(0, ["tp", "fp", "fn"])
    q, r, f = M.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.withColumns({"precision": q, "recall": r, "f1": f})


def outcome_label(task: str, disposition: Column, released: Column, hours: Column, future: bool = False) -> Column:
    """What a simulated stay says for a task: 1, 0 or null (a death has no length).

    ``icu_los`` (more than three days): by the hours to the release; never released is yes; with ``future`` the word asked for decides. ``icu_mortality``: a death. ``ed_admission``: an admission.
    """
    if task == "icu_los":
        if future:
            return (F.coalesce(disposition, F.lit("")) == "STAYED").cast("int")
        return F.when(released, (hours > 72).cast("int")).when(disposition == "DIED", F.lit(None).cast("int")).otherwise(F.lit(1))
    if task in ("icu_mortality", "ed_admission"):
        return (F.coalesce(disposition, F.lit("")) == {"icu_mortality": "DIED", "ed_admission": "ADMITTED"}[task]).cast("int")
    raise ValueError(f"unknown task: {task}")


def binary_report(df: DataFrame, gt: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """``n, accuracy, precision, recall, f1, auc`` of 0/1 columns per group. A missing prediction counts as 0, but leaves the area under the curve null; that of
    hard predictions is (sensitivity + specificity) / 2, and null where a class is absent. Rows without truth are left out."""
    d = df.where(F.col(gt).isNotNull())
    g, p = F.col(gt) == 1, F.coalesce(F.col(pred), F.lit(0)) == 1
    c = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[x.alias(k) for k, x in M.confusion(g, p).items()], F.count_if(F.col(pred).isNull()).alias("missing"))
    q, r = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0), F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    both = (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0) & (F.col("missing") == 0)
    auc = F.when(both, (F.col("tp") / (F.col("tp") + F.col("fn")) + F.col("tn") / (F.col("tn") + F.col("fp"))) / 2)
    return c.select(*by, "n", (F.try_divide(F.col("tp") + F.col("tn"), F.col("n"))).alias("accuracy"), q.alias("precision"), r.alias("recall"), f.alias("f1"), auc.alias("auc"))


def multilabel_report(df: DataFrame, gt: str, pred: str, names: Sequence[str]) -> DataFrame:
    """:func:`binary_report` of each class (``label``) of two array columns; a null array has no class."""
    hot = lambda c, n: F.coalesce(F.array_contains(c, n), F.lit(False)).cast("int")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), hot(gt, n).alias("g"), hot(pred, n).alias("p")) for n in names]))
    return binary_report(df.select(each.alias("x")).select("x.*"), "g", "p", ["label"])
