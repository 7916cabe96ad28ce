"""Scores: events, numbers, words, binary and multi-label, with defined results where there is nothing to score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.operators.common import attach
from stayline.functions.numeric import safe_ratio


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1: 0 where a denominator is 0, NaN for all three where there was nothing at all."""
    p, r = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    none = (tp + fp + fn) == 0
    return tuple(F.when(none, F.lit(float("nan"))).otherwise(x) for x in (p, r, f1))


def confusion(gt: Column, pred: Column) -> dict[str, Column]:
    """Summed tp, fp, fn, tn of two boolean columns."""
    return {"tp": F.count_if(gt & pred), "fp": F.count_if(~gt & pred), "fn": F.count_if(gt & ~pred), "tn": F.count_if(~gt & ~pred)}


def event_sets(gt: DataFrame, pred: DataFrame, keys: Sequence[str], event: str, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn per group of events as sets per key; one full join of the distinct events."""
    g = gt.select(*keys, event, *by).distinct().withColumn("__g", F.lit(True))
    p = pred.select(*keys, event, *by).distinct().withColumn("__p", F.lit(True))
    j = g.join(p, [*keys, event, *by], "full_outer")
    a, b = F.coalesce("__g", F.lit(False)), F.coalesce("__p", F.lit(False))
    return j.groupBy(*by).agg(*[c.alias(n) for n, c in confusion(a, b).items() if n != "tn"])


def regression(gt: Column, pred: Column) -> tuple[Column, Column]:
    """RMSE and MAE."""
    return F.sqrt(F.avg(F.pow(gt - pred, F.lit(2.0)))), F.avg(F.abs(gt - pred))


def worst_case(aligned: DataFrame, gt: str, pred: str, low: str, high: str) -> DataFrame:
    """A missing prediction becomes the bound that is farther from the truth, a missing truth the lower bound; rows without bounds give ``skipped``."""
    far = F.when(F.abs(F.col(gt) - F.col(low)) >= F.abs(F.col(gt) - F.col(high)), F.col(low)).otherwise(F.col(high))
    both = F.col(gt).isNotNull() & F.col(pred).isNotNull()
    d = aligned.withColumn("skipped", ~both & (F.col(low).isNull() | F.col(high).isNull()))
    return d.withColumn(pred, F.coalesce(F.col(pred), far)).withColumn(gt, F.coalesce(F.col(gt), F.col(low)))


def accuracy(gt: Column, pred: Column, unknown: str = "UNKNOWN") -> Column:
    """Share of equal words, a missing side counting as a word of its own; NaN for no rows."""
    same = F.coalesce(gt, F.lit(unknown)) == F.coalesce(pred, F.lit(unknown))
    return F.when(F.count(F.lit(1)) == 0, F.lit(float("nan"))).otherwise(F.count_if(same) / F.count(F.lit(1)))


def auc_by_rank(df: DataFrame, by: Sequence[str], gt: str, score: str) -> DataFrame:
    """Area under the ROC curve per group by Mann-Whitney with tied scores at half; NaN where a class is absent.

    Rows are first aggregated to distinct scores; only those are ordered.
    """
    from pyspark.sql import Window

    s = df.groupBy(*by, score).agg(F.count_if(F.col(gt)).alias("__p"), F.count_if(~F.col(gt)).alias("__q"))
    w = Window.partitionBy(*by).orderBy(score) if by else Window.orderBy(score)
    s = s.withColumn("__below", F.coalesce(F.sum("__q").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    u = F.sum(F.col("__p") * (F.col("__below") + F.col("__q") / 2))
    pos, neg = F.sum("__p"), F.sum("__q")
    return s.groupBy(*by).agg(F.when((pos > 0) & (neg > 0), u / (pos * neg)).otherwise(F.lit(float("nan"))).alias("auc"))


def macro_micro(counts: DataFrame) -> DataFrame:
    """Macro F1 (mean over groups that aren't NaN; 0 if all are) and micro F1 (of summed counts) from tp, fp, fn per group."""
    f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))[2]
    g = counts.withColumn("__f", F.nanvl(f1, F.lit(None).cast("double"))).agg(F.coalesce(F.avg("__f"), F.lit(0.0)).alias("macro_f1"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return g.select("macro_f1", prf(F.col("tp"), F.col("fp"), F.col("fn"))[2].alias("micro_f1"))


def corpus_bleu(df: DataFrame, reference: str, candidate: str, n: int = 4) -> DataFrame:
    """Corpus BLEU of word lists: clipped n-gram matches summed over the corpus, brevity penalty, geometric mean over 1..n."""
    # a pair of texts is named by hashes of it, the same on every run; equal pairs count together, which gives the same sums
    code = F.struct(F.xxhash64(reference, candidate), F.xxhash64(F.lit("2"), F.col(candidate), F.col(reference)))
    base = df.select(code.alias("__i"), F.split(F.lower(F.trim(reference)), r"\s+").alias("r"), F.split(F.lower(F.trim(candidate)), r"\s+").alias("c"))
    sums = base.agg(F.sum(F.size("r")).alias("__r"), F.sum(F.size("c")).alias("__c"))
    for k in range(1, n + 1):
        grams = lambda a: F.when(F.size(a) >= k, F.transform(F.sequence(F.lit(1), F.size(a) - k + 1), lambda i: F.array_join(F.slice(a, i, k), " "))).otherwise(F.array().cast("array<string>"))  # noqa: B023, E731
        one = lambda side: base.select("__i", F.explode(grams(F.col(side))).alias("g")).groupBy("__i", "g").agg(F.count(F.lit(1)).alias(side))  # noqa: B023, E731
        m = one("c").join(one("r"), ["__i", "g"], "left").agg(F.sum(F.least("c", F.coalesce("r", F.lit(0)))).alias(f"m{k}"), F.sum("c").alias(f"t{k}"))
        sums = sums.transform(attach, m)
    logs = sum((F.log(F.col(f"m{k}") / F.col(f"t{k}")) for k in range(1, n + 1)), F.lit(0.0)) / n
    hit = F.lit(True)
    for k in range(1, n + 1):
        hit = hit & (F.coalesce(F.col(f"m{k}"), F.lit(0)) > 0)
    bp = F.when(F.col("__c") >= F.col("__r"), F.lit(1.0)).otherwise(F.exp(1 - F.col("__r") / F.col("__c")))
    return sums.select(F.when(hit, bp * F.exp(logs)).otherwise(F.lit(0.0)).alias("bleu"))


def false_positive_accuracy(df: DataFrame, gt: str, pred: str) -> DataFrame:
    """Of all predicted names in array columns the share that is true; names that were missed don't count. NaN if none was predicted."""
    hit = F.sum(F.size(F.array_intersect(gt, pred)))
    miss = F.sum(F.size(F.array_except(pred, gt)))
    return df.agg(F.when(hit + miss > 0, hit / (hit + miss)).otherwise(F.lit(float("nan"))).alias("accuracy"), hit.alias("correct"), miss.alias("incorrect"))


def plain_words(event: Column, value: Column) -> Column:
    """Spellings of free-text readings brought to one: pain that can't be assessed, sleep, `n/10`; paced rhythms."""
    v = F.lower(F.trim(value))
    pain = F.when(v.rlike("unable|uta|u/a"), "unable to assess").when(F.contains(v, F.lit("sleep")), "sleeping").when(F.contains(v, F.lit("/10")), F.concat(F.split_part(v, F.lit("/"), F.lit(1)), F.lit(".0"))).otherwise(v)
    return F.when(event == "pain", pain).when((event == "rhythm") & F.contains(v, F.lit("avp")), "av paced").otherwise(v)


def outcome(disposition: Column, released: Column, hours: Column, limit: int = 72) -> Column:
    """1 if a simulated stay is longer than ``limit`` hours: by its length if it ended, null if the patient died, else 1 (out of steps)."""
    return F.when(released, (hours > limit).cast("int")).when(disposition == "DIED", F.lit(None).cast("int")).otherwise(F.lit(1))


def tolerant_scores(gt: DataFrame, pred: DataFrame, keys: Sequence[str], event: str, at: str, value: str, tol_seconds: int) -> DataFrame:
    """Per event: tp, fp, fn within the tolerance, and RMSE and MAE against the nearest value, in one grouped result."""
    from stayline.operators import joins as J

    k = [*keys, event]
    count = lambda df, name: df.groupBy(event).agg(F.count(F.lit(1)).alias(name))
    near = J.nearest_value(pred, gt, k, at, value, tol_seconds)
    rmse, mae = regression(F.col("gt_value"), F.col(value))
    parts = [
        count(J.tolerant(gt, pred, k, at, tol_seconds, "left_semi"), "tp"),
        count(J.tolerant(pred, gt, k, at, tol_seconds, "left_anti"), "fp"),
        count(J.tolerant(gt, pred, k, at, tol_seconds, "left_anti"), "fn"),
        near.groupBy(event).agg(rmse.alias("rmse"), mae.alias("mae")),
    ]
    out = gt.select(event).union(pred.select(event)).distinct()
    for p in parts:
        out = out.join(p, event, "left")
    return out.fillna(0, ["tp", "fp", "fn"])
