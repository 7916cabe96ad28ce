"""Token budgets: water-filling, tail cuts, parts, and prompts; blocks and shards of work; embeddings in 8 bits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.operators.common import attach, cut_lineage, ship_package

#: Characters that count as a token where no tokenizer is given.
CHARS_PER_TOKEN = 3


def level(lengths: Column, limit: Column) -> Column:
    """The largest b with sum(min(length, b)) <= limit, as a whole number; the greatest length if all fit.

    Closed form over the sorted lengths: with the k shortest whole, the others get an equal part of what is left.
    """
    s = F.array_sort(lengths)
    n = F.size(s)

    def step(acc, x):  # noqa: ANN001, ANN202
        fits = acc["open"] & (x * (n - acc["k"]) <= limit - acc["used"])
        return F.struct(
            fits.alias("open"),
            F.when(fits, acc["k"] + 1).otherwise(acc["k"]).alias("k"),
            F.when(fits, acc["used"] + x).otherwise(acc["used"]).alias("used"),
        )

    zero = F.struct(F.lit(True).alias("open"), F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("used"))
    done = F.aggregate(F.transform(s, lambda x: x.cast("bigint")), zero, step)
    return F.when(n == 0, F.lit(0)).when(done["k"] == n, F.element_at(s, -1)).otherwise(F.floor((limit - done["used"]) / (n - done["k"]))).cast("bigint")


def shorten(parts: Column, limit: Column, margin: float = 0.0) -> Column:
    """Texts cut to their last characters so that together they keep within the limit; of it, the share ``margin`` is kept free."""
    b = level(F.transform(parts, F.length), F.floor(limit * F.lit(1 - margin)) if margin else limit)
    return F.transform(parts, lambda t: F.when(F.length(t) > b, F.right(t, b)).otherwise(t))


def split_parts(items: DataFrame, keys: Sequence[str], order: str, length: str, budget: int, max_parts: int = 4, seed: str | None = None) -> DataFrame:
    """Part number of each item by its cumulated length; items of at most ``max_parts`` parts are kept, the latest ones or, with a ``seed``, any by hash."""
    from stayline.operators.sampling import draw

    w = Window.partitionBy(*keys).orderBy(order)
    d = items.withColumn("part", F.floor((F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1) / budget).cast("bigint"))
    if seed is not None:
        p = d.select(*keys, "part").distinct().withColumn("__u", draw(seed, *keys, "part"))
        kept = p.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("__u", "part"))).where(F.col("__r") <= max_parts).drop("__u", "__r")
        return d.join(kept, [*keys, "part"], "left_semi")
    last = d.groupBy(*keys).agg(F.max("part").alias("__m"))
    return d.join(last, list(keys)).where(F.col("part") > F.col("__m") - max_parts).drop("__m")


def sections_to_budget(entries: DataFrame, keys: Sequence[str], section: str, name: str, length: str, budget: int, seed: str, tail: dict[str, str] | None = None, fixed: Sequence[str] = ()) -> DataFrame:
    """Entries of a sample's sections that stay once the drop ratio was raised by tenths until all that is kept fits the budget; adds ``drop_ratio``.

    At ratio r/10 each section keeps ceil(n (10 - r) / 10) of its n entries, never less than one: by hash, or in ``tail`` sections (name to the column that orders them) the first
    in order. ``fixed`` sections lose nothing. If nothing fits, the ratio is 1.
    """
    from stayline.operators.sampling import draw

    sec = Window.partitionBy(*keys, section)
    place = F.lit(None).cast("double")
    for s, c in (tail or {}).items():
        place = F.when(F.col(section) == s, F.col(c).cast("double")).otherwise(place)
    d = entries.withColumn("__u", F.coalesce(place, draw(seed, *keys, section, name))).withColumn("__n", F.count(F.lit(1)).over(sec))
    d = d.withColumn("__k", F.row_number().over(sec.orderBy("__u", name)))
    stays = lambda r: F.col(section).isin(*fixed) | (F.col("__k") <= F.greatest(F.ceil(F.col("__n") * (10 - r) / 10), F.lit(1))) if fixed else F.col("__k") <= F.greatest(F.ceil(F.col("__n") * (10 - r) / 10), F.lit(1))
    kept = F.array(*[F.sum(F.when(stays(F.lit(r)), F.col(length)).otherwise(0)).over(Window.partitionBy(*keys)) for r in range(11)])
    ratio = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.lit(10)), lambda r: F.get(F.col("__t"), r) <= budget)), F.lit(10))
    d = d.withColumn("__t", kept).withColumn("__r", ratio)
    return d.where(stays(F.col("__r"))).withColumn("drop_ratio", F.col("__r") / 10).drop("__u", "__n", "__k", "__t", "__r")


def drop_to_budget(entries: DataFrame, keys: Sequence[str], name: str, length: str, budget: int, seed: str) -> DataFrame:
    """Entries of a sample that stay once the drop ratio was raised by tenths until the kept characters fit the budget.

    Closed form of the loop: entries in hash order; at ratio r/10 the first ceil(n (10 - r) / 10) stay; the least r whose prefix
    fits is taken, at r = 10 the one entry that comes first.
    """
    from stayline.operators.sampling import draw

    w = Window.partitionBy(*keys)
    d = entries.withColumn("__u", draw(seed, *keys, name)).withColumn("__n", F.count(F.lit(1)).over(w))
    o = w.orderBy("__u", name)
    d = d.withColumn("__k", F.row_number().over(o)).withColumn("__c", F.sum(length).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    fit = F.max(F.when(F.col("__c") <= budget, F.col("__k"))).over(w)
    d = d.withColumn("__fit", F.coalesce(fit, F.lit(0)))
    r = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(10)), lambda x: F.ceil(F.col("__n") * (10 - x) / 10) <= F.col("__fit")))
    keep = F.greatest(F.ceil(F.col("__n") * (10 - F.coalesce(r, F.lit(10))) / 10), F.lit(1))
    return d.where(F.col("__k") <= keep).withColumn("drop_ratio", F.coalesce(r, F.lit(10)) / 10).drop("__u", "__n", "__k", "__c", "__fit")


def chat_prompt(roles: Column, texts: Column, generate: bool = False) -> Column:
    """Chat turns as one text: ``<|role|>\\ntext\\n`` each, with an open assistant turn at the end if asked for."""
    t = F.array_join(F.zip_with(roles, texts, lambda r, x: F.concat(F.lit("<|"), r, F.lit("|>\n"), x, F.lit("\n"))), "")
    return F.concat(t, F.lit("<|assistant|>\n")) if generate else t


def label_mask(prompt_ids: Column, answer_ids: Column) -> Column:
    """Training labels: -100 over the prompt, the answer's own numbers behind it."""
    return F.concat(F.transform(prompt_ids, lambda _: F.lit(-100).cast("bigint")), F.transform(answer_ids, lambda x: x.cast("bigint")))


def clamp_int8(v: Column) -> Column:
    """Numbers clamped to [-128, 127] and cut to bytes."""
    return F.transform(v, lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), x.cast("double"))).cast("tinyint"))


def embed(df: DataFrame, text: str, model: Callable[[list[str]], np.ndarray], name: str = "embedding") -> DataFrame:
    """Rows with the model's states of their text as bytes (``ARRAY<ARRAY<TINYINT>>``: states, then dimensions). ``model`` gets the texts of an Arrow
    batch, nulls as empty ones, and gives an array (texts, states, dimensions); it is shipped to the workers, so it should load what it needs there."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = np.clip(np.asarray(model([t or "" for t in b[text]]), dtype=np.float64), -128, 127).astype(np.int8)
                yield b.assign(**{name: [[row.tolist() for row in states] for states in v]})

    base = df.drop(name)
    return base.mapInPandas(run, ", ".join([*(f"`{c}` {t}" for c, t in base.dtypes), f"{name} array<array<tinyint>>"]))


def group_embeddings(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "embedding") -> DataFrame:
    """The embeddings of a sample's sections in order, in one list, with the sections' names beside it."""
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, name))).alias("__e"))
    return g.select(*keys, F.transform("__e", lambda e: F.struct(*[e[o].alias(o) for o in order])).alias("sections"), F.transform("__e", lambda e: e[name]).alias(name))


def summary_slice(states: Column, n: int = 8, end: int = 2) -> Column:
    """The ``n`` states before the last ``end`` ones; fewer if there are fewer."""
    size = F.greatest(F.size(states) - end, F.lit(0))
    return F.slice(states, F.greatest(size - n, F.lit(0)) + 1, F.least(size, F.lit(n)))


def length_blocks(df: DataFrame, order: str, length: str, tie: str, block: int = 100) -> DataFrame:
    """Longest first inside blocks of ``block`` rows: ``block_no`` and ``place``.

    Rows are numbered in order by range shards whose sizes are summed up, so numbering needs no single task.
    """
    d = row_numbers(df, order, tie).withColumn("block_no", F.floor((F.col("rn") - 1) / block).cast("bigint"))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("block_no").orderBy(F.col(length).desc(), tie))).drop("rn")


def row_numbers(df: DataFrame, order: str, tie: str) -> DataFrame:
    """``rn`` = 1, 2, ... in (order, tie): range partitions, written down once, are numbered each for itself, offset by the rows of those before.

    There are as many as shuffle partitions, which go with the data; equal values of ``order`` are parted by ``tie``.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, F.col(order), F.col(tie)) if order != tie else df.repartitionByRange(n, F.col(order))
    d = cut_lineage(ranged.withColumn("__s", F.spark_partition_id()))
    sizes = d.groupBy("__s").agg(F.count(F.lit(1)).alias("__n"))  # a row per partition
    off = sizes.withColumn("__off", F.sum("__n").over(Window.orderBy("__s")) - F.col("__n")).select("__s", "__off")
    return d.join(F.broadcast(off), "__s").withColumn("rn", F.row_number().over(Window.partitionBy("__s").orderBy(order, tie)) + F.col("__off")).drop("__s", "__off")


def position_shards(df: DataFrame, order: str, parts: int = 4) -> DataFrame:
    """Rows in order, cut at multiples of int(n / parts): ``part`` 0, 1, ...; the last part takes the rest."""
    d = row_numbers(df, order, order).transform(attach, df.agg(F.count(F.lit(1)).alias("__t")))
    size = F.greatest(F.floor(F.col("__t") / parts), F.lit(1))
    return d.withColumn("part", F.least(F.floor((F.col("rn") - 1) / size), F.lit(parts - 1)).cast("bigint")).drop("rn", "__t")


def worker_shards(df: DataFrame, key: str, workers: int) -> DataFrame:
    """Distinct keys in order, in ``workers`` parts of sizes that differ by one at most: ``key, worker``."""
    ids = row_numbers(df.select(key).dropna().distinct(), key, key)
    total = ids.agg(F.count(F.lit(1)).alias("__t"))
    d = ids.transform(attach, total)
    base, extra = F.floor(F.col("__t") / workers), F.col("__t") % workers
    head = extra * (base + 1)
    i = F.col("rn") - 1
    w = F.when(i < head, F.floor(i / (base + 1))).otherwise(extra + F.floor((i - head) / F.greatest(base, F.lit(1))))
    return d.select(key, w.cast("bigint").alias("worker"))
