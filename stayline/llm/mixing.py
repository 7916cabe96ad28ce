"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.operators.common import cut_lineage, require, ship_package

#: Folder of the public vocabularies, and the rank file used.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Most sources of one mixture; their totals are what the driver sees.
MAX_SOURCES = 10_000
#: Hash buckets per source in which the tokens of a fractional repetition are measured.
BUCKETS = 4096
#: The published pre-split pattern of the rank files. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, object] = {}


def encoding(path: str):  # noqa: ANN201
    """The byte-level BPE of a rank file, loaded once per worker."""
    if path not in _loaded:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def n_tokens(text: Column, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text; none of a null one. Strings of special tokens are ordinary text."""
    ship_package()
    path = os.path.join(folder, vocabulary)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for s in batches:
            yield pd.Series([0 if t is None else len(enc.encode_ordinary(t)) for t in s], dtype="int64")

    return count(text)


@dataclass(frozen=True)
class Share:
    """What a source is to give: ``tokens`` of it in ``epochs`` = whole + fractional repetitions."""

    source: str
    target: float
    size: int
    cap: int
    tokens: float

    @property
    def epochs(self) -> float:
        return self.tokens / self.size if self.size else 0.0


def water_fill(targets: dict[str, tuple[float, int]], sizes: dict[str, int], total: float | None = None) -> list[Share]:
    """Tokens per source: its share of ``total``, clamped at ``max_repeats`` times its size, the excess going to the others.

    ``targets``: source to (share, max_repeats). Sources whose part passes their cap are clamped there, and what they can't
    give is spread over the rest in proportion to their shares, until none passes its cap. ``total`` is by default the tokens
    that there are; if even all caps together fall short of it, every source gives its cap. Shares needn't sum to 1; sources
    without documents or with no repetitions give nothing; negative shares are an error.
    """
    if any(w < 0 or r < 0 for w, r in targets.values()):
        raise ValueError("shares and repetitions can't be negative")
    cap = {s: r * sizes.get(s, 0) for s, (w, r) in targets.items()}
    left = float(sum(sizes.get(s, 0) for s in targets) if total is None else total)
    given: dict[str, float] = {}
    free = {s for s, (w, _) in targets.items() if w > 0}
    while free:
        weight = sum(targets[s][0] for s in free)
        over = {s for s in free if targets[s][0] / weight * left >= cap[s]}
        if not over:
            given |= {s: targets[s][0] / weight * left for s in free}
            break
        for s in over:
            given[s] = float(cap[s])
            left -= cap[s]
        left = max(left, 0.0)
        free -= over
    return [Share(s, targets[s][0], sizes.get(s, 0), targets[s][1], given.get(s, 0.0)) for s in sorted(targets)]


def source_key(c: Column) -> Column:
    """A source without regard to case and outer blanks."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source", folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). Mixture: ``doc_id, source, n_tokens, repeats``, documents used at least once. Report: per source the
    target, feasible and actual share, tokens there and used, documents used and the repetitions.

    Documents of no target source (a null source too) and documents without tokens are not used. ``targets`` has ``source,
    target_share, max_repeats``, at most ``MAX_SOURCES`` rows; of repeated sources shares add up and the least cap holds. Repeated
    documents count each. Without any document shares are null. Tokens are counted once, over whole texts. One sum per source reaches the driver. The fractional
    repetition takes documents by a seeded hash: whole hash buckets as far as the wanted tokens go, and in the one bucket
    that passes them documents in hash order; no source is sorted or gathered.
    """
    require(docs, [doc_id, text, source])
    spark = docs.sparkSession
    goal = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL AND target_share IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("w"), F.min("max_repeats").alias("r"))
    rows = goal.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    want = {r.source: (float(r.w), int(r.r or 0)) for r in rows}
    names = spark.createDataFrame([(s,) for s in want], "source string")
    slim = docs.select(F.col(doc_id).alias("doc_id"), source_key(F.col(source)).alias("source"), F.col(text).alias("t"))
    counted = slim.join(F.broadcast(names), "source", "left_semi").select("doc_id", "source", n_tokens(F.col("t"), folder).alias("n_tokens"))
    at = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    counted = cut_lineage(counted.withColumn("u", at).withColumn("bucket", F.pmod("u", F.lit(BUCKETS)).cast("int")).where("n_tokens > 0"))
    per = cut_lineage(counted.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n")))
    sizes = {r.source: int(r.n) for r in per.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    plan = {s.source: s for s in water_fill(want, sizes, total)}
    rows = [(s.source, int(s.epochs + 1e-9), float(max(0.0, (s.epochs - int(s.epochs + 1e-9)) * s.size))) for s in plan.values() if s.size]
    goal_ = spark.createDataFrame(rows, "source string, whole int, wanted double")
    # the bucket that passes what is wanted of a source, and what is left for it: found where the buckets' sums are
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = per.join(F.broadcast(goal_), "source").withColumn("upto", F.sum("n").over(run))
    full = F.col("upto") <= F.col("wanted")
    cut = upto.groupBy("source", "whole", "wanted").agg(F.max(F.when(full, F.col("bucket"))).alias("last"), F.max(F.when(full, F.col("upto"))).alias("had"))
    # empty buckets lie between full ones: the edge is the first bucket beyond the last full one that has tokens
    cut = cut.select("source", "whole", F.coalesce(F.col("last") + 1, F.lit(0)).alias("edge"), (F.col("wanted") - F.coalesce("had", F.lit(0))).alias("rest"))
    nxt = per.join(F.broadcast(cut), "source").where("bucket >= edge").groupBy("source").agg(F.min("bucket").alias("__e"))
    cut = cut_lineage(cut.join(nxt, "source", "left").withColumn("edge", F.coalesce("__e", "edge")).drop("__e"))
    placed = counted.join(F.broadcast(cut), "source")
    inside = placed.where("bucket <> edge").withColumn("extra", (F.col("bucket") < F.col("edge")).cast("int"))
    w = Window.partitionBy("source").orderBy("u", "doc_id", "n_tokens")
    border = placed.where("bucket = edge").withColumn("extra", (F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("rest")).cast("int"))
    used = inside.unionByName(border).withColumn("repeats", F.col("whole") + F.col("extra"))
    mixture = used.where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")
    goals = spark.createDataFrame([(s.source, s.target, s.size, s.cap, s.tokens) for s in plan.values()], "source string, target_share double, tokens_there bigint, max_repeats int, tokens_wanted double")
    sums = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_used"), F.count(F.lit(1)).alias("docs_used"), F.max("repeats").alias("most_repeats"))
    all_ = Window.partitionBy()
    report = F.broadcast(goals).join(sums, "source", "left").fillna(0, ["tokens_used", "docs_used", "most_repeats"])
    report = report.withColumn("feasible_share", F.try_divide(F.col("tokens_wanted"), F.sum("tokens_wanted").over(all_))).withColumn("actual_share", F.try_divide(F.col("tokens_used"), F.sum("tokens_used").over(all_)))
    return mixture, report.drop("tokens_wanted")

