"""References to records that do not exist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.operators.common import require, salted_join


def orphan_references(child: DataFrame, fk: Sequence[str], parent: DataFrame, pk: Sequence[str], required: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``child`` whose foreign key isn't among the keys of ``parent``.

    A key with a null in ``required`` (all of ``fk`` by default) is no reference. Other null parts match only null.
    Repeated child rows stay; an empty parent makes every reference an orphan; an empty child gives no rows.

    Distinct foreign keys, collapsed before the shuffle, meet distinct parent keys in a left anti-join; the orphan keys,
    unique by then, are joined back with the child's hot keys salted.
    """
    require(child, fk)
    require(parent, pk)
    need = list(required or fk)
    names = [f"__k{i}" for i in range(len(fk))]
    named = child.where(" AND ".join(f"`{c}` IS NOT NULL" for c in need))
    # a null part becomes a text of its own, so that equality holds for it too
    keyed = named.withColumns({n: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for n, c in zip(names, fk)})
    parents = parent.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")).alias(n) for n, c in zip(names, pk)]).distinct()
    orphans = keyed.select(*names).distinct().join(parents, names, "left_anti")
    return salted_join(keyed, orphans, names, "left_semi").drop(*names)


def late_references(child: DataFrame, fk: str, at: str, parent: DataFrame, pk: str, begins: str, grace_hours: float = 24.0) -> DataFrame:
    """The rows of ``child`` whose parent exists but begins more than ``grace_hours`` after the child's ``at``.

    Every row of the parent key must begin so late; a parent row without a beginning counts as begun. Child rows without
    key or time are left out.
    """
    require(child, [fk, at])
    require(parent, [pk, begins])
    first = (
        parent.where(F.col(pk).isNotNull())
        .groupBy(F.col(pk).alias("__k"))
        .agg(F.min(begins).alias("__first"), F.max(F.col(begins).isNull()).alias("__open"))
        .where(~F.col("__open"))
    )
    rows = child.where(F.col(fk).isNotNull() & F.col(at).isNotNull()).withColumn("__k", F.col(fk))
    late = F.col("__first") > F.col(at) + F.expr(f"INTERVAL '{int(grace_hours * 3600)}' SECOND")
    return salted_join(rows, first, ["__k"]).where(late).drop("__k", "__first", "__open")


def count_by_period(orphans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows and distinct keys of orphan references per table, kind and period."""
    return orphans.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ref_key").alias("n_keys"))
