"""Helpers that every operator shares: lineage cuts, size-checked broadcasts, salted joins, sharded neighbours."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes up to which a side may be broadcast by hand.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
#: A key is hot from one in so many rows on; there are at most so many such keys.
HOT_KEYS = 100
#: Rows of a hot key that one time shard of it is meant to hold.
SHARD_ROWS = 200_000


_shipped: set[str] = set()


def ship_package(spark: SparkSession | None = None) -> None:
    """Give the Python workers of all executors this package, once a session; they needn't have it installed."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="stayline-"), "stayline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(top)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(spark.sparkContext.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, a folder that all executors share; one is made only where none is set (local runs)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        conf = sc.getConf().get("spark.checkpoint.dir")
        if not conf and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="stayline-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder that all executors share, so that a lost executor costs no data."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a table in the shared folder (in folders ``by`` columns), and what removes it again once nothing reads it any more (rounds of an iteration)."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(df.schema).parquet(path), lambda: at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes (as JSON). Counting stops at the bound on rows; ``df`` should be cheap to read."""
    seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")).first()
    return seen.n <= max_rows and seen.b <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small, else unchanged (Spark then shuffles)."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def row_hash(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    """A hash of a row's values: stable when a task is run again, unlike ``rand``."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in (cols or [c for c, t in df.dtypes if not t.startswith("map")])])


def _hot(df: DataFrame, code: Column) -> Column:
    """Hashes of the keys that hold a hundredth of the rows or more, as a scalar subquery.

    A mergeable frequent-items sketch over the key columns; it decides only how rows are spread, never which rows there are.
    """
    top = df.select(code.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {HOT_KEYS}, {HOT_KEYS * 100})").alias("t"))
    return top.select(F.transform(F.filter("t", lambda x: x["count"] * HOT_KEYS >= F.col("n")), lambda x: x["item"]).alias("hot")).scalar()


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", salts: int | None = None) -> DataFrame:
    """Join with the hot keys of ``big`` spread over ``salts`` tasks each (all shuffle partitions, whose number goes with the data);
    ``small`` has copies of these keys' rows only.

    ``small`` must be the side that is small per key (best: unique keys). ``how`` may be inner, left, left_semi or
    left_anti with ``big`` on the left, as each row of ``big`` meets every matching row of ``small`` exactly once.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join can't do {how}")
    s = "__salt"
    salts = salts or int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(big.dtypes)
    code = F.xxhash64(*[F.col(f"`{k}`").cast(kinds[k]) for k in keys])
    hot = _hot(big, code)
    left = big.withColumn(s, F.when(F.array_contains(hot, code), F.pmod(row_hash(big), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    right = small.withColumn(s, F.explode(F.when(F.array_contains(hot, code), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, s], how).drop(s)


def join_dimension(df: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "left", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a table of unique keys: broadcast if it is small, else salted. ``dim`` is worked out once, before its size is checked."""
    dim = cut_lineage(dim)
    if is_small(dim, max_rows):
        return df.join(F.broadcast(dim), list(keys), how)
    return salted_join(df, dim, keys, how)


def attach(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row frame (totals, bounds), as a scalar subquery that runs once; no join takes place."""
    row = one.select(F.struct(*[F.col(f"`{c}`") for c in one.columns]).alias("row")).scalar()
    return df.withColumn("__one", row).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col("__one")[c].alias(c) for c in one.columns])


def aside(names: Sequence[str]) -> tuple[list[str], list[Column], list[Column]]:
    """Names that no user column has for ``names``, and the columns that rename to them and back."""
    inner = [f"__key{i}" for i in range(len(names))]
    return inner, [F.col(f"`{n}`").alias(i) for n, i in zip(names, inner)], [F.col(i).alias(n) for n, i in zip(names, inner)]


def require(df: DataFrame, cols: Sequence[str]) -> None:
    """Fail early, with the names, if ``df`` lacks a column."""
    if missing := [c for c in cols if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def hot_shards(df: DataFrame, keys: Sequence[str], place: Column, rows: int = SHARD_ROWS) -> tuple[DataFrame, bool]:
    """``df`` with ``__shard``, and whether any key has more than one: 0 but for hot keys, which get stretches of ``place`` of equal width.

    A key is hot if it has a hundredth of all rows and more than ``rows`` of them. Which keys are is told by a mergeable sketch over
    the key columns; of these, at most a hundred, the range of ``place`` and the count of rows are then taken exactly. Shards
    never fall along ``place``. Rows without a place get shard 0.
    """
    code = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    rank = place.cast("double")
    top = df.select(code.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {HOT_KEYS}, {HOT_KEYS * 100})").alias("t")).first()
    hot = [x["item"] for x in top.t or [] if x["count"] * HOT_KEYS >= top.n and x["count"] > rows]
    if not hot:
        return df.withColumn("__shard", F.lit(0).cast("bigint")), False
    per = df.select(code.alias("__h"), rank.alias("__p")).where(F.col("__h").isin(hot) & F.col("__p").isNotNull())
    per = cut_lineage(per.groupBy("__h").agg(F.min("__p").alias("__lo"), F.max("__p").alias("__hi"), F.ceil(F.count(F.lit(1)) / rows).alias("__k")))
    wide = (F.col("__hi") - F.col("__lo")) / F.col("__k")
    shard = F.when((wide > 0) & rank.isNotNull(), F.least(F.floor((rank - F.col("__lo")) / wide), F.col("__k") - 1))
    out = df.withColumn("__h", code).join(F.broadcast(per), "__h", "left").withColumn("__shard", F.coalesce(shard.cast("bigint"), F.lit(0).cast("bigint")))
    return out.drop("__h", "__lo", "__hi", "__k"), True


def sharded_neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], shard: str, what: dict[str, tuple[str, int]], k: int, several: bool = True) -> DataFrame:
    """``lag``/``lead`` over ``keys`` in ``order``, without one task having to hold a hot key; not ``several``: no key has a second shard.

    ``what`` maps a new column to (column, offset); a negative offset looks back, at most ``k`` rows. ``shard`` must not
    fall along ``order`` (a time bucket, say). Each shard is windowed alone; only its first and last ``k`` rows, the
    boundary states, meet those of the key's other shards in a second window. Rows inside a shard are final at once.
    """
    inner = Window.partitionBy(*keys, shard).orderBy(*order)
    whole = Window.partitionBy(*keys, shard)
    at = df.withColumn("__rn", F.row_number().over(inner)).withColumn("__n", F.count(F.lit(1)).over(whole))
    for name, (col, off) in what.items():
        at = at.withColumn(name, F.lag(col, -off).over(inner) if off < 0 else F.lead(col, off).over(inner))
    if not several:
        return at.drop("__rn", "__n")
    edge = (F.col("__rn") <= k) | (F.col("__rn") > F.col("__n") - k)
    across = Window.partitionBy(*keys).orderBy(*order)
    edges = at.where(edge)
    for name, (col, off) in what.items():
        near = F.col("__rn") <= -off if off < 0 else F.col("__rn") > F.col("__n") - off
        over = F.lag(col, -off).over(across) if off < 0 else F.lead(col, off).over(across)
        edges = edges.withColumn("__x", over).withColumn(name, F.when(near, F.col("__x")).otherwise(F.col(name))).drop("__x")
    return at.where(~edge).unionByName(edges).drop("__rn", "__n")
