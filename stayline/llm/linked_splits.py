"""Splits that keep related records together: hash-to-min components, then weighted rendezvous hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.hashing import uniform
from stayline.operators.common import require, salted_join, written


def shared_key_edges(links: DataFrame, node: str, key: str) -> DataFrame:
    """Edges ``(a, b)``, a < b, that tie all nodes filed under one key: a star around the key's least node, not all pairs.

    Rows with a null node or key tie nothing. Keys with one node fall out before anything is joined.
    """
    require(links, [node, key])
    pairs = links.select(F.col(node).alias("n"), F.col(key).alias("k")).dropna().distinct()
    hubs = pairs.groupBy("k").agg(F.min("n").alias("a"), F.max("n").alias("z")).where("a < z").drop("z")
    return salted_join(pairs, hubs, ["k"]).where("n <> a").select("a", F.col("n").alias("b")).distinct()


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: ``node, component`` (the least node of it), for every node of an edge.

    Hash-to-min: every node keeps a cluster of nodes; each round it sends the cluster to its least member and that least
    member to all others, until nothing changes, after a number of rounds of the order of the logarithm of the diameter.
    Clusters are rows (node, member), never arrays, so a large component is spread over tasks, and each round is written to the shared folder and removed after the next.
    Self loops and repeated edges do no harm; rows with a null are left out; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("n"), F.col(b).alias("m")).dropna()
    own = e.select("n", F.col("n").alias("m")).union(e.select(F.col("m").alias("n"), "m"))
    rows, drop = written(e.union(e.select(F.col("m").alias("n"), F.col("n").alias("m"))).union(own).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("n", "m").cast("decimal(38,0)"))).first())

    old = state(rows)
    while True:  # members only ever become smaller, so it ends
        least = rows.groupBy("n").agg(F.min("m").alias("least"))
        sent = salted_join(rows, least, ["n"])
        new, drop_new = written(sent.select(F.col("least").alias("n"), "m").union(sent.select(F.col("m").alias("n"), F.col("least").alias("m"))).distinct())
        if (now := state(new)) == old:
            drop_new()
            return rows.groupBy("n").agg(F.min("m").alias("component")).withColumnRenamed("n", "node")
        drop()  # a round's table is read by the next round only
        rows, drop, old = new, drop_new, now


def rendezvous(key: Column, weights: dict[str, float], seed: str = "split") -> Column:
    """The split of a key by weighted rendezvous hashing: of all splits the one with the largest -weight / ln(u(key, split)).

    A key's split depends on nothing but the key, the weights and the seed; changing a weight moves only the keys it must.
    """
    if not weights or any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must be non-negative, and one of them positive")
    score = {s: -F.lit(float(w)) / F.log(uniform(F.concat_ws("|", F.lit(seed), F.lit(s), key.cast("string")))) for s, w in weights.items() if w > 0}
    best = F.greatest(*[F.struct(v.alias("v"), F.lit(s).alias("s")) for s, v in score.items()]) if len(score) > 1 else F.struct(F.lit(0.0).alias("v"), F.lit(next(iter(score))).alias("s"))
    return F.when(key.isNotNull(), best["s"])


def linked_split(df: DataFrame, node: str, components: DataFrame, weights: dict[str, float], seed: str = "split") -> DataFrame:
    """``df`` with ``component`` and ``split``: the split of the node's component; a node in no component is its own.

    A row whose node is null gets null for both. Older columns of these names are replaced.
    """
    require(df, [node])
    base = df.drop("component", "split").withColumn("__node", F.col(node))
    joined = salted_join(base, components.select(F.col("node").alias("__node"), "component"), ["__node"], "left")
    return joined.withColumn("component", F.coalesce("component", "__node")).withColumn("split", rendezvous(F.col("component"), weights, seed)).drop("__node")
