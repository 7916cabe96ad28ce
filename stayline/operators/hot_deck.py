"""Filling missing values from similar records: nearest-neighbour hot-deck within hash blocks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.operators.common import SHARD_ROWS, broadcast_if_small, cut_lineage, hot_shards, join_dimension, require

#: Words that say that nothing was written down, known beforehand; others are inferred. Words for a finding (none, absent) aren't among them.
PLACEHOLDERS = ("n/a", "na", "nan", "null", "nil", "not recorded", "not available", "not charted", "not documented", "not entered", "missing", "unknown", "#n/a", "<na>")
#: Donors looked at on either side of a record, and the closest of them that are used.
SIDE, DONORS = 3, 4


def usable(text: Column, words: Column | None = None) -> Column:
    """Whether a text holds a measurement or an observation: not null, not blank or mere punctuation, no placeholder, none of ``words``."""
    t = F.lower(F.trim(text))
    # a text that has letters with case is the common one; the regular expression is for the rest
    good = ~t.isin(*PLACEHOLDERS) & ((t != F.upper(t)) | t.rlike(r"[\p{L}\p{N}]"))
    return F.coalesce(good if words is None else good & ~F.array_contains(words, t), F.lit(False))


def number(text: Column) -> Column:
    """A text's number, else null; NaN is none."""
    return F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))


def missing_codes(counts: DataFrame, group: str, text: str, n: str, spread: float = 0.5, reach: float = 20.0) -> DataFrame:
    """What stands for a missing value in a column, inferred from how it spreads over the groups (items, labels): one row ``words, numbers, codes``.

    ``counts``: rows ``n`` per group and text. A group is numeric if four in five of its usable texts are numbers. ``words`` are texts that are no number and
    stand in half (``spread``) of the numeric groups, three at least: what would be a finding is at home in few groups, and never in those of
    measurements. ``codes`` are (group, number) where a number lies farther from the group's 5 % to 95 % range than ``reach`` times
    its width, and is written in nines only (``-9999``, ``999999``) or does so in half of the numeric groups; ``numbers`` are theirs.
    Tables without such texts give empty arrays. Only counts are read: nothing grows with the rows.
    """
    t = F.lower(F.trim(F.col(text)))
    base = counts.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), t.alias("t"), number(t).alias("x"), F.col(n).alias("n"), usable(F.col(text)).alias("ok"))
    # three significant digits keep the number of distinct values per group small
    digits = F.when(F.col("x") == 0, F.lit(1.0)).otherwise(F.pow(F.lit(10.0), 2 - F.floor(F.log10(F.abs("x")))))
    rough = F.round(F.col("x") * digits) / digits
    per = base.groupBy("g").agg(
        F.sum(F.when(F.col("x").isNotNull(), F.col("n"))).alias("nums"), F.sum(F.when(F.col("ok"), F.col("n"))).alias("all"),
        F.percentile(rough, F.array(F.lit(0.05), F.lit(0.95)), F.col("n")).alias("q"),
    )
    low, high = F.col("q")[0], F.col("q")[1]
    width = F.greatest(high - low, F.lit(0.1) * F.greatest(F.abs(low), F.abs(high)), F.lit(1e-9))
    per = per.where(F.col("nums") * 5 >= F.col("all") * 4).select("g", (low - reach * width).alias("lo"), (high + reach * width).alias("hi"))
    least = F.greatest(F.lit(3.0), F.col("k") * spread)
    seen = base.join(per, "g")
    groups = per.agg(F.count(F.lit(1)).alias("k"))
    both = lambda df: df.withColumn("k", groups.scalar())
    words = both(seen.where("x IS NULL AND t <> ''").groupBy("t").agg(F.countDistinct("g").alias("c"))).where(F.col("c") >= least)
    far = seen.where("x < lo OR x > hi")
    wide = both(far.groupBy("x").agg(F.countDistinct("g").alias("c"), F.bool_or(F.col("t").rlike(r"^-?9{3,}(?:\.0+)?$")).alias("nines"))).where(F.col("nines") | (F.col("c") >= least))
    codes = far.join(wide.select("x"), "x").agg(F.array_sort(F.collect_set(F.struct("g", "x"))).alias("codes"), F.array_sort(F.collect_set("x")).alias("numbers"))
    one = words.agg(F.array_sort(F.collect_set("t")).alias("words"))
    return one.withColumn("c", codes.select(F.struct("codes", "numbers")).scalar()).select("words", F.col("c.numbers").alias("numbers"), F.col("c.codes").alias("codes"))


@dataclass(frozen=True)
class Target:
    """A column to fill. ``num`` holds its number where it has one, ``txt`` its text else (either may be absent).

    Both may be names or expressions; an expression is worked out behind the shuffle, so its result needn't travel.
    """

    name: str
    num: str | Column | None = None
    txt: str | Column | None = None


@dataclass(frozen=True)
class Feature:
    """A further observed feature in which donors may differ from a record; what it adds to the distance is between 0 and ``weight``.

    ``kind``: ``category`` (0 if equal, else 1), ``number`` (difference over ``scale``, at most 1) or ``cycle`` (difference on a circle of length
    ``scale``, over half of it). A null on either side adds a half. Without ``col`` the feature is the position itself.
    """

    kind: str
    col: str | None = None
    weight: float = 1.0
    scale: float = 1.0

    def part(self, a: Column, b: Column) -> Column:
        gap = F.abs(a - b) if self.kind != "category" else None
        if self.kind == "category":
            d = (a != b).cast("double")
        elif self.kind == "number":
            d = F.least(gap / self.scale, F.lit(1.0))
        elif self.kind == "cycle":
            round_ = gap % self.scale
            d = F.least(round_, self.scale - round_) / (self.scale / 2)
        else:
            raise ValueError(f"unknown kind of feature: {self.kind}")
        return self.weight * F.coalesce(d, F.lit(0.5))


def weighted_median(donors: Column) -> Column:
    """Median of ``num`` by weight ``w``: the least number at which half of the weight is reached."""
    known = F.array_sort(F.filter(F.transform(donors, lambda d: F.struct(d["num"].alias("num"), d["w"].alias("w"))), lambda d: d["num"].isNotNull()))
    total = F.aggregate(known, F.lit(0.0), lambda a, d: a + d["w"])
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("num"))
    step = lambda a, d: F.struct((a["w"] + d["w"]).alias("w"), F.when(a["num"].isNull() & ((a["w"] + d["w"]) * 2 >= total - 1e-9), d["num"]).otherwise(a["num"]).alias("num"))
    return F.aggregate(known, zero, step)["num"]


def weighted_majority(donors: Column) -> Column:
    """The text with the greatest summed weight; the least text on ties."""
    words = F.array_distinct(F.filter(F.transform(donors, lambda d: d["txt"]), lambda t: t.isNotNull()))
    sums = F.transform(words, lambda t: F.struct((-F.round(F.aggregate(F.filter(donors, lambda d: d["txt"] == t), F.lit(0.0), lambda a, d: a + d["w"]), 9)).alias("w"), t.alias("t")))
    return F.array_min(sums)["t"]


def hot_deck(
    df: DataFrame, block: Sequence[str], near: str | Column, targets: Sequence[Target], wide: Sequence[str] = (), features: Sequence[Feature] = (), scale: float = 1.0,
    side: int = SIDE, donors: int = DONORS, only_missing: bool = False, counts: dict[str, DataFrame] | None = None, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Fill each target from the closest donors in the record's block.

    Per target ``t`` these columns are added: ``t_missing`` (neither number nor text is there), ``t_num`` and ``t_txt`` (own or
    filled), ``t_filled``, ``t_donors`` (positions of the donors that gave the value, the closest first) and ``t_level`` (``block``, ``wide`` or
    null). ``block``: observed features that must be equal; ``near``: the numeric position by which donors are looked up. Of the ``side``
    donors before and after the record the ``donors`` closest are used; the distance is mixed: the difference in position over ``scale`` plus
    what each of ``features`` adds (ties: before goes before after, the nearer in position first). Numbers give the median and texts
    the majority, both weighted by 1 / (1 + distance); ties take the least value. A record without donors in its block takes the median or the commonest text of its
    ``wide`` group; failing that it stays missing, with ``t_missing`` true and ``t_filled`` false. Records with a null in ``block`` or
    ``near`` give nothing and go to the wide group at once. Records at one position stand in the order of their targets' values, nulls first. Repeated rows are
    kept; extra columns pass through; older columns of the new names are replaced. ``only_missing`` returns only records that lack a target.
    ``counts``: per target the wide groups' values ``wide, num, txt, n`` where the caller has counted them already.

    One shuffle serves all targets: donors are the nearest non-null neighbours of an ordered window, so no pairs are formed, and
    blocks without a gap fall out before they are ordered if only gaps are asked for. A block with more than ``shard_rows`` rows and a hundredth of the table is
    cut into stretches of ``near``; of these, only the first and last ``side`` donors are exchanged, and the fills are the same.
    """
    block, wide = list(block), list(wide)
    require(df, [*block, *wide, *[f.col for f in features if f.col], *([near] if isinstance(near, str) else [])])
    suffixes = ("missing", "num", "txt", "filled", "donors", "level")
    base = df.drop(*[f"{t.name}_{x}" for t in targets for x in suffixes])
    col = lambda c, kind: F.lit(None).cast(kind) if c is None else (F.col(c) if isinstance(c, str) else c).cast(kind)
    own = {t.name: (col(t.num, "double"), col(t.txt, "string")) for t in targets}
    place = col(near, "double")
    placed = place.isNotNull()
    for b in block:
        placed = placed & F.col(b).isNotNull()
    at, several = hot_shards(base, block, place, shard_rows)
    # records without a place have no donors and are spread by a hash of their own
    apart = -1 - F.pmod(F.xxhash64(*[F.col(c) for c, kind in base.dtypes if not kind.startswith("map")]), F.lit(1024))
    at = at.withColumn("__shard", F.when(placed, F.col("__shard")).otherwise(apart).cast("int"))
    lack = {t.name: own[t.name][0].isNull() & own[t.name][1].isNull() for t in targets}
    some = F.lit(False)
    for c in lack.values():
        some = some | c
    at = at.repartition(*[F.col(b) for b in block], F.col("__shard")).withColumn("__near", F.when(placed, place))
    if only_missing:
        at = at.withColumn("__some", some)
        part = Window.partitionBy(*block, "__shard")
        at = at.withColumn("__any", F.max("__some").over(part)).where("__any AND (__some OR __near IS NOT NULL)").drop("__any")
    fields = [F.col("__near").alias("at"), *[F.col(f.col).alias(f"f{i}") for i, f in enumerate(features) if f.col]]
    donor = {n: F.when(~lack[n] & F.col("__near").isNotNull(), F.struct(*fields, own[n][0].alias("num"), own[n][1].alias("txt"))) for n in lack}
    ties = {f"__o{i}": c for i, c in enumerate(x for t in targets for x, given in zip(own[t.name], (t.num, t.txt)) if given is not None)}
    at = at.withColumns({**{f"{n}_missing": c for n, c in lack.items()}, **{f"__d_{n}": c for n, c in donor.items()}, **ties})
    order = ", ".join(["__near NULLS FIRST", *[f"`{o}` NULLS FIRST" for o in ties]])
    over = f"IGNORE NULLS OVER (PARTITION BY {', '.join(f'`{b}`' for b in block)}, __shard ORDER BY {order})"
    at = at.withColumns({f"__d_{n}_{s}{i}": F.expr(f"{f}(`__d_{n}`, {i}) {over}") for n in lack for i in range(1, side + 1) for s, f in (("b", "lag"), ("a", "lead"))})
    at = at.drop(*ties, *[f"__d_{n}" for n in lack])
    if only_missing:
        at = at.where("__some").drop("__some")
    sides = {(n, s): F.filter(F.array(*[F.col(f"__d_{n}_{s}{i}") for i in range(1, side + 1)]), lambda x: x.isNotNull()) for n in lack for s in "ba"}
    at = at.withColumns({f"__{s}_{n}": x for (n, s), x in sides.items()}).drop(*[f"__d_{n}_{s}{i}" for n, s in sides for i in range(1, side + 1)])
    if several:
        at = _carry_over(cut_lineage(at), base, place, own, donor, ties, block, side, shard_rows, order)
    for n in lack:
        miss, (num, txt) = F.col(f"{n}_missing"), own[n]
        found = F.filter(F.array(*[F.get(f"__{s}_{n}", F.lit(i)) for i in range(side) for s in "ba"]), lambda x: x.isNotNull())
        at = at.withColumn("__f", F.when(miss & F.col("__near").isNotNull(), _closest(found, features, scale, donors)))
        at = at.withColumns({
            f"{n}_num": F.when(miss, weighted_median(F.col("__f"))).otherwise(num),
            f"{n}_txt": F.when(miss, weighted_majority(F.col("__f"))).otherwise(txt),
            f"{n}_donors": F.when(F.size("__f") > 0, F.transform("__f", lambda x: x["at"])),
            f"{n}_level": F.when(F.size("__f") > 0, F.lit("block")),
        }).drop("__f", f"__b_{n}", f"__a_{n}")
    at = at.drop("__near", "__shard")
    if only_missing:
        at = cut_lineage(at)  # few rows, made by the whole table's sort; what follows reads them several times
    for t in targets:
        at = _fill_wide(at, base, t, own[t.name], wide, only_missing, (counts or {}).get(t.name))
    return at


def _closest(found: Column, features: Sequence[Feature], scale: float, donors: int) -> Column:
    """The closest of the donors by the mixed distance, each with its weight."""

    def judged(d: Column, i: Column) -> Column:
        gap = F.abs(d["at"] - F.col("__near")) / scale
        for k, f in enumerate(features):
            gap = gap + (f.part(d[f"f{k}"], F.col(f.col)) if f.col else f.part(d["at"], F.col("__near")))
        return F.struct(F.round(gap, 9).alias("gap"), i.alias("i"), d["at"].alias("at"), d["num"].alias("num"), d["txt"].alias("txt"), (F.lit(1.0) / (1.0 + gap)).alias("w"))

    return F.slice(F.array_sort(F.transform(found, judged)), 1, donors)


def _carry_over(at: DataFrame, base: DataFrame, place: Column, own: dict, donor: dict[str, Column], ties: dict[str, Column], block: list[str], side: int, shard_rows: int, order: str) -> DataFrame:
    """Lengthen the donors before and after (``__b_t``, ``__a_t``, nearest first) to ``side`` with those of a hot block's other shards.

    The boundary states are each shard's first and last ``side`` donors per target; only they meet in a window over a whole block.
    """
    rows, _ = hot_shards(base, block, place, shard_rows)
    hot = rows.where("__shard > 0").select(*block).distinct()  # at most a hundred blocks
    rows = rows.join(F.broadcast(hot), block, "left_semi").withColumn("__near", place).where(F.col("__near").isNotNull()).withColumns(ties)
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(n).alias("t"), d.alias("d")) for n, d in donor.items()]), lambda x: x["d"].isNotNull()))
    each = rows.select(*block, "__shard", "__near", *ties, each.alias("__e")).select(*block, "__shard", "__near", *ties, "__e.t", "__e.d")
    part = f"PARTITION BY {', '.join(f'`{b}`' for b in block)}, __shard, t"
    each = each.withColumn("__i", F.expr(f"row_number() OVER ({part} ORDER BY {order})")).withColumn("__n", F.expr(f"count(1) OVER ({part})")).withColumn("__z", F.col("__n") + 1 - F.col("__i")).where((F.col("__i") <= side) | (F.col("__z") <= side))
    pick = lambda n, i: F.transform(F.array_sort(F.collect_list(F.when((F.col("t") == n) & (F.col(i) <= side), F.struct(F.col(i), F.col("d"))))), lambda x: x["d"])
    states = each.groupBy(*block, "__shard").agg(*[pick(n, i).alias(f"{s}_{n}") for n in donor for s, i in (("b", "__z"), ("a", "__i"))])
    states = states.unionByName(at.where("__near IS NOT NULL").join(F.broadcast(hot), block, "left_semi").select(*block, F.col("__shard").cast("bigint").alias("__shard")).distinct(), allowMissingColumns=True)
    cols = [f"{s}_{n}" for n in donor for s in "ba"]
    # shards without donors of their own take part, as their records may lack some
    states = states.groupBy(*block, "__shard").agg(*[F.first(F.when(F.size(c) > 0, F.col(c)), ignorenulls=True).alias(c) for c in cols])
    over = f"IGNORE NULLS OVER (PARTITION BY {', '.join(f'`{b}`' for b in block)} ORDER BY __shard)"
    for c in cols:
        f = "lag" if c.startswith("b_") else "lead"
        found = F.filter(F.array(*[F.expr(f"{f}(`{c}`, {i}) {over}") for i in range(1, side + 1)]), lambda x: x.isNotNull())
        states = states.withColumn(f"__x{c}", F.slice(F.flatten(found), 1, side))
    states = states.select(*block, F.col("__shard").cast("int").alias("__shard"), *[f"__x{c}" for c in cols])
    at = join_dimension(at, states, [*block, "__shard"])
    more = {f"__{c}": F.slice(F.concat(F.col(f"__{c}"), F.coalesce(F.col(f"__x{c}"), F.array().cast(dict(at.dtypes)[f"__{c}"]))), 1, side) for c in cols}
    return at.withColumns(more).drop(*[f"__x{c}" for c in cols])


def _fill_wide(at: DataFrame, base: DataFrame, t: Target, own: tuple[Column, Column], wide: list[str], narrow: bool, counts: DataFrame | None) -> DataFrame:
    """Fill what the blocks left open from the wide groups' values. ``narrow``: only groups with an open record are counted."""
    miss, level = F.col(f"{t.name}_missing"), F.col(f"{t.name}_level")
    if wide:
        num, txt = own
        open_ = at.where(miss & level.isNull()).select(*wide).dropna().distinct()
        if narrow and open_.isEmpty():
            return at.withColumn(f"{t.name}_filled", miss & level.isNotNull())
        if counts is not None:
            seen = counts.select(*wide, F.col("num").alias("__a"), F.when(F.col("num").isNull(), F.col("txt")).alias("__b"), F.col("n").alias("__c")).where("__a IS NOT NULL OR __b IS NOT NULL")
        else:
            base = base.join(broadcast_if_small(open_), wide, "left_semi") if narrow else base
            seen = base.select(*wide, num.alias("__a"), F.when(num.isNull(), txt).alias("__b"), F.lit(1).alias("__c")).where("__a IS NOT NULL OR __b IS NOT NULL")
        seen = seen.groupBy(*wide, "__a", "__b").agg(F.sum("__c").alias("__c"))
        stats = seen.groupBy(*wide).agg(F.percentile("__a", F.lit(0.5), F.col("__c")).alias("__n"), F.min(F.when(F.col("__b").isNotNull(), F.struct((-F.col("__c")).alias("c"), F.col("__b").alias("b"))))["b"].alias("__x"))
        at = join_dimension(at, stats, wide)
        use = miss & level.isNull() & (F.col("__n").isNotNull() | F.col("__x").isNotNull())
        at = at.withColumns({f"{t.name}_num": F.when(use, F.col("__n")).otherwise(F.col(f"{t.name}_num")), f"{t.name}_txt": F.when(use, F.col("__x")).otherwise(F.col(f"{t.name}_txt")), f"{t.name}_level": F.when(use, F.lit("wide")).otherwise(level)}).drop("__n", "__x")
    return at.withColumn(f"{t.name}_filled", miss & F.col(f"{t.name}_level").isNotNull())
