"""Implausible spikes in measurements: plausibility, peaks over threshold, stuck runs, each relative to its own series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.operators.common import SHARD_ROWS, aside, cut_lineage, hot_shards, join_dimension, require, salted_join, sharded_neighbours


@dataclass(frozen=True)
class Limits:
    """What one kind of measurement can be, and its resolution, which is the least scatter assumed."""

    low: float
    high: float
    resolution: float


@dataclass(frozen=True)
class SpikeRules:
    """Parameters of the rules; the defaults were chosen on the made-up series of ``tests/test_spikes.py``.

    ``risk``: share of ordinary readings that the fitted tail lets pass the cutoff. ``tail``: share of the scores that is its tail; ``screen``:
    scores beyond so many times the 95 % quantile are suspected spikes and kept out of the fit. ``tail_prior``: exceedances for which the tail of the
    kind counts beside a series' own; ``season_prior`` readings for which no season counts beside a month's. ``min_readings``: shortest series
    judged. ``stuck_run``: shortest run of equal readings; ``stuck_change``: share of the other steps that change the value;
    ``stuck_least``, ``stuck_expected``: a series that changes less often, but at least that often, still counts as stuck where
    fewer such runs are expected by chance. ``prior``: readings for which the usual scatter of the kind counts beside a series' own.
    """

    risk: float = 1e-4
    tail: float = 0.10
    screen: float = 3.0
    tail_prior: float = 10.0
    season_prior: float = 50.0
    min_readings: int = 6
    prior: float = 2.0
    stuck_run: int = 5
    stuck_change: float = 0.9
    stuck_least: float = 0.6
    stuck_expected: float = 0.002
    shard_rows: int = SHARD_ROWS


#: Grid of quantiles of the steps between neighbours from which a series' scatter is read.
GRID = [round(0.20 + 0.01 * i, 2) for i in range(31)]


def _median(a: str, b: str, c: str) -> Column:
    """Median of the neighbours at hand: the farther ones may be missing. Plain comparisons, so that it stays within generated code."""
    x, y, z = F.col(a), F.col(b), F.col(c)
    return F.when(z.isNotNull(), F.greatest(F.least(x, y), F.least(F.greatest(x, y), z))).when(y.isNotNull(), (x + y) / 2).otherwise(x)


def _run(k: int) -> Column:
    """How many readings in a row equal this one, itself and at most ``k`` neighbours on either side counted."""
    n = F.lit(1)
    for side in "mp":
        same = F.lit(True)
        for i in range(1, k + 1):
            same = same & F.coalesce(F.col(f"{side}{i}") == F.col("x"), F.lit(False))
            n = n + same.cast("int")
    return n


def _with(df: DataFrame, keys: list[str], aggs: dict[str, Column], several: bool) -> DataFrame:
    """``df`` with aggregates of each row's series: in the window that the rows already lie in, or, if a series is spread over shards, grouped and joined back."""
    if several:
        return salted_join(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), keys, "left")
    return df.withColumns({n: c.over(Window.partitionBy(*keys)) for n, c in aggs.items()})


def pot_cutoff(u: Column, mean: Column, square: Column, n: Column, own: Column, own_n: Column, rules: SpikeRules) -> tuple[Column, Column, Column]:
    """(shape, scale, cutoff) of a source's tail by peaks over threshold.

    The generalised Pareto tail of a kind comes from the mean and the mean square of its ``n`` excesses over ``u`` (method of moments; shape
    within a half); a source's own mean excess, of ``own_n``, is drawn towards it and sets its scale. The cutoff is the value that an ordinary reading passes
    with probability ``rules.risk``. Without excesses the cutoff is null.
    """
    ratio = F.try_divide(mean * mean, square - mean * mean)
    shape = F.greatest(F.lit(-0.5), F.least(F.lit(0.45), 0.5 * (1 - F.coalesce(ratio, F.lit(1.0)))))
    excess = (F.coalesce(own, F.lit(0.0)) * own_n + mean * rules.tail_prior) / (own_n + rules.tail_prior)
    scale = excess * (1 - shape)
    r = F.lit(rules.risk / rules.tail)
    flat = F.abs(shape) < 1e-6
    tail = F.when(flat, -scale * F.log(r)).otherwise(scale / shape * (F.pow(r, -shape) - 1))
    return shape, scale, F.when(n > 0, u + tail)


def flag_readings(df: DataFrame, series: Sequence[str], kind: Sequence[str], order: Sequence[str], x: str, limits: dict[tuple, Limits], day: str, rules: SpikeRules = SpikeRules(), bad: str | None = None) -> DataFrame:
    """One row per reading with ``implausible, spike, stuck`` and the ``score`` and ``cutoff`` behind ``spike``.

    ``series`` names the columns of one source, which must include those of ``kind`` (which measurement it is); ``order`` the
    columns that order a series; ``day`` a timestamp of ``order``; ``bad`` a boolean column of readings known to be impossible. Readings equal in all
    of them count once; rows with a null in ``series``, ``order`` or ``x`` are left out; kinds without limits are never implausible
    and have no least scatter. An empty input gives no rows; short series get no ``spike``, constant ones no ``stuck``. Implausible readings are
    taken out of the series before the others are judged; ``cutoff`` is null where a score isn't in the tail.

    Residuals are taken against the local level, the medians of three readings on either side, which follows drifts
    and lasting new levels, and against the usual residual of the kind in that month of the year; a series' scatter comes from the steps between neighbours (stuck ones left out), of which a
    drift or a new level moves few, at a quantile corrected for the two steps at a reading under suspicion, and is drawn towards
    that of its kind where readings are few. The score of a reading is the least distance of it, or of it and a neighbour, from the levels before and
    after, in units of scatter; :func:`pot_cutoff` sets each source's cutoff. Rows are shuffled once, by series; what concerns whole kinds is
    aggregated. A series with over ``shard_rows`` rows and a hundredth of all is cut into stretches of time whose boundary rows meet in a second window.
    """
    require(df, [*series, *order, x, day, *([bad] if bad else [])])
    names = list(dict.fromkeys([*series, *order, day]))
    cols, hide, show = aside(names)
    inner = dict(zip(names, cols))
    series, kind, order, day = [inner[c] for c in series], [inner[c] for c in kind], [inner[c] for c in order], inner[day]
    known = F.coalesce(F.col(bad), F.lit(False)) if bad else F.lit(False)
    base = df.select(*hide, F.col(x).cast("double").alias("x"), known.alias("implausible")).dropna()
    base, several = hot_shards(base, series, F.datediff(F.col(day), F.lit("1970-01-01").cast("date")), rules.shard_rows)
    # one shuffle serves both the repeats, which are few, and the windows
    base = base.repartition(*series, "__shard").distinct()
    types = dict(base.dtypes)
    lim = df.sparkSession.createDataFrame([(*k, float(v.low), float(v.high), float(v.resolution)) for k, v in limits.items()], ", ".join([*(f"{c} {types[c]}" for c in kind), "lo double", "hi double", "res double"]))
    base = base.join(F.broadcast(lim), kind, "left").withColumn("implausible", F.col("implausible") | F.coalesce((F.col("x") < F.col("lo")) | (F.col("x") > F.col("hi")), F.lit(False)))
    # implausible readings stand in an order of their own behind the others, so that no plausible one has them beside it
    base = base.withColumn("lane", F.col("implausible").cast("int")).drop("lo", "hi")
    near = {f"m{i}": ("x", -i) for i in range(1, 5)} | {f"p{i}": ("x", i) for i in range(1, 5)}
    if several:
        every = sharded_neighbours(base, [*series, "lane"], order, "__shard", near, 4)
    else:
        every = sharded_neighbours(base, series, ["lane", *order], "__shard", near | {f"l{i}": ("lane", i) for i in range(1, 5)} | {f"k{i}": ("lane", -i) for i in range(1, 5)}, 4, several=False)
        every = every.withColumns({f"{s}{i}": F.when(F.col(f"{t}{i}") == F.col("lane"), F.col(f"{s}{i}")) for s, t in (("m", "k"), ("p", "l")) for i in range(1, 5)}).drop(*[f"{t}{i}" for t in "kl" for i in range(1, 5)])
    ok = ~F.col("implausible")
    every = every.withColumn("run", F.when(ok, _run(4)).otherwise(F.lit(1))).withColumn("long", F.col("run") >= rules.stuck_run)
    moved = F.when(ok, (F.col("m1") != F.col("x")).cast("int"))
    still = F.col("long") & (F.col("m1") == F.col("x"))
    step = F.when(ok & ~still, F.abs(F.col("x") - F.col("m1")))
    every = _with(every, series, {
        "n": F.count(F.lit(1)), "changes": F.sum(moved), "moves": F.count(moved), "within": F.sum(still.cast("int")),
        "runs": F.sum((F.col("long") & (F.coalesce(F.col("m1") != F.col("x"), F.lit(True)))).cast("int")),
        "grid": F.percentile(step, F.array(*[F.lit(g) for g in GRID])), "steps": F.count(step),
    }, several)
    at = F.round((F.lit(0.5) * F.greatest(F.col("steps") - 2, F.lit(0)) / F.col("steps") - GRID[0]) * 100).cast("int")
    own = F.lit(1.4826 / 2**0.5) * F.get("grid", F.greatest(F.lit(0), F.least(F.lit(len(GRID) - 1), at)))
    every = every.withColumn("own", F.when(F.col("steps") > 0, F.greatest(own, F.coalesce("res", F.lit(1e-9))))).drop("grid", "__shard", "lane")
    every = cut_lineage(every)

    # what is usual for a kind; each series counts by one row
    one = every.where("m1 IS NULL AND NOT implausible")
    usual = one.groupBy(*kind).agg((F.sum("changes") / F.sum("moves")).alias("usual_change"), F.percentile_approx(F.when(F.col("steps") >= rules.min_readings - 1, F.col("own")), 0.5).alias("usual"))
    every = join_dimension(every, usual, kind)
    # the steps of one stuck run are left out, those of further runs count as steps without a change
    outside = F.col("moves") - F.coalesce(F.col("within") / F.greatest("runs", F.lit(1)), F.lit(0))
    weight = rules.prior * 2
    change = (F.coalesce("changes", F.lit(0)) + weight * F.coalesce("usual_change", F.lit(0))) / (outside + weight)
    chance = F.col("n") * F.pow(1 - change, F.col("run") - 1)
    stuck = F.col("long") & ((change >= rules.stuck_change) | ((change >= rules.stuck_least) & (chance <= rules.stuck_expected)))
    blend = F.exp((F.col("steps") * F.log("own") + F.lit(rules.prior) * F.log(F.coalesce("usual", "own"))) / (F.col("steps") + rules.prior))
    every = every.withColumns({"stuck": F.coalesce(stuck, F.lit(False)), "sigma": F.greatest(blend, F.coalesce("res", F.lit(1e-9))), "month": F.month(day)})
    before, after = _median("m1", "m2", "m3"), _median("p1", "p2", "p3")
    every = every.withColumn("level", F.coalesce((before + after) / 2, before, after)).drop("changes", "moves", "within", "runs", "steps", "own", "usual", "usual_change", "run", "long", "res")

    # seasons: the kind's usual residual in a month, in units of scatter
    season = every.where("level IS NOT NULL AND sigma IS NOT NULL").groupBy(*kind, "month").agg(F.percentile_approx((F.col("x") - F.col("level")) / F.col("sigma"), 0.5).alias("s"), F.count(F.lit(1)).alias("c"))
    season = season.select(*kind, "month", (F.col("s") * F.col("c") / (F.col("c") + rules.season_prior)).alias("season"))
    every = join_dimension(every, season, [*kind, "month"]).withColumn("here", F.col("x") - F.coalesce("season", F.lit(0.0)) * F.col("sigma"))

    def away(left: tuple, right: tuple, *beside: str) -> Column:
        a, b = _median(*left), _median(*right)
        block = [F.col("here"), *[F.col(c) for c in beside]]
        lo, hi = (F.least(*block), F.greatest(*block)) if len(block) > 1 else (block[0], block[0])
        there = F.col(left[0]).isNotNull() & F.col(right[0]).isNotNull()
        for c in beside:
            there = there & F.col(c).isNotNull()
        return F.when(there, F.greatest(lo - F.greatest(a, b), F.least(a, b) - hi, F.lit(0.0)))

    one = away(("m1", "m2", "m3"), ("p1", "p2", "p3"))
    two = [away(("m1", "m2", "m3"), ("p2", "p3", "p4"), "p1"), away(("m2", "m3", "m4"), ("p1", "p2", "p3"), "m1")]
    score = F.when(~F.col("implausible") & (F.col("n") >= rules.min_readings), F.coalesce(F.greatest(one, *two) / F.col("sigma"), F.lit(0.0)))
    scored = cut_lineage(every.select(*cols, "x", "implausible", "stuck", score.alias("score")))

    # tails: of the kind, then of each source among its own exceedances
    q = scored.where("score IS NOT NULL").groupBy(*kind).agg(F.percentile_approx("score", F.array(F.lit(1 - rules.tail), F.lit(0.95)), F.lit(10000)).alias("q")).select(*kind, F.col("q")[0].alias("u"), (F.greatest(F.col("q")[1], F.col("q")[0]) * rules.screen).alias("top"))
    marked = join_dimension(scored, q, kind)
    excess = F.when(F.col("score") <= F.col("top"), F.col("score") - F.col("u"))
    over = marked.where("score > u").withColumn("excess", excess)
    tails = over.groupBy(*kind).agg(F.avg("excess").alias("mean"), F.avg(F.col("excess") * F.col("excess")).alias("square"), F.count("excess").alias("total"))
    over = join_dimension(_with(over, series, {"own": F.avg("excess"), "own_n": F.count("excess")}, several), tails, kind)
    cutoff = pot_cutoff(F.col("u"), F.col("mean"), F.col("square"), F.col("total"), F.col("own"), F.col("own_n"), rules)[2]
    over = over.withColumn("cutoff", cutoff).select(*cols, "x", "implausible", "stuck", "score", "cutoff")
    rest = marked.where("score IS NULL OR u IS NULL OR score <= u").select(*cols, "x", "implausible", "stuck", "score", F.lit(None).cast("double").alias("cutoff"))
    spike = F.coalesce(F.col("score") > F.col("cutoff"), F.lit(False))
    return rest.unionByName(over).select(*show, "x", "implausible", spike.alias("spike"), "stuck", "score", "cutoff")
