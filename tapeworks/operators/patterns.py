"""Patterns and features of the bars after a start: one row a mint.

Bars (mint, open, high, low, close, volume, trades, buys, sells) have `offset`, the seconds from the mint's start to the bar's.
A mint has few bars before its entry, so windows over them and the one array of closes are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite


def _late(least: float) -> Column:
    return F.col("offset") >= least


def entries(bars: DataFrame, entry: float, inclusive: bool, tolerance: float = 30.0) -> DataFrame:
    """Bars before the entry with their position `i` (from 0), the number `n` of them, returns against the first open, and the entry's return.

    `inclusive` counts the bar at the entry itself among those before it. Mints with fewer than three such bars,
    without a bar from the entry on, or with a first or entry price that isn't positive are left out.
    """
    post = bars.where(_late(-tolerance))
    at = Window.partitionBy("mint")
    post = post.withColumns({
        "first_open": F.first("open").over(at.orderBy("offset")),
        "entry_price": F.min_by("open", F.when(_late(entry), F.col("offset"))).over(at),
        "_post": F.count("*").over(at),
    })
    before = post.where((F.col("offset") <= entry) if inclusive else (F.col("offset") < entry))
    before = before.withColumns({"i": F.row_number().over(at.orderBy("offset")) - 1, "n": F.count("*").over(at)})
    ok = (F.col("_post") >= 3) & (F.col("n") >= 3) & (F.col("first_open") > 0) & (F.col("entry_price") > 0)
    ret = lambda c: F.col(c) / F.col("first_open") - 1
    return before.where(ok).withColumns({"c": ret("close"), "h": ret("high"), "l": ret("low"), "entry_ret": ret("entry_price")})


def _extremes(rows: DataFrame) -> DataFrame:
    """Per mint: highest and lowest return with their first positions, last close, volumes and the array of closes."""
    last = lambda k: F.max(F.when(F.col("i") == F.col("n") - k, F.col("c")))
    tail = F.greatest(F.lit(2), F.floor(F.col("n") * 0.3).cast("int"))
    return rows.groupBy("mint").agg(
        F.max("n").alias("n"), F.max("h").alias("peak"), F.min("l").alias("trough"), F.min_by("i", F.struct(-F.col("h"), F.col("i"))).alias("peak_at"), F.min_by("i", F.struct("l", "i")).alias("trough_at"),
        F.max("entry_ret").alias("entry"), last(1).alias("last"), last(3).alias("third_last"), F.max(F.when(F.col("i") == F.col("n") - tail, F.col("c"))).alias("tail_first"),
        F.sum(F.when(F.col("i") < 3, F.col("volume"))).alias("early_volume"), F.sum(F.when(F.col("i") >= F.col("n") - 3, F.col("volume"))).alias("late_volume"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("closes"), F.transform(F.array_sort(F.collect_list(F.struct("i", "volume"))), lambda x: x["volume"]).alias("volumes"),
    )


def _shapes(e: DataFrame) -> DataFrame:
    reach = F.col("peak") - F.col("trough")
    e = e.withColumns({"range": reach, "fall": F.col("last") - F.col("peak"), "recovery": F.when(reach > 0.01, (F.col("last") - F.col("trough")) / reach).otherwise(0.0)})
    v = (F.col("peak") >= 0.10) & (F.col("trough") < F.col("peak") - 0.10) & (F.col("recovery") >= 0.30) & (F.col("peak_at") < F.col("trough_at"))
    steady = (F.col("entry") > 0.10) & (F.col("fall") > -0.10)
    near = ~v & ~steady & (F.col("fall") > -0.20) & (F.col("entry") > 0) & (F.col("peak") >= 0.05)
    return e.withColumns({"vshape": v, "steady": steady, "near": near})


def pattern(bars: DataFrame, entry: float, inclusive: bool = True) -> DataFrame:
    """(mint, pattern, entry_ret, trough_ret, recovery): the first that fits of vshape, steady and near, else none."""
    e = _shapes(_extremes(entries(bars, entry, inclusive)))
    name = F.when(F.col("vshape"), "vshape").when(F.col("steady"), "steady").when(F.col("near"), "near").otherwise("none")
    return e.select("mint", name.alias("pattern"), F.col("entry").alias("entry_ret"), F.col("trough").alias("trough_ret"), "recovery")


def stair_bumps(closes: Column, up: float = 0.05, down: float = 0.03) -> Column:
    """Rises by `up` over the last high while no fall by `down` came between: the state is (high, after a rise, bumps)."""

    def step(s: Column, x: Column) -> Column:
        rise, fall = x > s["high"] + up, x < s["high"] - down
        return F.struct(
            F.when(rise & (~s["held"] | ~fall), x).otherwise(s["high"]).alias("high"), F.when(s["held"], ~fall).otherwise(rise).alias("held"), (s["bumps"] + F.when(s["held"] & ~fall & rise, 1).otherwise(0)).alias("bumps")
        )

    start = F.struct(F.lit(0.0).alias("high"), F.lit(False).alias("held"), F.lit(0).alias("bumps"))
    return F.aggregate(F.slice(closes, F.lit(2), F.greatest(F.size(closes) - 1, F.lit(0))), start, step)["bumps"]


def patterns7(bars: DataFrame, entry: float) -> DataFrame:
    """Flags of seven patterns before the entry (its own bar excluded), and the figures that they rest on."""
    e = _shapes(_extremes(entries(bars, entry, inclusive=False)))
    n = F.col("n")
    back = F.when(F.col("range") > 0.01, (F.col("entry") - F.col("trough")) / F.col("range")).otherwise(0.0)
    reversal = ~F.col("vshape") & ~F.col("steady") & ~F.col("near") & (F.col("trough_at") < F.col("peak_at")) & (F.col("entry") > 0.15) & (back > 0.50) & (F.col("peak") >= 0.10)
    cup = (n >= 5) & (F.col("trough_at") > 0) & (F.col("trough_at") < n - 2) & (F.col("trough") >= -0.30) & (F.col("trough") < -0.05)
    cup = cup & (F.col("last") - F.col("tail_first") >= 0.10) & ((F.col("peak_at") >= F.col("trough_at")) | (F.col("peak") < 0.10))
    stair = (n >= 4) & (stair_bumps(F.col("closes")) >= 2)
    swell = (n >= 6) & (F.col("early_volume") > 0) & (F.col("late_volume") / F.col("early_volume") >= 2.0) & (F.col("last") > -0.10)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    split = F.col("trough_at") + 1
    before, after = total(F.slice("volumes", F.lit(1), split)), total(F.slice("volumes", split + 1, F.greatest(n - split, F.lit(0))))
    ratio = F.when((F.col("trough_at") > 0) & (F.col("trough_at") < n - 1) & (before > 0), after / before).otherwise(0.0)
    e = e.withColumns({"reversal": reversal, "cup_handle": cup, "stair_step": stair, "volume_acceleration": swell})
    flags = ["vshape", "steady", "near", "reversal", "cup_handle", "stair_step", "volume_acceleration"]
    some = F.greatest(*[F.col(c).cast("int") for c in flags])
    return e.select(
        "mint", *[F.col(c).cast("int").alias(c) for c in flags], some.alias("any_pattern"), F.col("peak").alias("peak_ret"), F.col("trough").alias("trough_ret"), F.col("entry").alias("entry_ret"), "recovery",
        F.col("fall").alias("drawdown"), ratio.alias("volume_ratio"), F.coalesce(F.col("last") - F.col("third_last"), F.lit(0.0)).alias("momentum"),
    )


def bar_panel20(bars: DataFrame, most: int = 6, look: int = 3) -> DataFrame:
    """Features of the last `look` of the first `most` bars (position i from 0), and of all of them.

    Mints with fewer than three bars or a first close that isn't positive are left out.
    """
    at = Window.partitionBy("mint")
    rows = bars.where(F.col("i") < most).withColumns({"n": F.count("*").over(at), "_r": F.try_divide(F.col("close") - F.lag("close").over(at.orderBy("i")), F.lag("close").over(at.orderBy("i")))})
    recent = F.col("i") >= F.greatest(F.col("n") - look, F.lit(0))
    inside = F.when(F.col("i") >= F.greatest(F.col("n") - look + 1, F.lit(1)), F.col("_r"))
    of = lambda c: F.when(recent, F.col(c))
    at_ = lambda c, k: F.max(F.when(F.col("i") == k, F.col(c)))
    head, last = F.greatest(F.col("n") - look, F.lit(0)), F.col("n") - 1
    a = rows.groupBy("mint").agg(
        F.max("n").alias("n"), at_("close", 0).alias("c0"), at_("close", head).alias("l0"), at_("close", last).alias("cl"), at_("high", last).alias("hl"), at_("low", last).alias("ll"), at_("volume", head).alias("v0"), at_("volume", last).alias("vl"),
        F.max(of("high")).alias("lh"), F.min(of("low")).alias("lw"), F.max(of("close")).alias("lmax"), F.min(of("close")).alias("lmin"), F.sum(of("volume")).alias("lv"), F.sum(of("trades")).alias("lt"), F.least(F.max("n"), F.lit(look)).alias("ln"),
        F.stddev_pop(inside).alias("rs"), F.max(inside).alias("rx"), F.min(inside).alias("rn"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("volume").alias("v"), F.sum("trades").alias("tr"),
    ).where((F.col("n") >= 3) & (F.col("c0") > 0))
    over = lambda x: F.coalesce(F.try_divide(x, "l0"), F.lit(0.0))
    c = F.col
    return a.select(
        "mint", over(c("cl") - c("l0")).alias("lookback_return"), over(c("lh") - c("lw")).alias("lookback_high_low"), over(c("lmax") - c("l0")).alias("lookback_max_close"), over(c("lmin") - c("l0")).alias("lookback_min_close"),
        F.coalesce(F.try_divide(c("hl") - c("ll"), c("cl")), F.lit(0.0)).alias("last_bar_range"), c("lv").alias("lookback_volume"), (c("lv") / c("ln")).alias("lookback_avg_volume"), (c("vl") - c("v0")).alias("lookback_volume_slope"),
        (c("vl") / F.greatest("v0", F.lit(1.0))).alias("lookback_volume_acceleration"), c("lt").cast("double").alias("lookback_trades"), (c("lt") / c("ln")).alias("lookback_avg_trades"), (c("lv") / F.greatest(c("lt").cast("double"), F.lit(1.0))).alias("lookback_avg_trade_size"),
        F.coalesce("rs", F.lit(0.0)).alias("lookback_return_std"), F.coalesce("rx", F.lit(0.0)).alias("lookback_return_max"), F.coalesce("rn", F.lit(0.0)).alias("lookback_return_min"), (c("cl") / c("c0") - 1).alias("cum_return"),
        (c("low") / c("c0") - 1).alias("cum_drawdown"), (c("high") / c("c0") - 1).alias("cum_max"), c("v").alias("cum_volume"), c("tr").cast("double").alias("cum_trades"),
    )


def legacy6(bars: DataFrame, count: int = 5) -> DataFrame:
    """Return, volume, trades, share of buys, volatility and share of empty bars of the first `count` bars; none with fewer bars."""
    at = Window.partitionBy("mint").orderBy("i")
    rows = bars.where(F.col("i") < count).withColumn("_r", F.try_divide("close", F.lag("close").over(at)) - 1)
    a = rows.groupBy("mint").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("i") == 0, F.col("close"))).alias("c0"), F.max(F.when(F.col("i") == count - 1, F.col("close"))).alias("c4"), F.sum("volume").alias("volume"), F.sum("trades").cast("double").alias("trades"),
        F.coalesce(F.try_divide(F.sum("buys"), F.sum(F.col("buys") + F.col("sells"))), F.lit(0.5)).alias("buy_share"), F.coalesce(F.stddev_pop("_r"), F.lit(0.0)).alias("volatility"), (F.count_if(F.col("trades") == 0) / F.count("*")).alias("stale"),
    ).where((F.col("n") == count) & (F.col("c0") > 0))
    return a.select("mint", (F.col("c4") / F.col("c0") - 1).alias("return"), "volume", "trades", "buy_share", "volatility", "stale")


def cross_validated(own: DataFrame, other: DataFrame, most: float) -> DataFrame:
    """Bars' cumulative returns (mint, ret) of two sources: accepted unless both are there and differ by more than `most`."""
    rows = own.join(other.select("mint", F.col("ret").alias("other")), "mint", "left")
    gap = F.abs(F.col("ret") - F.col("other"))
    return rows.select("mint", "ret", "other", F.coalesce(gap <= most, F.lit(True)).alias("accepted"))


def winner(bars: DataFrame, entry: float, later: int, least: float) -> DataFrame:
    """Whether the close `later` bars after the first bar from `entry` on exceeds its open by `least`; null if there is no such bar."""
    at = Window.partitionBy("mint")
    rows = bars.withColumns({"i": F.row_number().over(at.orderBy("offset")), "n": F.count("*").over(at)})
    rows = rows.withColumn("e", F.min(F.when(_late(entry), F.col("i"))).over(at))
    a = rows.groupBy("mint").agg(F.max(F.when(F.col("i") == F.col("e"), F.col("open"))).alias("ep"), F.max(F.when(F.col("i") == F.least(F.col("n"), F.col("e") + later), F.col("close"))).alias("xp"))
    return a.select("mint", F.when((F.col("ep") > 0) & (F.col("xp") > 0), (F.col("xp") / F.col("ep") - 1 > least).cast("int")).alias("winner"))


def passes(value: Column, orientation: Column, threshold: Column) -> Column:
    """Whether a value reaches a threshold from the side that counts; null if either is missing or not finite, or the side unknown."""
    x, y = finite(value), finite(threshold)
    return F.when(orientation == "high", x >= y).when(orientation == "low", x <= y)


def event_scan(features: DataFrame, thresholds: DataFrame, need: dict[str, int], wanted: list[str], share: float = 0.60) -> DataFrame:
    """(mint, delay): the earliest delay of each mint at which all wanted families pass.

    features: mint, delay and a double column for each feature. thresholds (a small table): feature, family, orientation,
    threshold. A family passes if at least need[family] of its features are there and `share` of those pass.
    """
    names = [c for c in features.columns if c not in ("mint", "delay")]
    long = features.unpivot(["mint", "delay"], names, "feature", "value").join(F.broadcast(thresholds), "feature")
    ok = passes(F.col("value"), F.col("orientation"), F.col("threshold"))
    needed = F.create_map(*[F.lit(x) for kv in need.items() for x in kv])
    by = long.groupBy("mint", "delay", "family").agg(F.count(ok).alias("there"), F.count_if(ok).alias("passed"))
    by = by.where((F.col("there") >= needed[F.col("family")]) & (F.try_divide("passed", "there") >= share) & F.col("family").isin(wanted))
    return by.groupBy("mint", "delay").agg(F.count("*").alias("_f")).where(F.col("_f") == len(wanted)).groupBy("mint").agg(F.min("delay").alias("delay"))


def event_states(features: DataFrame, thresholds: DataFrame, need: dict[str, int], share: float = 0.60) -> DataFrame:
    """(mint, delay, for each family of `need` <family>_share and <family>): the share of its features that pass, and whether the family does.

    As in event_scan; a feature that is null at a delay is absent there: it counts neither as passed nor as failed.
    """
    names = [c for c in features.columns if c not in ("mint", "delay")]
    long = features.unpivot(["mint", "delay"], names, "feature", "value").join(F.broadcast(thresholds), "feature")
    long = long.withColumn("_ok", passes(F.col("value"), F.col("orientation"), F.col("threshold")))
    of = lambda f: F.when(F.col("family") == f, F.col("_ok"))
    by = long.groupBy("mint", "delay").agg(*[x for f in need for x in (F.count(of(f)).alias(f"_n_{f}"), F.count_if(of(f)).alias(f"_p_{f}"))])
    by = by.withColumns({f"{f}_share": F.try_divide(f"_p_{f}", f"_n_{f}") for f in need})
    passed = {f: (F.col(f"_n_{f}") >= n) & (F.coalesce(f"{f}_share", F.lit(0.0)) >= share) for f, n in need.items()}
    return by.withColumns(passed).select("mint", "delay", *[c for f in need for c in (f"{f}_share", f)])


def first_event(states: DataFrame, wanted: list[str], more: str) -> DataFrame:
    """Of each mint the earliest delay at which all of `wanted` pass, with the shares then; `with_<more>` tells if that family passes too."""
    every = F.lit(True)
    for f in wanted:
        every = every & F.col(f)
    rows = states.where(every).withColumn(f"with_{more}", F.col(more))
    kept = [f"{f}_share" for f in (*wanted, more)] + [f"with_{more}"]
    return rows.groupBy("mint").agg(F.min("delay").alias("delay"), F.min_by(F.struct(*kept), "delay").alias("_k")).select("mint", "delay", "_k.*")
