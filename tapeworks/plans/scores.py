"""Queries on scores and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panels, scoring
from ..sources import views as v
from . import panels as panel_plans
from .market import rounded
from .registry import ORACLES, query

WEIGHTS, BIAS = {"peak_pnl": 1.5, "recoveries": -0.2, "hhi_top5": 2.0, "sell_share": 1.0, "size_cv": -1.0}, -0.4
LINEAR = "1 / (1 + exp(-(" + f"{BIAS}" + "".join(f" + {w} * coalesce({n}, 0)" for n, w in WEIGHTS.items()) + ")))"
BANDS = {"low": 0.3, "medium": 0.5, "high": 0.7}
PANEL5 = ORACLES["panel5"].replace("with recursive ", "", 1)
HEAD, _, LAST = PANEL5.rpartition("\n  select ")
SCORED = f"with recursive {HEAD}, p5 as (select {LAST}), mm as (select distinct mint from swaps_v), sc as (select mint, peak_pnl, swaps, {LINEAR} score from mm left join p5 using (mint))"


def _features(spark, d):
    tape = v.swaps(spark, d)
    return tape.select("mint").distinct().join(panel_plans.panel5(spark, d), "mint", "left")


@query("decision_ensemble", f"{SCORED} select mint, case when swaps is not null then round(score, 5) end score, case when swaps is null then 'SKIP_NO_DATA' when peak_pnl >= 0.8 or score >= 0.55 then 'REJECT' else 'PASS' end decision from sc")
def decision_ensemble(spark, d):
    """A rule on one feature or a linear score at its cutoff rejects; mints without features are skipped."""
    rows = _features(spark, d).withColumn("s", scoring.linear(WEIGHTS, BIAS))
    has = F.col("swaps").isNotNull()
    return rows.select("mint", F.round(F.when(has, F.col("s")), 5).alias("score"), scoring.decision(F.col("s"), 0.55, has, F.lit(False), F.coalesce(F.col("peak_pnl") >= 0.8, F.lit(False))).alias("decision"))


@query("model_scores", f"{SCORED} select mint, round(score, 5) score, case when score >= 0.7 then 'high' when score >= 0.5 then 'medium' when score >= 0.3 then 'low' else 'none' end band, case when score >= 0.5 then 'REJECT' else 'PASS' end decision from sc where swaps is not null")
def model_scores(spark, d):
    """The same score by an injected model over batches of rows, with bands and decisions."""
    rows = scoring.scored(_features(spark, d).where("swaps is not null"), list(WEIGHTS), scoring.Logistic(WEIGHTS, BIAS), missing=0.0)
    failed = F.col("model_error").isNotNull()
    return rows.select("mint", F.round("score", 5).alias("score"), scoring.band(F.col("score"), BANDS).alias("band"), scoring.decision(F.col("score"), 0.5, F.lit(True), failed).alias("decision"))


@query("panel_versions", f"with {panel_plans.PANEL}, r as (select mint, mint % 2 as version, total_volume, mean_size_300 from panel) select mint, version, round(case when version = 0 then total_volume else mean_size_300 end, 6) as feature from r")
def panel_versions(spark, d):
    """The feature that the model's version of a mint takes."""
    tape = v.swaps(spark, d)
    p = panels.panel22(tape, panel_plans.starts(tape), panel_plans.UNIT, panel_plans.DUST).withColumn("version", F.col("mint") % 2)
    return rounded(p.select("mint", "version", F.when(F.col("version") == 0, F.col("total_volume")).otherwise(F.col("mean_size_300")).alias("feature")), 6, "feature")
