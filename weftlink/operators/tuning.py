"""Threshold searches: one job over (threshold, entity), never a loop of jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlink.operators.metrics import entity_f05, hits, true_counts


def steps(low: float, high: float, step: float) -> list[float]:
    return [round(low + i * step, 4) for i in range(int(round((high - low) / step)) + 1)]


def _curve(spine: DataFrame, scored: DataFrame, truth: DataFrame, grid: DataFrame, keep, names: list[str], most: int | None = None) -> DataFrame:
    """Macro figures for each row of a small grid; keep tells which pairs a row accepts.

    The grid is a list in the plan (its length is known here), so it may be
    broadcast.  Entities without a pair are added as counts, not as rows.
    """
    pairs = hits(scored, truth)
    accepted = pairs.crossJoin(F.broadcast(grid)).where(keep)
    if most:
        w = Window.partitionBy(*names, "s1").orderBy(F.col("score").desc(), "cid")
        accepted = accepted.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    per = accepted.groupBy(*names, "s1").agg(F.count(F.lit(1)).alias("n_pred"), F.count("hit").alias("tp"))
    true = true_counts(truth)
    with_pred = entity_f05(per.join(true, "s1", "left").na.fill(0, ["n_true"]))
    figures = with_pred.groupBy(*names).agg(
        F.sum("f05").alias("f"), F.sum("precision").alias("p"), F.sum("recall").alias("r"),
        F.count_if(F.col("n_true") > 0).alias("true_with"), F.count_if(F.col("n_true") == 0).alias("single_with"),
    )
    return _macro(spine, true, grid.join(figures, names, "left").na.fill(0), names)


def _macro(spine: DataFrame, true: DataFrame, out: DataFrame, names: list[str]) -> DataFrame:
    """The macro figures from the sums over entities with a prediction (f, p, r, true_with, single_with)."""
    totals = spine.select("s1").distinct().join(true, "s1", "left").agg(F.count(F.lit(1)).alias("n"), F.count("n_true").alias("n_with_truth"))
    out = out.crossJoin(F.broadcast(totals))
    # Without a prediction: singletons are right (1, 1, 1), others have P 1, R 0, F 0.
    quiet = F.col("n") - F.col("n_with_truth") - F.col("single_with")
    missed = F.col("n_with_truth") - F.col("true_with")
    n = F.greatest(F.col("n"), F.lit(1))
    singles = F.col("n") - F.col("n_with_truth")
    return out.select(
        *names,
        ((F.col("f") + quiet) / n).alias("macro_f05"),
        ((F.col("p") + quiet + missed) / n).alias("precision"),
        ((F.col("r") + quiet) / n).alias("recall"),
        F.when(singles > 0, quiet / singles).otherwise(1.0).alias("singleton_accuracy"),
    )


def threshold_curve(spine: DataFrame, scored: DataFrame, truth: DataFrame, taus: list[float]) -> DataFrame:
    """(tau, macro_f05, precision, recall, singleton_accuracy).

    Pairs are counted once, by entity and the number of thresholds they pass; an
    entity's figures change only there, so it adds its change to the threshold
    where it begins, and the changes are summed up over the thresholds.  Rows
    never exceed the pairs, however fine the curve.
    """
    taus = sorted(float(t) for t in taus)
    true = true_counts(truth)
    # By score first: behind an aggregate the score is a value, not an expression that each threshold evaluates again.
    by_score = hits(scored.select("s1", "cid", "score"), truth).where(F.col("score") >= taus[0]).groupBy("s1", "score").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("h"))
    passes = F.expr(f"size(filter(array({', '.join(f'{t!r}D' for t in taus)}), t -> score >= t))")
    each = by_score.groupBy("s1", passes.alias("b")).agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
    down = Window.partitionBy("s1").orderBy(F.col("b").desc())
    steps_ = each.select("s1", F.col("b").alias("until"), F.coalesce(F.lead("b").over(down), F.lit(0)).alias("since"), F.sum("n").over(down).alias("n_pred"), F.sum("h").over(down).alias("tp"))
    known = entity_f05(steps_.join(true, "s1", "left").na.fill(0, ["n_true"]))
    figures = [F.col("f05").alias("f"), F.col("precision").alias("p"), F.col("recall").alias("r"), (F.col("n_true") > 0).cast("double").alias("true_with"), (F.col("n_true") == 0).cast("double").alias("single_with")]
    values = known.select("since", "until", *figures)
    names = ["f", "p", "r", "true_with", "single_with"]
    change = values.select(F.col("since").alias("at"), *names).unionByName(values.select(F.col("until").alias("at"), *((-F.col(c)).alias(c) for c in names)))
    change = change.groupBy("at").agg(*(F.sum(c).alias(c) for c in names))
    grid = spine.sparkSession.createDataFrame(list(enumerate(taus)), "i int, tau double")
    # As many rows as thresholds on either side.
    summed = grid.join(F.broadcast(change), F.col("at") <= F.col("i"), "left").groupBy("i", "tau").agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names))
    return _macro(spine, true, summed, ["tau"])


def tiered_grid(spine: DataFrame, scored: DataFrame, truth: DataFrame, taus: list[float], highs: list[float], floors: list[float], most: int | None = None) -> DataFrame:
    """Figures for each (tau, high, floor) with high >= tau; scored has score and address."""
    rows = [(float(t), float(h), float(f)) for t in taus for h in highs for f in floors if h >= t]
    grid = spine.sparkSession.createDataFrame(rows, "tau double, high double, floor double")
    keep = (F.col("score") >= F.col("high")) | ((F.col("score") >= F.col("tau")) & (F.col("address") >= F.col("floor")))
    # Pairs under every tau and high cannot be accepted by any row.
    least = min([*taus, *highs])
    return _curve(spine, scored.where(F.col("score") >= least), truth, grid, keep, ["tau", "high", "floor"], most)


def margin_grid(spine: DataFrame, scored: DataFrame, truth: DataFrame, taus: list[float], margins: list[float], highs: list[float]) -> DataFrame:
    """Figures for each (tau, margin, high) of the margin guard."""
    grid = spine.sparkSession.createDataFrame([(float(t), float(m), float(h)) for t in taus for m in margins for h in highs], "tau double, margin double, high double")
    w = Window.partitionBy("s1").orderBy(F.col("score").desc(), "cid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = scored.withColumn("top", F.first("score").over(w)).withColumn("second", F.coalesce(F.nth_value("score", 2).over(w), F.lit(0.0)))
    keep = (F.col("score") >= F.col("tau")) & ((F.col("top") >= F.col("high")) | (F.col("top") - F.col("second") >= F.col("margin")))
    return _curve(spine, ahead, truth, grid, keep, ["tau", "margin", "high"])


def best(curve: DataFrame, names: list[str]) -> DataFrame:
    """The row of the highest macro_f05; ties go to the smaller parameters in order."""
    return curve.orderBy(F.col("macro_f05").desc(), *names).limit(1)


def sorted_configs(curve: DataFrame, names: list[str]) -> DataFrame:
    """All rows, best first: macro_f05, then the larger parameters in order."""
    return curve.orderBy(F.col("macro_f05").desc(), *(F.col(n).desc() for n in names))


def nearest(curve: DataFrame, tau: float, within: float = 0.007) -> DataFrame:
    """The row whose threshold is closest to tau, if closer than ``within``."""
    return curve.withColumn("off", F.abs(F.col("tau") - F.lit(tau))).where(F.col("off") < within).orderBy("off", "tau").limit(1).drop("off")


def coarse_to_fine(spine: DataFrame, scored: DataFrame, truth: DataFrame, low: float = 0.2, high: float = 0.96) -> DataFrame:
    """The best threshold of a coarse curve (.02), searched again within .04 of it (.005)."""
    first = best(threshold_curve(spine, scored, truth, steps(low, high, 0.02)), ["tau"]).first()
    around = steps(max(0.0, first["tau"] - 0.04), min(1.0, first["tau"] + 0.04), 0.005)
    return best(threshold_curve(spine, scored, truth, around), ["tau"])


@dataclass(frozen=True)
class Gate:
    """Whether a challenger may replace the champion."""

    gain: float = 0.0020
    singletons: float = 0.90

    def passes(self, champion: dict, challenger: dict, valid: bool = True) -> tuple[bool, list[str]]:
        reasons = []
        if challenger["macro_f05"] - champion["macro_f05"] < self.gain:
            reasons.append(f"gain {challenger['macro_f05'] - champion['macro_f05']:.4f} under {self.gain}")
        if challenger["singleton_accuracy"] < self.singletons:
            reasons.append(f"singleton accuracy {challenger['singleton_accuracy']:.4f} under {self.singletons}")
        if not valid:
            reasons.append("the output does not validate")
        return not reasons, reasons


@dataclass(frozen=True)
class SecondGate:
    """A later gate, which judges singletons against the champion; the champion's file changes either way, with the reason kept."""

    gain: float = 0.002
    singletons: float = 0.01

    def passes(self, champion: dict, challenger: dict) -> tuple[bool, str]:
        better = challenger["macro_f05"] - champion["macro_f05"] > self.gain
        safe = challenger["singleton_accuracy"] >= champion["singleton_accuracy"] - self.singletons
        return better and safe, "promoted" if better and safe else "no gain" if not better else "singletons lost"
