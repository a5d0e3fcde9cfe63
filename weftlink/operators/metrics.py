"""Evaluation of predicted against true pairs; every entity of the spine counts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hits(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds hit, 1 for a true pair and null for any other.

    truth is a table of true pairs (s1, cid), or one of classes (id, class) whose
    members are each other's matches (a null class: none); a class is never
    expanded into its pairs, so it may hold any share of the records.
    """
    if "class" in truth.columns:
        of = lambda side: truth.select(F.col("id").alias(side), F.col("class").alias(f"_{side}"))
        both = pairs.join(of("s1"), "s1", "left").join(of("cid"), "cid", "left")
        return both.withColumn("hit", F.when((F.col("_s1") == F.col("_cid")) & (F.col("s1") != F.col("cid")), 1)).select(*pairs.columns, "hit")
    return pairs.join(truth.select("s1", "cid").distinct().withColumn("hit", F.lit(1)), ["s1", "cid"], "left")


def true_counts(truth: DataFrame) -> DataFrame:
    """(s1, n_true) of entities that have a match."""
    if "class" in truth.columns:
        size = truth.where(F.col("class").isNotNull()).groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return truth.join(size, "class").select(F.col("id").alias("s1"), (F.col("n") - 1).alias("n_true"))
    return truth.select("s1", "cid").distinct().groupBy("s1").agg(F.count(F.lit(1)).alias("n_true"))


def true_total(truth: DataFrame) -> DataFrame:
    """One row: n_true, the number of true pairs."""
    return true_counts(truth).agg(F.coalesce(F.sum("n_true"), F.lit(0)).alias("n_true"))


def counts(spine: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1, n_pred, n_true, tp) for every s1 of the spine; pairs are taken once."""
    found = hits(predicted.select("s1", "cid").distinct(), truth).groupBy("s1").agg(F.count(F.lit(1)).alias("n_pred"), F.count("hit").alias("tp"))
    every = spine.select("s1").distinct().join(found, "s1", "left").join(true_counts(truth), "s1", "left").na.fill(0, ["n_pred", "n_true", "tp"])
    return every.select("s1", "n_pred", "n_true", "tp")


def f_half(precision: Column, recall: Column) -> Column:
    bottom = 0.25 * precision + recall
    return F.when(bottom > 0, 1.25 * precision * recall / bottom).otherwise(0.0)


def entity_f05(n: DataFrame) -> DataFrame:
    """Adds f05, precision and recall: both sides empty 1; truth empty P 0, R 1; prediction empty P 1, R 0."""
    p, t, tp = F.col("n_pred"), F.col("n_true"), F.col("tp")
    precision = F.when((p == 0) & (t == 0), F.lit(1.0)).when(t == 0, F.lit(0.0)).when(p == 0, F.lit(1.0)).otherwise(tp / p)
    recall = F.when((p == 0) & (t == 0), F.lit(1.0)).when(t == 0, F.lit(1.0)).when(p == 0, F.lit(0.0)).otherwise(tp / t)
    f = F.when((p == 0) & (t == 0), F.lit(1.0)).when((p == 0) | (t == 0) | (tp == 0), F.lit(0.0)).otherwise(f_half(tp / F.greatest(p, F.lit(1)), tp / F.greatest(t, F.lit(1))))
    return n.withColumns({"precision": precision, "recall": recall, "f05": f})


def macro(spine: DataFrame, predicted: DataFrame, truth: DataFrame, convention: str = "default") -> DataFrame:
    """One row: macro F0.5, precision, recall, singleton accuracy and error counts.

    convention decides over one-sided entities in precision and recall:
    "default" as entity_f05; "one_sided_zero": P = R = 0; "non_singletons": only
    entities with a truth, an empty prediction having P 0; "predicted":
    precision over entities with truth and prediction only.
    """
    n = entity_f05(counts(spine, predicted, truth))
    p, t, tp = F.col("n_pred"), F.col("n_true"), F.col("tp")
    if convention == "default":
        precision, recall = F.col("precision"), F.col("recall")
    elif convention == "one_sided_zero":
        one = (p == 0) != (t == 0)
        precision, recall = F.when(one, 0.0).otherwise(F.col("precision")), F.when(one, 0.0).otherwise(F.col("recall"))
    else:
        hit = F.when(p > 0, tp / F.greatest(p, F.lit(1))).otherwise(0.0)
        precision = F.when(t > 0, hit) if convention == "non_singletons" else F.when((t > 0) & (p > 0), hit)
        recall = F.when(t > 0, tp / F.greatest(t, F.lit(1)))
    single = t == 0
    return n.agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.coalesce(F.avg("f05"), F.lit(0.0)).alias("macro_f05"),
        F.coalesce(F.avg(precision), F.lit(0.0)).alias("precision"),
        F.coalesce(F.avg(recall), F.lit(0.0)).alias("recall"),
        F.coalesce(F.avg(F.when(single, (p == 0).cast("double"))), F.lit(1.0)).alias("singleton_accuracy"),
        F.count_if(single & (p > 0)).alias("false_merges"),
        F.count_if(~single & (p == 0)).alias("missed_matches"),
        F.coalesce(F.sum(p - tp), F.lit(0)).alias("false_pairs"),
        F.coalesce(F.sum(t - tp), F.lit(0)).alias("missed_pairs"),
    )


def over_predictions(predicted: DataFrame, truth: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """macro() over the prediction's own entities: those of keys (s1), or of the predicted pairs where no file lists the empty ones."""
    return macro((predicted if keys is None else keys).select("s1"), predicted, truth)


def cardinality(n: DataFrame) -> DataFrame:
    """One row on n_pred: mean, median, upper percentiles, most, and shares of empty, 5 and 10 or more."""
    p = F.col("n_pred")
    at = [("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)]
    return n.agg(
        F.avg(p).alias("mean"), *(F.percentile(p, F.lit(q)).alias(k) for k, q in at), F.max(p).alias("most"),
        F.avg((p == 0).cast("double")).alias("share_empty"), F.avg((p >= 5).cast("double")).alias("share_5"), F.avg((p >= 10).cast("double")).alias("share_10"),
        F.count_if(p >= 20).alias("n_20"),
    )


def blocking_quality(spine: DataFrame, pool_size: DataFrame, pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: pair recall, entity-perfect recall, any-hit recall, mean, median and most candidates, reduction ratio."""
    n = counts(spine, pairs, truth)
    true = F.col("n_true") > 0
    return n.crossJoin(F.broadcast(pool_size.agg(F.count(F.lit(1)).alias("pool")))).agg(
        (F.sum("tp") / F.greatest(F.sum("n_true"), F.lit(1))).alias("pair_recall"),
        F.avg(F.when(true, (F.col("tp") == F.col("n_true")).cast("double"))).alias("perfect_recall"),
        F.avg(F.when(true, (F.col("tp") > 0).cast("double"))).alias("hit_recall"),
        F.avg("n_pred").alias("mean_candidates"),
        F.percentile("n_pred", F.lit(0.5)).alias("median_candidates"),
        F.max("n_pred").alias("most_candidates"),
        F.count_if(~true & (F.col("n_pred") > 0)).alias("singletons_with_candidates"),
        (1.0 - F.sum("n_pred") / (F.count(F.lit(1)) * F.max("pool"))).alias("reduction_ratio"),
    )


def k_sweep(spine: DataFrame, ranked: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """(k, pairs, hits, pair_recall) for prefixes of one ranking, in one pass over the ranked pairs."""
    total = true_total(truth)
    row = hits(ranked.select("s1", "cid", "rn"), truth).agg(*(F.count_if(F.col("rn") <= k).alias(f"p{k}") for k in ks), *(F.count_if((F.col("rn") <= k) & F.col("hit").isNotNull()).alias(f"h{k}") for k in ks))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("pairs"), F.col(f"h{k}").alias("hits")) for k in ks))).alias("x")
    return row.select(rows).select("x.*").crossJoin(F.broadcast(total)).select("k", "pairs", "hits", (F.col("hits") / F.greatest("n_true", F.lit(1))).alias("pair_recall"))


def channel_recall(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """(channel, hits, recall) of each channel and of all together, of pairs with their channels."""
    found = hits(pairs.select("s1", "cid", "channels"), truth).where("hit = 1")
    each = found.select(F.explode("channels").alias("channel")).groupBy("channel").agg(F.count(F.lit(1)).alias("hits"))
    every = found.agg(F.lit("all").alias("channel"), F.count(F.lit(1)).alias("hits"))
    total = true_total(truth)
    return each.unionByName(every.select("channel", "hits")).crossJoin(F.broadcast(total)).select("channel", "hits", (F.col("hits") / F.greatest("n_true", F.lit(1))).alias("recall"))
