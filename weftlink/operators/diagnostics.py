"""Where matches are lost, and what the data look like."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.functions import similarity as S
from weftlink.operators.metrics import hits, k_sweep, true_counts, true_total
from weftlink.operators.scoring import side
from weftlink.sources.readers import id_list


def failure_stages(truth: DataFrame, blocked: DataFrame, ranked: DataFrame, scored: DataFrame, accepted: DataFrame, tau: float) -> DataFrame:
    """(stage, n, share) of true pairs by the first stage that lost them.

    blocked, ranked, scored and accepted are (s1, cid) tables of later and later
    stages; scored has score (under 0: rejected outright), or reject, the
    reason of an outright rejection (null: none).
    """
    key = ["s1", "cid"]
    flag = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    every = flag(blocked, "blocked").join(flag(accepted, "accepted"), key, "full")
    t = hits(every, truth).where("hit = 1").join(flag(ranked, "kept"), key, "left").join(scored.groupBy(*key).agg(F.max("score").alias("score"), (F.min("reject") if "reject" in scored.columns else F.lit(None).cast("string")).alias("reject")), key, "left")
    told = "reject" in scored.columns
    refused, rejected = (F.col("reject").isNotNull(), F.concat(F.col("reject"), F.lit(" reject"))) if told else (F.col("score") < 0, F.lit("hard reject"))
    stage = (
        F.when(F.col("accepted"), "accepted").when(F.col("blocked").isNull(), "not blocked").when(F.col("kept").isNull(), "pruned")
        .when(refused, rejected).when(F.col("score") < tau, "below threshold").otherwise("address floor")
    )
    n = t.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    # True pairs that no stage has seen are counted, not listed.
    total = true_total(truth).select(F.col("n_true").alias("total"))
    unseen = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("seen")).crossJoin(F.broadcast(total)).select(F.lit("not blocked").alias("stage"), (F.col("total") - F.col("seen")).alias("n"))
    n = n.unionByName(unseen).groupBy("stage").agg(F.sum("n").alias("n")).where("n > 0")
    return n.crossJoin(F.broadcast(total)).select("stage", "n", (F.col("n") / F.col("total")).alias("share"))


def error_kinds(wrong: DataFrame) -> DataFrame:
    """Adds kind to false or missed pairs with l, r and jw: the first of the usual reasons that holds."""
    address = S.jaccard(*side("addr_tokens"))
    kind = (
        F.when(S.differ(*side("street")), "street conflict").when(F.col("jw") >= 0.95, "near duplicate name")
        .when((F.col("l.clean_addr") == "") | (F.col("r.clean_addr") == ""), "missing address")
        .when((S.overlap(*side("name_tokens")) == 0) & (address == 0), "nothing in common").otherwise("abbreviation")
    )
    return wrong.withColumn("kind", kind)


def singleton_errors(accepted: DataFrame, truth: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(s1, cid, score): the best accepted pair of entities that have no match; with names (id, clean_name) also error, whether the names are the same."""
    lone = accepted.join(true_counts(truth).select("s1"), "s1", "left_anti")
    best = lone.groupBy("s1").agg(F.max(F.struct("score", "cid")).alias("b")).select("s1", "b.cid", "b.score")
    if names is None:
        return best
    of = lambda side: names.select(F.col("id").alias(side), F.col("clean_name").alias(f"_{side}"))
    error = F.when(F.col("_s1") == F.col("_cid"), "same name, other address").otherwise("similar name")
    return best.join(of("s1"), "s1").join(of("cid"), "cid").select("s1", "cid", "score", error.alias("error"))


def error_counts(scored: DataFrame, truth: DataFrame, tau: float = 0.56) -> DataFrame:
    """One row of six counts over candidate pairs with l, r, jw, address and score.

    False pairs of entities without a match; entities that miss a match in the
    end; entities that miss one among the candidates already; and false pairs
    by kind: equal names at other places, similar names, and another name at
    the same street number.
    """
    known = hits(scored.select("s1", "cid", "score", "jw", "address", S.same(*side("street")).alias("number")), truth)
    good = F.col("score") >= tau
    per = known.groupBy("s1").agg(F.count("hit").alias("found"), F.count_if(good & F.col("hit").isNotNull()).alias("tp"))
    true = true_counts(truth)
    missed = true.join(per, "s1", "left").na.fill(0, ["found", "tp"]).agg(F.count_if(F.col("tp") < F.col("n_true")).alias("missed_entities"), F.count_if(F.col("found") < F.col("n_true")).alias("missed_at_retrieval"))
    false = known.where(good & F.col("hit").isNull()).join(true, "s1", "left")
    elsewhere, alike = (F.col("jw") >= 0.90) & (F.col("address") < 0.20), F.col("jw") >= 0.85
    kinds = false.agg(
        F.count_if(F.col("n_true").isNull()).alias("singleton_merges"), F.count_if(elsewhere).alias("same_name_elsewhere"), F.count_if(~elsewhere & alike).alias("similar_name"),
        F.count_if(~elsewhere & ~alike & F.col("number") & (F.col("jw") < 0.60)).alias("same_number"),
    )
    return kinds.crossJoin(F.broadcast(missed))


def truth_profile(lists: DataFrame, entities: int, list_col: str = "matched_entity_ids") -> DataFrame:
    """One row on a file of id lists: rows, entities with matches, without, absent from the file, the most matches and the mentions of either source."""
    ids = id_list(list_col)
    n = F.size(ids)
    of = lambda prefix: F.coalesce(F.sum(F.size(F.filter(ids, lambda x: x.startswith(prefix)))), F.lit(0))
    found = lists.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(n > 0).alias("with_matches"), F.count_if(n == 0).alias("empty"), F.coalesce(F.max(n), F.lit(0)).alias("most"), of("S2-").alias("s2_mentions"), of("S3-").alias("s3_mentions"))
    absent = F.greatest(F.lit(0), F.lit(entities) - F.col("n_rows"))
    return found.select("*", absent.cast("long").alias("absent"), (100.0 * (F.col("empty") + absent) / max(entities, 1)).alias("singleton_percent"))


def wrong_pairs(accepted: DataFrame, truth: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(s1, cid, error, n): accepted but untrue pairs, and true ones not accepted.

    Of a truth in pairs the missed ones are listed, with retrieved if blocked
    pairs are given; of a truth in classes they are counted for each entity
    (cid null), as a class has too many pairs to list.
    """
    a = accepted.select("s1", "cid").distinct()
    false = hits(a, truth).where("hit is null").select("s1", "cid", F.lit("false").alias("error"), F.lit(1).cast("long").alias("n"))
    if "class" in truth.columns:
        found = hits(a, truth).groupBy("s1").agg(F.count("hit").alias("tp"))
        left = F.col("n_true") - F.coalesce("tp", F.lit(0))
        missed = true_counts(truth).join(found, "s1", "left").select("s1", F.lit(None).cast("string").alias("cid"), F.lit("missed").alias("error"), left.alias("n")).where("n > 0")
        return false.unionByName(missed)
    missed = truth.select("s1", "cid").distinct().join(a, ["s1", "cid"], "left_anti").withColumn("error", F.lit("missed")).withColumn("n", F.lit(1).cast("long"))
    out = false.unionByName(missed)
    if blocked is None:
        return out
    return out.join(blocked.select("s1", "cid").distinct().withColumn("retrieved", F.lit(True)), ["s1", "cid"], "left").na.fill(False, ["retrieved"])


def profile(df: DataFrame, id_col: str) -> DataFrame:
    """One row: rows, distinct and duplicate ids, and missing values ("" or null) of each column."""
    missing = [F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(f"missing_{c}") for c in df.columns]
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("ids"), (F.count(id_col) - F.count_distinct(id_col)).alias("duplicate_ids"), *missing)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, n, share), the share by a second aggregate, not by a window over one partition."""
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))).select(column, "n", (F.col("n") / F.col("total")).alias("share"))


def match_histogram(spine: DataFrame, truth: DataFrame, most: int = 15) -> DataFrame:
    """(matches, entities) for the smallest ``most`` numbers of matches."""
    n = true_counts(truth).withColumnRenamed("n_true", "matches")
    all_ = spine.select("s1").distinct().join(n, "s1", "left").na.fill(0, ["matches"])
    return all_.groupBy("matches").agg(F.count(F.lit(1)).alias("entities")).orderBy("matches").limit(most)


def frequent_first_words(df: DataFrame, column: str, n: int = 500) -> DataFrame:
    """(word, n): the most frequent first words; ties by word."""
    word = F.split(F.lower(F.trim(F.col(column))), r"\s+").getItem(0)
    return df.select(word.alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(n)


def largest(n: DataFrame, least: int = 10, most: int = 500) -> DataFrame:
    """(s1, n_pred) of the entities with at least ``least`` predictions, the ``most`` largest; ties by id."""
    return n.where(F.col("n_pred") >= least).select("s1", "n_pred").orderBy(F.col("n_pred").desc(), "s1").limit(most)


def retrieval_loss(spine: DataFrame, ranked: dict[str, DataFrame], truth: DataFrame, ks: list[int]) -> DataFrame:
    """(mode, k, pairs, hits, pair_recall): rankings by name, such as three cap modes, each at every K."""
    out = None
    for mode, df in ranked.items():
        part = k_sweep(spine, df, truth, ks).select(F.lit(mode).alias("mode"), "k", "pairs", "hits", "pair_recall")
        out = part if out is None else out.unionByName(part)
    return out


def throughput(stages: dict[str, Callable[[], DataFrame]], units: dict[str, int] | None = None) -> list[dict]:
    """Runs the stages one after the other and gives stage, seconds, rows and rows (or the stage's units) a second; rows are counted, not kept."""
    import time

    out = []
    for name, make in stages.items():
        began = time.perf_counter()
        rows = make().count()
        seconds = time.perf_counter() - began
        out.append({"stage": name, "seconds": seconds, "rows": rows, "per_second": (units or {}).get(name, rows) / max(seconds, 1e-9)})
    return out
