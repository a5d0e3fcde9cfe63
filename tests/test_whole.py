"""Queries that once read less than the whole record."""

import math

from pyspark.sql import functions as F

from weftlink.functions import udfs
from weftlink.plans import queries
from weftlink.plans.queries import QUERIES


def corpus(spark, path, rows):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(rows)], "doc_id long, text string, lang string")
    df.coalesce(1).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


def test_features_core_reads_whole_addresses_and_caps_at_60(spark, tmp_path):
    rows = ["Rarename Trading\nfirst line\nLondon 75001", "Rarename Trading\nfirst line\nParis 99999"]
    rows += [f"Sharedword own{i}" for i in range(30)]
    got = {(r["s1"], r["cid"]): r for r in QUERIES["features_core"](spark, corpus(spark, tmp_path, rows)).collect()}
    pair = got["0", "1"]
    assert math.isclose(pair["f07"], 0.333333) and pair["f08"] == 0 and pair["f09"] == 0
    assert ("2", "31") in got


def test_monge_elkan_reads_whole_names(spark, tmp_path):
    pad = " ".join(["padding"] * 20)
    got = {(r["s1"], r["cid"]): r["sim"] for r in QUERIES["sim_monge_elkan"](spark, corpus(spark, tmp_path, [f"{pad} xxxx", f"{pad} zzzz"])).collect()}
    assert got["0", "1"] == round(20 / 21, 6)


def test_gbt_match_predicts_all_candidates_and_knows_all_copies(spark, tmp_path, monkeypatch):
    class Stub:
        @classmethod
        def fit(cls, data, rounds, depth, **more):
            assert rounds >= 250 and depth >= 6
            return cls()

        def predict(self, data):
            return data.withColumn("p", F.lit(1.0))

    monkeypatch.setattr(queries, "Matcher", Stub)
    rows = ["Copied Words", "copied words", "COPIED words!"] + [f"Sharedword own{i}" for i in range(30)]
    got = {(r["s1"], r["cid"]): r["label"] for r in QUERIES["gbt_match"](spark, corpus(spark, tmp_path, rows)).collect()}
    assert [got[a, b] for a, b in (("0", "1"), ("0", "2"), ("1", "2"), ("2", "1"))] == [1] * 4
    assert got["3", "32"] == 0 and len(got) == 6 + 30 * 29


def test_kernels_equal_plain_forms():
    texts = ["", "a", "alpha beta", "beta alpha gamma", "alpah betta", "aab abab baa", "gamma"]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        return row[-1]

    def mean(x, y):
        s, t = x.split(), y.split()
        return sum(max(2 * lcs(p, q) / (len(p) + len(q)) for q in t) for p in s) / len(s) if s and t else 0.0

    for a in texts:
        for b in texts:
            assert udfs.lcs_length(a, b) == lcs(a, b)
            assert math.isclose(udfs.monge_elkan_of(a, b), mean(a, b), abs_tol=1e-12)
