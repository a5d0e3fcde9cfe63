import gzip
import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlink.functions import udfs
from weftlink.operators import blocking, diagnostics, metrics, sampling, scoring, tuning
from weftlink.operators.boosting import Boosted
from weftlink.operators.model import Matcher
from weftlink.plans.presets import PRESETS
from weftlink.plans.resolve import resolve
from weftlink.settings import Settings
from weftlink.sources import readers, writers

# Boolean rules against a plain run -------------------------------------------------

SIDE = "struct<id:string,clean_name:string,alpha:string,domain:string,indic:boolean,state:string,specific:array<string>,digits:array<string>,name_tokens:array<string>,addr_tokens:array<string>>"


def record(r, i):
    words = r.sample(["alpha", "medical", "center", "metro", "works", "alphamed"], r.randint(0, 3))
    name = " ".join(words)
    alpha = "".join(words) + r.choice(["", "", "x", "xy"])
    digits, specific = r.sample(["123", "999", "7"], r.randint(0, 2)), r.sample(["health", "dallas", "oak"], r.randint(0, 3))
    return (str(i), name, alpha, r.choice(["", "", "alpha", "alphamed", "medic", "alphamedical", alpha]), r.random() < 0.1, r.choice(["", "tx", "tx", "oh"]), specific, digits, words, specific + digits)


def plain_rules(a, b, rules):
    """The rules, one pair at a time."""
    _, n1, a1, d1, i1, s1, p1, g1, t1, _ = a
    _, n2, a2, d2, i2, s2, p2, g2, t2, _ = b
    if s1 and s2 and s1 != s2:
        return False
    common, digits = len({*p1} & {*p2}), bool({*g1} & {*g2})
    against = bool(g1 and g2 and not digits)
    if a1 and a1 == a2 and (not against or (rules.equal_backed and common)):
        return True
    if a1 and a2 and a1 != a2 and min(len(a1), len(a2)) >= 8 and abs(len(a1) - len(a2)) <= rules.gap and (a1 in a2 or a2 in a1) and not against:
        return True
    for d, x in ((d2, a1), (d1, a2)):
        if len(d) >= rules.stem and (d == x or (len(d) >= 8 and (d in x or x in d))) and not against:
            return True
    jw = udfs.jaro_winkler_of(n1, n2, 50, "any") if n1 and n2 else 0.0
    shared, fewest = len({*t1} & {*t2}), min(len(t1), len(t2))
    backed = not p1 or not p2 or common >= 1 or digits
    if against:
        return False
    if jw >= rules.high and (backed or jw >= 0.98) or jw >= rules.contained and fewest >= 2 and shared >= fewest and backed:
        return True
    return (common >= 2 or (common >= 1 and digits)) and (i1 or i2 or jw >= rules.address or shared >= 1)


@pytest.mark.parametrize("name", ["production", "optimised", "strict"])
def test_rules_equal_a_plain_run(spark, name):
    r = random.Random(8)
    rows = [(record(r, 2 * i), record(r, 2 * i + 1)) for i in range(1500)]
    df = scoring.with_kernels(spark.createDataFrame(rows, f"l {SIDE}, r {SIDE}"), 50, "any")
    got = {(x["a"], x["b"]) for x in df.where(scoring.boolean_rules(scoring.RULES[name])).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).collect()}
    want = {(a[0], b[0]) for a, b in rows if plain_rules(a, b, scoring.RULES[name])}
    assert got == want and 50 < len(want) < 1450


def test_strict_rejects_conflicting_numbers(spark):
    s1 = spark.createDataFrame([("S1-1", "Alpha Medical Center", "123 Health Ave, Dallas", "US")], readers.ENTITY)
    s2 = spark.createDataFrame([("S2-1", "Alpha Medical Center", "999 Health Ave, Dallas", "US"), ("S2-2", "Alpha Medical Center", "123 Health Ave, Dallas", "US")], readers.ENTITY)
    found = lambda preset: {r["cid"] for r in resolve(s1, s2, preset).collect()}
    assert found("strict") == {"S2-2"}
    assert found("optimised") == {"S2-1", "S2-2"}


# Models ------------------------------------------------------------------------------


def test_boosted_trees_learn_and_travel():
    r = np.random.default_rng(3)
    x = r.random((3000, 6))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4) | (x[:, 2] > 0.9)).astype(float)
    m = Boosted.fit(x[:2000], y[:2000], np.ones(2000), 60, 4, 0.2)
    assert ((m.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert (m.predict(x) == Boosted.from_json(m.to_json()).predict(x)).all()
    assert (m.predict(x) == Boosted.fit(x[:2000], y[:2000], np.ones(2000), 60, 4, 0.2).predict(x)).all()
    assert m.gains[:3].min() > m.gains[3:].max()
    same = Boosted.fit(x[:10], np.ones(10), np.ones(10), 3, 2, 0.1)
    assert (same.predict(x) > 0.9).all()


def test_matcher_saves_scores_and_serves_presets(spark, tmp_path):
    from weftlink.operators import features
    from weftlink.plans.resolve import ranked_candidates

    s1 = spark.createDataFrame([("S1-1", "Alpha Medical Center", "123 Health Ave, Dallas, TX 75001", "US"), ("S1-2", "Beta Works", "9 Oak St, Austin, TX", "US")], readers.ENTITY)
    s2 = spark.createDataFrame([("S2-1", "Alpha Medical Center", "123 Health Ave Dallas TX 75001", "US"), ("S2-2", "Alpha Other", "5 Elm Rd, Dallas, TX", "US"), ("S3-1", "Beta Works Inc", "9 Oak Street, Austin, TX", "US"), ("S3-2", "Beta Nothing", "77 Far Rd, Waco, TX", "US")], readers.ENTITY)
    for preset in ("core", "full", "challenger_hybrid"):
        kind = "core" if preset == "core" else "unified"
        p = PRESETS[preset]
        pairs = ranked_candidates(s1, s2, p)
        data = features.extract(pairs, kind).withColumn("label", F.col("cid").isin("S2-1", "S3-1").cast("int"))
        data = data.unionByName(data.withColumn("s1", F.concat("s1", F.lit("x"))))
        m = Matcher.fit(data, rounds=40, depth=2, kind=kind)
        m.threshold = 0.4
        m.save(spark, str(tmp_path / preset))
        back = Matcher.load(spark, str(tmp_path / preset))
        assert back.threshold == 0.4 and back.kind == kind and back.importances() == m.importances()
        got = {(r["s1"], r["cid"]) for r in resolve(s1, s2, preset, back).collect()}
        assert ("S1-1", "S2-1") in got and ("S1-1", "S2-2") not in got
    with pytest.raises(ValueError):
        resolve(s1, s2, "core")


# Truth in classes ----------------------------------------------------------------------


def test_classes_count_as_their_pairs(spark):
    r = random.Random(2)
    ids = [str(i) for i in range(30)]
    kind = {i: r.choice(["a", "b", "c", "d", None, f"own{i}"]) for i in ids}
    classes = spark.createDataFrame(list(kind.items()), "id string, class string")
    listed = spark.createDataFrame([(a, b) for a in ids for b in ids if a != b and kind[a] and kind[a] == kind[b]], "s1 string, cid string")
    spine = spark.createDataFrame([(i,) for i in ids], "s1 string")
    scored = spark.createDataFrame([(a, b, r.random()) for a in ids for b in r.sample(ids, 8)], "s1 string, cid string, score double").where("s1 <> cid")
    rows = lambda df: sorted(map(tuple, df.collect()))
    near = lambda a, b: all(len(x) == len(y) and all(p == q if isinstance(p, str) else abs(p - q) < 1e-9 for p, q in zip(x, y)) for x, y in zip(rows(a), rows(b))) and len(rows(a)) == len(rows(b))
    assert near(metrics.macro(spine, scored, classes), metrics.macro(spine, scored, listed))
    taus = tuning.steps(0.0, 1.0, 0.05)
    curve = tuning.threshold_curve(spine, scored, classes, taus)
    assert near(curve, tuning.threshold_curve(spine, scored, listed, taus))
    for row in curve.where("tau in (0.25, 0.7)").collect():
        m = metrics.macro(spine, scored.where(F.col("score") >= row["tau"]), listed).first()
        assert abs(m["macro_f05"] - row["macro_f05"]) < 1e-9 and abs(m["singleton_accuracy"] - row["singleton_accuracy"]) < 1e-9
    kept = blocking.ranked(scored, 3, "score")
    stages = [diagnostics.failure_stages(t, scored, kept, scored, kept.where("score > 0.6"), 0.6) for t in (classes, listed)]
    assert near(*stages)
    good = scored.where("score > 0.5")
    by_class = {x["s1"]: x["n"] for x in diagnostics.wrong_pairs(good, classes).where("error = 'missed'").collect()}
    by_pair = {x["s1"]: x["n"] for x in diagnostics.wrong_pairs(good, listed).where("error = 'missed'").groupBy("s1").agg(F.sum("n").alias("n")).collect()}
    assert by_class == by_pair
    told = diagnostics.wrong_pairs(good, listed, scored)
    assert told.where("error = 'false' and not retrieved").count() == 0


def test_gates_fine_search_and_throughput(spark):
    better, worse = {"macro_f05": 0.80, "singleton_accuracy": 0.95}, {"macro_f05": 0.85, "singleton_accuracy": 0.93}
    assert tuning.Gate().passes(better, worse)[0]
    assert not tuning.Gate().passes(better, {**worse, "singleton_accuracy": 0.8})[0]
    assert not tuning.Gate().passes(better, better)[0] and not tuning.Gate().passes(better, worse, valid=False)[0]
    assert tuning.SecondGate().passes(better, worse) == (False, "singletons lost")
    assert tuning.SecondGate().passes(better, {**worse, "singleton_accuracy": 0.945}) == (True, "promoted")
    spine = spark.createDataFrame([("a",), ("b",)], "s1 string")
    scored = spark.createDataFrame([("a", "x", 0.613), ("a", "y", 0.59), ("b", "z", 0.4)], "s1 string, cid string, score double")
    truth = spark.createDataFrame([("a", "x")], "s1 string, cid string")
    assert 0.59 < tuning.coarse_to_fine(spine, scored, truth).first()["tau"] <= 0.613
    curve = tuning.threshold_curve(spine, scored, truth, [0.3, 0.5, 0.6])
    assert tuning.nearest(curve, 0.602).first()["tau"] == 0.6 and tuning.nearest(curve, 0.55).first() is None
    assert [r["tau"] for r in tuning.sorted_configs(curve, ["tau"]).collect()][0] == 0.6
    done = diagnostics.throughput({"load": lambda: spine, "score": lambda: scored}, {"score": 30})
    assert [(d["stage"], d["rows"]) for d in done] == [("load", 2), ("score", 3)] and all(d["per_second"] > 0 for d in done)


def test_splits_that_share_ids(spark):
    of = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert sampling.overlapping({"train": of("a", "b"), "test": of("c")}, "id") == []
    assert sampling.overlapping({"train": of("a", "b"), "test": of("c", "b", "b"), "more": of("b")}, "id") == [("train", "test", 1), ("train", "more", 1), ("test", "more", 1)]


# Files -----------------------------------------------------------------------------------


def test_readers_of_odd_files(spark, tmp_path):
    p = tmp_path / "a.tsv.gz"
    with gzip.open(p, "wb") as f:
        f.write('entity_id\tname\tx\nS1-1\t"quoted name\t \nS1-2\tbad \xff'.encode("latin-1") + b" byte\ty\nshort\nentity_id\tthe same id as the header's\tz\n")
    got = readers.tsv_by_position(spark, str(p), ["entity_id", "name"]).collect()
    assert [tuple(r) for r in got] == [("S1-1", '"quoted name'), ("S1-2", "bad  byte"), ("entity_id", "the same id as the header's")]
    q = tmp_path / "q.tsv"
    q.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"a\tb"\tx\tUS\nS1-2\t\t\tFR\n')
    assert [tuple(r) for r in readers.tsv(spark, str(q), quoted=True).collect()] == [("S1-1", "a\tb", "x", "US"), ("S1-2", "", "", "FR")]
    (tmp_path / "m.json").write_text(json.dumps({"split": 1, "s1_entity_ids": ["S1-1", "S1-9"]}, indent=1))
    assert sorted(r["entity_id"] for r in readers.manifest(spark, str(tmp_path / "m.json")).collect()) == ["S1-1", "S1-9"]
    (tmp_path / "s.json").write_text('{"tau": 0.5}')
    assert readers.settings(spark, str(tmp_path / "s.json")) == {"tau": 0.5}
    (tmp_path / "big.bin").write_bytes(b"0123456789" * 10)
    r = readers.fingerprint(spark, f"file://{tmp_path}/big.bin", 25).first()
    assert r["size"] == 100 and r["sha256"] == hashlib.sha256((b"0123456789" * 3)[:25]).hexdigest()


def test_reports_packages_logs_and_settings(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "name string, n int")
    for kind in ("csv", "json", "md"):
        writers.report(df, str(tmp_path / kind), kind)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "md")).collect()] == ["| name | n |", "|---|---|", "| a\\|b | 1 |", "|  | 2 |"]
    assert spark.read.json(str(tmp_path / "json")).count() == 2 and spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "x.py").write_text("1")
    (tmp_path / "code" / ".hidden").write_text("1")
    (tmp_path / "out.tsv").write_text("1")
    assert writers.package({"output.tsv": str(tmp_path / "out.tsv"), "code": str(tmp_path / "code")}, str(tmp_path / "p.zip")) == ["code/x.py", "output.tsv"]
    log = str(tmp_path / "log")
    writers.log_run(spark, log, "one", "running", preset="core")
    writers.log_run(spark, log, "one", "done", rows=3)
    writers.log_run(spark, log, "two", "running")
    assert [(r["run_id"], r["status"]) for r in writers.runs(spark, log).collect()] == [("one", "done"), ("two", "running")]
    assert writers.runs(spark, log, "one").first()["status"] == "done"
    s = spark.createDataFrame([("S1-1", "n", "a", "US")], readers.ENTITY)
    pool = spark.createDataFrame([("S2-1", "n", "a", "US"), ("S3-1", "n ", "a", "US")], readers.ENTITY)
    writers.diagnostic_set(s, pool, spark.createDataFrame([("S1-1", "S2-1,S3-1")], readers.TRUTH), str(tmp_path / "d"))
    assert [r["entity_id"] for r in readers.tsv(spark, str(tmp_path / "d" / "source3")).collect()] == ["S3-1"]
    assert readers.pairs(readers.tsv(spark, str(tmp_path / "d" / "ground_truth"), readers.TRUTH)).count() == 2
    assert Settings.load({}) == Settings() and Settings.load({"WEFTLINK_CANDIDATES": "100", "WEFTLINK_DATA": "/x"}) == Settings(data="/x", candidates=100)
