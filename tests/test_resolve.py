import pytest
from pyspark.sql import functions as F

from weftlink.operators import blocking, features, metrics, sampling, scoring, tuning, validate, wordsets
from weftlink.plans import queries
from weftlink.plans.normalise import normalised
from weftlink.plans.presets import PRESETS, Channel
from weftlink.plans.queries import QUERIES
from weftlink.plans.resolve import ranked_candidates, resolve
from weftlink.sources import readers, writers
from weftlink.streaming.incremental import resolve_stream

S1 = [("S1-1", "Alpha Medical Center", "123 Health Ave, Dallas, TX 75001", "US"), ("S1-2", "Tata Consultancy Services", "BKC Bandra Mumbai MH 400051", "India"), ("S1-3", "Nobody Here", "", "US")]
S23 = [
    ("S2-1", "Alpha Med Ctr", "123 Health Avenue, Dallas, TX 75001", "US"), ("S3-1", "Alpha Medical Center", "123 Health Ave Dallas TX 75001", "US"),
    ("S2-2", "Tata Consultancy Services Ltd", "Bandra Kurla Complex Mumbai MH 400051", "India"), ("S3-2", "Alpha Medical Center", "9 Other Rd, Austin, TX 78701", "India"),
    ("S2-3", None, None, "US"),
]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(S1, readers.ENTITY), spark.createDataFrame(S23, readers.ENTITY)


@pytest.mark.parametrize("preset", ["champion", "phase10b", "phase16", "production"])
def test_presets_find_the_same_business(tables, preset):
    got = {(r["s1"], r["cid"]) for r in resolve(*tables, preset).collect()}
    assert ("S1-1", "S3-1") in got
    assert not any(s == "S1-3" for s, _ in got)
    assert ("S1-1", "S3-2") not in got  # never across countries


def test_ranking_keeps_at_most_k(tables):
    n = ranked_candidates(*tables, PRESETS["phase16"]).groupBy("s1").agg(F.max("rn").alias("m")).collect()
    assert n and all(r["m"] <= 100 for r in n)


def test_records_meet_in_cells(spark, monkeypatch):
    """Lists opened where blocks and slices meet give what plain joins give, and pairs with records are not dealt out again."""
    monkeypatch.setattr(blocking, "BLOCK_ROWS", 7)
    rows = [(str(i), [None, [], [f"w{i}", "x"]][i % 3], i) for i in range(40)]
    r = spark.createDataFrame(rows, "id string, words array<string>, n int")
    pairs = spark.createDataFrame([(str(i), str(j), i * j) for i in range(40) for j in range(i % 5, 40, 3)], "s1 string, cid string, w int")
    out = blocking.joined(pairs, r, r, ["id", "words"])
    by = {i: w for i, w, _ in rows}
    got = sorted((x["s1"], x["cid"], x["w"], str(x["l"]["words"]), str(x["r"]["words"])) for x in out.collect())
    assert got == sorted((x["s1"], x["cid"], x["w"], str(by[x["s1"]]), str(by[x["cid"]])) for x in pairs.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan.split("ShuffledHashJoin")[1] and "cid" not in plan.split("ShuffledHashJoin")[1].split("hashpartitioning(")[1].split(")")[0]


def test_lists_hold_all_candidates(spark, monkeypatch):
    """Lists and the pairs met from them are what the joins of postings give, whole or the first by id."""
    monkeypatch.setattr(blocking, "SLIM_ROWS", 6)
    rows = [(str(i), ["US", "India", "", "France"][i % 4], None if i == 9 else [f"w{i % 5}", f"v{i % 3}", "hot"][: i % 4], [f"v{i % 6}"], i) for i in range(60)]
    r = spark.createDataFrame(rows, "id string, country string, words array<string>, more array<string>, n int")
    channels = [Channel("rare", "words", 3, rare=9), Channel("words", "words", 12), Channel("less", "words", 4), Channel("more", "more")]
    want = sorted((x["s1"], x["cid"]) for x in blocking.candidates(r, r, channels).collect())
    other = r.select("*")
    for right in (r, other):
        for k in (None, 2):
            each = blocking.lists(r, right, channels, k)
            out = blocking.met(each, r, right, ["id", "words", "n"], {"twice": lambda x: x["words"]}, place=k is not None).collect()
            first = [p for i, p in enumerate(want) if k is None or sum(q[0] == p[0] for q in want[:i]) < k]
            assert sorted((x["s1"], x["cid"]) for x in out) == first
            assert all(x["l"]["id"] == x["s1"] and x["r"]["id"] == x["cid"] and x["r"]["n"] == int(x["cid"]) for x in out)
            assert all(len(set(x["l"]["words"] or []) & set(x["r"]["words"] or [])) == len(set(rows[int(x["s1"])][2] or []) & set(rows[int(x["cid"])][2] or [])) for x in out)
    broken = spark.createDataFrame([("a\x01b", "US", ["x"]), ("c", "US", ["x"])], "id string, country string, words array<string>")
    with pytest.raises(Exception, match="mark"):
        blocking.lists(broken, broken, [Channel("words", "words")]).collect()


@pytest.mark.parametrize("preset", ["phase8b", "phase10b", "strict", "phase9"])
def test_overlaps_are_computed_once_for_a_pair(tables, preset):
    plan = resolve(*tables, preset)._jdf.queryExecution().optimizedPlan().toString()
    sets = [c for c in scoring.FIELDS[PRESETS[preset].score] if c in scoring.SETS]
    assert plan.count("array_intersect") == len(sets)


def test_caps(spark):
    rows = [(str(i), "US", ["hot", f"k{i % 3}"], i) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, country string, keys array<string>, row_idx long")
    skip, first = Channel("c", "keys", 10), Channel("c", "keys", 10, "first")
    count = lambda c: {r["key"]: r["count"] for r in blocking.capped(blocking.postings(df, [c]), [c]).groupBy("key").count().collect()}
    assert count(skip) == {"k0": 10, "k1": 10, "k2": 10}
    assert count(first) == {"k0": 10, "k1": 10, "k2": 10, "hot": 10}
    kept = blocking.capped(blocking.postings(df, [first]), [first]).where("key = 'hot'").collect()
    assert sorted(int(r["id"]) for r in kept) == list(range(10))


def test_f05(spark):
    spine = spark.createDataFrame([(x,) for x in "abcde"], "s1 string")
    pred = spark.createDataFrame([("a", "A"), ("b", "A"), ("b", "B"), ("d", "x")], "s1 string, cid string")
    true = spark.createDataFrame([("a", "A"), ("a", "B"), ("b", "A"), ("e", "x")], "s1 string, cid string")
    got = {r["s1"]: round(r["f05"], 6) for r in metrics.entity_f05(metrics.counts(spine, pred, true)).collect()}
    assert got == {"a": 0.833333, "b": 0.555556, "c": 1, "d": 0, "e": 0}
    curve = tuning.threshold_curve(spine, pred.withColumn("score", F.lit(0.5)), true, [0.4, 0.6]).orderBy("tau").collect()
    assert round(curve[0]["macro_f05"], 6) == round((0.833333 + 0.555556 + 1) / 5, 6)
    assert round(curve[1]["macro_f05"], 6) == 0.4


def test_features_are_bounded(tables):
    a, b = (normalised(t, "joined") for t in tables)
    p = blocking.joined(a.select("id", "country").crossJoin(b.select(F.col("id").alias("cid"))).select(F.col("id").alias("s1"), "cid"), a, b)
    for r in features.audit(features.extract(p)).collect():
        assert r["bad"] == 0 and r["negative"] == 0
        assert r["greatest"] <= 1 or r["feature"] == "f24"


def test_split_and_quota(spark):
    assert spark.createDataFrame([("S1-925783039",)], "k string").select(sampling.hash_bucket(F.col("k")).alias("b")).first()["b"] == 80
    df = spark.createDataFrame([(i, "ab"[i % 7 == 0]) for i in range(100)], "id long, g string")
    assert sampling.stratified(df, "id", ["g"], 20).count() == 20
    split = sampling.stratified_split(df, "id", ["g"], {"train": 0.7, "validation": 0.15, "test": 0.15}).groupBy("split").count().collect()
    assert sum(r["count"] for r in split) == 100 and len(split) == 3


def test_files_round_trip_and_validate(spark, tables, tmp_path):
    spine = tables[0].select(F.col("entity_id").alias("s1"), F.monotonically_increasing_id().alias("row_idx"))
    chosen = spark.createDataFrame([("S1-1", "S2-1", 0.7), ("S1-1", "S3-1", 0.9)], "s1 string, cid string, score double")
    writers.write_tsv(writers.id_lists(spine, chosen), str(tmp_path / "m"), files=1)
    back = readers.tsv(spark, str(tmp_path / "m"), readers.TRUTH)
    assert [tuple(r) for r in back.collect()] == [("S1-1", "S3-1,S2-1"), ("S1-2", ""), ("S1-3", "")]
    required = spine.select(F.col("s1").alias("source1_entity_id"))
    assert validate.validate(back, None, required).valid
    broken = back.unionByName(back.limit(1)).withColumn("matched_entity_ids", F.concat_ws(",", "matched_entity_ids", F.lit("S1-9")))
    assert len(validate.validate(broken, None, required).errors) == 2


def test_stream_resolves_arriving_records(spark, tables, tmp_path):
    tables[0].coalesce(1).write.parquet(str(tmp_path / "in"))
    q = resolve_stream(spark, str(tmp_path / "in"), tables[1], "champion", str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert ("S1-1", "S3-1") in {(r["s1"], r["cid"]) for r in got.collect()}


def test_block_domain_pairs_pieces_of_a_stem(spark, monkeypatch, tmp_path):
    """Every two rows of a stem, repeated rows as often as in SQL."""
    monkeypatch.setattr(blocking, "CHUNK", 3)
    stems = ["shop", "market", "abc"]
    rows = [(i % 15, f"https://{stems[i % 5 % 3]}.com/{i}") for i in range(20)] + [(30, None), (31, "no stem")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    out = QUERIES["block_domain"](spark, str(tmp_path))
    keyed = [(str(i), u.split("/")[2][:-4]) for i, u in rows if u and u.startswith("http")]
    want = [(a, b) for a, k in keyed for b, m in keyed if k == m and a != b and len(k) >= 4]
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) > len(set(want))


def test_packed_sets_keep_their_overlaps(spark, monkeypatch):
    """Words with and without a place, repeated ones, empty and missing sets."""
    monkeypatch.setattr(wordsets, "PLACES", 4)
    sets = [["a", "b", "c", "d", "e", "é"], ["e", "f", "a", "a"], [], None, ["f", "é", "d", "x"], ["x", "y"]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, s array<string>").coalesce(1)
    words = wordsets.frequent(df, ["s"])
    assert 0 < len(words) <= 4
    got = {r["i"]: r["s"] for r in df.withColumn("p", wordsets.packed(F.col("s"), words)).select("i", wordsets.opened(F.col("p")).alias("s")).collect()}
    assert got[3] is None and got[2] == []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if a is not None and b is not None:
                assert len(got[i]) == len(a) and len(set(got[i]) & set(got[j])) == len(set(a) & set(b))


def test_a_pair_and_its_reverse_meet_once(spark):
    """Records are joined for one of the two only, and give both."""
    rows = [(str(i), "US", ["x", f"w{i % 3}"], i) for i in range(12)]
    out = queries.spread(spark.createDataFrame(rows, "id string, country string, name_tokens array<string>, n int"), ["id", "name_tokens", "n"], ("name_tokens",))
    got = out.collect()
    assert sorted((r["s1"], r["cid"]) for r in got) == sorted((a[0], b[0]) for a in rows for b in rows if a != b)
    assert all(r["l"]["id"] == r["s1"] and r["r"]["n"] == int(r["cid"]) and r["l"]["name_tokens"] == rows[int(r["s1"])][2] for r in got)
    assert all((a["s1"], a["cid"]) == (b["cid"], b["s1"]) for a, b in zip(got[::2], got[1::2]))
