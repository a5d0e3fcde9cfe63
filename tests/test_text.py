import pytest
from pyspark.sql import functions as F

from weftlink.functions import text, udfs


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("expression", "value", "wanted"),
    [
        (text.joined, "Café & Bakery Co., L.L.C. — Suite #104", "cafe bakery co llc suite 104"),
        (text.contract_name, "Reliance Logistics Private Limited", "reliance logistics pvt ltd"),
        (text.contract_name, "Café de la République S.A.R.L.", "cafe de la republique sarl"),
        (text.contract_address, "Plot 42, Sector 18, MG Marg", "plot 42 sec 18 mg mg"),
        (text.strip_noise, ">> Acme Pvt. Ltd.", "acme"),
        (text.plain, "A&B  Café", "a and b caf"),
        (text.spaced, " A-&B ", "a  b"),
        (text.alpha_stripped, "Acme Solutions Inc", "acmesolutions"),
        (text.domain_stem, "see My-Shop.com now", "myshop"),
        (text.postal, "12 Main 75001 x 400051", "75001"),
        (text.street_not_postal, "75001 paris 14 rue", "14"),
        (text.plain, None, ""),
        (text.plain, "", ""),
    ],
)
def test_normalisers(spark, expression, value, wanted):
    assert one(spark, value, expression) == wanted


def test_states(spark):
    rows = [("austin tx 78701", "US", "tx"), ("west virginia", "US", "va"), ("bkc mumbai mh 400051", "India", "mh"), ("paris", "France", "")]
    df = spark.createDataFrame([r[:2] for r in rows], "a string, c string")
    got = df.select(text.state_first(F.col("a"), F.col("c")).alias("s"), text.state_near_end(F.col("a"), F.col("c")).alias("e"), text.state_longest(F.col("a"), F.col("c")).alias("l")).collect()
    assert [r["s"] for r in got] == [r[2] for r in rows]
    assert got[0]["e"] == "tx" and got[1]["l"] == "wv"


def test_tokens_and_ngrams(spark):
    assert one(spark, "the acme of acme", text.name_tokens) == ["acme"]
    assert one(spark, "ab cd", lambda c: text.ngrams(c, 3)) == ["ab_", "b_c", "_cd"]
    assert one(spark, "ab", lambda c: text.ngram_set(c, 3)) == []
    assert one(spark, "ab", lambda c: text.ngram_set(c, 3, short=True)) == ["ab"]
    assert one(spark, "main st", text.expanded) == ["main", "street"]


@pytest.mark.parametrize(
    ("a", "b", "run", "any_", "lcs"),
    [("martha", "marhta", 0.961111, 0.961111, 0.833333), ("abxd", "abyd", 0.866667, 0.883333, 0.75), ("bda bdd bcb", "bdcad abcac", 0.748918, 0.748918, 0.636364), ("techcorp solutions", "techcorp sol inc", 0.930556, 0.930556, 0.823529), ("ab", "ba", 0, 0, 0.5)],
)
def test_kernels(spark, a, b, run, any_, lcs):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    r = df.select(udfs.jaro_winkler(F.col("a"), F.col("b")).alias("x"), udfs.jaro_winkler(F.col("a"), F.col("b"), 40, "any").alias("y"), udfs.lcs_ratio(F.col("a"), F.col("b")).alias("z")).first()
    assert (round(r["x"], 6), round(r["y"], 6), round(r["z"], 6)) == (run, any_, lcs)
