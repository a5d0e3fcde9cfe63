"""A fit reads all labelled rows, in whatever order."""

import numpy as np
from pyspark.sql import functions as F

from test_whole import corpus

from weftlink.operators import model
from weftlink.plans.queries import QUERIES


def labelled(spark, n):
    value = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000
    return spark.range(n).select(F.col("id").cast("string").alias("s1"), F.lit("0").alias("cid"), value.alias("f00"), F.lit(0.0).alias("f01"), (value > 0.7).cast("int").alias("label"))


def test_a_fit_does_not_depend_on_the_order_of_rows(spark):
    data = labelled(spark, 2000)
    alone = model.Matcher.fit(data, ["f00", "f01"], rounds=10, depth=3).model
    assert model.Matcher.fit(data.orderBy(F.xxhash64("s1")), ["f00", "f01"], rounds=10, depth=3).model.to_json() == alone.to_json()
    assert abs(alone.limit[0, 0] - 0.7) < 0.02 and alone.gains[0] > 0 == alone.gains[1]


def test_every_row_is_fitted(spark):
    rows = spark.range(400_000).select(F.lit(0.0).alias("f00"), (F.col("id") % 4 == 0).cast("int").alias("label"), F.lit("a").alias("s1"), F.lit("b").alias("cid"))
    m = model.Matcher.fit(rows, ["f00"], rounds=1, depth=1).model
    assert m.prior == float(np.log(0.25 / 0.75))


def test_features_send_no_whole_address(spark, tmp_path):
    df = QUERIES["features_28d"](spark, corpus(spark, tmp_path, ["Same Name\n" + "road " * 60 + "1", "Same Name\n" + "road " * 60 + "2"]))
    assert "clean_addr" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["s1"], r["cid"]): r for r in df.collect()}
    assert got["0", "1"]["f15"] == got["1", "0"]["f15"] == 1.0 and got["0", "1"]["f17"] == 1.0
