"""Sets of words as numbers of few bytes: places of frequent words, hashes of the others.

What a set holds, and how often, is kept, its order is not.  Which words count
as frequent changes the bytes only, never an overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words with a place of two bytes; there is one list of them for a table.
PLACES = 1 << 16
PACKED = T.StructType([T.StructField("places", T.ArrayType(T.ShortType(), False)), T.StructField("hashes", T.ArrayType(T.LongType(), False))])


def frequent(df: DataFrame, columns: list[str]) -> list[str]:
    """The words that most sets of these columns hold, the most frequent first."""
    each = F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in columns))
    counts = df.select(F.explode(each).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND word IS NOT NULL")
    return [r["word"] for r in counts.orderBy(F.col("n").desc(), "word").limit(PLACES).collect()]


def packed(sets: Column, words: list[str]) -> Column:
    @F.arrow_udf(PACKED)
    def pack(sets: pa.Array) -> pa.Array:
        import xxhash

        none = sets.is_null()
        sizes = pc.fill_null(pc.list_value_length(sets), 0).to_numpy(zero_copy_only=False)
        row, flat = np.repeat(np.arange(len(sets)), sizes), sets.flatten()
        place = pc.fill_null(pc.index_in(flat, value_set=pa.array(words, flat.type)), -1).to_numpy(zero_copy_only=False)
        has = place >= 0
        rest = np.fromiter((xxhash.xxh64_intdigest((w or "").encode("utf-8", "surrogatepass")) - 2**63 for w in flat.filter(pa.array(~has)).to_pylist()), np.int64)

        def lists(of: np.ndarray, values: np.ndarray) -> pa.Array:
            ends = np.cumsum(np.bincount(row[of], minlength=len(sets)))
            return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values))

        return pa.StructArray.from_arrays([lists(has, (place[has] - PLACES // 2).astype(np.int16)), lists(~has, rest)], ["places", "hashes"], mask=none)

    return pack(sets)


def opened(c: Column) -> Column:
    """The numbers of a packed set, without a UDF: these forget how rows were dealt out."""
    return F.when(c.isNotNull(), F.concat(F.transform(c["places"], lambda x: x.cast("long")), c["hashes"]))
