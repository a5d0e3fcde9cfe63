"""Operators as pipeline stages: documents in, documents out, all columns kept.

For every stage: a null text is the empty one, a null doc_id a value of its own;
texts are read whole, whatever their length; other columns, whatever their
names, travel in one struct and meet none of the stage's own; an empty table
gives an empty table of the same columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm import common, neardup, packing, quality, substrings

#: Names that no input column has.
ROW, KEY, HASH, SPANS = "__row", "__key", "__hash", "__spans"
#: Words of a shingle, and the least similarity in per cent, of a near duplicate.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no rule rejects, as they came; repeated rows are judged alike, so all of them stay or go."""
    return quality.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, that of the least (doc_id, hash of the text); rows without words stay.

    Rows are judged by their texts, so rows with one doc_id and different texts
    stand for themselves.  Of rows equal in id and text the one with the least
    hash of all its columns stays.
    """
    found = neardup.near_duplicates(docs, PERCENT, SHINGLE)
    stays = F.col("n_shingles").isNull() | (F.col("n_shingles") == 0) | ((F.col("doc_id") == F.col("component_id")) & (F.col("row_hash") == F.col("least_hash")))
    kept = common.saved(found.where(stays).groupBy("doc_id", "row_hash").agg(F.when(F.max("n_shingles") > 0, F.count(F.lit(1))).otherwise(1).alias("rows")), "kept")
    common.dropped(found)
    columns = docs.columns
    keyed = docs.select(F.struct(*columns).alias(ROW), F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID)).alias(KEY), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(HASH))
    left = keyed.join(kept.select(F.col("doc_id").alias(KEY), F.col("row_hash").alias(HASH), "rows").hint("shuffle_hash"), [KEY, HASH])
    once = left.where("rows = 1").select(f"{ROW}.*")
    if kept.where("rows > 1").isEmpty():
        return once
    several = left.where("rows > 1").groupBy(KEY, HASH).agg(F.min_by(ROW, F.xxhash64(F.to_json(ROW))).alias(ROW)).select(f"{ROW}.*")
    return once.unionByName(several)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, the texts without the words of repeated windows; n_chars, where there is one, is the new text's.

    Rows with one doc_id are no reference for each other, so repeated rows keep
    their words; a text that is removed whole becomes the empty text.
    """
    spans = substrings.duplicate_spans(docs).select(F.col("doc_id").alias(KEY), F.col("row_hash").alias(HASH), F.col("spans").alias(SPANS))
    keyed = docs.select(F.struct(*docs.columns).alias(ROW), F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID)).alias(KEY), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(HASH))
    joined = keyed.join(spans, [KEY, HASH], "left").select(ROW, SPANS)
    text_at, columns = docs.columns.index("text"), docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).flatten()
            texts = [substrings.cut_text(t, s) if s else t for t, s in zip(own[text_at].to_pylist(), b.column(1).to_pylist())]
            own[text_at] = pa.array(texts, own[text_at].type)
            yield pa.RecordBatch.from_arrays(own, names=columns)

    out = joined.mapInArrow(cut, docs.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences.

    Repeated rows are pieces of their own; pieces equal in length go by doc_id,
    then by their number.  The columns of documents end here.
    """
    return packing.pack(docs)
