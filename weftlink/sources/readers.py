"""Reading records, truth, predictions, manifests and checkpoints."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"


def tsv(spark: SparkSession, path: str, schema: str = ENTITY, quoted: bool = False, header: bool = True) -> DataFrame:
    """A tab-separated file; everything is a string and missing is "".  Unquoted reading takes quotes as they stand; .gz works too."""
    options = {"sep": "\t", "header": str(header).lower(), "mode": "DROPMALFORMED", "enforceSchema": "true"}
    df = spark.read.options(**options).option("quote", '"' if quoted else "").schema(schema).csv(path)
    return df.na.fill("")


def tsv_by_position(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> DataFrame:
    """Lines split at tabs; lines with fewer fields than columns are left out, as are lines that say what the first one (the header) says; bytes that are no UTF-8 are dropped."""
    lines = spark.read.text(path)
    head = lines.limit(1).collect() if header else []
    if head:
        lines = lines.where(F.col("value") != F.lit(head[0]["value"]))
    clean = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")))
    parts = F.split(clean, "\t", -1)
    return lines.where(F.size(parts) >= len(columns)).select(*(F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)))


def tsv_by_header(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """Columns by their names in the header, by position where a name is missing."""
    df = spark.read.options(sep="\t", header="true", quote="", mode="DROPMALFORMED").csv(path)
    names = df.columns
    return df.select(*(F.coalesce(F.col(f"`{w if w in names else names[i]}`"), F.lit("")).alias(w) for i, w in enumerate(wanted)))


def with_order(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Adds row_idx: file order, or the given key's own order where there is one integer key."""
    if order and len(order) == 1 and dict(df.dtypes)[order[0]] in ("int", "bigint"):
        return df.withColumn("row_idx", F.col(order[0]).cast("long"))
    return df.withColumn("row_idx", F.monotonically_increasing_id())


def id_list(c: Column | str, trim: bool = True) -> Column:
    """The ids of a comma list; empty ones are left out."""
    ids = F.split(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), ",")
    ids = F.transform(ids, lambda x: F.trim(x)) if trim else ids
    return F.filter(ids, lambda x: x != "")


def pairs(df: DataFrame, id_col: str = "source1_entity_id", list_col: str = "matched_entity_ids", trim: bool = True) -> DataFrame:
    """(s1, cid) of a file with one comma list for each entity."""
    return df.select(F.col(id_col).alias("s1"), F.explode(id_list(list_col, trim)).alias("cid"))


def ids_only(df: DataFrame, id_col: str) -> DataFrame:
    """Distinct trimmed ids, blank ones left out; only this column is read."""
    return df.select(F.trim(F.col(id_col)).alias(id_col)).where(F.col(id_col) != "").distinct()


def candidate_pool(records: DataFrame, needed: DataFrame, id_col: str, order: str, n: int, by: list[str] | None = None) -> DataFrame:
    """All needed records and the first n others in order (for each of ``by``)."""
    others = records.join(needed.select(id_col).distinct(), id_col, "left_anti")
    if by:
        from weftlink.operators.sampling import first_n

        rest = first_n(others, by, [order, id_col], n)
    else:
        rest = others.orderBy(order, id_col).limit(n)
    return records.join(needed.select(id_col).distinct(), id_col, "left_semi").unionByName(rest.select(*records.columns))


def entity(records: list[DataFrame], entity_id: str, id_col: str = "entity_id") -> DataFrame:
    """The first table's row with the id, else the next one's."""
    tagged = [r.where(F.col(id_col) == entity_id).withColumn("_table", F.lit(i)) for i, r in enumerate(records)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.orderBy("_table").limit(1).drop("_table")


def by_country(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Writes the records once, partitioned by country, and reads them back: a country's rows are then a partition filter."""
    df.write.mode("overwrite").partitionBy("country").parquet(path)
    return spark.read.parquet(path)


def unfinished(records: DataFrame, done: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """Records without a row in the checkpoint."""
    return records.join(done.select(id_col).distinct(), id_col, "left_anti")


def manifest(spark: SparkSession, path: str, key: str = "s1_entity_ids") -> DataFrame:
    """The id list of a JSON manifest."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode(key).alias("entity_id"))


def settings(spark: SparkSession, path: str) -> dict:
    """A small JSON object."""
    return json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))


def fingerprint(spark: SparkSession, path: str, first: int = 64 << 20) -> DataFrame:
    """(path, size, sha256 of the first bytes) of each file of a path or pattern; no more than these bytes are read."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for status in sorted(fs.globStatus(at) or [], key=lambda s: s.getPath().toString()):
        found = [x for x in fs.listStatus(status.getPath()) if x.isFile()] if status.isDirectory() else [status]
        for f in found:
            stream = fs.open(f.getPath())
            try:
                digest = jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(jvm.org.apache.commons.io.input.BoundedInputStream(stream, first))
            finally:
                stream.close()
            rows.append((f.getPath().toString(), f.getLen(), digest))
    return spark.createDataFrame(rows, "path string, size long, sha256 string")
