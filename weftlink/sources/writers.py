"""Result files: one row for each entity, in input order, ids joined by commas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def id_lists(spine: DataFrame, chosen: DataFrame, out_id: str = "source1_entity_id", out_list: str = "matched_entity_ids") -> DataFrame:
    """Every s1 of the spine (with row_idx) and its cids, best score first, "" if it has none."""
    order = F.struct(-F.col("score"), F.col("cid")) if "score" in chosen.columns else F.struct(F.lit(0.0), F.col("cid"))
    lists = chosen.select("s1", order.alias("o")).groupBy("s1").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda x: x["cid"]), ",").alias(out_list))
    return spine.join(lists, "s1", "left").select(F.col("s1").alias(out_id), F.coalesce(out_list, F.lit("")).alias(out_list), "row_idx")


def write_tsv(df: DataFrame, path: str, order: str = "row_idx", files: int | None = None) -> None:
    """Tab-separated with header, LF, in order; files=1 gives one file."""
    out = df.orderBy(order).drop(order) if order in df.columns else df
    out = out.coalesce(files) if files else out
    out.write.mode("overwrite").options(sep="\t", header="true", emptyValue="", quote="", lineSep="\n", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def append_checkpoint(lists: DataFrame, path: str) -> None:
    """Appends finished entities by country; with readers.unfinished a run resumes where it stopped."""
    lists.write.mode("append").partitionBy("country").parquet(path)


def merged_checkpoint(spark: SparkSession, path: str, spine: DataFrame) -> DataFrame:
    """The checkpoint's rows on the spine, in its order; of an entity finished twice the least row stays."""
    done = spark.read.parquet(path).drop("country")
    rest = [c for c in done.columns if c != "s1"]
    once = done.groupBy("s1").agg(F.min(F.struct(*rest)).alias("r")).select("s1", *(F.col(f"r.{c}").alias(c) for c in rest))
    return spine.join(once, "s1", "left")


def append_log(spark: SparkSession, row: dict, path: str) -> None:
    """Appends one experiment row."""
    spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "entry string").coalesce(1).write.mode("append").text(path)


def report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small result as one file: csv with header, json lines, or a Markdown table."""
    if kind == "md":
        cell = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\|", r"\\|"), F.lit(""))
        rows = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |")).alias("value")).coalesce(1)
        spark = df.sparkSession
        head = spark.createDataFrame([(f"| {' | '.join(df.columns)} |",), (f"|{'---|' * len(df.columns)}",)], "value string").coalesce(1)
        head.union(rows).coalesce(1).write.mode("overwrite").text(path)
    elif kind == "json":
        df.coalesce(1).write.mode("overwrite").json(path)
    else:
        df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def diagnostic_set(s1: DataFrame, pool: DataFrame, lists: DataFrame, path: str) -> None:
    """A sample's four files: source1, source2 and source3 by the pool's id prefixes, and ground_truth."""
    write_tsv(s1.orderBy("entity_id"), f"{path}/source1")
    for n in ("2", "3"):
        write_tsv(pool.where(F.startswith("entity_id", F.lit(f"S{n}-"))).orderBy("entity_id"), f"{path}/source{n}")
    write_tsv(lists.orderBy("source1_entity_id"), f"{path}/ground_truth")


def package(files: dict[str, str], out: str) -> list[str]:
    """Zips local files and folders under the given names; gives the names packed, hidden files and caches left out."""
    import os
    import zipfile

    packed = []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, source in sorted(files.items()):
            found = [(name, source)] if os.path.isfile(source) else [(f"{name}/{os.path.relpath(os.path.join(d, x), source)}", os.path.join(d, x)) for d, _, xs in os.walk(source) for x in xs]
            for inside, path in sorted(found):
                parts = inside.split("/")
                if any(x.startswith((".", "__pycache__")) for x in parts):
                    continue
                z.write(path, inside)
                packed.append(inside)
    return packed


def log_run(spark: SparkSession, path: str, run_id: str, status: str, **more) -> None:
    """Appends a state of a run; the last one of a run is its status."""
    import time

    append_log(spark, {"run_id": run_id, "status": status, "at": time.time(), **more}, path)


def runs(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """(run_id, status, at, entry): the last state of each run, or of one."""
    entry = spark.read.text(path).select(F.col("value").alias("entry"), *(F.get_json_object("value", f"$.{k}").alias(k) for k in ("run_id", "status", "at")))
    entry = entry.withColumn("at", F.col("at").cast("double"))
    entry = entry if run_id is None else entry.where(F.col("run_id") == run_id)
    last = entry.groupBy("run_id").agg(F.max(F.struct("at", "status", "entry")).alias("r"))
    return last.select("run_id", "r.status", "r.at", "r.entry").orderBy("run_id")
