"""Checks of a result file against the records it speaks of; each gives a DataFrame of findings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.sources.readers import id_list


def header(spark: SparkSession, path: str, wanted: list[str]) -> list[str]:
    """What is wrong with the first line (nothing: an empty list)."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0]["value"] if first else ""
    if "\t" not in line and "," in line:
        return ["the file is separated by commas"]
    found = [x.strip().lower() for x in line.split("\t")]
    return [] if found == [w.lower() for w in wanted] else [f"header {found} is not {wanted}"]


def malformed(lines: DataFrame) -> DataFrame:
    """Rows of (row_idx, value) without a tab."""
    return lines.where((F.instr("value", "\t") == 0) & (F.trim("value") != ""))


def duplicate_rows(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_ids(rows: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """Entities whose list names an id twice."""
    ids = id_list(list_col)
    return rows.select(id_col, (F.size(ids) - F.size(F.array_distinct(ids))).alias("extra")).where("extra > 0")


def bad_ids(rows: DataFrame, id_col: str, list_col: str, valid: DataFrame | None = None) -> DataFrame:
    """(id, cid, problem): ids of the reference source, with a wrong prefix, or unknown."""
    each = rows.select(F.col(id_col), F.explode(id_list(list_col)).alias("cid"))
    problem = F.when(F.startswith("cid", F.lit("S1-")), "self match").when(~(F.startswith("cid", F.lit("S2-")) | F.startswith("cid", F.lit("S3-"))), "wrong prefix")
    if valid is not None:
        known = valid.select("cid").distinct().withColumn("known", F.lit(1))
        each = each.join(known, "cid", "left")
        problem = F.coalesce(problem, F.when(F.col("known").isNull(), "unknown id"))
    return each.select(id_col, "cid", problem.alias("problem")).where(F.col("problem").isNotNull())


def missing(rows: DataFrame, required: DataFrame, id_col: str) -> DataFrame:
    return required.select(id_col).distinct().join(rows, id_col, "left_anti")


def extra(rows: DataFrame, required: DataFrame, id_col: str) -> DataFrame:
    return rows.select(id_col).distinct().join(required, id_col, "left_anti")


def not_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matched (s1, cid) that no candidate row has."""
    return matches.select("s1", "cid").distinct().join(candidates, ["s1", "cid"], "left_anti")


def misaligned(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """Rows of two files whose ids at the same line differ, or that one file lacks."""
    x = a.select("row_idx", F.col(id_col).alias("left_id"))
    y = b.select("row_idx", F.col(id_col).alias("right_id"))
    return x.join(y, "row_idx", "full").where(~F.col("left_id").eqNullSafe(F.col("right_id")))


def first_examples(findings: DataFrame, column: str, n: int = 5) -> DataFrame:
    """(total, examples): the number of findings and the first n values in order, without gathering the rest."""
    top = findings.select(column).distinct().orderBy(column).limit(n).agg(F.array_sort(F.collect_list(column)).alias("examples"))
    return findings.agg(F.count(F.lit(1)).alias("total")).crossJoin(F.broadcast(top))


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    stats: dict = field(default_factory=dict)

    @property
    def valid(self) -> bool:
        return not self.errors


def validate(matches: DataFrame, candidates: DataFrame | None, required: DataFrame, valid_ids: DataFrame | None = None, strict_subset: bool = False) -> Report:
    """All checks on matching_results (and candidate_pairs) rows; only counts and a few examples reach the driver."""
    out = Report()
    tables = [("matching_results", matches, "matched_entity_ids")] + ([("candidate_pairs", candidates, "candidate_entity_ids")] if candidates is not None else [])
    for name, rows, ids in tables:
        found = {
            "duplicate rows": (duplicate_rows(rows, "source1_entity_id"), "source1_entity_id"),
            "duplicate ids in a list": (duplicate_ids(rows, "source1_entity_id", ids), "source1_entity_id"),
            "bad ids": (bad_ids(rows, "source1_entity_id", ids, valid_ids), "cid"),
            "missing entities": (missing(rows, required, "source1_entity_id"), "source1_entity_id"),
            "extra entities": (extra(rows, required, "source1_entity_id"), "source1_entity_id"),
        }
        for what, (df, column) in found.items():
            r = first_examples(df, column).first()
            if r["total"]:
                out.errors.append(f"{name}: {r['total']} {what}, such as {r['examples']}")
        out.stats[f"{name}_rows"] = rows.count()
    if candidates is not None:
        to = lambda df, ids: df.select(F.col("source1_entity_id").alias("s1"), F.explode(id_list(ids)).alias("cid"))
        r = first_examples(not_candidates(to(matches, "matched_entity_ids"), to(candidates, "candidate_entity_ids")), "s1").first()
        if r["total"]:
            (out.errors if strict_subset else out.warnings).append(f"{r['total']} matches are no candidates, such as {r['examples']}")
    return out
