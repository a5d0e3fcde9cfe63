"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are measured on a sample of about
``SAMPLE_ROWS`` documents, drawn by a hash of the id; the rules then run in
the order of rejections per unit of cost, and a document leaves the cascade at
the first rule that rejects it.  The order changes the time only: a document is
kept if no rule rejects it, whatever the order.

A null or empty text has no words and is rejected.  Texts are judged whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm import common

#: Rows (about) on which cost and selectivity are measured.
SAMPLE_ROWS = 1024
#: Words in a window of n_repeat_words.
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows whose word sequence starts at two or more places of the text."""
    n = len(words)
    if n <= window:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
    h = np.zeros(n - window + 1, np.uint64)
    for j in range(window):
        h = (h ^ ids[j : n - window + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    # Equal hashes are only a hint: the words themselves decide.
    at: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(np.isin(h, twice)).tolist():
        at.setdefault(tuple(words[i : i + window]), []).append(i)
    edge = np.zeros(n + 1, np.int64)
    for starts in at.values():
        if len(starts) > 1:
            starts = np.array(starts)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


class Doc:
    """A text whose measures are taken when a rule first asks for them."""

    __slots__ = ("_lines", "_raw", "_repeat", "_words", "text")

    def __init__(self, text: str):
        self.text, self._raw, self._words, self._lines, self._repeat = text, None, None, None, None

    @property
    def raw(self) -> bytes:
        if self._raw is None:
            self._raw = self.text.encode("utf-8", "surrogatepass")
        return self._raw

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.raw.split()  # splits at SPACES and nothing else
        return self._words

    @property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, SPACES)))

    @property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @property
    def lines(self) -> tuple[int, int]:
        """Lines with a word, and those of them equal to an earlier line."""
        if self._lines is None:
            full = [x for x in self.raw.split(b"\n") if x.strip()]
            self._lines = len(full), len(full) - len(set(full))
        return self._lines

    @property
    def n_repeat_words(self) -> int:
        if self._repeat is None:
            self._repeat = repeat_words(self.words)
        return self._repeat

    @property
    def cases(self) -> tuple[int, int]:
        """Upper-case and lower-case ASCII letters."""
        return len(self.raw) - len(self.raw.translate(None, UPPER)), len(self.raw) - len(self.raw.translate(None, LOWER))


@dataclass(frozen=True)
class Rule:
    """rejects must depend on the document alone."""

    name: str
    rejects: Callable[[Doc], bool]


def _upper(d: Doc) -> bool:
    upper, lower = d.cases
    return upper > lower


def _lines(d: Doc) -> bool:
    lines, again = d.lines
    return again >= 2 and 100 * again > 30 * lines


def _stutter(d: Doc) -> bool:
    return 100 * sum(map(eq, d.words, d.words[1:])) > 30 * len(d.words)


#: The two rules of the base verdict.
BASE_RULES = (
    Rule("few_words", lambda d: len(d.words) < 20),
    Rule("repeated_windows", lambda d: 100 * d.n_repeat_words > 30 * len(d.words)),
)
#: Further rules: share of symbols, capitals, repeated lines, words said twice running, and the mean word.
MORE_RULES = (
    Rule("symbols", lambda d: 100 * d.n_symbols > 30 * len(d.words)),
    Rule("capitals", _upper),
    Rule("repeated_lines", _lines),
    Rule("stutter", _stutter),
    Rule("word_length", lambda d: d.word_chars > 25 * len(d.words) or d.word_chars < 2 * len(d.words)),
)


def measured(df: DataFrame, rules: tuple[Rule, ...], rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds for a document, rejected share) on about ``rows`` documents; each rule is timed on fresh documents."""
    total = df.count()
    if not total:
        return [(r.name, 1.0, 0.0) for r in rules]
    share = min(1.0, rows / total)
    # The hash is uniform over the longs.
    drawn = df if share == 1.0 else df.where(F.xxhash64("doc_id", F.lit(0)) < F.lit(int(-(2**63) + share * (2**64 - 1))).cast("long"))
    schema = pa.schema([("rule", pa.string()), ("ns", pa.int64()), ("rejected", pa.int64()), ("n", pa.int64())])

    def time_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {r.name: [0, 0, 0] for r in rules}
        for b in batches:
            for text in b.column("text").to_pylist():
                for r in rules:
                    d = Doc(text)
                    began = time.perf_counter_ns()
                    no = r.rejects(d)
                    took = time.perf_counter_ns() - began
                    x = found[r.name]
                    x[0], x[1], x[2] = x[0] + took, x[1] + no, x[2] + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found)), *(pa.array([v[i] for v in found.values()], pa.int64()) for i in range(3))], schema=schema)

    sums = {r["rule"]: r for r in drawn.mapInArrow(time_rules, "rule string, ns long, rejected long, n long").groupBy("rule").agg(F.sum("ns").alias("ns"), F.sum("rejected").alias("rejected"), F.sum("n").alias("n")).collect()}
    out = []
    for r in rules:
        n = max(1, sums[r.name]["n"]) if r.name in sums else 1
        out.append((r.name, sums[r.name]["ns"] / n / 1e9 if r.name in sums else 1.0, sums[r.name]["rejected"] / n if r.name in sums else 0.0))
    return out


def cascade_order(stats: list[tuple[str, float, float]]) -> list[str]:
    """Names by rejections per cost, most first; ties by name."""
    return [n for n, _, _ in sorted(stats, key=lambda x: (-(x[2] / max(x[1], 1e-9)), x[0]))]


def cascade(df: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept, and the rule that rejected the document (in the order chosen for these data)."""
    docs = common.base(df, id_col, text_col)
    by_name = {r.name: r for r in rules}
    ordered = [by_name[n] for n in cascade_order(measured(docs, rules))]
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.bool_()), ("rejected_by", pa.string())])

    def judge(ids: list[int], texts: list[str]) -> list:
        by = []
        for t in texts:
            d = Doc(t)
            by.append(next((r.name for r in ordered if r.rejects(d)), None))
        return [ids, [x is None for x in by], by]

    return common.null_ids(docs.mapInArrow(common.per_slice(judge, schema), "doc_id long, kept boolean, rejected_by string"))


def measures(df: DataFrame, rules: tuple[Rule, ...] = MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base measures of every document and its verdict; the further rules run as a cascade on what the base rules leave."""
    docs = common.base(df, id_col, text_col)
    by_name = {r.name: r for r in rules}
    ordered = [by_name[n] for n in cascade_order(measured(docs, rules))]
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in longs), ("base_failed", pa.bool_()), ("kept", pa.bool_())])

    def judge(ids: list[int], texts: list[str]) -> list:
        rows = []
        for t in texts:
            d = Doc(t)
            failed = any(r.rejects(d) for r in BASE_RULES)
            rows.append((len(d.words), d.word_chars, d.n_symbols, d.lines[1], d.n_repeat_words, failed, not failed and not any(r.rejects(d) for r in ordered)))
        return [ids, *([r[i] for r in rows] for i in range(7))]

    return common.null_ids(docs.mapInArrow(common.per_slice(judge, schema), "doc_id long, " + ", ".join(f"{n} long" for n in longs) + ", base_failed boolean, kept boolean"))


def filtered(df: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, that every rule keeps.  The verdict is a function of the text alone, so rows never leave their partition."""
    docs = df.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("doc_id", F.xxhash64("text"))
    by_name = {r.name: r for r in rules}
    ordered = [by_name[n] for n in cascade_order(measured(docs, rules))]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, common.SLICE):
                part = b.slice(at, common.SLICE)
                docs = (Doc(t or "") for t in part.column(part.schema.get_field_index(text_col)).to_pylist())
                yield part.filter(pa.array([not any(r.rejects(d) for r in ordered) for d in docs], pa.bool_()))

    return df.mapInArrow(keep, df.schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures(common.documents(spark, sf_dir))

OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
pos AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS s FROM pos),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
full_lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS again FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(f.again, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(f.n, 0) AS n_lines,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_stutter,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS lower
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN full_lines f ON f.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 30 * n_words OR upper > lower
            OR (n_dup_lines >= 2 AND 100 * n_dup_lines > 30 * n_lines) OR 100 * n_stutter > 30 * n_words OR word_chars > 25 * n_words OR word_chars < 2 * n_words) AS kept
FROM m
"""
