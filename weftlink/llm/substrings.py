"""Substring dedup by a greedy parse of every document against the documents before it.

The reference of a document is every document with a smaller id.  Reference
and document are cut alike, at anchors that the content itself sets (see
``rolling.blocks``), and every block of every document is indexed by anchor and
content.  A block that the reference holds is a phrase as a whole.  Where a
block with the same anchor differs in content, that is at the boundaries of
what two documents share, its windows are looked up one by one and each found
one is a phrase.

The parse goes over a document's phrases from left to right: the running factor
takes every phrase that begins no later than right behind its last window, so
it grows over any number of blocks; it ends where neither a block nor a window
across its end is in the reference.  Factors of at least a window are the
duplicate spans (``rolling.factors``).  Phrases come from hash joins in place of
a search for the longest match at each place, so one factor may run over
phrases of several documents; the windows that it covers are the same.

All groupings are sums, minima and joins on 128 bits of hash; no group of
blocks is gathered in one place, so a passage may stand in any share of the
documents.  Every step's rows are at most the blocks of the input, or the
windows of blocks that differ under one anchor.

Null and empty texts, and texts shorter than a window, lose nothing.  Documents
with the same id are not a reference for each other.  Rows equal in id and text
have the same spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm import common, rolling

#: Words of a window and of an anchor.
WINDOW = 50
ANCHOR = 16


#: Entries of a worker's table of word hashes (about 150 bytes each); the table is emptied beyond it.
WORDS = 300_000


class WordHashes(dict):
    """Word -> 64-bit hash, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def text_hash(text: str) -> int:
    """Spark's xxhash64 of the text."""
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - 2**64 if h >> 63 else h


def word_units(text: str) -> np.ndarray:
    return word_hashes(text.encode("utf-8", "surrogatepass").split())


BLOCKS = "doc_id long, row_hash long, anchor long, content long, first int, n int"


def block_rows(units_of: Callable[[str], np.ndarray], window: int, anchor: int) -> Callable:
    """An Arrow mapper from (doc_id, text) to the blocks of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("anchor", pa.int64()), ("content", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, common.SLICE):
                part = b.slice(at, common.SLICE)
                cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    units, row = units_of(text), None
                    for low, high in rolling.segments(len(units), window):
                        anchors, contents, first, n, _ = rolling.blocks(units[low:high], window, anchor)
                        row = text_hash(text) if row is None else row
                        for col, x in zip(cols, (np.full(len(n), doc), np.full(len(n), row), anchors.view(np.int64), contents.view(np.int64), first + low, n)):
                            col.append(x)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def window_rows(units_of: Callable[[str], np.ndarray], window: int) -> Callable:
    """An Arrow mapper from (doc_id, row_hash, text, blocks: array of (anchor, first, n)) to the windows of those blocks."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("anchor", pa.int64()), ("seen", pa.int64()), ("first", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, common.SLICE):
                part = b.slice(at, common.SLICE)
                cols: list[list[np.ndarray]] = [[], [], [], [], []]
                for doc, row, text, wanted in zip(*(part.column(n).to_pylist() for n in ("doc_id", "row_hash", "text", "blocks"))):
                    units = units_of(text)
                    for w in wanted:
                        low, n = w["first"], w["n"]
                        hashes = rolling.spans(units[low : low + n - 1 + window], window).view(np.int64)
                        for col, x in zip(cols, (np.full(n, doc), np.full(n, row), np.full(n, w["anchor"]), hashes, np.arange(low, low + n))):
                            col.append(x)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def with_row_hash(docs: DataFrame) -> DataFrame:
    """Adds text_hash() of the text: with the id, what the later joins go by."""
    return docs.withColumn("row_hash", F.xxhash64("text"))


def duplicate_spans(df: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_hash and spans, the phrases as arrays of (low, high) in words; only documents that have some."""
    docs = common.base(df, id_col, text_col)
    blocks = common.saved(docs.mapInArrow(block_rows(word_units, window, anchor), BLOCKS), "blocks")
    # Anchors that two documents share; the rest is in no other document.
    # Aggregates are saved before they are joined: only then may Spark split a join's hot keys.
    shared = common.saved(blocks.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"), "shared")
    index = common.saved(blocks.join(shared, "anchor"), "index")
    common.dropped(blocks, shared)
    # The first document of each block; the block may stand there several times.
    firsts = common.saved(index.groupBy("anchor", "content").agg(F.min("doc_id").alias("earliest")), "firsts")
    placed = index.join(firsts, ["anchor", "content"])
    whole = placed.where("doc_id > earliest").select("doc_id", "row_hash", F.col("first").alias("low"), (F.col("first") + F.col("n") - 1 + window).alias("high"))
    # Boundaries: one anchor, several contents.
    several = common.saved(firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("anchor"), "several")
    wanted = placed.where("doc_id = earliest").join(several, "anchor").groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("anchor", "first", "n")).alias("blocks"))
    windows = common.saved(
        with_row_hash(docs).join(wanted, ["doc_id", "row_hash"]).mapInArrow(window_rows(word_units, window), "doc_id long, row_hash long, anchor long, seen long, first int"),
        "windows",
    )
    earliest = common.saved(windows.groupBy("anchor", "seen").agg(F.min("doc_id").alias("earliest")), "earliest")
    single = windows.join(earliest, ["anchor", "seen"]).where("earliest < doc_id").select("doc_id", "row_hash", F.col("first").alias("low"), (F.col("first") + window).alias("high"))
    out = common.saved(whole.unionByName(single).distinct().groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "spans")
    common.dropped(index, firsts, several, windows, earliest)
    return out


def parsed(df: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, row_hash and spans (null: none) of every row."""
    spans = duplicate_spans(df, window, anchor, id_col, text_col)
    return with_row_hash(common.base(df, id_col, text_col)).join(spans, ["doc_id", "row_hash"], "left")


def cut_text(text: str, spans: list[dict], window: int = WINDOW) -> str:
    """The text without the words in the factors of the phrases; what stands between kept words stays."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    gone = rolling.covered(len(at), rolling.factors([(s["low"], s["high"]) for s in spans], window))
    edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])).tolist()
    out, done = [], 0
    for low, high in zip(edges[::2], edges[1::2]):
        out.append(raw[done : at[low]])
        done = at[high] if high < len(at) else len(raw)
    out.append(raw[done:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def kept_words(text: str, spans: list[dict] | None, window: int = WINDOW) -> tuple[list[bytes], int]:
    """The words outside the factors of the phrases, and the number of words inside."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not spans:
        return words, 0
    gone = rolling.covered(len(words), rolling.factors([(s["low"], s["high"]) for s in spans], window))
    return [w for w, g in zip(words, gone.tolist()) if not g], int(gone.sum())


def digests(df: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and sha256 of the kept words."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, spans in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "spans"))):
                kept, gone = kept_words(text, spans, window)
                rows.append((doc, len(kept) + gone, gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return common.null_ids(parsed(df, window, anchor, id_col, text_col).mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS f FROM win) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM dup),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.s, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
