"""Exact BM25 top-k by block-max WAND over sharded inverted indexes.

Documents are indexed once, in shards of ``SHARD``: a posting list for each
term, with term frequencies and document lengths.  The statistics are those of
all documents (their number, mean length, and the document frequencies of the
terms asked for, summed over the shards), so a shard's scores are those of one
large index and the shards' best lists merge exactly.

Lists of at least ``BLOCK`` postings have a greatest impact for each block of
``BLOCK`` documents.  A query's threshold is its k-th best score in the shards
that the task has seen.  In a shard, lists are ordered by their upper bounds;
the pivot is the first whose bound, with those before it, reaches the
threshold, so a document that stands only in lists before the pivot cannot
enter and cursors stop only at documents of the lists from the pivot on.
These are scored on the latter; where that and the block maxima of the lists
before the pivot stay under the threshold, the block is passed over, and the
lists before the pivot are read in the other blocks alone.  All cursors of a
shard move at once, as arrays.  A task searches ``JOINED`` stored shards as one,
and the lists that hold a ``DENSE``-th of its documents or more are a matrix,
multiplied for ``ASKED`` queries at once: with their exact sums known, the pivot
and the blocks are chosen among the other lists.

Queries come in batches of at most ``BATCH`` bytes (and one query more), two
passes over the shards for each, so what is sent to the tasks is bounded.  A
query is the set of distinct words of a text; words are
``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.

Ties go to the smaller doc_id; scores are compared to nine digits after the
point.  A null or empty text has no words: as a query it finds nothing, as a
document it is never found.  Every query row is answered by itself, repeated
ids and rows included; a null query_id or doc_id sorts first and comes back as
null; repeated documents are found as often as they stand there.  An empty
table, of documents or of queries, gives no rows.
"""

from __future__ import annotations

import ctypes
import math
import struct
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlink.llm import common, substrings

K1, B = 1.2, 0.75
TOP = 10
SHARD, BLOCK = 4096, 64
BATCH = 32 << 20
JOINED, DENSE, ASKED = 4, 8, 64
#: Bytes of the matrix at most; the longest lists go first.
MATRIX = 32 << 20
#: Sums of floats in another order come this close to a bound before it counts as passed.
SLACK = 1e-9


def terms(text: str) -> np.ndarray:
    return substrings.word_hashes(text.encode("utf-8", "surrogatepass").lower().split())


def idf(n: int, df: np.ndarray) -> np.ndarray:
    return np.log(1 + (n - df + 0.5) / (df + 0.5))


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


class Shard:
    """Posting lists as arrays: terms, where their postings begin, and the postings' documents and frequencies."""

    FIELDS = (("doc_ids", "<i8"), ("lengths", "<i4"), ("terms", "<u8"), ("at", "<i4"), ("doc", "<u2"), ("tf", "<i4"))

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, docs: list[tuple[int, np.ndarray]]) -> Shard:
        places, hashes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, (_, words) in enumerate(docs):
            h, tf = np.unique(words, return_counts=True)
            places.append(np.full(len(h), i, np.int64))
            hashes.append(h)
            counts.append(tf)
        place, h, tf = map(np.concatenate, (places, hashes, counts))
        order = np.argsort(h, kind="stable")  # documents stay in order within a term
        h = h[order]
        new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        return cls(doc_ids=np.array([d for d, _ in docs], np.int64), lengths=np.array([len(w) for _, w in docs], np.int64), terms=h[new], at=np.r_[new, len(h)], doc=place[order], tf=tf[order])

    def to_bytes(self) -> bytes:
        parts = [getattr(self, n).astype(t).tobytes() for n, t in self.FIELDS]
        return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        sizes = struct.unpack_from(f"<{len(cls.FIELDS)}I", data)
        at, out = 4 * len(sizes), {}
        for (name, kind), size in zip(cls.FIELDS, sizes):
            out[name] = np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at)
            at += size
        return cls(**out)

    @classmethod
    def joined(cls, shards: list[Shard]) -> Shard:
        """The shards as one, the documents of each after those of the shards before."""
        if len(shards) == 1:
            return shards[0]
        words = np.unique(np.concatenate([s.terms for s in shards]))
        places, sizes = [np.searchsorted(words, s.terms) for s in shards], [np.diff(s.at).astype(np.int64) for s in shards]
        n = np.zeros(len(words), np.int64)
        for p, own in zip(places, sizes):
            n[p] += own
        at = np.r_[0, np.cumsum(n)]
        doc, tf, free, first = np.zeros(at[-1], np.int32), np.zeros(at[-1], np.int32), at[:-1].copy(), 0
        for s, p, own in zip(shards, places, sizes):
            to = spread(free[p], own)
            doc[to], tf[to] = s.doc.astype(np.int32) + first, s.tf
            free[p] += own
            first += len(s.doc_ids)
        return cls(doc_ids=np.concatenate([s.doc_ids for s in shards]), lengths=np.concatenate([s.lengths for s in shards]), terms=words, at=at, doc=doc, tf=tf)

    def place(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which terms of the query stand here, and where."""
        if not len(self.terms):
            return np.zeros(len(query), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, query), len(self.terms) - 1)
        has = self.terms[at] == query
        return has, at[has]

    def prepare(self, mean: float, block: int = BLOCK, dense: int | None = None) -> None:
        """Impacts, given the mean length of all documents, the greatest of each list, and of each block of the long lists; with dense, the matrix of the longest."""
        norm = K1 * (1 - B + B * self.lengths / mean)
        self.impact = self.tf * (K1 + 1) / (self.tf + norm[self.doc])
        n = np.diff(self.at)
        self.most = np.maximum.reduceat(self.impact, self.at[:-1]) if len(n) else np.zeros(0)
        self.block = block
        self.slot = np.full(len(n), -1)
        if dense:
            rows = np.flatnonzero(n * dense >= len(self.doc_ids))
            rows = rows[np.argsort(-n[rows], kind="stable")][: MATRIX // (8 * max(len(self.doc_ids), 1))]
            self.slot[rows] = np.arange(len(rows))
            self.matrix = np.zeros((len(rows), len(self.doc_ids)))
            for i, t in enumerate(rows):
                own = slice(self.at[t], self.at[t + 1])
                self.matrix[i, self.doc[own]] = self.impact[own]
        long = np.flatnonzero((n >= block) & (self.slot < 0))
        self.row = np.full(len(n), -1)
        self.row[long] = np.arange(len(long))
        self.blocks = -(-len(self.doc_ids) // block)
        p = spread(self.at[long].astype(np.int64), n[long].astype(np.int64))
        cell = np.repeat(np.arange(len(long)), n[long]) * self.blocks + self.doc[p] // block
        new = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        block_most = np.zeros(len(long) * self.blocks)
        block_at, block_n = np.zeros(len(block_most), np.int64), np.zeros(len(block_most), np.int64)
        if len(cell):
            block_most[cell[new]] = np.maximum.reduceat(self.impact[p], new)
            block_at[cell[new]], block_n[cell[new]] = p[new], np.diff(np.r_[new, len(cell)])
        shape = (len(long), self.blocks)
        self.block_most, self.block_at, self.block_n = block_most.reshape(shape), block_at.reshape(shape), block_n.reshape(shape)

    def score(self, start: np.ndarray, n: np.ndarray, weight: np.ndarray) -> np.ndarray:
        p = spread(start, n)
        return np.bincount(self.doc[p], np.repeat(weight, n) * self.impact[p], minlength=len(self.doc_ids))

    def score_lists(self, t: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """As score(), of whole lists: their slices are copied as they stand."""
        if not len(t):
            return np.zeros(len(self.doc_ids))
        own = [slice(a, b) for a, b in zip(self.at[t].tolist(), self.at[t + 1].tolist())]
        points = np.concatenate([self.impact[x] for x in own]) * np.repeat(weight, self.at[t + 1] - self.at[t])
        return np.bincount(np.concatenate([self.doc[x] for x in own]), points, minlength=len(self.doc_ids))

    def dense(self, asked: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The scores of all documents, a row for each query (its lists here, their weights), by the lists of the matrix alone."""
        q = np.zeros((len(asked), len(self.matrix)))
        for i, (t, w) in enumerate(asked):
            s = self.slot[t]
            q[i, s[s >= 0]] = w[s >= 0]
        return q @ self.matrix

    def search(self, query: np.ndarray, weights: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc_ids, scores) of documents that may be among the k best, given that k score at least ``floor`` already."""
        has, t = self.place(query)
        return self.search_lists(t, weights[has], self.dense([(t, weights[has])])[0] if (self.slot >= 0).any() else None, floor, k)

    def search_lists(self, t: np.ndarray, w: np.ndarray, known: np.ndarray | None, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As search(), for lists and their weights; known: what the lists of the matrix give."""
        if known is not None:
            rest = self.slot[t] < 0
            t, w = t[rest], w[rest]
        bound, row = w * self.most[t], self.row[t]
        floor -= SLACK
        # Lists before the pivot, of the long ones: together they stay under the floor.  A document of the matrix is met in any case.
        order = np.flatnonzero(row >= 0)
        order = order[np.argsort(bound[order], kind="stable")]
        before = order[: np.searchsorted(np.cumsum(bound[order]), floor)]
        stop = np.ones(len(t), bool)
        stop[before] = False
        total = self.score_lists(t[stop], w[stop])
        if known is not None:
            total += known
        if len(before):
            rest = w[before] @ self.block_most[row[before]]
            open_ = (total > 0) & (total + np.repeat(rest, self.block)[: len(total)] >= floor)
            live = np.flatnonzero(np.bitwise_or.reduceat(open_, np.arange(0, len(total), self.block)))
            if 4 * len(live) > self.blocks:  # whole lists are read faster than many blocks
                total += self.score_lists(t[before], w[before])
            elif len(live):
                cells = np.ix_(row[before], live)
                n = self.block_n[cells].ravel()
                total += self.score(self.block_at[cells].ravel(), n, np.repeat(w[before], len(live)))
            found = np.flatnonzero(open_ & (total >= floor))
        else:
            found = np.flatnonzero((total > 0) & (total >= floor))
        if len(found) > k:
            cut = np.partition(total[found], -k)[-k]
            found = found[total[found] >= cut - SLACK]  # ties stay: the doc_id decides later
        return self.doc_ids[found], total[found]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -np.round(scores, 9)))[:k]
    return ids[order], scores[order]


def one_thread() -> None:
    """Threads of numpy's own BLAS spin between small products: a task keeps to its core."""
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        put = getattr(ctypes.CDLL(str(path)), "scipy_openblas_set_num_threads64_", None)
        if put is not None:
            put(1)


@contextmanager
def one_by_one(spark: SparkSession) -> Iterator[None]:
    """Rows of megabytes are read and handed to Python one at a time while this holds."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "1")
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def indexed(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """The shards of (doc_id, text), saved, with their documents and words."""
    schema = pa.schema([("docs", pa.int64()), ("words", pa.int64()), ("shard", pa.binary())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            shard = Shard.build(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([len(shard.doc_ids)]), pa.array([int(shard.lengths.sum())]), pa.array([shard.to_bytes()], pa.binary())], schema=schema)

        for b in batches:
            for at in range(0, b.num_rows, common.SLICE):
                part = b.slice(at, common.SLICE)
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    held.append((doc, terms(text)))
                    if len(held) == size:
                        yield flush()
        if held:
            yield flush()

    return common.saved(docs.mapInArrow(index, "docs long, words long, shard binary"), "shards")


def search(df: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", size: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), doc_id, score: the k best documents of each query row (query_id, text), by shards of size documents."""
    spark = df.sparkSession
    shards = indexed(common.base(df, id_col, text_col), size)
    stats = shards.agg(F.sum("docs").alias("n"), F.sum("words").alias("words")).first()
    total, mean = stats["n"] or 0, max((stats["words"] or 0) / max(stats["n"] or 0, 1), 1e-9)

    def distinct(ids: list[int], texts: list[str]) -> list:
        return [ids, [np.unique(terms(t)).tobytes() for t in texts]]

    schema = pa.schema([("doc_id", pa.int64()), ("terms", pa.binary())])
    asked = common.base(queries, "query_id", "text").mapInArrow(common.per_slice(distinct, schema), "doc_id long, terms binary")
    asked = common.saved(asked.where("length(terms) > 0").select(F.col("doc_id").alias("query_id"), "terms", F.monotonically_increasing_id().alias("row")), "queries")

    def frequencies(wanted: np.ndarray) -> np.ndarray:
        """The document frequency of each wanted term; a task sums its shards first."""
        sent = spark.sparkContext.broadcast(wanted)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df = np.zeros(len(sent.value), np.int64)
            for b in batches:
                for data in b.column("shard"):
                    shard = Shard.from_bytes(data.as_py())
                    has, at = shard.place(sent.value)
                    df[has] += np.diff(shard.at)[at]
            own = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(df[own], pa.int64())], names=["term", "df"])

        # As many rows as the batch has terms.
        with one_by_one(spark):
            counted = common.saved(shards.select("shard").mapInArrow(count, "term long, df long"), "counted")
        rows = counted.groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        common.dropped(counted)
        out = np.zeros(len(wanted), np.int64)
        out[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
        sent.unpersist()
        return out

    def scan(batch: list[tuple[int, int, bytes]]) -> DataFrame:
        """The k best of the batch's queries in each task's shards."""
        words = [np.frombuffer(t, np.uint64) for _, _, t in batch]
        wanted = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        weight = idf(total, frequencies(wanted))
        sent = spark.sparkContext.broadcast((np.array([r for r, _, _ in batch], np.int64), [w.tobytes() for w in words], wanted, weight))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_thread()
            rows, asked, wanted, weight = sent.value
            asked = [np.frombuffer(t, np.uint64) for t in asked]
            asked = [np.searchsorted(wanted, t) for t in asked]
            top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(asked)
            held: list[Shard] = []

            def work() -> None:
                shard = Shard.joined(held)
                held.clear()
                shard.prepare(mean, block, DENSE)
                has, t = shard.place(wanted)
                place = np.full(len(wanted), -1)
                place[has] = t
                for at in range(0, len(asked), ASKED):
                    lists = [(place[a], weight[a]) for a in asked[at : at + ASKED]]
                    lists = [(t[t >= 0], w[t >= 0]) for t, w in lists]
                    for i, ((t, w), known) in enumerate(zip(lists, shard.dense(lists)), at):
                        ids, scores = top[i]
                        more, points = shard.search_lists(t, w, known, float(scores[-1]) if len(scores) >= k else -math.inf, k)
                        if len(more):
                            top[i] = best(np.r_[ids, more], np.r_[scores, points], k)

            for b in batches:
                for data in b.column("shard"):
                    held.append(Shard.from_bytes(data.as_py()))
                    if len(held) == JOINED:
                        work()
            if held:
                work()
            sizes = [len(x[0]) for x in top]
            cols = [np.repeat(rows, sizes), np.concatenate([x[0] for x in top] or [np.zeros(0, np.int64)]), np.concatenate([x[1] for x in top] or [np.zeros(0)])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["row", "doc_id", "score"])

        with one_by_one(spark):
            found = common.saved(shards.select("shard").mapInArrow(run, "row long, doc_id long, score double"), "found")
        sent.unpersist()
        return found

    found, batch, size = [], [], 0
    for r in asked.select("row", "query_id", "terms").toLocalIterator():  # a batch at a time is on the driver
        batch.append((r["row"], r["query_id"], bytes(r["terms"])))
        size += len(r["terms"])
        if size >= BATCH:
            found.append(scan(batch))
            batch, size = [], 0
    if batch or not found:
        found.append(scan(batch))
    # The best of each batch are merged at once, so that what stays is k rows a query.
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.round("score", 9).desc(), "doc_id"))
    merged = every.withColumn("rank", rank).where(F.col("rank") <= k).join(asked.select("row", "query_id"), "row")
    out = common.saved(merged.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score")), "ranked")
    common.dropped(shards, asked, *found)
    return common.null_ids(out, "query_id", "doc_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id 100 divides, as a query against all documents."""
    docs = common.documents(spark, sf_dir)
    return search(docs, docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"))
