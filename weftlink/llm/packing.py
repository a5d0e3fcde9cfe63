"""Best-fit packing in bulk-synchronous supersteps.

A document's ids (with its end id) enter sequences of ``capacity`` ids; only
longer ones are cut, the first piece taking the remainder.  Pieces and gaps are
range-sorted and kept as runs of equal length.  A superstep takes the run of
the longest pieces left: a sweep finds the successor of its length among the
gaps, the piece and the gap of equal rank meet (so two pieces never claim one
gap), what is left of the gaps joins the gaps, and the rest of the run sweeps
on; pieces without a gap open new sequences.  Equal pieces are
interchangeable, so a sweep over runs decides the same as one over rows, and
its state is bounded by the capacity: at most ``capacity`` runs of pieces and
as many gap sizes, whatever the input.  Ranks, and the way back from a rank to
a place, are distributed: rows are range-sorted by (length, id), and a length
of any frequency spreads over many tasks.

Ties go by doc_id, then piece.  A null or empty text is a piece of its end id.
An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm import common

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 0


def pieces(df: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of every document."""
    path = path or common.tokenizer_path(VOCABULARY)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(ids: list[int], texts: list[str]) -> list:
        out: list[list] = [[], [], [], [], []]
        encode = common.text_encoder(path)
        for doc, text in zip(ids, texts):
            data = np.append(encode(text), np.uint32(end_id)).astype("<u4", copy=False)
            n, at = len(data), 0
            length = (n - 1) % capacity + 1
            for piece in range(-(-n // capacity)):
                row = (doc, piece, at, length, zlib.crc32(data[at : at + length]))
                for col, x in zip(out, row):
                    col.append(x)
                at, length = at + length, capacity
        return out

    return common.base(df, id_col, text_col).mapInArrow(common.per_slice(cut, schema), "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The places of counts[length] pieces of each length: (length, first rank, number, first sequence, offset), and the number of sequences.

    Gaps are stacks of runs of sequences, one stack for each size.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    placed, opened = [], 0

    def free(size: int, first: int, n: int) -> None:
        if size:
            if size not in gaps:
                gaps[size] = []
                insort(sizes, size)
            gaps[size].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(sizes, length)  # the successor
            if k < len(sizes):
                size = sizes[k]
                first, n = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size]
                    sizes.pop(k)
                each = size // length
            else:
                # New sequences, as many as these pieces need.
                each = capacity // length
                size, first, n = capacity, opened, -(-left // each)
                opened += n
            # A gap takes what it holds of equal pieces before the next one is touched; the last may take fewer.
            whole = min(n, left // each)
            runs = [(whole, first, j) for j in range(each if whole else 0)]
            rest = min(left - whole * each, each) if whole < n else 0
            runs += [(1, first + whole, j) for j in range(rest)]
            for m, at, j in runs:
                placed.append((length, rank, m, at, capacity - size + j * length))
                rank, left = rank + m, left - m
            if whole:
                free(size - each * length, first, whole)
            if rest:
                free(size - rest * length, first + whole, 1)
            used = whole + (rest > 0)
            if used < n:
                free(size, first + used, n - used)
    return placed, opened


def packed(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (1 to capacity)."""
    rows = common.ranked(table, "length", ["doc_id", "piece"], "pieces", "rank")
    # At most one row for each possible length.
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed, _ = sweep(counts, capacity)
    # By length: first ranks, first sequences and offsets, in order of rank.
    plan: dict[int, np.ndarray] = {}
    by_length: dict[int, list] = {}
    for length, rank, _, first, offset in placed:
        by_length.setdefault(length, []).append((rank, first, offset))
    for length, found in by_length.items():
        plan[length] = np.array(found, np.int64).reshape(-1, 3)
    names = [c for c in rows.columns if c != "rank"]

    def place(batches):
        for b in batches:
            lengths = b.column("length").to_numpy()
            ranks = b.column("rank").to_numpy()
            sequence, offset = np.empty(b.num_rows, np.int64), np.empty(b.num_rows, np.int64)
            for length in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == length)
                runs = plan[length]
                k = np.searchsorted(runs[:, 0], ranks[mine], "right") - 1
                sequence[mine] = runs[k, 1] + ranks[mine] - runs[k, 0]
                offset[mine] = runs[k, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(place, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", sequence_id long, offset long")


def pack(df: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    # Saved, as the range sort reads its input twice and tokenizing is the costly part.
    cut = common.saved(pieces(df, capacity, end_id, path, id_col, text_col), "cut")
    out = packed(cut, capacity)
    common.dropped(cut)
    return common.null_ids(out)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
