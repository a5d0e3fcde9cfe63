"""Exact byte-level dedup with suffix arrays built by Lyndon grouping.

Bytes covered by a string of ``WINDOW`` bytes that also starts anywhere else,
in the same document or another, are removed at all its places.

Every window has an anchor, its least hash of ``ANCHOR`` bytes, at a place that
the content sets; a block is a run of windows with one anchor.  Blocks with
equal anchor and content repeat as a whole.  Where one anchor stands in several
contents, windows may repeat in part: two windows around an anchor have
``HALF`` equal bytes on at least one side of it, so contents that share neither
side with another content drop out.  The rest is sorted by suffixes: contents
are dealt by anchor to buffers, cut into cells of ``CELL`` bytes aligned at the
anchor, and the buffer's suffix array (see ``lyndon``) brings together the
suffixes that agree for all but a cell of a window; in such a run the windows
at the cell's bytes are compared.  An anchor with more than ``BUFFER`` contents
is salted over several buffers; there each buffer passes on one row for each
distinct window, and sums over the buffers settle the rest.  No buffer grows
with the input.

Null and empty texts, and texts shorter than a window, lose nothing.  Rows are
places of their own: a repeated row repeats its windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm import common, lyndon, rolling, substrings

WINDOW = 400
ANCHOR = 64
CELL = 8
#: Contents of one anchor that share a buffer.
BUFFER = 4096
#: Bytes gathered before a suffix array is built.
GATHER = 1 << 18

_BYTES: list[np.ndarray] = []


def byte_units(raw: bytes) -> np.ndarray:
    if not _BYTES:
        import xxhash

        _BYTES.append(np.array([xxhash.xxh64_intdigest(bytes([b]), 3) for b in range(256)], np.uint64))
    return _BYTES[0][np.frombuffer(raw, np.uint8)]


BLOCKS = pa.schema([(n, pa.int64()) for n in ("doc_id", "row_hash", "anchor", "content", "before", "after")] + [(n, pa.int32()) for n in ("first", "n", "place")])
BLOCKS_SQL = "doc_id long, row_hash long, anchor long, content long, before long, after long, first int, n int, place int"


def block_rows(window: int, anchor: int):
    """An Arrow mapper from texts to blocks; before and after are the hashes of the sides of the anchor (0: the block has less)."""
    half = (window - anchor) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, common.SLICE // 4):
                part = b.slice(at, common.SLICE // 4)
                cols: list[list[np.ndarray]] = [[] for _ in BLOCKS]
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    raw, row = text.encode("utf-8", "surrogatepass"), substrings.text_hash(text)
                    for low, high in rolling.segments(len(raw), window):
                        units = byte_units(raw[low:high])
                        anchors, contents, first, n, place = rolling.blocks(units, window, anchor)
                        sides = rolling.spans(units, half)
                        before, after = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                        has = place - first >= half
                        before[has] = sides[place[has] - half]
                        has = first + n - 1 + window - place - anchor >= half
                        after[has] = sides[place[has] + anchor]
                        for col, x in zip(cols, (np.full(len(n), doc), np.full(len(n), row), anchors.view(np.int64), contents.view(np.int64), before.view(np.int64), after.view(np.int64), first + low, n, place + low)):
                            col.append(x)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(cols, BLOCKS)], schema=BLOCKS)

    return run


def equal_windows(contents: list[bytes], places: list[int], window: int, cell: int = CELL) -> list[list[tuple[int, int]]]:
    """Groups of (content, window start) with equal bytes, by one suffix array over all contents.

    places are the anchors' places in the contents; equal windows have them at
    equal distances, so cells aligned at the anchor are aligned in both.
    """
    whole = window // cell - 1  # cells that two windows share wherever they start in a cell
    owner, starts, cells = [], [], []
    for k, (data, place) in enumerate(zip(contents, places)):
        off = place % cell
        n = (len(data) - off) // cell
        if n:
            cells.append(np.frombuffer(data, "<u8" if cell == 8 else "u1", n, off))
            owner.append(np.full(n, k))
            starts.append(off + cell * np.arange(n))
        cells.append(None)
    if not owner:
        return []
    flat = np.concatenate([c for c in cells if c is not None])
    _, names = np.unique(flat, return_inverse=True)
    symbols, owners, offsets, at, j = [], [], [], 0, 0
    for c in cells:
        if c is None:
            symbols.append(np.zeros(1, np.int64))
            owners.append(np.full(1, -1))
            offsets.append(np.zeros(1, np.int64))
        else:
            symbols.append(names[at : at + len(c)] + 1)
            owners.append(owner[j])
            offsets.append(starts[j])
            at, j = at + len(c), j + 1
    owners, offsets = np.concatenate(owners).tolist(), np.concatenate(offsets).tolist()
    span = whole * cell
    out, run, last = [], [], None

    def close() -> None:
        if len(run) > 1:
            for back in range(cell):
                same: dict[bytes, list[tuple[int, int]]] = {}
                for k, start in run:
                    s = start - back
                    if 0 <= s and s + window <= len(contents[k]) and s <= places[k]:
                        same.setdefault(contents[k][s : s + window], []).append((k, s))
                out.extend(x for x in same.values() if len(x) > 1)

    for i in lyndon.suffix_array(np.concatenate(symbols)):
        k, start = owners[i], offsets[i]
        if k < 0 or start + span > len(contents[k]) or start > places[k] + cell:
            continue
        head = contents[k][start : start + span]
        if head != last:
            close()
            run, last = [], head
        run.append((k, start))
    close()
    return out


FOUND = pa.schema([("anchor", pa.int64()), ("seen", pa.int64()), ("doc_id", pa.int64()), ("row_hash", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("copies", pa.int64())])
FOUND_SQL = "anchor long, seen long, doc_id long, row_hash long, low int, high int, copies long"


def sorted_buffers(window: int):
    """An Arrow mapper over contents sorted by (anchor, salt).

    Gives spans of repeated windows (seen null), and for anchors that span
    buffers one row for each distinct window of the buffer: its hash, its
    copies here and, for a single copy, its place.
    """

    def settle(rows: list[dict]) -> list[tuple]:
        import xxhash

        contents = [r["data"] for r in rows]
        groups = equal_windows(contents, [r["place"] - r["first"] for r in rows], window)
        hits: list[set[int]] = [set() for _ in rows]
        out = []
        for g in groups:
            for k, s in g:
                if s < rows[k]["n"]:
                    hits[k].add(s)
            k, s = g[0]
            if rows[k]["salts"] > 1:
                out.append((rows[k]["anchor"], xxhash.xxh64_intdigest(contents[k][s : s + window]) - 2**63, None, None, None, None, len(g)))
        for r, data, found in zip(rows, contents, hits):
            run = None
            for s in sorted(found):
                if run and s <= run[1]:
                    run[1] = s + window
                else:
                    if run:
                        out.append((None, None, r["doc_id"], r["row_hash"], r["first"] + run[0], r["first"] + run[1], 0))
                    run = [s, s + window]
            if run:
                out.append((None, None, r["doc_id"], r["row_hash"], r["first"] + run[0], r["first"] + run[1], 0))
            if r["salts"] > 1:
                for s in range(r["n"]):
                    if s not in found:
                        out.append((r["anchor"], xxhash.xxh64_intdigest(data[s : s + window]) - 2**63, r["doc_id"], r["row_hash"], r["first"] + s, r["first"] + s + window, 1))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = settle(held)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(FOUND)], schema=FOUND)

        for b in batches:
            for r in b.to_pylist():
                # A buffer ends between anchors (or salts) only.
                if size > GATHER and (r["anchor"], r["salt"]) != (held[-1]["anchor"], held[-1]["salt"]):
                    yield flush()
                    held, size = [], 0
                held.append(r)
                size += len(r["data"])
        if held:
            yield flush()

    return run


def duplicate_spans(df: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_hash and spans, arrays of (low, high) in bytes, not merged; only documents that have some."""
    docs = common.base(df, id_col, text_col)
    key = ["anchor", "content"]
    blocks = common.saved(docs.mapInArrow(block_rows(window, anchor), BLOCKS_SQL), "blocks")
    # Aggregates are saved before they are joined: only then may Spark split a join's hot keys.
    shared = common.saved(blocks.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "shared")
    index = common.saved(blocks.join(shared, "anchor"), "index")
    common.dropped(blocks, shared)
    firsts = common.saved(index.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "row_hash", "first", "n", "place", "before", "after")).alias("at")).select(*key, "copies", "at.*"), "firsts")
    whole = index.join(firsts.where("copies > 1").select(*key), key).select("doc_id", "row_hash", F.col("first").alias("low"), (F.col("first") + F.col("n") - 1 + window).alias("high"))
    # Contents that share a side of their anchor with another content.
    sides = firsts.select(*key, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("hash")), F.struct(F.lit(1).alias("side"), F.col("after").alias("hash")))).alias("s")).select(*key, "s.side", "s.hash").where("hash <> 0")
    twice = common.saved(sides.groupBy("anchor", "side", "hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "twice")
    partial = common.saved(sides.join(twice, ["anchor", "side", "hash"]).select(*key).distinct(), "partial")
    per_anchor = common.saved(partial.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / F.lit(BUFFER)).cast("int").alias("salts")), "salts")
    wanted = firsts.join(partial, key).join(per_anchor, "anchor").withColumn("salt", F.pmod(F.xxhash64("content"), F.col("salts")).cast("int"))
    wanted = wanted.groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("anchor", "salt", "salts", "first", "n", "place")).alias("blocks"))
    parts = pa.schema([("anchor", pa.int64()), ("salt", pa.int32()), ("salts", pa.int32()), ("doc_id", pa.int64()), ("row_hash", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("place", pa.int32()), ("data", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, common.SLICE):
                part, rows = b.slice(at, common.SLICE), []
                for doc, row, text, found in zip(*(part.column(c).to_pylist() for c in ("doc_id", "row_hash", "text", "blocks"))):
                    raw = text.encode("utf-8", "surrogatepass")
                    rows += [(w["anchor"], w["salt"], w["salts"], doc, row, w["first"], w["n"], w["place"], raw[w["first"] : w["first"] + w["n"] - 1 + window]) for w in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(parts)], schema=parts)

    cuts = substrings.with_row_hash(docs).dropDuplicates(["doc_id", "row_hash"]).join(wanted, ["doc_id", "row_hash"]).mapInArrow(cut, "anchor long, salt int, salts int, doc_id long, row_hash long, first int, n int, place int, data binary")
    found = common.saved(cuts.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(sorted_buffers(window), FOUND_SQL), "found")
    spans = found.where("seen is null").select("doc_id", "row_hash", "low", "high")
    across = found.where("seen is not null")
    several = common.saved(across.groupBy("anchor", "seen").agg(F.sum("copies").alias("c")).where("c > 1").select("anchor", "seen"), "several")
    late = across.where("copies = 1").join(several, ["anchor", "seen"]).select("doc_id", "row_hash", "low", "high")
    out = common.saved(whole.unionByName(spans).unionByName(late).distinct().groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "spans")
    common.dropped(index, firsts, twice, partial, per_anchor, found, several)
    return out


def digests(df: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and sha256 of the remaining bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, spans in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "spans"))):
                raw = text.encode("utf-8", "surrogatepass")
                merged = merge([(s["low"], s["high"]) for s in spans or ()])
                h, at = hashlib.sha256(), 0
                for low, high in merged:
                    h.update(raw[at:low])
                    at = high
                h.update(raw[at:])
                rows.append((doc, len(raw), sum(high - low for low, high in merged), len(merged), h.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    spans = duplicate_spans(df, window, anchor, id_col, text_col)
    rows = substrings.with_row_hash(common.base(df, id_col, text_col)).join(spans, ["doc_id", "row_hash"], "left")
    return common.null_ids(rows.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs; ranges that touch are one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))
