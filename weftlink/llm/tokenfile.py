"""Token ids in files of independently coded frames.

A file is a table of frames.  A frame holds whole documents (about
``FRAME`` ids; a longer document has one to itself) as bytes::

    "WFT2" | vocabulary u32 | ids in a block u32 | blocks in a set u32 | documents u32 | blocks u32
    doc_id i64 x documents | ids of the document u32 x documents
    crc32 of the block's ids (u32, ids as u32) x blocks | coded bytes u32 x blocks
    crc32 of all this u32
    coded blocks (see idcoder)

all little-endian.  Each set of blocks starts from a fresh model and can be
read without the others; a block has its own checksum.  Frames are numbered by
(part, start): parts are ranges of doc_id in ascending order, start counts the
ids of the part before the frame.

Ties of doc_id go by text.  A null or empty text has its end id only.  An empty
table gives no frames.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm import common, idcoder

VOCABULARY = "word_bpe_49k.json"
VOCABULARY_SIZE = 49408
END_ID = 2
#: Ids after which a frame is closed, and ids that a task holds before it codes them.
FRAME = 1 << 18
GATHER = idcoder.TOGETHER * idcoder.BLOCK
MAGIC = b"WFT2"
HEAD = struct.Struct("<5I")


Damaged = idcoder.Damaged


def sets_of(n_blocks: list[int], size: int) -> list[int]:
    """The number of each block's set, given the number of blocks of each frame; no set goes over frames."""
    out, first = [], 0
    for n in n_blocks:
        out += [first + i // size for i in range(n)]
        first += -(-n // size)
    return out


def frames(docs: list[list[tuple[int, np.ndarray]]], vocabulary: int, block: int = idcoder.BLOCK, together: int = idcoder.SET) -> list[bytes]:
    """The bytes of each frame, given as (doc_id, ids) of its documents; all blocks are coded together."""
    pieces = []
    for frame in docs:
        ids = np.concatenate([i for _, i in frame])
        pieces.append([ids[at : at + block] for at in range(0, len(ids), block)])
    counts = [len(p) for p in pieces]
    coded = iter(idcoder.encode([x for p in pieces for x in p], vocabulary, sets_of(counts, together)))
    out = []
    for frame, own in zip(docs, pieces):
        words = [next(coded) for _ in own]
        head = (
            MAGIC
            + HEAD.pack(vocabulary, block, together, len(frame), len(own))
            + np.array([d for d, _ in frame], "<i8").tobytes()
            + np.array([len(i) for _, i in frame], "<u4").tobytes()
            + np.array([idcoder.checksum(x) for x in own], "<u4").tobytes()
            + np.array([len(w) for w in words], "<u4").tobytes()
        )
        out.append(head + struct.pack("<I", zlib.crc32(head)) + b"".join(words))
    return out


def documents_of(data: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """The (doc_id, ids) of each frame; all blocks are decoded together."""
    heads, blocks, sums = [], [], []
    for f in data:
        if f[:4] != MAGIC or len(f) < 4 + HEAD.size:
            raise Damaged("not a frame")
        vocabulary, block, together, n_docs, n_blocks = HEAD.unpack_from(f, 4)
        at = 4 + HEAD.size
        end = at + 12 * n_docs + 8 * n_blocks
        if f[end : end + 4] != struct.pack("<I", zlib.crc32(f[:end])):
            raise Damaged("a frame's head differs from its checksum")
        doc_ids = np.frombuffer(f, "<i8", n_docs, at)
        sizes = np.frombuffer(f, "<u4", n_docs, at + 8 * n_docs)
        checks = np.frombuffer(f, "<u4", n_blocks, at + 12 * n_docs)
        coded = np.frombuffer(f, "<u4", n_blocks, end - 4 * n_blocks)
        at, left = end + 4, int(sizes.sum(dtype=np.int64))
        for c, size in zip(checks.tolist(), coded.tolist()):
            blocks.append((f[at : at + size], min(block, left)))
            sums.append(c)
            at, left = at + size, left - min(block, left)
        heads.append((vocabulary, together, doc_ids, sizes, n_blocks))
    if not heads:
        return []
    if len({h[:2] for h in heads}) > 1:
        raise ValueError("frames read together have one vocabulary and one size of sets")
    ids = idcoder.decode(blocks, heads[0][0], sets_of([h[4] for h in heads], heads[0][1]))
    for got, want in zip(ids, sums):
        if idcoder.checksum(got) != want:
            raise Damaged("a block's ids differ from its checksum")
    out, at = [], 0
    for _, _, doc_ids, sizes, n in heads:
        flat = np.concatenate(ids[at : at + n]) if n else np.zeros(0, np.int32)
        out.append(list(zip(doc_ids.tolist(), np.split(flat, np.cumsum(sizes, dtype=np.int64)[:-1]))))
        at += n
    return out


FRAMES_SQL = "part int, start long, n_ids long, frame binary"


def written(df: DataFrame, end_id: int = END_ID, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of every document in ascending doc_id order; gives the table of frames read back from the files."""
    path = path or common.tokenizer_path(VOCABULARY)
    schema = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("frame", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        held: list[list[tuple[int, np.ndarray]]] = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal start, held, sizes
            starts = start + np.cumsum([0, *sizes])[:-1]
            out = pa.RecordBatch.from_arrays([pa.array([part] * len(held), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(frames(held, VOCABULARY_SIZE), pa.binary())], schema=schema)
            start += sum(sizes)
            held, sizes = [], []
            return out

        for b in batches:
            for low, high in common.text_slices(b.column("text")):
                rows = b.slice(low, high - low)
                encoded = common.word_ends(path).look_up(rows.column("text").to_pylist())
                for doc, own in zip(rows.column("doc_id").to_pylist(), encoded):
                    ids = np.append(own, np.uint16(end_id))
                    if not held or sizes[-1] >= FRAME or sizes[-1] + len(ids) > 2 * FRAME:
                        if sum(sizes) >= GATHER:
                            yield flush()
                        held.append([])
                        sizes.append(0)
                    held[-1].append((doc, ids))
                    sizes[-1] += len(ids)
        if held:
            yield flush()

    docs = common.base(df, id_col, text_col)
    ordered = docs.repartitionByRange(common.partitions(df.sparkSession), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return common.saved(ordered.mapInArrow(write, FRAMES_SQL), "frames")


def read_back(table: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the frames; start counts all ids before it."""
    spark = table.sparkSession
    # One row for each part.
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, bases = 0, []
    for p in parts:
        bases.append((p["part"], before))
        before += p["n"]
    offsets = spark.createDataFrame(bases, "part int, base long")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for (at, _), docs in zip(held, documents_of([f for _, f in held])):
                for doc, ids in docs:
                    rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], schema=schema)

        for b in batches:
            for base, start, n, frame in zip(*(b.column(c).to_pylist() for c in ("base", "start", "n_ids", "frame"))):
                held.append((base + start, frame))
                size += n
                if size >= GATHER:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    joined = table.join(F.broadcast(offsets), "part").select("base", "start", "n_ids", "frame")
    return common.null_ids(joined.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(written(common.documents(spark, sf_dir)))
