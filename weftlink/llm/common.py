"""Shared pieces: shared-folder tables, distributed ranks, unit-wise tokenizing.

Conventions of every operator here:

* A null ``doc_id`` is a value of its own that sorts before every other id and
  comes back as null.  A null text is the empty text.
* Only the id and the text column are read; other columns, whatever their
  names, never meet the operator's own.
* Rows are the unit: repeated rows give repeated result rows.
* An empty table gives an empty table of the same schema.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside the operators.
NULL_ID = -(2**63)
#: Entries of a worker's table of encoded units; the table is emptied beyond it.
TABLE_SIZE = 700_000
#: In a table of units: this text must be encoded whole.
WHOLE = None
#: Documents handled at once inside a worker.
SLICE = 256
#: Bytes of text handled at once where words that repeat are to be met once.
TEXTS = 1 << 21


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def base(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) without nulls, and no other column."""
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def null_ids(df: DataFrame, *names: str) -> DataFrame:
    """Turns the stand-in for null ids back into null."""
    return df.withColumns({n: F.nullif(F.col(n), F.lit(NULL_ID)) for n in (names or ("doc_id",))})


#: Stands in for spark.checkpoint.dir where the session names none, as in a test.
_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; only a local session, as in a test, does without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        if not _OWN_DIR:
            _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="weftlink-"))
        found = _OWN_DIR[0]
    return found.rstrip("/")


def saved(df: DataFrame, name: str, partitions: list[str] | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later steps do not repeat the work, nor need the executors that did it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftlink-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    (df.write.partitionBy(*partitions) if partitions else df.write).parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back._weftlink_path = path
    return back


def like(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, a view of a table made by saved(), so that dropped() finds the table."""
    df._weftlink_path = table._weftlink_path
    return df


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by saved() that nothing will read again."""
    for df in tables:
        path = getattr(df, "_weftlink_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, group: str, order: list[str], name: str, rank: str, weight: str | None = None) -> DataFrame:
    """Adds rank: the row's gapless place (or, with weight, the sum of weight before it) among the rows of its group.

    Rows are range-sorted by (group, order), so that a group of any size
    spreads over many tasks.  What reaches the driver is one row for each pair
    of partition and group that meet: partitions + groups rows at most.
    """
    amount = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    cols = df.columns
    table = saved(
        df.repartitionByRange(partitions(df.sparkSession), group, *order).sortWithinPartitions(group, *order).select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_at"), amount.alias("_w")),
        name,
    )
    sums = table.groupBy("_pid", group).agg(F.sum("_w").alias("n"), F.min("_at").alias("first")).collect()
    seen: dict = {}
    bases = []
    for r in sorted(sums, key=lambda r: (r["_pid"], r["first"])):
        bases.append((r["_pid"], r[group], seen.get(r[group], 0), r["first"]))
        seen[r[group]] = seen.get(r[group], 0) + r["n"]
    kind = dict(table.dtypes)[group]
    small = df.sparkSession.createDataFrame(bases, f"_pid int, _group {kind}, _base long, _first long")
    joined = table.join(F.broadcast(small), (table["_pid"] == small["_pid"]) & table[group].eqNullSafe(small["_group"])).drop(small["_pid"])
    if weight is None:
        value = F.col("_base") + F.col("_at") - F.col("_first")
    else:
        from pyspark.sql import Window

        within = Window.partitionBy("_pid", group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        value = F.col("_base") + F.coalesce(F.sum("_w").over(within), F.lit(0))
    return joined.select(*cols, value.cast("long").alias(rank))


def per_slice(handle: Callable[[list[int], list[str]], list], schema: str | pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow mapper over (doc_id, text): handle gets some documents at a time and returns columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                cols = handle(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def text_slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about TEXTS bytes of text; a longer text ends one."""
    end = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
    edges = np.flatnonzero(np.diff(end // TEXTS, prepend=0)) + 1
    for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(end)]):
        if low < high:
            yield low, high


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class UnitTable:
    """Texts cut at single spaces into units, each distinct unit encoded once.

    ``encode`` turns a list of units into their values.  A unit after the first
    carries its leading space.  ``joint`` tells whether a unit of this text may
    be encoded by itself; texts where it may not go to ``whole``.
    """

    def __init__(self, encode: Callable[[list[str]], list], whole: Callable[[str], object], spaced: bool, special: tuple[str, ...]):
        self.encode, self.whole, self.spaced, self.special = encode, whole, spaced, special
        self.table: dict[str, object] = {}

    def units(self, text: str) -> list[str] | None:
        """The units, or None if the text must be encoded whole.  The first is marked, as it has no space before it."""
        if any(s in text for s in self.special) or self.spaced and "\0" in text:
            return None
        units = text.split(" ")
        if self.spaced:
            units[0] = "\0" + units[0]
        return units

    def look_up(self, texts: Iterable[str]) -> list[list]:
        """For each text the list of its units' values, or one value for the whole text."""
        split = [self.units(t) for t in texts]
        if len(self.table) > TABLE_SIZE:
            self.table.clear()
        new = set(chain.from_iterable(u for u in split if u is not None)) - self.table.keys()
        if new and self.spaced:
            firsts = [u for u in new if u[:1] == "\0"]
            # An empty unit, or one that starts with white space, belongs to a longer run of white space.
            alone = {u for u in new if not u or u[0].isspace()}
            rest = [u for u in new if u[:1] != "\0" and u not in alone]
            self.table.update(dict.fromkeys(alone, WHOLE))
            self.table.update(zip(firsts, self.encode([u[1:] for u in firsts])))
            self.table.update(zip(rest, self.encode([" " + u for u in rest])))
        elif new:
            rest = list(new)
            self.table.update(zip(rest, self.encode(rest)))
        get = self.table.__getitem__
        out = []
        for u, t in zip(split, texts):
            values = [WHOLE] if u is None else list(map(get, u))
            if WHOLE in values:
                values = [self.whole(t)]
            out.append(values)
        return out


#: The pre-tokenizer's chunks of ASCII text, and whether the text is lower-cased before.
ASCII_CHUNKS = {"byte_bpe_50k.json": (r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", False)}


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def same_merges(path: str) -> dict[bytes, int] | None:
    """The ranks beside a byte-level vocabulary, if they say the same; None if there are none or they do not.

    Every entry must have its rank as id, and the i-th merge must make the
    entry of the i-th rank after the single bytes.  A merge of two neighbours
    into an entry then happens by the one table exactly when it does by the
    other: inside an entry's bytes nothing crosses its ends before, so they are
    merged as they would be alone, which is how the entry came about.
    """
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not path.endswith(".json") or not os.path.exists(ranks):
        return None
    import base64
    import json

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    to = byte_of()
    raw = lambda entry: bytes(to[c] for c in entry)
    special = {x["content"] for x in found["added_tokens"]}
    vocabulary = {raw(k): v for k, v in found["model"]["vocab"].items() if k not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in found["model"]["merges"]]
    singles = len(vocabulary) - len(merges)
    same = vocabulary == table and all(table.get(raw(a) + raw(b)) == singles + i for i, (a, b) in enumerate(merges))
    return table if same else None


class WordEnds:
    """Texts to ids by a vocabulary whose words end in a mark of their own, as the tokenizers library gives them.

    Texts are put in normal form and lower case, cut into words by the classes
    of their characters, all texts at hand at once, and every word gets MARK
    behind it; the vocabulary's merges then stand as ranks over bytes with MARK
    for the word's end.  Among the texts at hand each distinct word is encoded
once.  Texts with special strings, with MARK itself or with a
    character whose class or lower case depends on more than itself (UNSURE)
    go to the library.  None of it is used unless every merge makes the entry
    of its own place.
    """

    MARK = "\x01"
    UNSURE = re.compile("[\u03a3\u0130\x01\x1c-\x1f]")
    SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
    #: The pattern's white space (fixed values).
    SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
    #: The pattern's endings after an apostrophe (fixed values).
    ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

    def __init__(self, path: str):
        import json
        import sys
        import unicodedata

        import tiktoken
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        self.library = lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.uint16)
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        self.special = tuple(x["content"] for x in found["added_tokens"])
        end, to = found["model"]["end_of_word_suffix"], byte_of()
        raw = lambda e: bytes(to[c] for c in e.removesuffix(end)) + (self.MARK.encode() if e.endswith(end) else b"")
        vocabulary = found["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in found["model"]["merges"]]
        # Single bytes, then bytes that end a word, then the merges in order.
        made = [*(a for a in vocabulary if a in to), *(a for a in vocabulary if a.removesuffix(end) in to and a not in to), *(a.removesuffix(end) + b for a, b in merges)]
        ranks = {raw(e): i for i, e in enumerate(made)}
        self.sure = set(made) == set(vocabulary) - set(self.special) and len(made) == len(set(made)) == len(ranks) and all(a.endswith(end) is False for a, _ in merges) and all(bytes([b]) in ranks for b in range(256))
        if self.sure:
            self.ids = np.array([vocabulary[e] for e in made], np.uint16)
            self.closes = np.array([e.endswith(end) for e in made])
            self.encode = tiktoken.Encoding("words", pat_str=f"[^{self.MARK}]*{self.MARK}", mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
            kinds = {"L": self.LETTER, "N": self.DIGIT}
            self.kinds = np.array([kinds.get(unicodedata.category(chr(c))[0], self.OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
            self.kinds[[ord(c) for c in self.SPACES]] = self.SPACE
            self.unassigned = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])
            self.normal = lambda t: t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)

    def marked(self, texts: list[str]) -> tuple[str, list[tuple[int, int] | None]]:
        """All texts' words with MARK behind each, and each text's range of words; None for a text that the library must see."""
        low = [None if self.UNSURE.search(t) or any(s in t for s in self.special) else self.normal(t).lower() for t in texts]
        # A space after each text keeps words apart.
        chars = np.frombuffer("".join([f"{t} " for t in low if t is not None]).encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.kinds[chars]
        # A word ends where the kind changes, and after every digit.
        ends = np.empty(len(chars), bool)
        ends[:-1] = kind[:-1] != kind[1:]
        ends[-1:] = True
        ends |= kind == self.DIGIT
        begins = np.flatnonzero((chars == 39) & np.r_[True, kind[:-1] != self.OTHER])
        for i in begins.tolist():
            tail = chars[i + 1 : i + 3].tobytes().decode("utf-32-le", "surrogatepass")
            for e in self.ENDINGS:
                if tail.startswith(e):
                    ends[i] = False
                    ends[i + len(e)] = True
                    break
        kept = kind != self.SPACE
        ends &= kept
        # Every kept character goes to its place among the kept ones and the marks before it.
        size = kept.astype(np.int8) + ends
        at = np.cumsum(size, dtype=np.int64) - size
        out = np.full(int(size.sum(dtype=np.int64)), ord(self.MARK), "<u4")
        out[at[kept]] = chars[kept]
        whole = out.tobytes().decode("utf-32-le", "surrogatepass")
        # The words that end before each text's end.
        stops = np.cumsum([len(t) + 1 for t in low if t is not None], dtype=np.int64)
        words = np.searchsorted(np.flatnonzero(ends), stops)
        odd = self.unassigned[chars].any()
        done, first, result = 0, 0, []
        rest = zip(stops.tolist(), words.tolist())
        for t in low:
            if t is None:
                result.append(None)
                continue
            stop, last = next(rest)
            result.append(None if odd and self.unassigned[chars[done:stop]].any() else (first, last))
            done, first = stop, last
        return whole, result

    def look_up(self, texts: list[str]) -> list[np.ndarray]:
        """The ids (uint16) of each text."""
        if not self.sure:
            return [self.library(t) for t in texts]
        whole, ranges = self.marked(texts)
        data = whole.encode("utf-8", "surrogatepass")
        stops = np.r_[0, np.flatnonzero(np.frombuffer(data, np.uint8) == ord(self.MARK)) + 1]
        words = pa.Array.from_buffers(pa.large_binary(), len(stops) - 1, [None, pa.py_buffer(stops), pa.py_buffer(data)]).dictionary_encode()
        _, places, distinct = words.dictionary.buffers()
        last = int(np.frombuffer(places, np.int64, len(words.dictionary) + 1)[-1]) if len(words) else 0
        ranks = self.encode(distinct[:last].to_pybytes().decode("utf-8", "surrogatepass") if last else "", disallowed_special=())
        # A word's last entry is its only one with MARK.
        end = np.flatnonzero(self.closes[ranks]) + 1
        start = np.r_[0, end[:-1]]
        at = words.indices.to_numpy()
        size = (end - start)[at]
        edge = np.r_[0, np.cumsum(size)]
        ids = self.ids[ranks[np.repeat(start[at] - edge[:-1], size) + np.arange(edge[-1])]]
        return [self.library(t) if r is None else ids[edge[r[0]] : edge[r[1]]] for t, r in zip(texts, ranges)]


_WORD_ENDS: dict[str, WordEnds] = {}


def word_ends(path: str) -> WordEnds:
    """One for each worker process."""
    if path not in _WORD_ENDS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _WORD_ENDS[path] = WordEnds(path)
    return _WORD_ENDS[path]


_WHOLE: dict[str, Callable[[str], np.ndarray]] = {}


def text_encoder(path: str) -> Callable[[str], np.ndarray]:
    """Whole texts to ids (uint32) as the tokenizers library gives them, without added ids.

    Where the vocabulary also stands there as ranks that say the same (see
    same_merges), texts without special strings are encoded by these with the
    vocabulary's published pattern; all others by the library.
    """
    if path not in _WHOLE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        with open(path, encoding="utf-8") as f:
            special = tuple(x["content"] for x in json.load(f)["added_tokens"])
        library = lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)
        table, fast = same_merges(path), None
        if table:
            import public_tokenizers
            import tiktoken

            fast = tiktoken.Encoding("texts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_to_numpy
        _WHOLE[path] = lambda text: library(text) if fast is None or any(s in text for s in special) else fast(text, disallowed_special=())
    return _WHOLE[path]


def crc32_of(col: Column) -> Column:
    """Unsigned crc32 of a string's UTF-8 bytes (null: of nothing)."""
    return F.crc32(F.encode(F.coalesce(col, F.lit("")), "UTF-8"))
