"""Near-duplicate components from bottom-k sketches.

A document's set is that of its word shingles, hashed by one 64-bit function;
its sketch is the ``k`` least hashes.  Rows with equal sets are one class from
the start, so copies never meet.  Each retained value has an inverted list of
the classes that retain it.

Of two sets at the threshold, at least ``need`` of the union's k least values
stand in both sketches, but for a chance of ``LOSS`` (sets that fit whole: for
certain).  So a class with fewer than ``need`` values that any other class
retains has no partner, and two partners meet in the list of at least one of
their ``shared - need + 1`` rarest shared values, whatever the rest is: a passage
that many texts share is among the commonest values of each, and texts that it
does not fill never meet there.  Only these prefixes are listed.

Lists of up to ``SHORT`` classes give all their pairs.  In a longer one every
class meets the list's leader, the one with most of the common values, so a
group of near copies is connected by one comparison a member.  What stays
outside a list's largest component after that meets the members of the other
components in blocks of bounded size, whole sets against whole sets, and only
links that join two components leave a block.  No pair that shares a list goes
unexamined unless its classes are already connected.

A pair's similarity is first estimated from the sketch of the union; pairs whose
estimate is out of reach (probability of a loss under ``LOSS``) are dropped, all
others are computed from the full sets.  Components come from rounds of
hooking and pointer jumping over the links, with the labels written out between
rounds.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  A document with fewer
words than a shingle has the whole sequence as its only one; without words (or
text) the set is empty and links with nothing.  Rows are judged by their texts:
rows with one doc_id and different texts are joined by their similarity alone,
and rows with equal sets share a component.  Ties go by doc_id, then by a hash
of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm import common, rolling, substrings

K = 64
#: Classes in a list whose pairs are all taken.
SHORT = 32
#: Chance of losing a pair at the threshold by its sketches.
LOSS = 1e-9
#: Classes, and shingles, of the two sides of a block (a single larger class makes a block of its own).
ASKING, ASKED, WEIGHT = 512, 2048, 1 << 20


def shingles(text: str, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    h = rolling.spans(substrings.word_hashes(words), min(width, len(words)))
    return np.unique(h)


def least_overlap(k: int, threshold: float, loss: float = LOSS) -> int:
    """The number of shared values among k that a pair at the threshold stays under with a chance below loss."""
    chance = 0.0
    for x in range(k + 1):
        chance += comb(k, x) * threshold**x * (1 - threshold) ** (k - x)
        if chance > loss:
            return x
    return k


SKETCH = "doc_id long, row_hash long, n long, set_hash long, set_hash2 long, sketch array<long>"


def sketches(df: DataFrame, width: int, k: int = K) -> DataFrame:
    """One row for each document: the set's size, two hashes of it, and its k least values (as unsigned, ascending)."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("n", pa.int64()), ("set_hash", pa.int64()), ("set_hash2", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def sketch(ids: list[int], texts: list[str]) -> list:
        import xxhash

        rows, kept = [], []
        for t in texts:
            s = shingles(t, width)
            whole = s.tobytes()
            rows.append((substrings.text_hash(t), len(s), xxhash.xxh64_intdigest(whole, 1) - 2**63, xxhash.xxh64_intdigest(whole, 2) - 2**63))
            kept.append(s[:k].view(np.int64))
        ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)))
        return [ids, *([r[i] for r in rows] for i in range(4)), values]

    return df.mapInArrow(common.per_slice(sketch, schema), SKETCH)


def lists(classes: DataFrame, percent: int, k: int = K) -> DataFrame:
    """(value, cls, n, need, rest, weight, members): the inverted lists of the classes' prefixes.

    rest counts the class's shared values from this one on, weight is the sum
    of the list lengths of all its shared values.
    """
    entries = classes.select("cls", "n", F.explode("sketch").alias("value"))
    # Aggregates are saved before they are joined: only then may Spark split a join's hot keys.
    often = common.saved(entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "often")
    need = F.least(F.lit(least_overlap(k, percent / 100)), F.floor((F.col("n") * percent + 99) / 100))
    own = (
        entries.join(often.hint("shuffle_hash"), "value")
        .groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("l"), F.sum("df").alias("weight"))  # k values at most
        .withColumn("shared", F.size("l").cast("long")).withColumn("need", need)
        .where("shared >= need")
    )
    prefix = F.slice("l", F.lit(1), (F.col("shared") - F.col("need") + 1).cast("int"))
    prefixes = common.saved(own.select("cls", "n", "need", "shared", "weight", F.posexplode(prefix).alias("at", "v")).select("cls", "n", "need", (F.col("shared") - F.col("at")).alias("rest"), "weight", F.col("v.value").alias("value")), "prefixes")
    sized = common.saved(prefixes.groupBy("value").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "sized")
    out = common.saved(prefixes.join(sized, "value"), "lists")
    common.dropped(often, prefixes, sized)
    return out


def estimated(pairs: DataFrame, classes: DataFrame, threshold: float, k: int = K) -> DataFrame:
    """The pairs (a, b) whose union sketch does not rule the threshold out."""
    least = least_overlap(k, threshold)

    def arrays(column: pa.ListArray) -> list[np.ndarray]:
        ends, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        return [values[i:j] for i, j in zip(ends, ends[1:])]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n1, n2, x, y in zip(b.column("na").to_pylist(), b.column("nb").to_pylist(), arrays(b.column("sa")), arrays(b.column("sb"))):
                both = np.intersect1d(x, y, assume_unique=True)
                if n1 <= k and n2 <= k:  # whole sets: exact
                    keep.append(len(both) >= threshold * (n1 + n2 - len(both)) - 1e-9)
                    continue
                # Values past the shorter sketch's end say nothing: the k-th of the union is the last that counts.
                end = np.partition(np.r_[x, np.setdiff1d(y, both, assume_unique=True)], k - 1)[k - 1]
                keep.append(int(np.searchsorted(both, end, "right")) >= least)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    left = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(near, "a long, b long")


def compared(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, b, shared, total): intersection and union sizes of the full sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("total", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, last, own = [], None, None
            for x, y, tx, ty in zip(*(b.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))):
                if x != last:
                    last, own = x, shingles(tx, width)
                other = shingles(ty, width)
                both = len(np.intersect1d(own, other, assume_unique=True))
                rows.append((x, y, both, len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], schema=schema)

    left = texts.select(F.col("cls").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("cls").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long, shared long, total long")


def in_blocks(percent: int) -> Callable:
    """An Arrow mapper from rows sorted by (value, ask, answer, side) to links (a, b).

    side 0 rows are asked for, side 1 rows answer; each has its class, label and
    whole set.  Of the links of a block only those leave it that join two
    components not joined yet.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, index = None, [], None
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while joined.setdefault(x, x) != x:
                joined[x] = x = joined[joined[x]]
            return x

        for b in batches:
            out: list[tuple[int, int]] = []
            names = ("value", "ask", "answer", "side", "cls", "label")
            for value, ask, answer, side, cls, label, data in zip(*(b.column(c).to_pylist() for c in names), b.column("set")):
                if (value, ask, answer) != unit:
                    unit, held, index, joined = (value, ask, answer), [], None, {}
                own = np.frombuffer(data.as_buffer(), np.uint64)
                if not side:
                    held.append((cls, label, own))
                    continue
                if not held:
                    continue
                if index is None:  # the asking sets, inverted
                    sizes = np.array([len(x[2]) for x in held])
                    flat = np.concatenate([x[2] for x in held])
                    order = np.argsort(flat, kind="stable")
                    who = np.repeat(np.arange(len(held)), sizes)[order]
                    flat = flat[order]
                    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
                    index = flat[first], np.r_[first, len(flat)], who, sizes
                values, edge, who, sizes = index
                at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                at = at[values[at] == own]
                start, n = edge[at], edge[at + 1] - edge[at]
                hits = who[np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(at) else np.zeros(0, np.int64)
                both = np.bincount(hits, minlength=len(held))
                for i in np.flatnonzero((both * 100 >= (sizes + len(own) - both) * percent) & (both > 0)).tolist():
                    x, y = root(held[i][1]), root(label)
                    if x != y:
                        joined[x] = y
                        out.append((held[i][0], cls))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], schema=schema)

    return run


def links(classes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], percent: int, width: int, k: int = K) -> DataFrame:
    """(a, b) of classes with 100 * intersection >= percent * union, enough of them to connect all that are linked."""
    listed = lists(classes, percent, k)
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    # All pairs of the short lists, at most SHORT - 1 for each entry, that can still share enough from this value on.
    short = (
        listed.where(F.col("members") <= SHORT)
        .groupBy("value").agg(F.sort_array(F.collect_list(F.struct("cls", "n", "need", "rest"))).alias("l"))
        .select("l", F.explode(F.sequence(F.lit(0), F.size("l") - 2)).alias("i"))
        .select(F.col("l")[F.col("i")].alias("x"), F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("y"))
        .where("x.need <= y.rest and y.need <= x.rest")
        .select(F.col("x.cls").alias("a"), F.col("x.n").alias("n"), F.col("y.cls").alias("b"), F.col("y.n").alias("m"))
    )
    long = listed.where(F.col("members") > SHORT)
    leaders = common.saved(long.groupBy("value").agg(F.max(F.struct("weight", F.xxhash64("cls").alias("h"), "cls", "n")).alias("top")).select("value", F.col("top.cls").alias("a"), F.col("top.n").alias("m")), "leaders")
    led = long.join(leaders, "value").where("a <> cls").select(F.least("a", "cls").alias("a"), "n", F.greatest("a", "cls").alias("b"), "m")
    pairs = short.unionByName(led).where(fits).select("a", "b").distinct()
    near = common.saved(estimated(pairs, classes, percent / 100, k), "near")
    texts = texts_of(near.select(F.col("a").alias("cls")).union(near.select("b")).union(long.select("cls")).distinct())
    good = common.saved(compared(near, texts, width).where(F.col("shared") * 100 >= F.col("total") * percent).select("a", "b"), "links")
    common.dropped(leaders, near)
    # Long lists with several components left: those outside the largest ask, the others answer.
    labels = components(good)
    named = common.saved(long.join(labels, long["cls"] == labels["node"], "left").select("value", "cls", "n", F.coalesce("label", "cls").alias("label")), "named")
    parts = named.groupBy("value", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    blocks = lambda c, t, most: F.greatest(F.ceil(c / most), F.ceil(t / WEIGHT)).cast("int")
    open_ = (
        parts.groupBy("value").agg(F.max(F.struct("c", "label", "t")).alias("main"), F.sum("c").alias("c"), F.sum("t").alias("t"), F.count(F.lit(1)).alias("labels"))
        .where("labels > 1")
        .select("value", F.col("main.label").alias("main"), blocks(F.col("c") - F.col("main.c"), F.col("t") - F.col("main.t"), ASKING).alias("asking"), blocks(F.col("c"), F.col("t"), ASKED).alias("asked"))
    )
    open_ = common.saved(open_, "open")
    left = common.saved(named.join(open_, "value"), "left")
    sets = common.saved(sets_of(texts.join(left.select("cls").distinct(), "cls"), width), "sets")
    every = left.join(sets, "cls")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asks = every.where("label <> main").withColumn("ask", F.pmod(F.xxhash64("cls"), "asking").cast("int")).select("value", "ask", spread(F.col("asked")).alias("answer"), F.lit(0).alias("side"), "cls", "label", "set")
    answers = every.withColumn("answer", F.pmod(F.xxhash64("cls"), "asked").cast("int")).select("value", spread(F.col("asking")).alias("ask"), "answer", F.lit(1).alias("side"), "cls", "label", "set")
    units = asks.unionByName(answers).repartition("value", "ask", "answer").sortWithinPartitions("value", "ask", "answer", "side", "cls")
    more = common.saved(units.mapInArrow(in_blocks(percent), "a long, b long"), "links")
    found = common.saved(good.unionByName(more).distinct(), "links")
    common.dropped(listed, texts, labels, named, open_, left, sets, good, more)
    return found


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """(cls, set): the whole shingle sets as little-endian binary."""
    schema = pa.schema([("cls", pa.int64()), ("set", pa.binary())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, common.SLICE):
                part = b.slice(at, common.SLICE)
                yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array([shingles(t, width).tobytes() for t in part.column("text").to_pylist()], pa.binary())], schema=schema)

    return texts.select("cls", "text").mapInArrow(whole, "cls long, set binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge: the least node that it can reach.

    Edges are turned into stars: each round hooks the neighbours of a node to
    its least neighbour, first from the larger and then from the smaller side,
    until nothing changes.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = common.saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        nearest = both(now).groupBy("a").agg(F.min("b").alias("least"))
        large = both(now).join(nearest, "a").where("b > a").select(F.col("b").alias("a"), F.least("least", "a").alias("b")).distinct()
        large = common.saved(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct()
        after = common.saved(small, "edges")
        state = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        common.dropped(now, large)
        now = after
        if state == before:
            return common.like(now.select(F.col("a").alias("node"), F.col("b").alias("label")), now)
        before = state


def near_duplicates(df: DataFrame, percent: int = 80, width: int = 5, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_hash, n_shingles, component_id, least_hash of every row; least_hash is the row_hash of the component's first row, which component_id is the doc_id of."""
    docs = common.base(df, id_col, text_col)
    rows = common.saved(sketches(docs, width, k), "sketches")
    full = rows.where("n > 0")
    # A class: rows with one set.  It goes by its least row.
    classes = common.saved(
        full.groupBy("set_hash", "set_hash2", "n").agg(F.min(F.struct("doc_id", "row_hash")).alias("r"), F.first("sketch").alias("sketch")).select("set_hash", "set_hash2", "n", F.col("r.doc_id").alias("doc_id"), F.col("r.row_hash").alias("row_hash"), "sketch", F.monotonically_increasing_id().alias("cls")),
        "classes",
    )

    def texts_of(wanted: DataFrame) -> DataFrame:
        """The texts of some classes."""
        at = classes.join(wanted, "cls").select("doc_id", "row_hash", "cls")
        # Repeated rows bring a class several times, but with one text.
        return common.saved(substrings.with_row_hash(docs).join(at.hint("shuffle_hash"), ["doc_id", "row_hash"]).groupBy("cls").agg(F.first("text").alias("text")), "texts")

    found = links(classes, texts_of, percent, width, k)
    labels = components(found)
    named = classes.join(labels, classes["cls"] == labels["node"], "left").select("set_hash", "set_hash2", "doc_id", "row_hash", F.coalesce("label", "cls").alias("label"))
    least = common.saved(named.groupBy("label").agg(F.min(F.struct("doc_id", "row_hash")).alias("first")), "least")
    of = common.saved(named.join(least, "label").select("set_hash", "set_hash2", F.col("first.doc_id").alias("component_id"), F.col("first.row_hash").alias("least_hash")), "components")
    out = common.saved(
        rows.join(of, ["set_hash", "set_hash2"], "left").select("doc_id", "row_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("least_hash", "row_hash").alias("least_hash")),
        "near-duplicates",
    )
    common.dropped(rows, classes, found, labels, least, of)
    return out


def report(df: DataFrame, percent: int = 85, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    found = near_duplicates(df, percent, width, id_col=id_col, text_col=text_col)
    return common.null_ids(found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")), "doc_id", "component_id")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.documents(spark, sf_dir))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * n_both >= 85 * (p.n + q.n - n_both)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
walk AS (SELECT a AS node, a AS seen FROM edges UNION SELECT walk.node, e.b FROM walk JOIN edges e ON e.a = walk.seen),
comp AS (SELECT node, min(seen) AS c FROM walk GROUP BY node)
SELECT w.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN size ON size.doc_id = w.doc_id LEFT JOIN comp ON comp.node = w.doc_id
"""
