"""Nulls, repeated rows, clashing columns, empty tables and very long texts, for every operator."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_operators import brute_words, library

import corpus_pipeline
from weftlink.llm import common, neardup, packing, pieces, quality, rolling, search, sharding, stages, substrings, suffixes, token_counts, tokenfile

#: Names that the operators use inside, as input columns.
CLASHES = "row_hash, anchor, content, size, shard, slot, unit, big, rank, length, sequence_id, offset, value, cls, label, set_hash, sketch, n, spans, low, high, text_crc32, __key, __row, __hash, __spans, rows, kept, terms, query_id".split(", ")
SCHEMA = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *(["keep"] * len(CLASHES))) for i, t in rows], SCHEMA)


ROWS = [(None, "no id"), (None, None), (None, "no id"), (3, None), (3, ""), (3, "twice the same"), (3, "twice the same"), (4, "another text"), (4, "yet another text"), (5, " \t\n")]
OPERATORS = {
    1: quality.measures, 2: packing.pack, 3: lambda df: token_counts.token_counts(df, 512), 4: lambda df: tokenfile.read_back(tokenfile.written(df)), 5: neardup.report,
    7: substrings.digests, 8: suffixes.digests, 9: pieces.digests, 10: sharding.shards_by_bytes,
}


@pytest.mark.parametrize("number", OPERATORS)
def test_odd_rows_and_clashing_columns(spark, number):
    operator = OPERATORS[number]
    got = operator(frame(spark, ROWS)).collect()
    plain = operator(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ROWS)
    if number != 2:  # which of equal pieces comes first is free
        assert sorted(map(str, got)) == sorted(map(str, plain))
    assert operator(frame(spark, [])).collect() == []


def test_search_with_clashing_columns(spark):
    got = search.search(frame(spark, ROWS), spark.createDataFrame([(1, "another no", "x")], "query_id long, text string, doc_id string")).collect()
    assert Counter((r["query_id"], r["doc_id"]) for r in got) == Counter([(1, None), (1, None), (1, 4), (1, 4)])


def long_rows(seed, unit_count):
    r = random.Random(seed)
    first = [f"w{r.randrange(3000)}" for _ in range(unit_count)]
    at = rolling.SEGMENT - 300  # a passage across the border of two segments
    second = [f"v{r.randrange(3000)}" for _ in range(400)] + first[at : at + 600] + ["tail"] * 3
    return [(1, " ".join(first)), (2, " ".join(second)), (3, "short")]


def test_substring_dedup_of_very_long_texts(spark):
    rows = long_rows(1, rolling.SEGMENT + 4000)
    got = substrings.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_words(rows, 50)
    assert {r["doc_id"]: r["n_removed"] for r in got}[2] == 600


def test_byte_dedup_of_very_long_texts(spark):
    r = random.Random(4)
    long = "".join(r.choice("abcdefghij ") for _ in range(rolling.SEGMENT + 9000))
    at = rolling.SEGMENT - 700
    rows = [(1, long), (2, "x" * 50 + long[at : at + 1500] + "y" * 50)]
    got = {x["doc_id"]: x for x in suffixes.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, text in rows:
        raw = text.encode()
        begin = raw.index(long[at : at + 1500].encode())
        rest = raw[:begin] + raw[begin + 1500 :]
        assert (got[doc]["n_removed"], got[doc]["n_spans"], got[doc]["kept_sha256"]) == (1500, 1, hashlib.sha256(rest).hexdigest())


def test_tokens_of_very_long_texts(spark):
    text = " ".join(f"word{i % 977}" for i in range(160_000))
    assert len(text) > tokenfile.FRAME
    df = spark.createDataFrame([(1, text), (2, "end")], "doc_id long, text string")
    ids = [*library("word_bpe_49k.json").encode(text, add_special_tokens=False).ids, 2]
    got = {r["doc_id"]: r for r in tokenfile.read_back(tokenfile.written(df)).collect()}
    assert (got[1]["n_tokens"], got[1]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and got[2]["start"] == len(ids)
    n = len(library("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, 512).collect()}[1] == n
    cut = packing.pack(df).where("doc_id = 1").collect()
    assert sum(r["length"] for r in cut) == n + 1 and max(r["length"] for r in cut) == packing.CAPACITY


def test_factors_are_greedy_and_long_enough():
    assert rolling.factors([(0, 10), (1, 11), (2, 12), (30, 40)], 10) == [(0, 12), (30, 40)]
    assert rolling.factors([(0, 10), (2, 12)], 10) == [(0, 10), (2, 12)]  # the window between them is not in the reference
    assert rolling.factors([(5, 9), (0, 3)], 5) == []
    r = random.Random(6)
    for _ in range(200):
        windows = {i for i in range(40) if r.random() < 0.6}
        got = rolling.factors([(i, i + 7) for i in windows], 7)
        assert {j for lo, hi in got for j in range(lo, hi)} == {j for i in windows for j in range(i, i + 7)}
        assert all(i in windows for lo, hi in got for i in range(lo, hi - 6))


def test_stages_keep_one_row_of_repeats_and_all_columns(spark):
    words = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"other{i}" for i in range(40))
    rows = [(None, words), (None, words), (1, words + " tail"), (1, other), (1, other), (2, None), (2, None), (3, "")]
    got = stages.near_dedup(spark, frame(spark, rows), "").collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(None, words), (1, other), (2, None), (2, None), (3, "")])
    assert all(r[c] == "keep" for r in got for c in CLASHES)
    # Rows equal in id and text, but not in other columns: the choice repeats.
    df = spark.createDataFrame([(1, words, c) for c in "cab"], "doc_id long, text string, more string")
    assert len({stages.near_dedup(spark, df.repartition(n), "").first()["more"] for n in (1, 2, 3)}) == 1
    cut = stages.substring_dedup(spark, frame(spark, [(1, " ".join([words, other])), (2, " ".join([words, other]) + " end"), (2, None)]), "").collect()
    assert {r["text"] for r in cut} == {" ".join([words, other]), "end", None} or {(r["text"] or "").strip() for r in cut} == {" ".join([words, other]), "end", ""}
    assert all(r[c] == "keep" for r in cut for c in CLASHES)
    assert Counter(r["doc_id"] for r in stages.quality_rules(spark, frame(spark, rows), "").collect()) <= Counter(i for i, _ in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), "").collect() == []


def test_shared_folder_is_named_on_a_cluster(spark):
    def session(master, found=None):
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: found)})
        return type("Session", (), {"conf": conf, "sparkContext": type("Context", (), {"master": master})})()

    assert common.shared_dir(spark) == common.shared_dir(session("spark://host:7077", common.shared_dir(spark) + "/"))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master))
