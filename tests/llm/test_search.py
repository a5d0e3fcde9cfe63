import math
import random
from collections import Counter

import numpy as np

from weftlink.llm import search


def brute(rows, queries, k):
    docs = [(d, Counter((t or "").encode().lower().split())) for d, t in rows]
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for q, t in queries:
        scored = []
        for d, c in docs:
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in sorted(set((t or "").encode().lower().split())) if w in c)
            if s > 0:
                scored.append((-round(s, 9), d, round(s, 6)))
        out += [(q, i + 1, d, s) for i, (_, d, s) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def run(spark, rows, queries, k, size, block):
    got = search.search(spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(queries, "query_id long, text string"), k, size=size, block=block).collect()
    return sorted(((x["query_id"], x["rank"], x["doc_id"], x["score"]) for x in got), key=str)


def same(got, rows, queries, k):
    want = sorted(brute([r[:2] for r in rows], queries, k), key=str)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(x[3] - y[3]) < 2e-6 for x, y in zip(got, want))


def test_search_against_brute_force(spark, monkeypatch):
    """Lists with and without blocks, thresholds from earlier shards, several batches, ties, copies and a very long text."""
    monkeypatch.setattr(search, "BATCH", 600)
    r = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choices(words, [1 / (j + 1) for j in range(60)], k=r.randint(0, 40))), "x") for i in range(300)]
    rows += [(300, None, None), (301, "", "y"), (302, rows[3][1], "z"), (303, rows[3][1].upper(), "z"), (304, " ".join(r.choices(words, k=60_000)), "long")]
    queries = [(i, t) for i, t, _ in rows if i % 20 == 0 or i > 298]
    for size, block in ((128, 4), (40, 16), (4096, 64)):
        same(run(spark, rows, queries, 5, size, block), rows, queries, 5)


def test_pivot_and_blocks_pass_documents_over():
    """With a threshold, lists before the pivot are not read where their blocks cannot help, and nothing is lost."""
    r = random.Random(5)
    docs = [(i, search.terms(" ".join(["the"] * r.randint(1, 3) + ["of"] + r.choices([f"v{j}" for j in range(400)], k=12)))) for i in range(512)]
    shard = search.Shard.from_bytes(search.Shard.build(docs).to_bytes())
    shard.prepare(14.0, 16)
    query = np.unique(search.terms("the of v1 v2 v3"))
    n = np.array([sum(t in d[1] for d in docs) for t in query])
    weights = search.idf(512, n)
    ids, scores = shard.search(query, weights, -math.inf, 512)
    assert len(ids) == 512
    floor = np.sort(scores)[-8]
    ids2, scores2 = shard.search(query, weights, float(floor), 8)
    assert set(ids2) == set(ids[scores >= floor]) and len(ids2) >= 8
    # "the" and "of" stand in every document, and are before the pivot.
    assert weights[n == 512].sum() * shard.most.max() < floor


def test_shards_joined_and_common_lists_as_a_matrix():
    """Several shards searched as one, with their common lists multiplied, give what one shard's lists give."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, search.terms(" ".join(r.choices(words, [1 / (j + 1) for j in range(300)], k=r.randint(0, 40))))) for i in range(500)]
    one = search.Shard.build(docs)
    parts = [search.Shard.from_bytes(search.Shard.build(docs[a : a + 70]).to_bytes()) for a in range(0, 500, 70)]
    many = search.Shard.joined(parts)
    assert all((getattr(one, n) == getattr(many, n)).all() for n, _ in search.Shard.FIELDS)
    one.prepare(20.0, 16)
    many.prepare(20.0, 16, 8)
    assert (many.slot >= 0).any() and (many.row >= 0).any()
    for _, words in docs[::25]:
        query = np.unique(words)
        weights = search.idf(500, np.diff(one.at)[one.place(query)[1]])
        floor = -math.inf
        for _ in range(2):
            want, got = (search.best(*s.search(query, weights, floor, 10), 10) for s in (one, many))
            assert (want[0] == got[0]).all() and np.allclose(want[1], got[1], atol=1e-9)
            floor = float(got[1][-1]) if len(got[1]) == 10 else floor


def test_every_query_row_is_answered(spark):
    rows = [(1, "a b", ""), (2, "a c", ""), (None, "a x", ""), (2, "a c", "")]
    queries = [(7, "a"), (7, "x"), (7, "x"), (None, "c"), (9, None)]
    got = run(spark, rows, queries, 2, 4096, 64)
    assert [x[:3] for x in got if x[0] is None] == [(None, 1, 2), (None, 2, 2)]
    sevens = sorted((x[:3] for x in got if x[0] == 7), key=str)
    assert sevens == sorted([(7, 1, None), (7, 2, 1), (7, 1, None), (7, 1, None)], key=str)
    assert all(x[0] != 9 for x in got)


def test_search_in_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert search.search(none, none.withColumnRenamed("doc_id", "query_id")).collect() == []
