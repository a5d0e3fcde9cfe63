import random

from weftlink.llm import neardup

SCHEMA = "doc_id long, text string"


def brute(rows, percent, width):
    sets = []
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        w = min(width, len(words)) or 1
        sets.append((doc, {tuple(words[i : i + w]) for i in range(len(words) - w + 1)} if words else set()))
    label = {doc: doc for doc, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return sorted((doc, len(s), find(doc), find(doc) == doc) for doc, s in sets)


def run(spark, rows, percent=85, width=3):
    out = neardup.report(spark.createDataFrame(rows, SCHEMA), percent, width)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect())


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def test_hot_lists_lose_no_link(spark, monkeypatch):
    """A group far over SHORT: close copies, copies that only chains of others connect, and texts that share half of theirs."""
    monkeypatch.setattr(neardup, "SHORT", 12)
    r = random.Random(4)
    seed = [f"s{r.randrange(500)}" for _ in range(160)]
    rows = [(i, edited(r, seed, r.choice([0, 1, 1, 2, 3, 4, 5]))) for i in range(60)]
    last = list(seed)
    for i in range(60, 80):  # a chain that walks away from the seed
        for _ in range(2):
            last[r.randrange(len(last))] = f"c{i}"
        rows.append((i, " ".join(last)))
    rows += [(i, " ".join(seed[:90] + [f"o{i}-{j}" for j in range(60)])) for i in range(80, 120)]
    r.shuffle(rows)
    assert run(spark, rows) == brute(rows, 85, 3)


def test_small_sets_ties_and_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two three"), (8, "one two three four"), (9, "é É"), (10, "é É"), (11, "One two\x0bthree")]
    r = random.Random(7)
    for i in range(12, 60):
        words = [f"v{j}" for j in range(r.randint(5, 12))]
        rows.append((i, edited(r, words, r.choice([0, 0, 1]))))
    assert run(spark, rows) == brute(rows, 85, 3)
    assert run(spark, rows, 80, 5) == brute(rows, 80, 5)


def test_null_ids_repeated_rows_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d", 1), (3, "a b c d", 2), (3, "a b c d", 2), (4, None, 3)], "doc_id long, text string, n_shingles int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.report(df).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (3, 2, None, False), (3, 2, None, False), (4, 0, 4, True)], key=str)
    assert neardup.report(spark.createDataFrame([], SCHEMA)).collect() == []
