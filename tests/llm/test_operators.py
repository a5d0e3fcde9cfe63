import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from weftlink.llm import common, idcoder, lyndon, packing, pieces, quality, sharding, substrings, suffixes, token_counts, tokenfile

SCHEMA = "doc_id long, text string"
BITS = ["a", "'", "re", "'ll", "'s", " ", "  ", "\n", "\t", " \n", "<|endoftext|>", "<|endof", "1", "23", "!", "--", "é", "中", "Hello", "the", " ", "​", "é", "😀", "Über", "ing", "\x00", "\x1c", "▁", " ▁", "²", "Σ", "İ"]
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (None, "null id"), (5, "twice"), (5, "twice"), (6, "same id"), (6, "other text")]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 14))) for _ in range(n)]


def library(name):
    return Tokenizer.from_file(common.tokenizer_path(name))


# 1: quality rules


def test_repeat_words_against_brute_force():
    r = random.Random(1)
    for _ in range(300):
        words = [r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 40))]
        seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        assert quality.repeat_words(words, 3) == len(covered)


def test_cascade_order_and_verdict(spark):
    assert quality.cascade_order([("slow", 1.0, 0.9), ("fast", 0.1, 0.5), ("never", 0.01, 0.0)]) == ["fast", "slow", "never"]
    good = " ".join(f"word{i} and" for i in range(30))
    df = spark.createDataFrame([*ODD, (7, good), (8, good.upper()), (9, " ".join(["x$$"] * 40))], SCHEMA)
    got = quality.measures(df).collect()
    assert len(got) == len(ODD) + 3
    assert {r["doc_id"] for r in got if r["kept"]} == {7}
    assert {r["doc_id"] for r in quality.cascade(df).collect() if r["kept"]} == {7}
    assert {r["doc_id"] for r in quality.filtered(df).collect()} == {7}
    assert quality.measures(spark.createDataFrame([], SCHEMA)).collect() == []


# 2: packing


def test_packing_fills_sequences_without_gaps(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["the", "house", "ab", "ing"]) for _ in range(r.choice([3, 5, 30, 90])))) for i in range(80)]
    got = packing.pack(spark.createDataFrame([*ODD, *rows], SCHEMA), capacity=64).collect()
    by = {}
    for x in got:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(x["length"] for x in got)
    assert len(by) <= -(-total // 64) + 1
    tok = library("byte_bpe_50k.json")
    want = Counter((i, zlib.crc32(np.array(([*tok.encode(t or "", add_special_tokens=False).ids, 0]), "<u4")[:64].tobytes())) for i, t in [*ODD, *rows] if len(tok.encode(t or "").ids) < 64)
    assert want <= Counter((x["doc_id"], x["ids_crc32"]) for x in got)
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sweep_is_near_the_bound_and_never_overfills():
    r = random.Random(3)
    for _ in range(50):
        counts = {length: r.randint(1, 50) for length in r.sample(range(1, 101), r.randint(1, 40))}
        placed, n = packing.sweep(counts, 100)
        use = Counter()
        for length, _, m, first, offset in placed:
            for s in range(first, first + m):
                assert use[s] == offset
                use[s] += length
        assert max(use.values()) <= 100 and len(use) == n
        assert sum(m for _, _, m, _, _ in placed) == sum(counts.values())


def plain_best_fit_decreasing(sizes, capacity):
    """Rooms of the bins, one size at a time."""
    rooms = []
    for size in sorted(sizes, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= size]
        if fits:
            rooms[min(fits, key=lambda i: (rooms[i], i))] -= size
        else:
            rooms.append(capacity - size)
    return rooms


def test_sweep_needs_no_more_than_plain_best_fit_decreasing():
    r = random.Random(31)
    for _ in range(40):
        counts = {length: r.randint(1, 12) for length in r.sample(range(1, 65), r.randint(1, 40))}
        _, n = packing.sweep(counts, 64)
        assert n == len(plain_best_fit_decreasing([x for x, m in counts.items() for _ in range(m)], 64))


def test_pieces_of_cut_documents_equal_the_library(spark):
    r = random.Random(32)
    rows = [(i, "".join(r.choice(BITS) for _ in range(r.choice([3, 40, 400])))) for i in range(60)] + [(99, "word " * 30_000), *ODD]
    tok = library("byte_bpe_50k.json")
    want = Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at, length = 0, (len(ids) - 1) % 64 + 1
        for piece in range(-(-len(ids) // 64)):
            want[i, piece, at, length, zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())] += 1
            at, length = at + length, 64
    got = packing.pack(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, sequence_id int"), capacity=64).collect()
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == want
    assert len({x["sequence_id"] for x in got}) == len(plain_best_fit_decreasing([x["length"] for x in got], 64))


def test_whole_text_encoders_equal_the_library():
    ts = [*texts(3000, 33), "a" * 5000, " " * 5000 + "x", "é" * 3000, "x\x01y", "ΑΣ ΑΣΑ", "it's 'tis ''s 'veto x'll"]
    path, tok = common.tokenizer_path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    assert common.same_merges(path)
    assert all(common.text_encoder(path)(t).tolist() == tok.encode(t, add_special_tokens=False).ids for t in ts)
    tok, words = library("word_bpe_49k.json"), common.word_ends(common.tokenizer_path("word_bpe_49k.json"))
    assert words.sure
    for at in range(0, len(ts), 100):
        for t, ids in zip(ts[at : at + 100], words.look_up(ts[at : at + 100])):
            assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
    # Every character among letters, digits, signs and spaces; the driver's box has the libraries' tables alike.
    for low in range(0, 0x30000, 1024):
        some = [f"a{c}1{c}!{c} {c}{c}  {c}b \n{c}'s" for c in map(chr, range(low, low + 1024)) if not "\ud800" <= c <= "\udfff"]
        for t, ids, e in zip(some, words.look_up(some), tok.encode_batch_fast(some, add_special_tokens=False)):
            assert ids.tolist() == e.ids, repr(t)


# 3: token counts


def test_prefix_counts_equal_the_library():
    path, tok = common.tokenizer_path("byte_bpe_50k.json"), library("byte_bpe_50k.json")
    c, _ = token_counts.counter(path)
    for t in texts(400, 4):
        want = [len(tok.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert c.prefixes(t).tolist() == want
        got = token_counts.counts_of(t, path)
        assert [got.at(i) for i in range(len(t) + 1)] == want
        assert got.fit(3) == max(i for i, n in enumerate(want) if n <= 3)


def test_token_counts_of_odd_rows(spark):
    got = token_counts.token_counts(spark.createDataFrame(ODD, SCHEMA), 1).collect()
    tok = library("byte_bpe_50k.json")
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == Counter((i, len((t or "").encode()), n := len(tok.encode(t or "").ids), n > 1) for i, t in ODD)


# 4: token files


def test_id_coder_round_trip_and_damage():
    r = np.random.default_rng(5)
    for size in (300, 49408, 70000):
        blocks = [r.integers(0, size, n).astype(np.int32) for n in (1, 2, 63, 64, 65, 700, 1500)] + [np.zeros(900, np.int32), np.full(50, size - 1, np.int32)]
        coded = idcoder.encode(blocks, size)
        assert all((x == y).all() for x, y in zip(blocks, idcoder.decode([(c, len(b)) for c, b in zip(coded, blocks)], size)))
    same = np.tile(np.arange(20, dtype=np.int32), 100)
    assert len(idcoder.encode([same], 49408)[0]) < 600  # contexts are learned
    frame = bytearray(tokenfile.frames([[(1, same)]], 49408)[0])
    frame[-30] ^= 1
    with pytest.raises(tokenfile.Damaged):
        tokenfile.documents_of([bytes(frame)])


def test_words_of_the_texts_at_hand_are_encoded_once(monkeypatch):
    words, tok, seen = common.WordEnds(common.tokenizer_path("word_bpe_49k.json")), library("word_bpe_49k.json"), []
    plain = words.encode
    monkeypatch.setattr(words, "encode", lambda text, **k: seen.append(text.count(words.MARK)) or plain(text, **k))
    ts = ["plover wexing plover", "", " ", "wexing x\x01y plover", "Ünder <|endoftext|>", "plover \u0378", "ünder 77"] * 30
    for t, ids in zip(ts, words.look_up(ts)):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
    assert sum(seen) <= 5  # plover, wexing, ünder, 7, the unassigned character
    assert [x.tolist() for x in words.look_up(["", " "])] == [[], []] and words.look_up([]) == []


def test_slices_hold_every_text_once(monkeypatch):
    monkeypatch.setattr(common, "TEXTS", 10)
    for sizes in ([], [0], [0, 0], [10, 0, 9, 25, 1], [3, 8], [30, 30], [4] * 20):
        found = list(common.text_slices(pa.array(["x" * n for n in sizes], pa.string())))
        assert [i for low, high in found for i in range(low, high)] == list(range(len(sizes)))
        assert all(sum(sizes[low : high - 1]) < 20 for low, high in found)


def test_blocks_of_a_set_share_what_they_learn():
    r = np.random.default_rng(6)
    # Any two ids tell the third, which no block of 64 sees twice.
    after = r.integers(0, 40, (40, 40))
    ids = [3, 4]
    for _ in range(6000):
        ids.append(int(after[ids[-2], ids[-1]]) if r.random() < 0.9 else int(r.integers(0, 40)))
    docs = [[(i, np.array(ids[i * 700 : (i + 1) * 700], np.uint16))] for i in range(8)] + [[(8, np.array(ids, np.uint16)), (9, np.array([2], np.uint16))], [(10, np.array([49407], np.uint16))]]
    # 6003 ids are 94 blocks, two of 48 for each of a set; frames of one set, several and a single id.
    coded = tokenfile.frames(docs, 49408, 64, 48)
    flat = lambda frames: [[(d, i.tolist()) for d, i in f] for f in frames]
    assert flat(tokenfile.documents_of(coded)) == flat(docs)
    assert [flat(tokenfile.documents_of([f]))[0] for f in reversed(coded)] == flat(docs)[::-1]  # each without the others
    one = tokenfile.frames(docs[8:9], 49408, 64)[0]
    assert flat(tokenfile.documents_of([one])) == flat(docs[8:9])
    assert len(one) < 6003 * 5 // 8  # order 0 alone takes 5.3 bits an id
    for at in (5, 30, 40, len(one) // 3, len(one) // 2):
        broken = bytearray(one)
        broken[at] ^= 16
        with pytest.raises(tokenfile.Damaged):
            tokenfile.documents_of([bytes(broken)])
    with pytest.raises(tokenfile.Damaged):
        tokenfile.documents_of([one[: len(one) // 2]])


def test_token_file_reads_back(spark):
    rows = [*ODD, *((i + 10, t) for i, t in enumerate(texts(60, 6)))]
    got = tokenfile.read_back(tokenfile.written(spark.createDataFrame(rows, SCHEMA))).collect()
    tok = library("word_bpe_49k.json")
    want = Counter((i, len(x := [*tok.encode(t or "", add_special_tokens=False).ids, 2]), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert tokenfile.read_back(tokenfile.written(spark.createDataFrame([], SCHEMA))).collect() == []


# 7: substring dedup


def brute_words(rows, w):
    first = {}
    for doc, t in rows:
        words = (t or "").encode().split()
        for i in range(len(words) - w + 1):
            k = tuple(words[i : i + w])
            first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, t in rows:
        words = (t or "").encode().split()
        gone = {j for i in range(len(words) - w + 1) if first[tuple(words[i : i + w])] < doc for j in range(i, i + w)}
        out.append((doc, len(words), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(words) if j not in gone)).hexdigest()))
    return sorted(out)


def passages(seed, n, unit):
    r = random.Random(seed)
    shared = [[f"p{k}-{j}" for j in range(r.randint(8, 30))] for k in range(4)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randint(0, 4)):
            words += [f"u{r.randrange(30)}" for _ in range(r.randint(0, 12))]
            p = r.choice(shared)
            words += p[r.randint(0, 3) : len(p) - r.randint(0, 3)]
        rows.append((i, unit.join(words)))
    return rows


def test_substring_dedup_against_brute_force(spark):
    rows = [*passages(8, 60, " "), (60, None), (61, ""), (62, "a"), (63, "zz " * 40), (64, "zz " * 40)]
    got = substrings.digests(spark.createDataFrame(rows, SCHEMA), 10, 4).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_words(rows, 10)
    assert substrings.digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_cut_text_keeps_what_stands_between():
    assert substrings.cut_text("a  b\nc d", [{"low": 1, "high": 3}], 2) == "a  d"
    assert substrings.cut_text("a b", [{"low": 0, "high": 2}], 2) == ""


# 8: suffix-array dedup


def test_suffix_array_against_sorting():
    r = random.Random(9)
    for _ in range(600):
        s = [r.randint(0, r.choice([1, 2, 3, 26])) for _ in range(r.randint(0, 40))]
        assert lyndon.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("buffer", [2, 4096])
def test_byte_dedup_against_brute_force(spark, monkeypatch, buffer):
    monkeypatch.setattr(suffixes, "BUFFER", buffer)
    rows = [*passages(10, 40, " "), (40, None), (41, ""), (42, "é" * 70), (43, "x" * 100), (44, "same row " * 3 + "y"), (44, "same row " * 3 + "y")]
    w = 48
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[i : i + w] for _, b in raw for i in range(len(b) - w + 1))
    want = []
    for doc, b in raw:
        runs = suffixes.merge([(i, i + w) for i in range(len(b) - w + 1) if seen[b[i : i + w]] > 1])
        gone = {j for lo, hi in runs for j in range(lo, hi)}
        want.append((doc, len(b), len(gone), len(runs), hashlib.sha256(bytes(x for j, x in enumerate(b) if j not in gone)).hexdigest()))
    got = suffixes.digests(spark.createDataFrame(rows, SCHEMA), w, 16).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(want)


# 9: pieces


def test_pieces_equal_the_library():
    p = pieces.pieces(common.tokenizer_path(pieces.MODEL))
    assert p.split
    ts = texts(1500, 11)
    for t, (ids, n, decoded) in zip(ts, p.run(ts)):
        want = p.sp.encode(t)
        assert (ids, n, decoded) == (" ".join(map(str, want)), len(want), p.sp.decode(want))


def test_piece_digests_of_odd_rows(spark):
    got = pieces.digests(spark.createDataFrame(ODD, SCHEMA)).collect()
    assert {(r["n_tokens"], r["ids_sha256"]) for r in got if r["doc_id"] in (1, 2)} == {(1, hashlib.sha256(b"2").hexdigest())}
    assert len(got) == len(ODD)


# 10: sharding


def test_best_fit_decreasing():
    r = random.Random(12)
    for _ in range(200):
        sizes = [r.randint(1, 50) for _ in range(r.randint(0, 60))]
        bins = sharding.best_fit_decreasing(sizes, 50)
        full = Counter()
        for b, s in zip(bins, sizes):
            full[b] += s
        assert all(x <= 50 for x in full.values())
        assert sorted(full) == list(range(len(full)))
        even = sharding.level(sizes, 4)
        load = Counter()
        for b, s in zip(even, sizes):
            load[b] += s
        if sizes:
            assert max(load.values()) <= max(max(sizes), -(-sum(sizes) // 4)) * 1.34


def test_shards_keep_equal_texts_together(spark):
    r = random.Random(13)
    rows = [*ODD, *((i + 10, f"text {r.randrange(60)}") for i in range(300))]
    got = sharding.shards_by_bytes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    by_text = {}
    for x in got:
        by_text.setdefault((x["text_crc32"], x["size"]), set()).add(x["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    for shard in {x["shard"] for x in got}:
        assert sorted(x["slot"] for x in got if x["shard"] == shard) == list(range(sum(x["shard"] == shard for x in got)))
    assert sharding.shards_by_bytes(spark.createDataFrame([], SCHEMA)).collect() == []
