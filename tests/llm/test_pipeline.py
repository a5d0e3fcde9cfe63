import random
import zlib

import numpy as np
from test_neardup import brute as components
from tokenizers import Tokenizer

import corpus_pipeline
from weftlink.llm import common, quality, rolling, substrings


def fixture():
    r = random.Random(21)
    shared = " ".join(f"passage{i}" for i in range(60))
    rows = []
    for i in range(24):
        words = [f"w{r.randrange(4000)}" for _ in range(r.randint(30, 120))]
        text = " ".join(words)
        if i % 4 == 1:
            text = f"{text}\n{shared} {' '.join(f'x{i}{j}' for j in range(20))}"
        rows.append((i, text))
    rows += [(24, rows[2][1]), (25, rows[3][1] + " tail"), (26, rows[4][1].upper()), (27, "few words"), (28, None), (29, " ".join(["ab$$"] * 50)), (None, rows[5][1] + " end")]
    return rows


def expected(rows):
    rules = quality.BASE_RULES + quality.MORE_RULES
    kept = [(d, t) for d, t in rows if not any(x.rejects(quality.Doc(t or "")) for x in rules)]
    low = [(common.NULL_ID if d is None else d, t) for d, t in kept]
    least = {d for d, _, c, k in components(low, 80, 5) if k}
    low = [(d, t) for d, t in low if d in least]
    first = {}
    for d, t in low:
        w = t.split()
        for i in range(len(w) - 49):
            first[tuple(w[i : i + 50])] = min(first.get(tuple(w[i : i + 50]), d), d)
    out = []
    tok = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))
    for d, t in low:
        w = t.split()
        spans = [{"low": i, "high": i + 50} for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d]
        assert rolling.covered(len(w), [(s["low"], s["high"]) for s in spans]).sum() in (0, 60)
        ids = np.array([*tok.encode(substrings.cut_text(t, spans), add_special_tokens=False).ids, 0], "<u4")
        out.append((None if d == common.NULL_ID else d, len(ids), zlib.crc32(ids.tobytes())))
    return sorted(out, key=str)


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["length"], r["ids_crc32"]) for r in got), key=str) == expected(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "substring_dedup", "best_fit_packing"]
