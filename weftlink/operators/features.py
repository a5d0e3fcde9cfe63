"""The 28-column feature vectors of a pair (structs l and r)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.functions import similarity as S
from weftlink.functions import text, udfs
from weftlink.operators.scoring import side

#: Column groups of the ablation: the first 10, 12, 18 and all features.
GROUPS = {"name": 10, "name_tokens": 12, "address": 18, "all": 28}
NAMES = [f"f{i:02d}" for i in range(28)]
#: What the vectors read of a record.
FIELDS = {
    "unified": ["id", "country", "clean_name", "clean_addr", "name_tokens", "expanded", "street", "postal", "digits", "suffix"],
    "core": ["id", "country", "clean_name", "clean_addr", "name_tokens", "postal", "digits"],
}


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def _length_ratio(a: Column, b: Column) -> Column:
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1)))


#: Overlaps that unified() reads again and again, for extract().
SHARED = {"o_tokens": "name_tokens", "o_expanded": "expanded", "o_digits": "digits"}
#: What a record may bring of its name's words, so that they are not cut out for each pair.
WORDS = {"n_words": lambda w: F.size(w), "first_word": lambda w: F.try_element_at(w, F.lit(1)), "last_word": lambda w: F.try_element_at(w, F.lit(-1))}


#: What the vector reads of an address, so that it is not sent whole: its first 100 characters, its length, and a hash that equal ones share.
ADDRESS = {"addr_head": lambda a: F.left(a, F.lit(100)), "addr_length": F.length, "addr_hash": F.md5}
#: What extract_both() reads of a record.
SHORT = [*(c for c in FIELDS["unified"] if c != "clean_addr"), *WORDS, *ADDRESS]


def worded(records: DataFrame) -> DataFrame:
    """Records with WORDS and ADDRESS."""
    return records.withColumns({n: of(text.words(F.col("clean_name"))) for n, of in WORDS.items()} | {n: of(F.col("clean_addr")) for n, of in ADDRESS.items()})


def unified(kernels: bool = True, shared: bool = False, words: bool = False) -> list[Column]:
    """The authoritative 28 features; records come from the "joined" normaliser.  Without kernels f01 (Jaro-Winkler) is 0.  shared, words: the pairs have SHARED, the records WORDS and ADDRESS."""
    n1, n2 = side("clean_name")
    t1, t2 = side("name_tokens")
    e1, e2 = side("expanded")
    k, first, last = ([F.col(f"{x}.{n}") if words else of(text.words(F.col(f"{x}.clean_name"))) for x in ("l", "r")] for n, of in WORDS.items())
    some = (k[0] > 0) & (k[1] > 0)
    tokens, addresses, numbers = (F.col(n) if shared else None for n in SHARED)
    name_j, addr_j = S.jaccard(t1, t2, shared=tokens), S.jaccard(e1, e2, shared=addresses)
    s1, s2 = side("street")
    country = F.when(F.col("l.country") != "", F.col("l.country")).otherwise(F.col("r.country"))
    four = (F.length(n1) >= 4) & (F.length(n2) >= 4)
    lengths = side("addr_length") if words else tuple(F.length(a) for a in side("clean_addr"))
    both = (lengths[0] > 0) & (lengths[1] > 0)
    alike = S.headed_share(F.col("l.addr_hash") == F.col("r.addr_hash"), lengths, side("addr_head")) if words else S.levenshtein_share(*side("clean_addr"))
    values = [
        S.levenshtein_share(n1, n2),
        F.col("jw") if kernels else F.lit(0.0),
        name_j,
        S.containment(t1, t2, shared=tokens),
        _flag(S.same(n1, n2)),
        _flag(four & (F.left(n1, F.lit(4)) == F.left(n2, F.lit(4)))),
        _flag(four & (F.right(n1, F.lit(4)) == F.right(n2, F.lit(4)))),
        _length_ratio(n1, n2),
        1.0 / (1.0 + F.abs(F.size(t1) - F.size(t2))),
        _flag(S.same(*side("suffix"))),
        _flag(tokens > 0 if shared else F.arrays_overlap(t1, t2)),
        addr_j,
        S.jaccard(*side("digits"), shared=numbers),
        F.when((s1 != "") & (s2 != ""), (s1 == s2).cast("double")).otherwise(0.5),
        S.agreement(*side("postal"), neither=0.5),
        F.when(both & (addresses > 0 if shared else F.arrays_overlap(e1, e2)), alike).otherwise(0.0),
        _flag(both),
        F.when(both, F.least(*lengths) / F.greatest(*lengths, F.lit(1))).otherwise(0.0),
        *(_flag(country == c) for c in ("US", "India", "France")),
        *(_flag(F.startswith(F.col("r.id"), F.lit(p))) for p in ("S2-", "S3-")),
        name_j * addr_j,
        F.when(some, F.least(*k)).otherwise(0).cast("double"),
        _flag(some & (first[0] == first[1])),
        _flag(some & (last[0] == last[1])),
        F.when((s1 != "") & (s2 != ""), (s1 != s2).cast("double")).when((s1 != "") | (s2 != ""), F.lit(0.2)).otherwise(0.0),
    ]
    return [v.cast("double").alias(n) for v, n in zip(values, NAMES)]


def core() -> list[Column]:
    """The earlier vector over the "contracting" normaliser, with phonetic codes by Soundex and embeddings absent."""
    n1, n2 = side("clean_name")
    a1, a2 = side("clean_addr")
    d1, d2 = side("digits")
    k1, k2 = F.size(text.words(n1)), F.size(text.words(n2))
    c1, c2 = F.length(n1), F.length(n2)
    indel = udfs.indel_ratio(n1, n2)
    values = [
        indel,
        F.col("jw"),
        udfs.monge_elkan(n1, n2),
        udfs.token_sort_ratio(n1, n2),
        udfs.token_set_ratio(n1, n2),
        F.when((n1 == "") | (n2 == ""), F.lit(0.0)).otherwise(indel),
        udfs.gram_cosine(n1, n2),
        S.jaccard(text.word_set(a1), text.word_set(a2)),
        S.jaccard(d1, d2, one=0.5),
        S.agreement(*side("postal")),
        S.phonetic_overlap(n1, n2),
        1.0 - F.abs(k1 - k2) / F.greatest(k1 + k2, F.lit(1)),
        S.prefix_share(n1, n2, 4),
        1.0 - F.abs(k1 - k2) / F.greatest(k1, k2, F.lit(1)),
        F.least(c1, c2) / F.greatest(c1, c2, F.lit(1)),
        *(_flag(F.startswith(F.col("r.id"), F.lit(p))) for p in ("S2-", "S3-")),
        F.lit(0.0),
        F.lit(0.0),
        S.suffix_agreement(n1, n2),
        _flag((a1 != "") & (a2 != "")),
        S.shared_long_token(*side("name_tokens")),
        udfs.token_sort_ratio(a1, a2),
        udfs.token_set_ratio(a1, a2),
        udfs.indel_ratio(a1, a2),
        F.lit(0.0),
        _flag((F.size(d1) > 0) | (F.size(d2) > 0)),
        _flag(S.same(n1, n2)),
    ]
    return [v.cast("double").alias(n) for v, n in zip(values, NAMES)]


def _values(columns: list[Column]) -> dict[str, Column]:
    return dict(zip(NAMES, columns))


def _named(values: dict[str, Column]) -> list[Column]:
    return [values[n].cast("double").alias(n) for n in NAMES]


def _first_n(a: Column, b: Column, cut) -> Column:
    """Equal ends of four characters, shorter texts by what they have."""
    return _flag((a != "") & (cut(a, F.lit(4)) == cut(b, F.lit(4))))


def _shared(a: Column, b: Column, least: bool = False) -> Column:
    """Overlap over the union (or the smaller set), two empty sets giving 0."""
    size = F.least(F.size(a), F.size(b)) if least else F.size(F.array_union(a, b))
    return S.overlap(a, b) / F.greatest(size, F.lit(1))


def _spread(a: Column, b: Column) -> Column:
    return F.abs(F.size(a) - F.size(b)) / F.greatest(F.size(a), F.size(b), F.lit(1))


def validation() -> list[Column]:
    """The vector of the validation suite: edit distances over 40 characters without a length limit, address words as they stand, the country of the reference record."""
    (n1, n2), (a1, a2), address = side("clean_name"), side("clean_addr"), side("addr_tokens")
    values, both = _values(unified()), (a1 != "") & (a2 != "")
    addresses = S.jaccard(*address)
    values |= {"f00": S.levenshtein_share(n1, n2, 40, None), "f11": addresses, "f15": F.when(both, S.levenshtein_share(a1, a2, 40, None)).otherwise(0.0), "f23": S.jaccard(*side("name_tokens")) * addresses}
    values |= {n: _flag(F.col("l.country") == c) for n, c in (("f18", "US"), ("f19", "India"), ("f20", "France"))}
    return _named(values)


def optimisation() -> list[Column]:
    """The vector of the optimisation suite: as validation(), but two empty sets share nothing, f08 is a difference, f10 stays 0, and one missing street number is no conflict."""
    (n1, n2), (a1, a2), tokens, address = side("clean_name"), side("clean_addr"), side("name_tokens"), side("addr_tokens")
    street, postal = side("street"), side("postal")
    known = (street[0] != "") & (street[1] != "")
    length = lambda a, b: F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    values = _values(validation())
    values |= {
        "f02": _shared(*tokens), "f03": _shared(*tokens, least=True), "f05": _first_n(n1, n2, F.left), "f06": _first_n(n1, n2, F.right), "f07": length(n1, n2), "f08": _spread(*tokens), "f10": F.lit(0.0),
        "f11": _shared(*address), "f12": _shared(*side("digits")), "f14": S.agreement(*postal, neither=0.5), "f15": S.levenshtein_share(a1, a2, 40, None), "f17": length(a1, a2),
        "f23": _shared(*tokens) * _shared(*address), "f27": F.when(known, (street[0] != street[1]).cast("double")).otherwise(0.0),
    }
    return _named(values)


def fast() -> list[Column]:
    """The light vector of the full runner: both string features are Jaro-Winkler (of names, and jw_address of addresses), numbers by their overlap, eight features stay 0."""
    n1, n2 = side("clean_name")
    (d1, d2), tokens = side("digits"), side("name_tokens")
    known, shared = (F.size(d1) > 0) & (F.size(d2) > 0), F.arrays_overlap(d1, d2)
    numbers = F.when(known, _shared(d1, d2)).otherwise(0.5)
    values = _values(optimisation()) | {n: F.lit(0.0) for n in ("f10", "f11", "f14", "f17", "f24", "f25", "f26")}
    values |= {
        "f00": F.col("jw"), "f09": _flag(S.same(*side("domain"))), "f12": numbers, "f13": F.when(known, shared.cast("double")).otherwise(0.5), "f15": F.col("jw_address"),
        "f23": _shared(*tokens) * numbers, "f27": F.when(known, (~shared).cast("double")).otherwise(0.0),
    }
    return _named(values)


def extract(pairs: DataFrame, kind: str = "unified", keep: list[str] | None = None) -> DataFrame:
    """(s1, cid, the kept columns, f00..f27); NaN counts as 0."""
    from weftlink.operators.scoring import with_kernels

    p = with_kernels(pairs, None if kind in ("unified", "core") else 40, "run")
    if kind == "fast":
        p = p.withColumn("jw_address", udfs.jaro_winkler(*side("clean_addr"), 40, "run"))
    if kind == "unified":
        p = p.withColumns({n: S.overlap(*side(c)) for n, c in SHARED.items()})  # read more than once, so Spark leaves them a step of their own
        return p.select("s1", "cid", *(keep or []), *unified(True, True)).na.fill(0.0, NAMES)
    columns = {"core": core, "validation": validation, "optimisation": optimisation, "fast": fast}[kind]()
    return p.select("s1", "cid", *(keep or []), *columns).na.fill(0.0, NAMES)


def extract_both(pairs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """extract() of "unified" for pairs within a country and their reverses, of which pairs holds one: what is the same both ways round is computed once.

    Features come before Jaro-Winkler, so that no record waits for a UDF.
    """
    from weftlink.operators.scoring import once

    keep = keep or []
    held = pairs.withColumns({n: S.overlap(*side(c)) for n, c in SHARED.items()})  # read more than once, so Spark leaves them a step of their own
    reverse = {f"_{n}": _flag(F.startswith(F.col("l.id"), F.lit(p))) for n, p in (("f21", "S2-"), ("f22", "S3-"))}
    values = dict(zip(NAMES, unified(False, True, True))) | reverse | {"_a": F.col("l.clean_name"), "_b": F.col("r.clean_name")}
    made = once(held, values).select("s1", "cid", *keep, *values)
    there = F.struct("s1", "cid", "_a", "_b", "f21", "f22")
    back = F.struct(F.col("cid").alias("s1"), F.col("s1").alias("cid"), F.col("_b").alias("_a"), F.col("_a").alias("_b"), F.col("_f21").alias("f21"), F.col("_f22").alias("f22"))
    same = [n for n in NAMES if n not in ("f01", "f21", "f22")]
    out = made.select(*keep, *same, F.explode(F.array(there, back)).alias("_d")).select(*keep, *same, "_d.*")
    return out.withColumn("f01", udfs.jaro_winkler(F.col("_a"), F.col("_b"), None, "run")).select("s1", "cid", *keep, *NAMES).na.fill(0.0, NAMES)


def audit(features: DataFrame) -> DataFrame:
    """feature, least, greatest, bad (null or NaN) and negative counts, one row for each feature."""
    stats = features.agg(*(F.struct(F.min(n).alias("least"), F.max(n).alias("greatest"), F.count_if(F.isnan(n) | F.col(n).isNull()).alias("bad"), F.count_if(F.col(n) < 0).alias("negative")).alias(n) for n in NAMES))
    return stats.select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("s")) for n in NAMES))).alias("x")).select("x.feature", "x.s.*")
