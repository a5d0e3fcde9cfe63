"""Ranking scores, match scores and decisions over pairs with structs l and r.

Scores are plain column arithmetic; the string kernels (Jaro-Winkler) are added
once by ``with_kernels`` and read as columns, so no UDF runs twice for a pair.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions import similarity as S
from weftlink.functions import udfs
from weftlink.plans.presets import Preset


def side(name: str) -> tuple[Column, Column]:
    return F.col(f"l.{name}"), F.col(f"r.{name}")


def once(pairs: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once for a pair, however often they are read; a filter on them is not moved before them, as one on plain columns is."""
    made = pairs.withColumn("_once", F.explode(F.array(F.struct(*(v.alias(k) for k, v in values.items())))))
    return made.select(*pairs.columns, "_once.*")


def _of(values: dict[str, Column], made: bool) -> dict[str, Column]:
    """The values, or the columns that once() made of them."""
    return {k: F.col(k) for k in values} if made else values


# Ranking ---------------------------------------------------------------------


def prelim(kind: str) -> Column:
    """The cheap score that candidates are ranked by."""
    names, addresses, digits, alphas = side("name_tokens"), side("addr_tokens"), side("digits"), side("alpha")
    shared = F.arrays_overlap(*digits)
    known = (F.size(digits[0]) > 0) & (F.size(digits[1]) > 0)
    name = S.jaccard(*names, both=0.0)
    alike = S.same(*alphas).cast("double")

    def by_digits(hit: float, miss: float, missing: float) -> Column:
        return F.when(~known, F.lit(missing)).when(shared, F.lit(hit)).otherwise(F.lit(miss))

    if kind == "p1":
        return 0.65 * name + 0.25 * by_digits(1.0, -0.5, 0.2) + F.least(F.lit(0.3), 0.1 * F.col("provenance"))
    if kind == "p2":
        return 0.75 * name + 0.25 * by_digits(0.5, 0.0, 0.2)
    if kind == "p3":
        return 5.0 * alike + 3.0 * name + 2.0 * S.jaccard(*addresses, both=0.0) + 2.0 * (known & shared).cast("double")
    if kind == "p3b":
        return 5.0 * alike + 3.0 * name + 2.0 * S.jaccard(*addresses, both=0.0) + 2.0 * S.same(*side("street")).cast("double") + 2.0 * S.same(*side("postal")).cast("double")
    if kind == "p4":
        return 3.0 * S.overlap(*names) + 2.0 * S.overlap(*addresses) + 4.0 * S.same(*side("street")).cast("double") + 10.0 * alike
    if kind == "p5":
        return 0.7 * name + 0.3 * by_digits(1.0, 0.0, 0.3)
    raise ValueError(kind)


# Match scores ----------------------------------------------------------------


def with_kernels(pairs: DataFrame, max_len: int | None = 40, prefix: str = "any", ordered: bool = False) -> DataFrame:
    """Adds jw (and jw_sorted): Jaro-Winkler of the clean names."""
    out = pairs.withColumn("jw", udfs.jaro_winkler(F.col("l.clean_name"), F.col("r.clean_name"), max_len, prefix))
    return out.withColumn("jw_sorted", udfs.sorted_jaro_winkler(F.col("l.clean_name"), F.col("r.clean_name"), max_len, prefix)) if ordered else out


def address_similarity(kind: str, made: bool = False) -> Column:
    if kind == "raw":
        return _jaccard("addr_tokens", made)
    if kind == "late":
        return _jaccard("expanded", made, both=0.0)
    return F.greatest(_jaccard("addr_tokens", made), _jaccard("expanded", made))


def _postal_term() -> Column:
    a, b = side("postal")
    return F.when(S.differ(a, b), F.lit(-0.15)).when(S.same(a, b), F.lit(0.06)).otherwise(0.0)


#: The sets of a record, and what a pair's column of their overlap is called.
SETS = ("name_tokens", "addr_tokens", "expanded", "specific", "digits", "ng3", "ng4")


def overlaps(kind: str) -> dict[str, Column]:
    """The overlaps that measures() reads, for once()."""
    out = {f"o_{c}": S.overlap(*side(c)) for c in FIELDS[kind] if c in SETS}
    if kind in ("l2", "l4"):  # these read the grams' Jaccard index only from 0.5 on, which sizes further apart don't reach
        sizes = [F.size(c) for c in side("ng4")]
        out["o_ng4"] = F.when(2 * F.least(*sizes) >= F.greatest(*sizes), out["o_ng4"]).otherwise(0)
    return out


def _overlap(field: str, made: bool) -> Column:
    return F.col(f"o_{field}") if made else S.overlap(*side(field))


def _jaccard(field: str, made: bool, both: float = 1.0) -> Column:
    return S.jaccard(*side(field), both=both, shared=F.col(f"o_{field}") if made else None)


def _containment(field: str, made: bool) -> Column:
    return S.containment(*side(field), shared=F.col(f"o_{field}") if made else None)


def measures(kind: str, made: bool = False) -> dict[str, Column]:
    """The set measures and the evidence that a match score and its decision read, for once().  made: the pair has overlaps()."""
    if kind in ("rules", "affinity"):
        return _evidence(made)
    out = {"m_name": _jaccard("name_tokens", made)}
    if kind in ("l1", "l2", "l3", "l3_raw", "l4"):
        out |= {"m_grams": _jaccard("ng4", made)} if kind != "l1" else {}
        out |= {"m_some": (F.size(side("ng4")[0]) > 0) & (F.size(side("ng4")[1]) > 0)} if kind == "l4" else {}
        return out | {"m_address": address_similarity({"l3": "best", "l4": "late"}.get(kind, "raw"), made)}
    if kind in ("p9", "p9b"):
        out |= {"m_grams": _jaccard("ng4", made), "m_third": _jaccard("ng3", made), "m_tokens": _containment("name_tokens", made)}
        return out | {"m_address": address_similarity("raw", made), "m_numbers": _jaccard("digits", made)} | _evidence(made)
    raise ValueError(kind)


def match_score(kind: str, made: bool = False) -> Column:
    """The score of a pair that has jw; -1 for a hard reject.  made: the pair has the columns of measures()."""
    if kind == "l0":
        return champion_parts()["score"]
    if kind == "affinity":
        return affinity(made)
    jw, conflict = F.col("jw"), S.conflict(*side("street"))
    m = _of(measures(kind), made)
    name, grams, address = m["m_name"], m.get("m_grams"), m["m_address"]
    a1, a2 = side("alpha")
    if kind in ("l1", "l2"):
        base = 0.5 * jw + 0.25 * name + 0.25 * address - 0.3 * conflict
        if kind == "l1":
            return base
        return F.when((grams >= 0.5) & (jw >= 0.65), F.greatest(base, 0.5 * jw + 0.15 * name + 0.15 * address + 0.2 * grams - 0.3 * conflict)).otherwise(base)
    if kind in ("l3", "l3_raw", "l4"):
        late = kind == "l4"
        base = 0.5 * jw + 0.25 * name + 0.25 * address - 0.3 * conflict + _postal_term()
        some = m["m_some"] if late else F.lit(True)
        base = F.when(some & (grams >= 0.5) & (jw >= 0.65), F.greatest(base, 0.5 * jw + 0.15 * name + 0.15 * address + 0.2 * grams - 0.3 * conflict)).otherwise(base)
        equal = S.same(a1, a2) & (F.length(a1) >= 4) & (conflict < 1.0)
        boost = F.greatest(base, 0.40 + 0.35 * jw + 0.25 * address - 0.2 * conflict)
        if late:
            both = (F.col("l.clean_addr") != "") & (F.col("r.clean_addr") != "")
            backed = (address >= 0.08) | F.arrays_overlap(*side("digits")) | ~both
            base = F.when(equal, F.when(backed, boost).otherwise(F.least(base, F.lit(0.65)))).otherwise(base)
        else:
            base = F.when(equal, boost).otherwise(base)
            inside = (F.length(a1) >= 8) & (F.length(a2) >= 8) & S.within(a1, a2) & (conflict < 1.0)
            base = F.when(inside, F.greatest(base, 0.35 + 0.35 * jw + 0.20 * address + 0.10 * grams - 0.2 * conflict)).otherwise(base)
        return F.when(S.differ(*side("state")) | (S.differ(*side("street")) & S.differ(*side("postal"))), F.lit(-1.0)).otherwise(base)
    if kind in ("p9", "p9b"):
        tokens, third, numbers = m["m_tokens"], m["m_third"], m["m_numbers"]
        penalty = 0.25 * S.differ(*side("street")).cast("double") + 0.35 * S.differ(*side("state")).cast("double")
        if kind == "p9":
            best = F.greatest(jw, F.col("jw_sorted"))
            base = 0.45 * best + 0.15 * name + 0.10 * tokens + 0.15 * address + 0.10 * grams + 0.05 * numbers - penalty
            alt = 0.35 * best + 0.10 * name + 0.10 * tokens + 0.15 * address + 0.25 * grams + 0.05 * numbers - penalty
            base = F.when((grams >= 0.5) & (best >= 0.60), F.greatest(base, alt)).otherwise(base)
            alt = 0.30 * best + 0.15 * tokens + 0.15 * third + 0.20 * address + 0.10 * grams + 0.10 * numbers - penalty
            return F.when((tokens >= 0.8) & (third >= 0.4), F.greatest(base, alt)).otherwise(base)
        base = 0.50 * jw + 0.25 * name + 0.25 * address - penalty
        alt = 0.40 * jw + 0.15 * name + 0.15 * address + 0.25 * grams + 0.05 * tokens - penalty
        base = F.when((grams >= 0.5) & (jw >= 0.60), F.greatest(base, alt)).otherwise(base)
        alt = 0.40 * jw + 0.20 * tokens + 0.20 * address + 0.15 * grams + 0.05 * name - penalty
        return F.when((tokens >= 0.8) & (jw >= 0.60), F.greatest(base, alt)).otherwise(base)
    raise ValueError(kind)


_RULES = ("specific", "digits", "alpha", "indic", "domain", "state", "name_tokens")
_L2 = ("name_tokens", "addr_tokens", "street", "ng4")
#: What the match scores, and the decisions of their presets, read of a record besides its id and clean name.
FIELDS = {
    "l0": ("domain", "digits", "words"),
    "l1": ("name_tokens", "addr_tokens", "street"),
    "l2": _L2,
    "l3_raw": (*_L2, "alpha", "postal", "state"),
    "l3": (*_L2, "expanded", "alpha", "postal", "state"),
    "l4": ("name_tokens", "expanded", "street", "ng4", "alpha", "postal", "state", "digits", "clean_addr"),
    "p9": (*_RULES, "addr_tokens", "street", "ng3", "ng4"),
    "p9b": (*_RULES, "addr_tokens", "street", "ng3", "ng4"),
    "rules": _RULES,
    "affinity": _RULES,
}
RANKING = {"p1": ("name_tokens", "digits"), "p2": ("name_tokens", "digits"), "p3": ("name_tokens", "addr_tokens", "digits", "alpha"), "p3b": ("name_tokens", "addr_tokens", "alpha", "street", "postal"), "p4": ("name_tokens", "addr_tokens", "alpha", "street"), "p5": ("name_tokens", "digits")}


def fields(preset: Preset) -> list[str] | None:
    """The columns that decided() reads; None: a model may read all."""
    return ["id", "clean_name", *FIELDS[preset.score]] if preset.score in FIELDS else None


def ranking_fields(preset: Preset) -> list[str]:
    return ["id", *RANKING.get(preset.rank_by, ()), *preset.before]


def champion_parts(words: bool = False) -> dict[str, Column]:
    """The tiered heuristic's name similarity, shared digits and score; no UDF.  words: the records have the word sets of their names."""
    n1, n2 = side("clean_name")
    d1, d2 = side("domain")
    x, y = side("digits")
    name = S.set_dice(*side("words")) if words else S.dice(n1, n2)
    tight = [F.replace(n, F.lit(" "), F.lit("")) for n in (n1, n2)]
    lifted = F.when(S.same(d1, d2), F.greatest(name, F.lit(0.95))).when(((d1 != "") & F.contains(tight[1], d1)) | ((d2 != "") & F.contains(tight[0], d2)), F.greatest(name, F.lit(0.90))).otherwise(name)
    name = F.when(name < 0.85, lifted).otherwise(name)
    known = (F.size(x) > 0) & (F.size(y) > 0)
    shared = S.overlap(x, y)
    address = F.when(~known, F.lit(0.5)).otherwise(S.jaccard(x, y))
    penalty = F.when(known & (shared == 0), F.lit(0.30)).otherwise(0.0)
    return {"name": name, "shared": shared, "score": 0.65 * name + 0.35 * address - penalty}


def explorer_score() -> Column:
    """The browser's score: word Dice with lifts for stems and other scripts, addresses by digits, both clamped."""
    n1, n2 = side("clean_name")
    name = S.dice(n1, n2)
    name = F.when(S.same(*side("domain")), name + 0.35).otherwise(name)
    name = F.least(F.lit(1.0), F.when(F.col("l.indic") != F.col("r.indic"), name + 0.60).otherwise(name))
    x, y = side("digits")
    known = (F.size(x) > 0) & (F.size(y) > 0)
    address = F.when(~known, F.lit(0.5)).when(S.overlap(x, y) > 0, S.jaccard(x, y)).otherwise(0.1)
    return F.least(F.lit(0.99), F.greatest(F.lit(0.05), 0.65 * name + 0.35 * address))


def _evidence(made: bool = False) -> dict[str, Column]:
    """Yes-no evidence that the rule cascades share, for once()."""
    s1, s2 = side("specific")
    d1, d2 = side("digits")
    a1, a2 = side("alpha")
    shared_digits = _overlap("digits", made) > 0
    return {
        "e_state": S.differ(*side("state")),
        "e_specific": _overlap("specific", made),
        "e_both_specific": (F.size(s1) > 0) & (F.size(s2) > 0),
        "e_digits": shared_digits,
        "e_against": (F.size(d1) > 0) & (F.size(d2) > 0) & ~shared_digits,
        "e_indic": F.col("l.indic") | F.col("r.indic"),
        "e_same": S.same(a1, a2) & (F.length(a1) >= 3),
        "e_inside": (a1 != a2) & (F.length(a1) >= 8) & (F.length(a2) >= 8) & S.within(a1, a2),
        "e_domain": S.domain_match(F.col("l.domain"), a1, F.col("r.domain"), a2),
        "e_common": _overlap("name_tokens", made),
        "e_fewest": F.when((F.size("l.name_tokens") > 0) & (F.size("r.name_tokens") > 0), F.least(F.size("l.name_tokens"), F.size("r.name_tokens"))).otherwise(0),
    }


def _told(made: bool) -> dict[str, Column]:
    return {k.removeprefix("e_"): c for k, c in _of(_evidence(), made).items()}


def affinity(made: bool = False) -> Column:
    """A continuous score with early answers: state, digits, equal names, stems, then name and address together."""
    e, jw = _told(made), F.col("jw")
    a1, a2 = side("alpha")
    d1, d2 = side("domain")

    def stem(d: Column, a: Column) -> Column:
        return (d != "") & ((d == a) | ((F.length(d) >= 8) & (a != "") & S.within(d, a)))

    spec = F.least(F.lit(0.70), 0.35 * e["specific"]) + F.when(e["digits"], F.lit(0.25)).otherwise(0.0)
    backed = (e["specific"] >= 1) | e["digits"]
    name = F.when((e["fewest"] >= 2) & (e["common"] >= e["fewest"] - 1), F.greatest(jw, F.lit(0.90))).otherwise(jw)
    latin = (
        F.when(~e["both_specific"], F.when(name >= 0.88, name * 0.95).otherwise(0.0))
        .when(backed, 0.5 * name + 0.5 * spec)
        .when(name >= 0.94, name * 0.85)
        .otherwise(0.0)
    )
    return (
        F.when(e["state"] | (e["against"] & (e["specific"] == 0)), F.lit(0.0))
        .when(S.same(a1, a2), F.when(e["against"], F.lit(0.85)).otherwise(0.99))
        .when(stem(d2, a1) | stem(d1, a2), F.when(e["against"], F.lit(0.80)).otherwise(0.98))
        .when(e["indic"], F.when((e["specific"] >= 2) | ((e["specific"] >= 1) & e["digits"]), 0.90 + spec * 0.1).otherwise(0.0))
        .otherwise(latin)
    )


# Decisions -------------------------------------------------------------------


def tiered(score: Column, address: Column, tau: float, high: float, floor: float) -> Column:
    return (score >= high) | ((score >= tau) & (address >= floor))


def cascade(tau: float, high: float, floor: float, made: bool = False) -> Column:
    """Rules R1 to R8, then the tiers."""
    e, jw, tokens = _told(made), F.col("jw"), F.col("m_tokens") if made else S.containment(*side("name_tokens"))
    free = ~e["against"]
    backed = ~e["both_specific"] | (e["specific"] >= 1) | e["digits"]
    strong = (e["specific"] >= 2) | ((e["specific"] >= 1) & e["digits"])
    accept = (
        (e["same"] & free & (backed | (jw >= 0.98)))
        | (e["domain"] & free)
        | (e["inside"] & free & backed)
        | ((jw >= 0.94) & free & (backed | (jw >= 0.98)))
        | ((jw >= 0.88) & (tokens >= 0.8) & free & backed)
        | (e["indic"] & free & strong & ((jw >= 0.50) | (tokens >= 0.5)))
        | (strong & free & ((jw >= 0.70) | (tokens >= 0.7)))
        | tiered(F.col("score"), F.col("address"), tau, high, floor)
    )
    return ~e["state"] & accept


@dataclass(frozen=True)
class Rules:
    """Limits of the boolean rules.

    equal_backed: equal names stand against conflicting digits if the addresses
    share a specific word; gap: length difference of a contained name; stem:
    least length of a domain's stem; high: Jaro-Winkler for a near-equal name;
    contained: the same where all tokens of the shorter name are shared;
    address: the same where the addresses agree.
    """

    high: float = 0.94
    equal_backed: bool = True
    gap: int = 2
    stem: int = 5
    contained: float = 0.88
    address: float = 0.70


RULES = {"production": Rules(), "optimised": Rules(), "strict": Rules(0.96, False, 1, 6, 0.90, 0.75)}


def boolean_rules(rules: Rules = RULES["production"], made: bool = False) -> Column:
    """Equal or contained names, stems, then cases A to C; a state conflict rejects."""
    e, jw = _told(made), F.when((F.col("l.clean_name") != "") & (F.col("r.clean_name") != ""), F.col("jw")).otherwise(0.0)
    a1, a2 = side("alpha")
    d1, d2 = side("domain")
    free = ~e["against"]
    close = (F.length(a1) >= 8) & (F.length(a2) >= 8) & (F.abs(F.length(a1) - F.length(a2)) <= rules.gap) & S.within(a1, a2)

    def stem(d: Column, a: Column) -> Column:
        # An empty name stands inside every stem.
        return (F.length(d) >= rules.stem) & ((d == a) | ((F.length(d) >= 8) & ((a == "") | S.within(d, a))))

    backed = ~e["both_specific"] | (e["specific"] >= 1) | e["digits"]
    strong = (e["specific"] >= 2) | ((e["specific"] >= 1) & e["digits"])
    equal = S.same(a1, a2) & ((free | (e["specific"] >= 1)) if rules.equal_backed else free)
    accept = (
        equal
        | (free & (close | stem(d2, a1) | stem(d1, a2)))
        | (free & (jw >= rules.high) & (backed | (jw >= 0.98)))
        | (free & (jw >= rules.contained) & (e["fewest"] >= 2) & (e["common"] >= e["fewest"]) & backed)
        | (free & strong & (e["indic"] | (jw >= rules.address) | (e["common"] >= 1)))
    )
    return ~e["state"] & accept


def champion_decision(tau: float, tiers: tuple[float, float, float] = (0.82, 0.60, 0.40), made: bool = False) -> Column:
    p = _of(champion_parts(), made)
    return (p["name"] >= tiers[0]) | ((p["name"] >= tiers[1]) & (p["shared"] >= 1)) | ((p["name"] >= tiers[2]) & (p["shared"] >= 2)) | (p["score"] >= tau)


def address_guard(least: float = 0.0) -> Column:
    """Both addresses known, no shared digit and too little in common: to be rejected."""
    both = (F.col("l.clean_addr") != "") & (F.col("r.clean_addr") != "")
    return both & (S.jaccard(*side("addr_tokens")) <= least) & (S.overlap(*side("digits")) == 0)


def hybrid_decision(p: Column, high: float = 0.70, tau: float = 0.48, floor: float = 0.16) -> Column:
    return ~S.differ(*side("state")) & ~S.differ(*side("street")) & ~address_guard() & tiered(p, S.jaccard(*side("addr_tokens")), tau, high, floor)


def penalised(p: Column, conflict: Column, penalty: float = 0.35) -> Column:
    """A probability less the penalty where numbers conflict, not under 0."""
    return F.when(conflict > 0.5, F.greatest(F.lit(0.0), p - penalty)).otherwise(p)


# Selections within an entity ---------------------------------------------------


def margin_guard(scored: DataFrame, margin: float, high: float, tau: float) -> DataFrame:
    """Pairs at or above tau of entities whose best is at least high, or ahead of the second by margin."""
    w = Window.partitionBy("s1").orderBy(F.col("score").desc(), "cid")
    top = F.first("score").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    second = F.coalesce(F.nth_value("score", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
    out = scored.withColumn("top", top).withColumn("second", second)
    return out.where((F.col("score") >= tau) & ((F.col("top") >= high) | (F.col("top") - F.col("second") >= margin))).drop("top", "second")


def margin_competition(scored: DataFrame, first: float = 0.60, rest: float = 0.52, margin: float = 0.12, most: int = 10) -> DataFrame:
    """The best pair if good enough, and others close behind it."""
    w = Window.partitionBy("s1")
    out = scored.withColumn("top", F.max("score").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.col("score").desc(), "cid")))
    good = ((F.col("rn") == 1) & (F.col("score") >= first)) | ((F.col("rn") > 1) & (F.col("score") >= rest) & (F.col("top") - F.col("score") < margin))
    return out.where(good & (F.col("rn") <= most)).drop("top", "rn")


def argmax_assignment(scored: DataFrame, least: float = 0.70, final: float = 0.75) -> DataFrame:
    """Each candidate stays with its best entity only."""
    w = Window.partitionBy("cid").orderBy(F.col("score").desc(), "s1")
    return scored.where(F.col("score") >= least).withColumn("rn", F.row_number().over(w)).where((F.col("rn") == 1) & (F.col("score") >= final)).drop("rn")


def cardinality_cap(scored: DataFrame, most: int = 10) -> DataFrame:
    w = Window.partitionBy("s1").orderBy(F.col("score").desc(), "cid")
    return scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def decided(pairs: DataFrame, preset: Preset) -> DataFrame:
    """(s1, cid, score) that the preset's decision accepts; pairs have l and r and, where a model decides, p."""
    if preset.score == "model":
        score = penalised(F.col("p"), S.conflict(*side("street")))
        scored = pairs.withColumn("score", score).withColumn("address", S.jaccard(*side("addr_tokens")))
        keep = hybrid_decision(score, preset.high, preset.tau, preset.floor) if preset.decision == "hybrid" else F.col("score") >= preset.tau
        out = scored.where(keep)
    elif preset.score == "l0":
        out = once(pairs, champion_parts("words" in pairs.schema["l"].dataType.names)).where(champion_decision(preset.tau, made=True))
    else:
        late = preset.normaliser.startswith("suffixed")
        held = once(once(pairs, overlaps(preset.score)), measures(preset.score, True))
        # What is left of the records are their short columns.
        short = [c for c in pairs.schema["l"].dataType.names if c not in SETS or c == "digits"]
        held = held.withColumns({x: F.struct(*(F.col(f"{x}.{c}").alias(c) for c in short)) for x in ("l", "r")})
        withk = with_kernels(held, 50 if late else 40, "any", ordered=preset.score == "p9")
        if preset.score == "rules":
            out = withk.withColumn("score", F.col("jw")).where(boolean_rules(RULES[preset.options.get("rules", "production")], True))
        else:
            scored = withk.withColumn("score", match_score(preset.score, True))  # of made columns: cheap to repeat
            if preset.decision in ("tiered", "cascade"):
                scored = scored.withColumn("address", F.col("m_address"))
            if preset.decision == "tiered":
                out = scored.where(tiered(F.col("score"), F.col("address"), preset.tau, preset.high, preset.floor))
            elif preset.decision == "cascade":
                out = scored.where(cascade(preset.tau, preset.high, preset.floor, True))
            elif preset.decision == "margin":
                out = margin_guard(scored, preset.options["margin"], preset.high, preset.tau)
            elif preset.decision == "argmax":
                out = argmax_assignment(scored, preset.tau, preset.high)
            else:
                out = scored.where(F.col("score") >= preset.tau)
    out = out.select("s1", "cid", "score")
    return cardinality_cap(out, preset.most).drop("rn") if preset.most else out
