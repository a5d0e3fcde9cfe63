"""The resolving plan: normalise, block, rank, score, decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.functions import similarity as S
from weftlink.functions import text
from weftlink.operators import blocking, scoring
from weftlink.plans.normalise import normalised
from weftlink.plans.presets import PRESETS, Preset
from weftlink.sources import scratch

#: What is made anew of the clean name where records meet, and not sent: grams, and in two families of normalisers the words.
GRAMS = {f"ng{n}": lambda r, n=n: blocking.numbered(text.ngram_set(r["clean_name"], n)) for n in (3, 4)}
ALL_WORDS = {"words": lambda r: blocking.numbered(text.word_set(r["clean_name"]))}
WORDS = {"name_tokens": lambda r: blocking.numbered(text.word_set(r["clean_name"]))}


def ranked_candidates(s1: DataFrame, s23: DataFrame, preset: Preset) -> DataFrame:
    """(s1, cid, prelim, rn, l, r) of the candidates that pruning keeps.

    Preliminary scores read the array columns of both records, never a UDF, and
    rejects that hold before ranking are filters here.
    """
    fields = scoring.fields(preset)
    if fields and preset.rank_by == "cid" and not preset.before:  # the places need no record
        derived = GRAMS | ALL_WORDS | (WORDS if preset.normaliser in ("plain", "spaced") else {})
        needed = dict.fromkeys(["id", "country", *(c for c in fields if c not in derived), *(c.keys for c in preset.channels)])
        left = scratch.saved(normalised(s1, preset.normaliser).select(*needed), "records")
        right = left if s1 is s23 else scratch.saved(normalised(s23, preset.normaliser).select(*needed), "records")
        each = blocking.lists(left, right, preset.channels, preset.top_k)
        out = blocking.met(each, left, right, fields, derived, place=True).select("s1", "cid", F.lit(0.0).alias("prelim"), "rn", "l", "r")
        scratch.dropped(left, right)
        return out
    left, right = normalised(s1, preset.normaliser), normalised(s23, preset.normaliser)
    pairs = blocking.candidates(left, right, preset.channels).select("s1", "cid", "provenance")
    if preset.rank_by == "cid" and not preset.before:
        return blocking.joined(blocking.ranked(pairs.withColumn("prelim", F.lit(0.0)), preset.top_k, None), left, right, fields)
    by_score = preset.rank_by != "cid"
    pairs = blocking.joined(pairs, left, right, scoring.ranking_fields(preset) if fields else None)
    if "state" in preset.before:
        pairs = pairs.where(~S.differ(*scoring.side("state")))
    pairs = pairs.withColumn("prelim", scoring.prelim(preset.rank_by) if by_score else F.lit(0.0))
    if not fields:
        return blocking.ranked(pairs, preset.top_k, "prelim" if by_score else None)
    # Only the pairs that pruning keeps get all that their score reads.
    return blocking.joined(blocking.ranked(pairs.drop("l", "r"), preset.top_k, "prelim" if by_score else None), left, right, fields)


def resolve(s1: DataFrame, s23: DataFrame, preset: str | Preset, model=None) -> DataFrame:
    """(s1, cid, score) of the accepted pairs; a preset that needs a model takes one with .score(pairs)."""
    p = PRESETS[preset] if isinstance(preset, str) else preset
    pairs = ranked_candidates(s1, s23, p)
    if p.score == "model":
        if model is None:
            raise ValueError(f"preset {p.name} needs a model")
        pairs = model.score(pairs)
    return scoring.decided(pairs, p)
