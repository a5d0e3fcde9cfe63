"""Matcher generations as parameter sets of one pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Channel:
    """One way to find candidates: equal keys within a country.

    keys names a column of the normalised record (a string or an array); mode
    "skip" leaves out keys with more than ``cap`` postings, "first" keeps the
    first ``cap`` postings in file order.  ``hot_cap`` applies above ``hot``
    postings; ``rare`` keeps only keys with fewer postings than that.
    """

    name: str
    keys: str
    cap: int | None = None
    mode: str = "skip"
    least: int = 1
    rare: int | None = None
    hot: int | None = None
    hot_cap: int | None = None
    weight: int = 1
    first_keys: int | None = None


@dataclass(frozen=True)
class Preset:
    name: str
    normaliser: str
    channels: tuple[Channel, ...]
    top_k: int | None
    rank_by: str = "cid"
    score: str = ""
    decision: str = "tiered"
    tau: float = 0.0
    high: float = 1.0
    floor: float = 0.0
    most: int | None = None
    before: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)


def _n3(name: int = 60, rare: int = 30, address: int = 40, street: int = 40, postal: int = 30, grams: int | None = None) -> tuple[Channel, ...]:
    out = (
        Channel("name", "name_tokens", name),
        Channel("rare", "name_tokens", rare, rare=50),
        Channel("address", "addr_tokens", address),
        Channel("street", "street", street),
        Channel("postal", "postal", postal),
    )
    return out + ((Channel("grams", "ng4", grams),) if grams else ())


_CORE = (Channel("name", "name_tokens", 60), Channel("digit", "digits", 40, least=3), Channel("domain", "domain", least=4, weight=2))
_CHAMPION = (Channel("name", "name_tokens", 60), Channel("digit", "digits", 40, least=2), Channel("domain", "domain"))
_PHASE9 = (
    Channel("name", "name_tokens", 100), Channel("rare", "name_tokens", 50, rare=50), Channel("address", "addr_tokens", 60),
    Channel("specific", "specific", 200), Channel("street", "street", 60), Channel("postal", "postal", 50), Channel("grams", "ng4", 40), Channel("domain", "domain"),
)
_PHASE9B = (
    Channel("name", "raw_tokens", 80), Channel("rare", "raw_tokens", 40, rare=50), Channel("address", "addr_tokens", 50),
    Channel("specific", "specific", 200), Channel("street", "street", 50), Channel("postal", "postal", 40), Channel("grams", "ng4", 40), Channel("domain", "domain"),
)
_PRODUCTION = (Channel("name", "name_tokens", 250, least=3), Channel("specific", "specific", 150), Channel("digit", "digits", 100, least=3), Channel("domain", "domain"))
_PHASE16 = (
    Channel("alpha", "alpha", 150, "first", least=3), Channel("name", "name_tokens", 150, "first", least=3, hot=200, hot_cap=60),
    Channel("rare", "name_tokens", 80, "first", least=3, rare=40), Channel("address", "addr_tokens", 80, "first", least=3),
    Channel("digit", "digits", 80, "first"), Channel("grams", "ng4", 60, "first"),
)
_CHALLENGER = (Channel("alpha", "alpha", 100, "first", least=3), Channel("name", "name_tokens", 100, "first", least=3, hot=100, hot_cap=40), Channel("address", "addr_tokens", 80, "first", least=3), Channel("street", "street", 60, "first"), Channel("postal", "postal", 60, "first"))

PRESETS = {
    p.name: p
    for p in (
        Preset("core", "contracting", _CORE, 50, "p1", "model", "probability", 0.56),
        Preset("champion", "noise", _CHAMPION, 50, "cid", "l0", "champion", 0.68),
        Preset("full", "noise", _CHAMPION, 50, "p2", "model", "probability", 0.56),
        Preset("reproduce_0793", "plain", (Channel("name", "name_tokens", 60), Channel("address", "addr_tokens", 40), Channel("street", "street", 40), Channel("postal", "postal", 30)), 50, "cid", "l1", "threshold", 0.56),
        Preset("test_reproduce", "plain", (Channel("name", "content_tokens", 60, "first"), Channel("address", "addr_tokens", 40, "first"), Channel("street", "street", 40, "first")), 50, "cid", "l1", "threshold", 0.56),
        Preset("phase3", "plain", (*_n3(grams=30), Channel("domain", "domain", least=4), Channel("grams3", "ng3", 20)), 50),
        Preset("phase5", "plain", _n3(grams=30), 80, "cid", "l2", "threshold", 0.56),
        Preset("phase8", "plain", _n3(grams=30), 80, "cid", "l2", "margin", 0.56, 0.82, options={"margin": 0.05}),
        Preset("phase8b", "plain", _n3(), 80, "cid", "l2", "tiered", 0.54, 0.82, 0.18),
        Preset("phase9", "suffixed", _PHASE9, 120, "cid", "p9", "cascade", 0.54, 0.82, 0.18),
        Preset("phase9b", "suffixed", _PHASE9B, 120, "cid", "p9b", "cascade", 0.54, 0.82, 0.18),
        Preset("production", "suffixed_once", _PRODUCTION, 120, "cid", "rules", "rules"),
        Preset("phase10", "spaced", _n3(grams=30), 120, "cid", "l3_raw", "tiered", 0.53, 0.75, 0.22),
        Preset("phase10b", "spaced", _n3(grams=30), 130, "cid", "l3", "tiered", 0.53, 0.75, 0.22),
        Preset("phase16", "late", _PHASE16, 100, "p3", "l4", "tiered", 0.52, 0.78, 0.22, 10, ("state",)),
        Preset("argmax", "suffixed", _PRODUCTION, None, "cid", "affinity", "argmax", 0.70, 0.75),
        Preset("optimised", "suffixed", _PRODUCTION, None, "cid", "rules", "rules", options={"rules": "optimised"}),
        Preset("strict", "suffixed", _PRODUCTION, None, "cid", "rules", "rules", options={"rules": "strict"}),
        Preset("challenger_hybrid", "late", _CHALLENGER, 100, "p3b", "model", "hybrid", 0.48, 0.70, 0.16, 10, ("state",)),
    )
}
