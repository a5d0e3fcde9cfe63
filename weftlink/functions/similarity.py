"""Similarities of names, token sets and numbers as column expressions.

Sets are arrays.  What two empty or one empty side gives differs from measure
to measure, so it is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlink.functions import fixed, text


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def _cases(a: Column, b: Column, value: Column, both: float, one: float) -> Column:
    na, nb = F.size(a), F.size(b)
    return F.when((na == 0) & (nb == 0), F.lit(both)).when((na == 0) | (nb == 0), F.lit(one)).otherwise(value)


def jaccard(a: Column, b: Column, both: float = 1.0, one: float = 0.0, shared: Column | None = None) -> Column:
    """shared: the overlap, if it is known, of sets that hold no value twice."""
    if shared is not None:
        return _cases(a, b, shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1)), both, one)
    return _cases(a, b, overlap(a, b) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)), both, one)


def containment(a: Column, b: Column, shared: Column | None = None) -> Column:
    """Share of the smaller set in the larger; 0 if either is empty."""
    return _cases(a, b, (overlap(a, b) if shared is None else shared) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1)), 0.0, 0.0)


def dice(a: Column, b: Column) -> Column:
    """Dice on the word sets of two texts; the same words in any order give 1."""
    return set_dice(text.word_set(a), text.word_set(b))


def set_dice(a: Column, b: Column) -> Column:
    """Twice the overlap over the sum of the sizes; 0 if either is empty."""
    return _cases(a, b, 2.0 * overlap(a, b) / F.greatest(F.size(a) + F.size(b), F.lit(1)), 0.0, 0.0)


def set_cosine(a: Column, b: Column) -> Column:
    """Overlap over the geometric mean of the sizes."""
    return _cases(a, b, overlap(a, b) / F.sqrt(F.greatest(F.size(a) * F.size(b), F.lit(1)).cast("double")), 1.0, 0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 for a null or zero vector."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))


def levenshtein_share(a: Column, b: Column, longest: int = 100, gap: float | None = 0.4) -> Column:
    """1 - distance / longer length, on the first ``longest`` characters; 0 if the lengths differ by more than ``gap``."""
    return headed_share(a == b, (F.length(a), F.length(b)), (F.left(a, F.lit(longest)), F.left(b, F.lit(longest))), gap)


def headed_share(equal: Column, lengths: tuple[Column, Column], heads: tuple[Column, Column], gap: float | None = 0.4) -> Column:
    """levenshtein_share() of two texts known by their first characters, their lengths and whether they are equal."""
    (la, lb), (s, t) = lengths, heads
    value = F.greatest(F.lit(0.0), 1.0 - F.levenshtein(s, t) / F.greatest(F.length(s), F.length(t), F.lit(1)))
    out = F.when(equal, F.lit(1.0)).when((la == 0) | (lb == 0), F.lit(0.0))
    if gap is not None:
        out = out.when(F.abs(la - lb) / F.greatest(la, lb) > gap, F.lit(0.0))
    return out.otherwise(value)


def agreement(a: Column, b: Column, neither: float = 1.0, one: float = 0.5) -> Column:
    """Equal 1, different 0, and what missing ("" or null) sides give."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when((x == "") & (y == ""), F.lit(neither)).when((x == "") | (y == ""), F.lit(one)).when(x == y, F.lit(1.0)).otherwise(0.0)


def conflict(a: Column, b: Column) -> Column:
    """Different 1, one-sided 0.2, else 0."""
    return F.when((a != "") & (b != "") & (a != b), F.lit(1.0)).when(((a != "") | (b != "")) & (a != b), F.lit(0.2)).otherwise(0.0)


def differ(a: Column, b: Column) -> Column:
    """Both known and different."""
    return (a != "") & (b != "") & (a != b)


def same(a: Column, b: Column) -> Column:
    return (a != "") & (a == b)


def within(a: Column, b: Column) -> Column:
    """Either text stands inside the other."""
    return F.contains(a, b) | F.contains(b, a)


def prefix_share(a: Column, b: Column, n: int = 4) -> Column:
    """Share of equal places among the first n characters, n cut to the shorter text."""
    m = F.least(F.length(a), F.length(b), F.lit(n))
    equal = sum(((F.substring(a, i, 1) == F.substring(b, i, 1)) & (m >= i)).cast("int") for i in range(1, n + 1))
    return F.when(m > 0, equal / m).otherwise(0.0)


def suffix_agreement(a: Column, b: Column) -> Column:
    """Last words: equal 1, both corporate 0.7, one missing 0.5, else 0."""
    x, y = (F.try_element_at(text.words(c), F.lit(-1)) for c in (a, b))
    corporate = text.literals(fixed.CORPORATE_WORDS)
    return (
        F.when(x.isNull() | y.isNull(), F.lit(0.5)).when(x == y, F.lit(1.0)).when(F.array_contains(corporate, x) & F.array_contains(corporate, y), F.lit(0.7)).otherwise(0.0)
    )


def shared_long_token(a: Column, b: Column, longer_than: int = 3) -> Column:
    return F.exists(F.array_intersect(a, b), lambda w: F.length(w) > longer_than).cast("double")


def domain_match(stem_a: Column, alpha_a: Column, stem_b: Column, alpha_b: Column) -> Column:
    """Equal stems of five letters, or a stem that is (or, at eight letters, contains or stands in) the other's name."""

    def fits(stem: Column, name: Column) -> Column:
        return (stem == name) | ((F.length(stem) >= 8) & within(stem, name))

    return (
        F.when((F.length(stem_a) >= 5) & (stem_a == stem_b), F.lit(True))
        .when((F.length(stem_b) >= 5) & (alpha_a != ""), fits(stem_b, alpha_a))
        .when((F.length(stem_a) >= 5) & (alpha_b != ""), fits(stem_a, alpha_b))
        .otherwise(F.lit(False))
    )


def phonetic_overlap(a: Column, b: Column, n: int = 3) -> Column:
    """Whether the Soundex codes of the first n words meet (1 or 0)."""

    def codes(c: Column) -> Column:
        return F.transform(F.slice(text.words(c), 1, n), lambda w: F.soundex(w))

    return F.coalesce(F.arrays_overlap(codes(a), codes(b)).cast("double"), F.lit(0.0))
