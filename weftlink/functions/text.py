"""Normalising names and addresses: columns in, columns out.

A null input counts as the empty string everywhere.  Regexes use (?U) where
letters beyond ASCII matter; ``[^\\p{L}\\p{N}_\\s]`` is punctuation.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlink.functions import fixed
from weftlink.functions.udfs import fold_accents

PUNCTUATION = r"(?U)[^\p{L}\p{N}_\s]"
SPACE = r"(?U)\s+"


def text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def _and(c: Column, pattern: str = "&") -> Column:
    return F.regexp_replace(c, pattern, " and ")


def words(c: Column) -> Column:
    """The words of a text; no words give an empty array."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def word_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def literals(values: Iterable[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def mapped(tokens: Column, table: Mapping[str, str]) -> Column:
    """Each token, or what the table makes of it."""
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(m, t), t))


# Names and addresses ---------------------------------------------------------


def contract_name(c: Column | str) -> Column:
    """Accents folded, legal phrases contracted (longest first), punctuation dropped inside words."""
    t = _and(F.lower(fold_accents(text(c))), r"(?U)\s*&\s*")
    for k in sorted(fixed.NAME_PHRASES, key=lambda k: -len(k)):
        t = F.regexp_replace(t, rf"(?U)\b{re.escape(k)}\b", fixed.NAME_PHRASES[k])
    return squeeze(F.array_join(F.transform(words(t), lambda w: F.regexp_replace(w, PUNCTUATION, "")), " "))


def contract_address(c: Column | str) -> Column:
    """Accents folded, address words contracted one after the other (longest first)."""
    t = _and(F.lower(fold_accents(text(c))), r"(?U)\s*&\s*")
    for k in sorted(fixed.ADDRESS_PHRASES, key=lambda k: -len(k)):
        t = F.regexp_replace(t, rf"(?<![A-Za-z]){re.escape(k)}(?![A-Za-z])", fixed.ADDRESS_PHRASES[k])
    return squeeze(F.regexp_replace(t, PUNCTUATION, " "))


def strip_noise(c: Column | str, prefix: bool = True) -> Column:
    """Accents folded, a noise prefix and legal words deleted."""
    t = F.lower(fold_accents(text(c)))
    t = F.regexp_replace(t, fixed.NOISE_PREFIX, "") if prefix else t
    return squeeze(F.regexp_replace(F.regexp_replace(t, fixed.LEGAL_WORDS, " "), PUNCTUATION, " "))


def plain(c: Column | str) -> Column:
    """Lower case, & as a word, everything but ASCII letters and digits a space, squeezed."""
    return squeeze(F.regexp_replace(_and(F.lower(text(c))), r"(?U)[^a-z0-9\s]", " "))


def plain_folded(c: Column | str) -> Column:
    """plain() after folding accents."""
    return squeeze(F.regexp_replace(_and(F.lower(fold_accents(text(c)))), r"(?U)[^a-z0-9\s]", " "))


def plain_acronyms(c: Column | str) -> Column:
    """plain() without the rule for &, dots of acronyms collapsed first."""
    return squeeze(F.regexp_replace(collapse_dots(F.lower(text(c))), r"(?U)[^a-z0-9\s]", " "))


def spaced(c: Column | str) -> Column:
    """Lower case, everything but ASCII letters and digits a space, trimmed; inner runs of spaces stay."""
    return F.trim(F.regexp_replace(F.lower(text(c)), r"(?U)[^a-z0-9\s]", " "))


def joined(c: Column | str) -> Column:
    """Accents folded, dots of acronyms collapsed, then as plain() without the rule for &."""
    return squeeze(F.regexp_replace(collapse_dots(F.lower(fold_accents(text(c)))), r"(?U)[^a-z0-9\s]", " "))


def collapse_dots(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=\b[a-z])\.(?=[a-z]\b)", "")


def strip_suffix(c: Column, suffixes: Iterable[str] = fixed.LEGAL_SUFFIXES, repeat: bool = True) -> Column:
    """Legal suffixes cut from the end of a clean name, longest first; without repeat the first in list order only."""
    if repeat:
        for s in sorted(suffixes, key=len, reverse=True):
            c = F.trim(F.regexp_replace(c, rf"(^| ){re.escape(s)}$", ""))
        return c
    return F.trim(F.regexp_replace(c, rf"(^| )({'|'.join(map(re.escape, suffixes))})$", ""))


def alpha(c: Column | str) -> Column:
    """Only ASCII letters and digits."""
    return F.regexp_replace(F.lower(text(c)), "[^a-z0-9]", "")


def alpha_stripped(c: Column | str) -> Column:
    """alpha() of the name without legal suffixes."""
    return F.regexp_replace(strip_suffix(spaced(c)), "[^a-z0-9]", "")


def domain_stem(c: Column | str, domains: str = fixed.DOMAINS) -> Column:
    """The first host label before a known top-level domain, without hyphens; empty if none."""
    return F.replace(F.regexp_extract(F.lower(text(c)), rf"\b([a-z0-9\-]+)\.(?:{domains})\b", 1), F.lit("-"), F.lit(""))


def has_indic(c: Column | str) -> Column:
    return text(c).rlike(r"[ऀ-ൿ]")


def legal_suffix(clean: Column, suffixes: Iterable[str] = fixed.LEGAL_SUFFIXES) -> Column:
    """The longest suffix that the clean name is or ends with; empty if none."""
    by_length = "|".join(re.escape(s) for s in sorted(suffixes, key=len, reverse=True))
    return F.regexp_extract(clean, rf"(?:^| )({by_length})$", 1)


# Tokens ----------------------------------------------------------------------


def name_tokens(clean: Column) -> Column:
    """Distinct words without articles."""
    return F.array_except(word_set(clean), literals(fixed.NAME_ARTICLES))


def long_tokens(clean: Column, stopwords: Iterable[str] = fixed.LEGAL_STOPWORDS, least: int = 3) -> Column:
    """Words in order, repeats kept, without stop words and short ones."""
    stop = literals(stopwords)
    return F.filter(words(clean), lambda w: ~F.array_contains(stop, w) & (F.length(w) >= least))


def content_tokens(clean: Column, stopwords: Iterable[str] = fixed.LEGAL_STOPWORDS, least: int = 2) -> Column:
    return F.array_distinct(long_tokens(clean, stopwords, least))


def expanded(clean: Column, table: Mapping[str, str] = fixed.EXPAND_WIDE, keep_short: bool = False) -> Column:
    """Distinct address words with abbreviations written out (and, with keep_short, as they stand)."""
    tokens = words(clean)
    long = mapped(tokens, table)
    return F.array_distinct(F.concat(long, tokens)) if keep_short else F.array_distinct(long)


def specific_tokens(tokens: Column) -> Column:
    """Address words of three letters or more that are not generic nor part of a state's name or code."""
    generic = {*fixed.GENERIC_ADDRESS, *fixed.US_STATES, *fixed.US_STATES.values(), *fixed.INDIA_STATES, *fixed.INDIA_STATES.values()}
    left = F.array_except(F.array_except(tokens, literals(fixed.SHORT_STOPWORDS)), literals(sorted(generic)))
    return F.filter(left, lambda w: F.length(w) >= 3)


def _grams(s: Column, n: int) -> Column:
    """All n-grams in order by one pass; substr would walk the text from its start for each."""
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def ngrams(clean: Column, n: int) -> Column:
    """All n-grams in order, spaces as underscores, repeats kept."""
    return _grams(F.replace(clean, F.lit(" "), F.lit("_")), n)


def ngram_set(clean: Column, n: int, short: bool = False) -> Column:
    """Distinct n-grams of the text without spaces, in order; a shorter text gives none, or itself with short."""
    s = F.replace(clean, F.lit(" "), F.lit(""))
    grams = F.array_distinct(_grams(s, n))
    return F.when((F.length(s) < n) & (s != ""), F.array(s)).otherwise(grams) if short else grams


# Numbers in addresses --------------------------------------------------------

NUMBER = r"(?<![\p{L}\p{N}_])\p{Nd}+(?![\p{L}\p{N}_])"


def numbers(c: Column | str) -> Column:
    """All whole-word digit runs in order."""
    return F.regexp_extract_all(text(c), F.lit(NUMBER), F.lit(0))


def digits(c: Column | str) -> Column:
    return F.array_distinct(numbers(c))


def postal(c: Column | str) -> Column:
    """The first run of five or six digits; empty if none."""
    return F.coalesce(F.try_element_at(F.filter(numbers(c), lambda d: F.length(d).isin(5, 6)), F.lit(1)), F.lit(""))


def leading_number(clean: Column) -> Column:
    return F.regexp_extract(clean, r"^(\d+)\b", 1)


def street_number(clean: Column) -> Column:
    """The first digit run of at most five digits."""
    return F.coalesce(F.try_element_at(F.filter(numbers(clean), lambda d: F.length(d) <= 5), F.lit(1)), F.lit(""))


def first_number(clean: Column, longest: int | None = None) -> Column:
    """The first digit run; empty if it is longer than ``longest``."""
    first = F.coalesce(F.try_element_at(numbers(clean), F.lit(1)), F.lit(""))
    return first if longest is None else F.when(F.length(first) <= longest, first).otherwise("")


def street_not_postal(clean: Column) -> Column:
    """The first digit run of at most five digits that is not the postal code."""
    code = postal(clean)
    return F.coalesce(F.try_element_at(F.filter(numbers(clean), lambda d: (d != code) & (F.length(d) <= 5)), F.lit(1)), F.lit(""))


# States ----------------------------------------------------------------------


def _by_name(clean: Column, states: Mapping[str, str], whole: bool) -> Column:
    """The code of the first state, in the table's order, whose name stands in the text."""
    cases = [F.when(clean.rlike(rf"\b{n}\b") if whole else F.contains(clean, F.lit(n)), F.lit(code)) for n, code in states.items()]
    return F.coalesce(*cases)


def _last_code(tokens: Column, states: Mapping[str, str], unsure: Iterable[str]) -> Column:
    sure = literals(sorted(set(states.values()) - set(unsure)))
    return F.try_element_at(F.filter(tokens, lambda w: F.array_contains(sure, w)), F.lit(-1))


def _for_country(country: Column, us: Column, india: Column) -> Column:
    return F.coalesce(F.when(country == "US", us).when(country == "India", india), F.lit(""))


def state_first(clean: Column, country: Column) -> Column:
    """A state's full name, tried in table order, else the last sure two-letter code."""
    two = F.regexp_extract_all(clean, F.lit(r"\b([a-z]{2})\b"), F.lit(1))
    return _for_country(
        country,
        F.coalesce(_by_name(clean, fixed.US_STATES, True), _last_code(two, fixed.US_STATES, fixed.UNSURE_US)),
        F.coalesce(_by_name(clean, fixed.INDIA_STATES, True), _last_code(two, fixed.INDIA_STATES, fixed.UNSURE_INDIA)),
    )


def state_longest(clean: Column, country: Column) -> Column:
    """The leftmost full name (longest first), else the last word that is a sure code."""

    def find(states: Mapping[str, str], unsure: Iterable[str]) -> Column:
        pattern = "|".join(sorted(states, key=len, reverse=True))
        name = F.regexp_extract(clean, rf"\b({pattern})\b", 1)
        table = F.create_map(*(F.lit(x) for kv in states.items() for x in kv))
        return F.coalesce(F.try_element_at(table, name), _last_code(words(clean), states, unsure))

    return _for_country(country, find(fixed.US_STATES, fixed.UNSURE_US), find(fixed.INDIA_STATES, fixed.UNSURE_INDIA))


def state_near_end(clean: Column, country: Column) -> Column:
    """A code searched from the end, then a name anywhere.

    A code counts among the last three words, or if the word after it has five
    digits (US), or if it is no preposition.
    """
    tokens = words(clean)
    n = F.size(tokens)

    def find(states: Mapping[str, str], prepositions: Iterable[str], zips: bool) -> Column:
        codes, unsure = literals(sorted(set(states.values()))), literals(prepositions)

        def counts(w: Column, i: Column) -> Column:
            back = n - 1 - i
            good = (back <= 2) | ~F.array_contains(unsure, w)
            if zips:
                good = good | ((i > 0) & F.coalesce(F.get(tokens, i + 1).rlike(r"^\d{5}$"), F.lit(False)))
            return F.array_contains(codes, w) & good

        found = F.filter(F.transform(tokens, lambda w, i: F.when(counts(w, i), w)), lambda w: w.isNotNull())
        return F.coalesce(F.try_element_at(found, F.lit(-1)), _by_name(clean, states, False))

    return _for_country(country, find(fixed.US_STATES, fixed.PREPOSITIONS_US, True), find(fixed.INDIA_STATES, fixed.PREPOSITIONS_INDIA, False))


# The browser explorer's own cleaning and highlighting ---------------------------


def explorer_clean(c: Column | str) -> Column:
    """Lower case without legal words, punctuation as spaces."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(text(c)), fixed.LEGAL_WORDS, ""), r"[^\w\s]", " "))


def common_words(a: Column, b: Column) -> Column:
    return F.array_intersect(words(F.lower(a)), words(F.lower(b)))
