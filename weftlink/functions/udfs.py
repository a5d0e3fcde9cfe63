"""Arrow UDFs for what Spark has no built-in: accent folding, Jaro-Winkler, longest common subsequence."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlink.functions import native


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else fold(t))


def fold_accents(c: Column) -> Column:
    """NFKD without combining marks (those of a non-zero class)."""
    return _fold(F.coalesce(c, F.lit("")))


def jaro_winkler_of(a: str, b: str, max_len: int | None = None, prefix: str = "run") -> float:
    """Jaro-Winkler, half transpositions counted as they are, no boost threshold.

    prefix "run" counts equal characters up to the first difference, of four;
    "any" counts all equal places among the first four.
    """
    if a == b:
        return 1.0
    if max_len:
        a, b = a[:max_len], b[:max_len]
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    if prefix == "run":
        reach = max(reach, 0)
    used = bytearray(len(b))
    left = []
    # Windows only move on and the first free place is taken, so a character's earlier places never come back.
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    for i, x in enumerate(a):
        free = places.get(x)
        while free and free[-1] < i - reach:
            free.pop()
        if free and free[-1] <= i + reach:
            used[free.pop()] = 1
            left.append(x)
    if not left:
        return 0.0
    m = len(left)
    right = [y for y, u in zip(b, used) if u]
    crossed = sum(x != y for x, y in zip(left, right))
    sim = (m / len(a) + m / len(b) + (m - crossed / 2) / m) / 3
    same = [x == y for x, y in zip(a[:4], b[:4])]
    n = sum(same) if prefix == "any" or all(same) else same.index(False)
    out = sim + n * 0.1 * (1.0 - sim)
    return min(1.0, out) if prefix == "run" else out


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit-parallel row at a time; common ends count as they are."""
    if a == b:
        return len(a)
    if len(a) < len(b):
        a, b = b, a
    head = _common(a, b)
    a, b = a[head:], b[head:]
    tail = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not b:
        return head + tail
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        u = row & masks.get(y, 0)
        row = (row + u | row - u) & full
    return head + tail + len(a) - row.bit_count()


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _pairs(f: Callable[[str, str], float], either: bool = False) -> Callable[[Column, Column], Column]:
    """either: f is the same both ways round, so a pair is computed once in a batch."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        if not either:
            return pd.Series([f(x or "", y or "") for x, y in zip(a, b)], dtype="float64")
        seen: dict[tuple[str, str], float] = {}
        out = []
        for x, y in zip(a, b):
            key = (x or "", y or "") if (x or "") <= (y or "") else (y or "", x or "")
            if key not in seen:
                seen[key] = f(*key)
            out.append(seen[key])
        return pd.Series(out, dtype="float64")

    return run


def jaro_winkler(a: Column, b: Column, max_len: int | None = None, prefix: str = "run") -> Column:
    @F.arrow_udf(T.DoubleType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = native.jaro_winkler(a, b, max_len, prefix)
        return pa.array(out if out is not None else [jaro_winkler_of(x or "", y or "", max_len, prefix) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    return run(a, b)


def sorted_jaro_winkler(a: Column, b: Column, max_len: int | None = None, prefix: str = "any") -> Column:
    """Jaro-Winkler of the words in order."""
    return _pairs(lambda x, y: jaro_winkler_of(" ".join(sorted(x.split())), " ".join(sorted(y.split())), max_len, prefix))(a, b)


def ratio(a: str, b: str) -> float:
    """2 * LCS / (length sum); both empty 1."""
    return 2.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


@lru_cache(1 << 12)
def _sorted_words(x: str) -> str:
    return " ".join(sorted(x.split()))


def _ratios(both: float, words: bool = False) -> Callable[[Column, Column], Column]:
    """ratio() of two columns, of their words in order with words; two empty texts give both, one gives 0."""

    @F.arrow_udf(T.DoubleType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        if words:
            a, b = (pa.array([_sorted_words(x or "") for x in c.to_pylist()], pa.large_string()) for c in (a, b))
        out = native.lcs(a, b)
        if out is None:
            return pa.array([ratio(x, y) if x and y else both * ((x or "") == (y or "")) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())
        shared, n, m = out
        return pa.array(np.where((n == 0) & (m == 0), both, np.where((n == 0) | (m == 0), 0.0, 2.0 * shared / np.maximum(n + m, 1))))

    return run


def indel_ratio(a: Column, b: Column) -> Column:
    """1 - insertions and deletions per character: both empty 1, one empty 0."""
    return _ratios(1.0)(a, b)


def lcs_ratio(a: Column, b: Column) -> Column:
    """As indel_ratio, but 0 if either is empty."""
    return _ratios(0.0)(a, b)


def _token_set(x: str, y: str) -> float:
    s, t = set(x.split()), set(y.split())
    both = " ".join(sorted(s & t))
    # The common words in order are a subsequence of either side's words in order.
    return max(2.0 * len(both) / (len(both) + n) if both else float(n == 0) for n in (len(" ".join(s)), len(" ".join(t))))


def token_sort_ratio(a: Column, b: Column) -> Column:
    return _ratios(1.0, True)(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    """The better ratio of the common words, sorted, with either side's words, sorted."""
    return _pairs(_token_set, True)(a, b)


def best_ratio(word: str, others: dict[int, list[str]]) -> float:
    """The best ratio of a word with words that differ from it, given by length; lengths are taken while they can still win."""
    n, best = len(word), 0.0
    for m in sorted(others, key=lambda m: abs(n - m) / (n + m)):
        if 2.0 * min(n, m) / (n + m) <= best:
            break
        best = max(best, *(_word_ratio(word, w) if word < w else _word_ratio(w, word) for w in others[m]))
    return best


@lru_cache(1 << 18)
def _word_ratio(a: str, b: str) -> float:
    return ratio(a, b)


def monge_elkan_of(a: str, b: str) -> float:
    """Mean, over all words of a, of the best ratio with a word of b; each distinct word is compared once."""
    s, t = a.split(), set(b.split())
    if not s or not t:
        return 0.0
    others: dict[int, list[str]] = {}
    for w in t:
        others.setdefault(len(w), []).append(w)
    best = {w: 1.0 if w in t else best_ratio(w, others) for w in set(s)}
    return sum(best[w] for w in s) / len(s)


def monge_elkan(a: Column, b: Column) -> Column:
    return _pairs(monge_elkan_of)(a, b)


def gram_cosine_of(a: str, b: str, n: int = 3) -> float:
    """Set cosine of the n-grams, spaces as underscores: both without 1, one without 0."""
    s, t = ({x[i : i + n] for i in range(len(x) - n + 1)} for x in (a.replace(" ", "_"), b.replace(" ", "_")))
    return len(s & t) / (len(s) * len(t)) ** 0.5 if s and t else float(not s and not t)


def gram_cosine(a: Column, b: Column) -> Column:
    return _pairs(gram_cosine_of, True)(a, b)
