"""The two string kernels in C: longest common subsequence and Jaro-Winkler of whole Arrow columns.

A worker compiles them once if its machine has a C compiler; where it has none,
``lcs`` and ``jaro_winkler`` give None and the plain forms in ``udfs`` run.
"""

from __future__ import annotations

import ctypes
import os
import shutil
import subprocess
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SOURCE = r"""
#include <stdint.h>
#include <stdlib.h>
#include <string.h>

static int64_t decode(const uint8_t *s, int64_t n, uint32_t *o) {
    int64_t i = 0, k = 0;
    while (i < n) {
        uint32_t c = s[i];
        int m = c < 0x80 ? 0 : c < 0xE0 ? 1 : c < 0xF0 ? 2 : 3;
        if (m) c &= 0x3F >> m;
        for (int j = 1; j <= m; j++) c = c << 6 | (s[i + j] & 0x3F);
        i += m + 1;
        o[k++] = c;
    }
    return k;
}

/* Numbers for characters: the place of each character of a, or of its first equal one, by open addressing. */
typedef struct { uint32_t *key; int32_t *value; int64_t mask; } Table;

static int64_t find(Table *t, uint32_t c) {
    int64_t h = (c * 2654435761u) & t->mask;
    while (t->value[h] >= 0 && t->key[h] != c) h = (h + 1) & t->mask;
    return h;
}

static int64_t lcs(const uint32_t *a, int64_t n, const uint32_t *b, int64_t m, Table *t, uint64_t *masks, uint64_t *row) {
    int64_t head = 0, tail = 0;
    while (head < n && head < m && a[head] == b[head]) head++;
    a += head; b += head; n -= head; m -= head;
    while (tail < n && tail < m && a[n - 1 - tail] == b[m - 1 - tail]) tail++;
    n -= tail; m -= tail;
    if (!n || !m) return head + tail;
    int64_t w = (n + 63) / 64, seen = 0, zeros = 0;
    for (int64_t i = 0; i < n; i++) {
        int64_t h = find(t, a[i]);
        if (t->value[h] < 0) { t->key[h] = a[i]; t->value[h] = seen; memset(masks + seen++ * w, 0, w * 8); }
        masks[t->value[h] * w + i / 64] |= 1ull << (i % 64);
    }
    memset(row, 0xFF, w * 8);
    for (int64_t j = 0; j < m; j++) {
        int64_t h = find(t, b[j]);
        if (t->value[h] < 0) continue;
        const uint64_t *of = masks + t->value[h] * w;
        unsigned char carry = 0;
        for (int64_t k = 0; k < w; k++) {
            uint64_t r = row[k], u = r & of[k], s = r + u, c = s < r;
            uint64_t x = s + carry;
            carry = c | (x < s);
            row[k] = x | (r & ~of[k]);
        }
    }
    if (n % 64) row[w - 1] |= ~0ull << (n % 64);
    for (int64_t k = 0; k < w; k++) zeros += __builtin_popcountll(~row[k]);
    return head + tail + zeros;
}

static double jaro_winkler(const uint32_t *a, int64_t n, const uint32_t *b, int64_t m, int64_t most, int any, Table *t, int32_t *next, uint8_t *used, uint32_t *left) {
    if (n == m && !memcmp(a, b, n * 4)) return 1.0;
    if (most && n > most) n = most;
    if (most && m > most) m = most;
    if (!n || !m) return 0.0;
    int64_t reach = (n > m ? n : m) / 2 - 1, hits = 0, crossed = 0, k = 0, same = 0;
    if (!any && reach < 0) reach = 0;
    memset(used, 0, m);
    for (int64_t j = m - 1; j >= 0; j--) {
        int64_t h = find(t, b[j]);
        next[j] = t->value[h] < 0 ? (int32_t)m : t->value[h];
        t->key[h] = b[j];
        t->value[h] = j;
    }
    for (int64_t i = 0; i < n; i++) {
        int64_t h = find(t, a[i]);
        if (t->value[h] < 0) continue;
        int32_t j = t->value[h];
        while (j < m && j < i - reach) j = next[j];
        if (j < m && j <= i + reach) { used[j] = 1; left[hits++] = a[i]; j = next[j]; }
        t->value[h] = j;
    }
    if (!hits) return 0.0;
    for (int64_t j = 0; j < m; j++) if (used[j]) crossed += left[k++] != b[j];
    double c = (double)hits, sim = (c / n + c / m + (c - crossed / 2.0) / c) / 3;
    for (int64_t i = 0; i < 4 && i < n && i < m; i++) {
        if (a[i] == b[i]) same++;
        else if (!any) break;
    }
    double out = sim + same * 0.1 * (1.0 - sim);
    return !any && out > 1.0 ? 1.0 : out;
}

/* kind 0: the length of the subsequence and both texts' lengths, three numbers a pair; 1 and 2: Jaro-Winkler, 2 with prefix "any". */
int run(int kind, int64_t rows, const uint8_t *da, const int64_t *oa, const uint8_t *db, const int64_t *ob, int64_t most, double *out) {
    int64_t la = 1, lb = 1;
    for (int64_t i = 0; i < rows; i++) {
        if (oa[i + 1] - oa[i] > la) la = oa[i + 1] - oa[i];
        if (ob[i + 1] - ob[i] > lb) lb = ob[i + 1] - ob[i];
    }
    int64_t longest = la > lb ? la : lb, size = 256;
    while (size < 2 * longest) size *= 2;
    uint32_t *a = malloc(longest * 4), *b = malloc(longest * 4), *key = malloc(size * 4), *left = malloc(longest * 4);
    int32_t *value = malloc(size * 4), *next = malloc(longest * 4);
    uint8_t *used = malloc(longest);
    uint64_t *row = malloc((longest / 64 + 1) * 8), *masks = 0;
    int64_t held = 0;
    for (int64_t i = 0; i < rows; i++) {
        int64_t n = decode(da + oa[i], oa[i + 1] - oa[i], a), m = decode(db + ob[i], ob[i + 1] - ob[i], b), limit = 256;
        while (limit < 2 * (n > m ? n : m)) limit *= 2;
        Table t = {key, value, limit - 1};
        memset(value, 0xFF, limit * 4);
        if (kind) { out[i] = jaro_winkler(a, n, b, m, most, kind == 2, &t, next, used, left); continue; }
        const uint32_t *x = n < m ? b : a, *y = n < m ? a : b;
        int64_t p = n < m ? m : n, q = n < m ? n : m, kinds = 0;
        for (int64_t j = 0; j < p; j++) { int64_t h = find(&t, x[j]); if (value[h] < 0) { key[h] = x[j]; value[h] = 0; kinds++; } }
        memset(value, 0xFF, limit * 4);
        if (kinds * (p / 64 + 1) > held) { held = kinds * (p / 64 + 1) * 2; free(masks); masks = malloc(held * 8); if (!masks) return 1; }
        out[3 * i] = (double)lcs(x, p, y, q, &t, masks, row);
        out[3 * i + 1] = (double)n;
        out[3 * i + 2] = (double)m;
    }
    free(a); free(b); free(key); free(left); free(value); free(next); free(used); free(row); free(masks);
    return 0;
}
"""


@lru_cache(1)
def _library() -> ctypes.CDLL | None:
    compiler = shutil.which("cc") or shutil.which("gcc")
    if not compiler:
        return None
    try:
        with tempfile.TemporaryDirectory() as d:
            path = os.path.join(os.path.abspath(d), "kernels.so")
            subprocess.run([compiler, "-O3", "-ffp-contract=off", "-shared", "-fPIC", "-x", "c", "-", "-o", path], input=SOURCE.encode(), check=True, capture_output=True)
            return ctypes.CDLL(path)
    except (OSError, subprocess.CalledProcessError):
        return None


def _run(kind: int, a: pa.Array, b: pa.Array, most: int, width: int) -> np.ndarray | None:
    library = _library()
    if library is None:
        return None
    out, sides, keep = np.zeros(len(a) * width), [], []
    for x in (a, b):
        x = pc.fill_null(x.cast(pa.large_string()), "")
        _, offsets, data = x.buffers()
        offsets = np.frombuffer(offsets, np.int64)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        keep += [x, offsets, data]
        sides += [ctypes.c_void_p(data.ctypes.data), ctypes.c_void_p(offsets.ctypes.data)]
    if library.run(kind, ctypes.c_int64(len(a)), *sides, ctypes.c_int64(most), ctypes.c_void_p(out.ctypes.data)):
        raise MemoryError("no room for the masks of a text")
    return out


def lcs(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Lengths of the longest common subsequences, of a and of b, in characters."""
    out = _run(0, a, b, 0, 3)
    return None if out is None else tuple(out.reshape(-1, 3).T)


def jaro_winkler(a: pa.Array, b: pa.Array, max_len: int | None, prefix: str) -> np.ndarray | None:
    return _run(2 if prefix == "any" else 1, a, b, max_len or 0, 1)
