"""Exact token counts at every prefix of a text, for a byte-level BPE.

The merges of a byte-pair encoding give one token sequence for each string, and
a sequence is that one exactly if each pair of neighbours is what the merges
make of the pair's bytes.  So the last token of every prefix follows from those
of shorter prefixes, and one pass over a chunk gives the token count of each of
its prefixes (no chunk is encoded again for another prefix).  Chunks are those
of the vocabulary's pre-tokenizer; distinct units of text are handled once.

With the counts at hand, ``at(i)`` answers how many tokens the first i
characters have and ``fit(budget)`` the longest prefix within a budget.

Null and empty texts have no tokens.  Texts are never shortened.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftlink.llm import common

#: GPT-2's pre-tokenizer, as the vocabulary's ByteLevel stage has it (fixed values).
CHUNKS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "byte_bpe_50k.json"
#: Pairs of tokens of which a worker remembers whether they stay apart.
MEMO = 500_000


def byte_alphabet() -> dict[str, int]:
    """ByteLevel's letters: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Prefix dynamic programming over one vocabulary."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        self.special = tuple(x["content"] for x in spec["added_tokens"])
        special = set(self.special)
        model = spec["model"]
        self.ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        #: Pair of tokens -> rank of their merge; token -> the pair that it is merged from.
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = tuple(self.ids[bytes(letters[c] for c in x)] for x in (a, b))
            self.ranks[pair] = rank
            self.made.setdefault(self.ids[self.bytes_of[pair[0]] + self.bytes_of[pair[1]]], pair)
        self.spines: dict[int, tuple[list, list]] = {}
        self.pairs: dict[int, bool] = {}
        self.done: dict[str, bytes | list[int]] = {}
        self.chunks = regex.compile(CHUNKS)
        self.ascii_chunks = re.compile(common.ASCII_CHUNKS[VOCABULARY][0], re.ASCII).findall

    def spine(self, token: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """How a token's last and its first part grow: (part, rank of the merge that ends it), the byte first."""
        known = self.spines.get(token)
        if known is None:
            sides = []
            for side in (1, 0):
                path, t, until = [], token, len(self.ranks)
                while True:
                    path.append((t, until))
                    if t not in self.made:
                        break
                    until = self.ranks[self.made[t]]
                    t = self.made[t][side]
                sides.append(path[::-1])
            known = self.spines[token] = tuple(sides)
        return known

    def fits(self, left: int, token: int) -> bool:
        """Whether (left, token) is what the merges make of their bytes; left -1: nothing is before.

        Merges go by rank, so the parts that touch grow along two spines.  The
        pair stays apart if no merge across the border comes before the one
        that takes up the touching part on its own side (at equal ranks the
        place further left goes first).
        """
        if left < 0:
            return True
        key = left << 32 | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > MEMO:
                self.pairs.clear()
            lefts, rights, ranks = self.spine(left)[0], self.spine(token)[1], self.ranks
            i = j = 0
            while True:
                (x, x_ends), (y, y_ends) = lefts[i], rights[j]
                across = ranks.get((x, y))
                if across is not None and across < x_ends and across <= y_ends:
                    known = False
                    break
                if i + 1 == len(lefts) and j + 1 == len(rights):
                    known = True
                    break
                if j + 1 == len(rights) or (i + 1 < len(lefts) and x_ends <= y_ends):
                    i += 1
                else:
                    j += 1
            self.pairs[key] = known
        return known

    def chunk(self, chunk: str) -> bytes | list[int]:
        """Token counts at the ends of the chunk's first 0, 1, ... bytes."""
        known = self.done.get(chunk)
        if known is None:
            if len(self.done) > common.TABLE_SIZE:
                self.done.clear()
            known = self._chunk(chunk.encode("utf-8", "surrogatepass"))
            known = self.done[chunk] = bytes(known) if max(known) < 256 else known
        return known

    def _chunk(self, data: bytes) -> list[int]:
        ids, fits = self.ids, self.fits
        last, count = [-1], [0]
        get, pairs, longest = ids.get, self.pairs, self.longest
        for i in range(1, len(data) + 1):
            for at in range(i - 1, i - longest - 1 if i > longest else -1, -1):
                token = get(data[at:i])
                if token is None:
                    continue
                known = pairs.get(last[at] << 32 | token) if at else True
                if known or known is None and fits(last[at], token):
                    last.append(token)
                    count.append(count[at] + 1)
                    break
        return count

    def total(self, text: str) -> int:
        """Tokens of the whole text: special strings count one, the rest by chunks."""
        if text.isascii() and not any(s in text for s in self.special):
            done, n = self.done, 0
            for c in self.ascii_chunks(text):
                known = done.get(c)
                n += (known or self.chunk(c))[-1]
            return n
        n = 0
        for k, part in enumerate(self.parts(text)):
            n += 1 if k % 2 else self.total_plain(part)
        return n

    def parts(self, text: str) -> list[str]:
        """Ordinary text and special strings in turn."""
        import regex

        return regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text) if any(s in text for s in self.special) else [text]

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of text[:0], text[:1], ... text[:len(text)]."""
        out, before = [0], 0
        parts = self.parts(text)
        for k, part in enumerate(parts):
            if k % 2:
                # Short of its end, a special string is ordinary text that goes on from the last chunks before.
                near = "".join(found[-2:])
                kept = before - self.total_plain_of(found[-2:])
                for i in range(1, len(part)):
                    out.append(kept + self.total_plain(near + part[:i]))
                before += 1
                out.append(before)
                continue
            found = self.chunks.findall(part)
            for j, c in enumerate(found):
                counts = self._characters(c)
                if counts[-1] == 0 or not c[0].isspace() and c[0] != "'":
                    out.extend([before + n for n in counts[1:]])
                    before += counts[-1]
                    continue
                partial = self._partial(c)
                for i in range(1, len(c)):
                    if i == 1 and c[0].isspace() and j and found[j - 1].isspace():
                        # A shorter text ends in white space here: one longer run.
                        back = found[j - 1]
                        out.append(before - self.total_plain(back) + self.total_plain(back + c[0]))
                    else:
                        out.append(before + (partial[i] if partial else counts[i]))
                before += counts[-1]
                if len(c) == 1 and j and c.isspace() and found[j - 1].isspace() and j + 1 < len(found):
                    out.append(before - counts[-1] - self.total_plain(found[j - 1]) + self.total_plain(found[j - 1] + c))
                else:
                    out.append(before)
        return np.array(out, np.int64)

    def total_plain(self, text: str) -> int:
        return self.total_plain_of(self.chunks.findall(text))

    def total_plain_of(self, chunks: list[str]) -> int:
        return sum(self.chunk(c)[-1] for c in chunks)

    def _characters(self, chunk: str) -> list[int]:
        """Counts at the characters' ends of a chunk."""
        counts = self.chunk(chunk)
        if len(counts) == len(chunk) + 1:
            return counts
        ends = np.cumsum([0, *(len(c.encode("utf-8", "surrogatepass")) for c in chunk)])
        return [counts[e] for e in ends]

    def _partial(self, chunk: str) -> list[int] | None:
        """Counts of a contraction's prefixes, which are no chunk themselves."""
        if chunk[0] != "'" or len(chunk) < 3 or chunk[1:] not in ("re", "ve", "ll"):
            return None
        return [self.total_plain(chunk[:i]) for i in range(len(chunk) + 1)]


class Counts:
    """The counts of one text: totals at the units' ends, and a unit's own prefixes where they are asked for."""

    __slots__ = ("counter", "ends", "sizes", "units")

    def __init__(self, counter: PrefixCounter, units: list[str], totals: list[int]):
        self.counter, self.units = counter, units
        self.ends = np.cumsum(totals, dtype=np.int64)
        self.sizes = np.cumsum([len(u) for u in units], dtype=np.int64)

    @property
    def total(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def at(self, i: int) -> int:
        """Tokens of the first i characters."""
        k = int(np.searchsorted(self.sizes, i, "left"))
        if k >= len(self.units):
            return self.total
        before, start = (int(self.ends[k - 1]), int(self.sizes[k - 1])) if k else (0, 0)
        return before + int(self.counter.prefixes(self.units[k])[i - start])

    def fit(self, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        k = bisect_right(self.ends, budget)
        # A shorter text may have more tokens than a longer one, so a later unit's first places may fit too.
        for j in range(min(k + 1, len(self.units)) - 1, -1, -1):
            before, start = (int(self.ends[j - 1]), int(self.sizes[j - 1])) if j else (0, 0)
            inside = np.flatnonzero(self.counter.prefixes(self.units[j]) + before <= budget)
            if len(inside):
                return int(inside[-1]) + start
        return 0


_COUNTERS: dict[str, tuple[PrefixCounter, common.UnitTable]] = {}


def counter(path: str) -> tuple[PrefixCounter, common.UnitTable]:
    """The dynamic program, and a table from units to their token counts; one of each for each worker process."""
    if path not in _COUNTERS:
        c = PrefixCounter(path)
        _COUNTERS[path] = c, common.UnitTable(lambda units: [c.total(u) for u in units], c.total, True, c.special)
    return _COUNTERS[path]


def counts_of(text: str, path: str) -> Counts:
    c, table = counter(path)
    totals = table.look_up([text])[0]
    return Counts(c, spaced_units(text) if len(totals) > 1 else [text], totals)


def spaced_units(text: str) -> list[str]:
    first, *rest = text.split(" ")
    return [first, *(" " + u for u in rest)]


def token_counts(df: DataFrame, limit: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and n_chars_fit: characters of the longest prefix within the limit."""
    path = path or common.tokenizer_path(VOCABULARY)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("n_chars_fit", pa.int64())])

    def count(ids: list[int], texts: list[str]) -> list:
        c, table = counter(path)
        totals, fits = [], []
        for text, units in zip(texts, table.look_up(texts)):
            n = sum(units)
            totals.append(n)
            fits.append(len(text) if n <= limit else _fit(c, text, units, limit))
        return [ids, [len(t.encode("utf-8", "surrogatepass")) for t in texts], totals, [n > limit for n in totals], fits]

    return common.null_ids(common.base(df, id_col, text_col).mapInArrow(common.per_slice(count, schema), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chars_fit long"))


def _fit(c: PrefixCounter, text: str, totals: list[int], limit: int) -> int:
    """Counts.fit over the units up to the limit only."""
    if len(totals) == 1:
        return Counts(c, [text], totals).fit(limit)
    n = k = 0
    while k < len(totals) and n <= limit + 64:
        n += totals[k]
        k += 1
    return Counts(c, spaced_units(text)[:k], totals[:k]).fit(limit)


def prefix_counts(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the token counts of all prefixes of its text, the empty one first."""
    path = path or common.tokenizer_path(VOCABULARY)
    schema = pa.schema([("doc_id", pa.int64()), ("counts", pa.list_(pa.int64()))])

    def count(ids: list[int], texts: list[str]) -> list:
        c, _ = counter(path)
        return [ids, [c.prefixes(t).tolist() for t in texts]]

    return common.null_ids(common.base(df, id_col, text_col).mapInArrow(common.per_slice(count, schema), "doc_id long, counts array<long>"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.documents(spark, sf_dir), 512)
