"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model goes from an ordinary character on to the white-space
marker, so merges never cross the start of a marked word: a text's ids are
those of its marked words, one after the other.  Each worker segments every
distinct marked word once and joins ids (and decoded words) back by position.
The property is checked when the model is loaded; a model without it, or one
whose normalizer changes more than spaces, is encoded text by text.

Null and empty texts have the end id only and decode to the empty text.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftlink.llm import common

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: A run of markers and the word after it; the first word of a text gets its marker from the library.
CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*|[^ {MARK}]+")
#: Words with each kind of character that a normalizer might change, to see that this model's does not.
PROBE = "é Å ﬁ  x 　y \t\n z  ​q Ａ İ ­- Ω"


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        self.split = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and self.sp.decode(self.sp.encode(PROBE)) == PROBE
        self.end = self.sp.eos_id()
        #: Chunk (with its markers) -> (ids joined by spaces, their number, decoded).
        self.table: dict[str, tuple[str, int, str]] = {}

    def _fill(self, chunks: list[str]) -> None:
        """A chunk's first marker is the one that the library itself puts before a text."""
        ids = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        texts = self.sp.decode(ids)
        self.table.update((c, (" ".join(map(str, i)), len(i), " " + t)) for c, i, t in zip(chunks, ids, texts))
        if " " in chunks:  # a marker at the end of a text; the library puts none before an empty text
            self.table[" "] = str(self.sp.piece_to_id(MARK)), 1, " "

    def chunks(self, text: str) -> list[str]:
        """The text's marked words, markers written as spaces; the first has the dummy one."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return CHUNK.findall(" " + text)
        return [" " + w for w in text.split(" ")]

    def run(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """For each text its ids (decimal, joined by spaces), their number without the end id, and the decoded text."""
        if not self.split:
            ids = self.sp.encode(texts, num_threads=1)
            return [(" ".join(map(str, i)), len(i), t) for i, t in zip(ids, self.sp.decode(ids))]
        split = [self.chunks(t) for t in texts]
        if len(self.table) > common.TABLE_SIZE:
            self.table.clear()
        new = list(set(chain.from_iterable(split)) - self.table.keys())
        if new:
            self._fill(new)
        get = self.table.__getitem__
        out = []
        for words in split:
            found = list(map(get, words))
            out.append((" ".join([x[0] for x in found]), sum([x[1] for x in found]), "".join([x[2] for x in found])[1:]))
        return out


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def encoded(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (with the end id) and decoded, the text that they give."""
    path = path or common.tokenizer_path(MODEL)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def encode(ids: list[int], texts: list[str]) -> list:
        p = pieces(path)
        rows = p.run(texts)
        return [ids, [[*map(int, r[0].split()), p.end] for r in rows], [r[2] for r in rows]]

    return common.null_ids(common.base(df, id_col, text_col).mapInArrow(common.per_slice(encode, schema), "doc_id long, ids array<int>, decoded string"))


def digests(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and sha256 of the decimal ids and of the decoded text."""
    path = path or common.tokenizer_path(MODEL)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digest(ids: list[int], texts: list[str]) -> list:
        p = pieces(path)
        rows = p.run(texts)
        end = str(p.end)
        return [
            ids,
            [n + 1 for _, n, _ in rows],
            [hashlib.sha256((f"{i} {end}" if n else end).encode()).hexdigest() for i, n, _ in rows],
            [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for _, _, t in rows],
        ]

    return common.null_ids(common.base(df, id_col, text_col).mapInArrow(common.per_slice(digest, schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))
