"""Operator 2: SentencePiece BPE encoding and decoding, by the table over prefixes of prefix_bpe."""

from __future__ import annotations

import hashlib
import re

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .prefix_bpe import PrefixBPE, Recent

SPACE = "▁"  # stands for a space inside pieces
CACHE = 200_000
_loaded: dict[str, PieceCodec] = {}


class PieceCodec:
    """Encodes and decodes as the sentencepiece library does for a BPE model with identity normalisation and byte fallback.

    The library is asked for the vocabulary and scores only. No piece has a space mark after another symbol, so a text
    falls into segments (a run of space marks and what follows) that are encoded independently and cached.
    """

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        names = {i: sp.id_to_piece(i) for i in range(n)}
        rank = {names[i]: -sp.get_score(i) for i in normal}
        if any(SPACE in p.lstrip(SPACE) for p in rank):
            raise ValueError("a piece crosses a word border: segments would not be independent")
        self.bpe = PrefixBPE({names[i]: i for i in normal}, lambda x, y: rank.get(x + y))
        self.byte_id = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unk = sp.unk_id()
        #: what an id decodes to; bytes of a byte piece stay apart, since a run of them decodes together
        self.raw = {i: names[i].replace(SPACE, " ") for i in normal}
        self.byte = {i: b for b, i in self.byte_id.items()}
        self.index_ids = [self.bpe.ids[t] for t in self.bpe.names]
        self.seen = Recent(CACHE)
        self.split = re.compile(f"{SPACE}*[^{SPACE}]*")
        #: a line end that no piece contains parts segments as well
        self.lines = not any("\n" in p for p in rank) and 10 in self.byte_id

    def ids_of(self, segment: str) -> list[int]:
        tokens = self.bpe.encode(segment)
        if -1 not in tokens:
            index = self.index_ids
            return [index[t] for t in tokens]
        out: list[int] = []
        at = 0
        for t in tokens:
            if t < 0:
                out += [self.byte_id.get(b, self.unk) for b in segment[at].encode("utf-8", "replace")]
                at += 1
            else:
                out.append(self.index_ids[t])
                at += self.bpe.sizes[t]
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for s in self.split.findall(SPACE + text.replace(" ", SPACE)):
            out += self.ids_of(s)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; runs of byte pieces decode as UTF-8, each byte that does not fit as U+FFFD; the space that encoding put in front goes."""
        out, run, first = [], bytearray(), True
        for i in ids:
            if i in self.byte:
                run.append(self.byte[i])
                first = False
                continue
            if run:
                out.append(utf8(run))
                run = bytearray()
            piece = self.raw.get(i, " ⁇ " if i == self.unk else "")
            if first and i in self.raw:
                piece = piece.removeprefix(" ")
                first = False
            out.append(piece)
        if run:
            out.append(utf8(run))
        return "".join(out)

    def _segment(self, s: str) -> tuple[int, str, str]:
        """Count, ids as text, decoded text of one segment, of which no byte run passes the end (it would break a symbol)."""
        ids = self.ids_of(s)
        raw = self.raw
        try:
            back = "".join([raw[i] for i in ids])
        except KeyError:  # byte pieces
            back = self.decode([self.bpe.ids[SPACE], *ids])
        found = (len(ids), ",".join(map(str, ids)), back)
        if len(s) < 64:
            self.seen.put(s, found)
        return found

    def _segments(self, text: str) -> list[str]:
        text = SPACE + text.replace(" ", SPACE)
        return [x for x in self.split.findall(text) if x]

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, sha256 of the ids joined by commas, sha256 of the decoded text)."""
        parts: list[str] = []
        if text:
            if "  " in text or SPACE in text or " \n" in text or text[-1] == " " or text[0] == " " or not self.lines:
                parts = self._segments(text)
            else:
                marked = (SPACE + text.replace("\n", " \n ")).split(" ")  # a line end is a segment, and the next word has no mark
                bare = True
                for w in marked:
                    if w == "\n":
                        parts.append(w)
                        bare = True
                    elif bare:
                        if w:
                            parts.append(w)
                        bare = False
                    else:
                        parts.append(SPACE + w)
        new = self.seen.new.get
        found = list(map(new, parts))
        if None in found:
            get, make = self.seen.get, self._segment
            found = [x or get(p) or make(p) for x, p in zip(found, parts, strict=True)]
        back = "".join([x[2] for x in found])
        ids = ",".join([x[1] for x in found])
        return sum([x[0] for x in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256((back[1:] if back[:1] == " " else back).encode("utf-8", "replace")).hexdigest()


def utf8(run: bytes) -> str:
    """Decodes byte by byte where UTF-8 breaks: one U+FFFD for each byte that fits nowhere."""
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(bytes(run[at : at + size]).decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def codec(path: str) -> PieceCodec:
    if path not in _loaded:
        _loaded[path] = PieceCodec(path)
    return _loaded[path]


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: (id, n_tokens, ids_sha256, decoded_sha256) of the whole text. No shuffle.

    Null text is empty: no ids, digests of the empty string. Ids may be null or repeat; rows are taken one by one; an
    empty table gives an empty result; other columns are not read.
    """

    def f(cols):
        c = codec(path)
        got = [c.digest(x or "") for x in cols["t"]]
        return {"i": cols["i"], "n_tokens": [x[0] for x in got], "ids_sha256": [x[1] for x in got], "decoded_sha256": [x[2] for x in got]}

    kind = dict(docs.dtypes)[id_col]
    return map_arrow(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), f, f"i {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("i", id_col)


def encode_column(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with an array of ids appended (general interface; null text gives an empty array)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<int>")
    def ids(texts):
        import pandas as pd

        c = codec(path)
        return pd.Series([c.encode(x or "") for x in texts])

    return docs.withColumn(out_col, ids(F.col(text_col)))


def decode_column(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """rows with the text of their ids appended (null ids give an empty text)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text(lists):
        import pandas as pd

        c = codec(path)
        return pd.Series([c.decode(list(x) if x is not None else []) for x in lists])

    return rows.withColumn(out_col, text(F.col(ids_col)))
