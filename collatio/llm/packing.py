"""Concatenate and cut: token streams of all partitions laid end to end and cut into windows of a fixed length."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_text_batches, table, written

WINDOW, END = 4096, 2
CACHED_WORDS = 300_000
BROADCAST_PARTITIONS = 1_000_000
#: What the tokenizer's own splitter makes of lower-case Latin-1 text without special tokens.
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^ \t\n\x0b\x0c\r0-9²³¹¼-¾a-zªµºß-öø-ÿ]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """ids of whole texts as little-endian unsigned 16-bit numbers, equal to the tokenizer's encode(text, add_special_tokens=False).

    The tokenizer lower-cases, splits and then encodes each part alone, so parts are encoded once and kept (at most
    ``CACHED_WORDS``, then anew). Text beyond Latin-1, with blanks beyond ASCII or with the opening of a special token goes to
    the tokenizer as it is, run by run between ASCII blanks.
    """

    class _Parts(dict):
        def __init__(self, make):
            self.make = make

        def __missing__(self, part):
            if len(self) >= CACHED_WORDS:
                self.clear()
            ids = self[part] = self.make(part)
            return ids

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        shown = {}  # bytes as the vocabulary writes them: printable ones as they are, the rest from U+0100
        for b in range(256):
            shown[b] = chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else chr(256 + sum(not (33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255) for c in range(b)))
        self.shown = shown
        self.parts, self.runs = self._Parts(self._part), self._Parts(self._run)

    @staticmethod
    def _packed(ids) -> bytes:
        return np.array(ids, dtype="<u2").tobytes()

    def _part(self, part: str) -> bytes:
        if not (part.isascii() and part.isprintable()):
            part = "".join(self.shown[b] for b in part.encode())
        return self._packed([t.id for t in self.tokenizer.model.tokenize(part)])

    def _run(self, run: str) -> bytes:
        return self._packed(self.tokenizer.encode(run, add_special_tokens=False).ids)

    def _plain(self, text: str) -> bool:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return b"<|" not in raw and b"\xa0" not in raw and b"\x85" not in raw

    def encode(self, text: str) -> bytes:
        if self._plain(text):
            return b"".join(map(self.parts.__getitem__, _SPLIT.findall(text.lower())))
        out = []
        for run in re.findall(r"[^\x20\x09-\x0D]+", text):
            out.append(b"".join(map(self.parts.__getitem__, _SPLIT.findall(run.lower()))) if self._plain(run) else self.runs[run])
        return b"".join(out)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(vocabulary: str) -> WordEncoder:
    """One for each worker process and vocabulary."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = WordEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def tokenized(docs: DataFrame, vocabulary: str, end: int = END) -> DataFrame:
    """(part, at, doc_id, n, ids): each document's ids and the tokens before it in its partition. Null text has the end id alone."""

    def encode(batches):
        enc, part, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        tail = np.array([end], dtype="<u2").tobytes()
        for b in batches:
            for lo in range(0, len(b), 500):
                few = b.iloc[lo : lo + 500]
                ids = [enc.encode(t or "") + tail for t in few.text]
                n = np.array([len(x) // 2 for x in ids], dtype=np.int64)
                before = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pd.DataFrame({"part": part, "at": before, "doc_id": few.doc_id.array, "n": n, "ids": ids})

    return in_text_batches(docs).select(F.col("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(encode, f"part int, at long, doc_id {dict(docs.dtypes)['doc_id']}, n long, ids binary")


def packed(docs: DataFrame, vocabulary: str, window: int = WINDOW, end: int = END, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and (unless ``with_ids`` is off) ids.

    Tokens are written once, each partition with its own running sums; the prefix sums of the partitions' totals then
    turn these into places in one global stream, which is cut every ``window`` ids. A document across a cut has a piece
    on either side (a boundary record). Only the last sequence has padding. No document is moved, so nothing is
    shuffled but the totals: one row a partition. Repeated rows and null ids are packed as they come; long documents get as
    many pieces as they need; an empty table has none.
    """
    tokens = written(tokenized(docs, vocabulary, end), "tokens")
    totals = tokens.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = written(totals.select("part", before.alias("base")), "bases")
    if bases.count() <= BROADCAST_PARTITIONS:  # 16 bytes each
        bases = F.broadcast(bases)

    def cut(batches):
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
        for b in batches:
            for lo in range(0, len(b), 500):  # few texts at a time, lest their ids stand in memory more than once
                few = b.iloc[lo : lo + 500]
                rows: dict[str, list] = {k: [] for k in names}
                for doc, n, place, raw in zip(few.doc_id, few.n, few.place, few.ids):
                    wide, start = np.frombuffer(raw, "<u2").astype("<u4"), 0
                    while start < n:
                        sequence, offset = divmod(place + start, window)
                        length = min(window - offset, n - start)
                        piece = wide[start : start + length]
                        for k, v in zip(rows, (doc, start, length, zlib.crc32(piece.tobytes()), n, sequence, offset, piece.view(np.int32))):
                            rows[k].append(v)
                        start += length
                yield pd.DataFrame(rows)

    placed = tokens.join(bases, "part").select("doc_id", "n", (F.col("base") + F.col("at")).alias("place"), "ids")
    kind = dict(docs.dtypes)["doc_id"]
    return placed.mapInPandas(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)


def packed_documents(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """The pieces of all documents without their ids."""
    return packed(table(spark, sf_dir, "documents"), vocabulary or default_vocabulary(), with_ids=False)
