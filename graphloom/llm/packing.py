"""Packing by power-of-two decomposition.

A document of n tokens is cut by the binary digits of n: as many pieces of the
full length as fit, then one piece for each lower set bit, longest first. Each
piece is a sequence of its own, so none crosses documents and none is padded;
equal lengths form a bucket from which training batches are drawn (``batched``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resharding import slotted
from .shared import held, map_batches
from tokenizers import Tokenizer

LONGEST, END = 2048, 1
_END = END.to_bytes(4, "little")
#: Pieces remembered per worker, in each of two generations; texts that are looked up together.
REMEMBERED, TOGETHER = 500_000, 256
_l, _m = "a-zß-öø-ÿ", r"!-&(-/:-@\[-^`{-~"  # letters; ASCII marks without apostrophe and underscore
_piece = re.compile(rf"[{_l}]+(?=[\s{_m}]|\Z)|[{_m}]+(?=[\s{_l}]|\Z)|\S+")
_core = re.compile(rf"[{_l}]+")
_gap = re.compile(r"[ \t\n\r]+")
_odd = re.compile("[^\x00-\x1b\x20-\xff]")


class Memory(dict):
    """A dictionary that forgets what two generations have not asked for."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.older = most, {}

    def lack(self, keys: set[str]) -> set[str]:
        """Those of ``keys`` that are not known; the others are kept."""
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        new, older = {k for k in keys if k not in self}, self.older
        for k in new:
            if k in older:
                self[k] = older[k]
        return {k for k in new if k not in self}


class WordIds:
    """Ids of texts, piece by piece.

    White space is dropped by the tokenizer and no merge crosses it, nor the
    border between letters and marks. So texts of Latin-1 characters are cut
    there, other texts at white space only, and each piece is encoded once.
    Pieces of letters are encoded many at once and told apart by the
    vocabulary's word ends.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.ids = Memory(remembered)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _learn(self, pieces: set[str]) -> None:
        cores = [p for p in pieces if _core.fullmatch(p)]
        if cores:
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(cores)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(cores):
                raise ValueError("the vocabulary does not mark word ends")
            data, at = ids.tobytes(), 0
            for core, stop in zip(cores, stops.tolist(), strict=True):
                self.ids[core], at = data[at:stop], stop
        for piece in pieces.difference(cores):
            self.ids[piece] = np.asarray(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id."""
        out = []
        for at in range(0, len(texts), TOGETHER):
            cut = [_gap.split(t) if _odd.search(t) else _piece.findall(t.lower()) for t in (t or "" for t in texts[at : at + TOGETHER])]
            self._learn(self.ids.lack(set().union(*cut)))
            look = self.ids.__getitem__
            out += [b"".join(map(look, pieces)) + _END for pieces in cut]
        return out


def word_ids(path: str, remembered: int = REMEMBERED) -> WordIds:
    """One memory per worker, kept from task to task of packing."""
    return held(WordIds, path, remembered)


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The pieces of ``n`` tokens; ``longest`` is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, longest: int = LONGEST, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, bucket, sequence_id, offset.

    A null text counts as empty: its single piece is the end id. Repeated rows
    give repeated pieces in sequences of their own; a null doc_id is carried
    along. An empty table gives an empty result. ``bucket`` is the logarithm of
    the length; ``sequence_id`` is unique, ``offset`` is 0. Other columns are not
    read, very long texts are whole. ``remembered`` pieces are kept by a worker in
    each of two generations; it bounds memory and changes no result.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path, remembered)
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "bucket"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            held = 0
            coded = (x for at in range(0, batch.num_rows, TOGETHER) for x in words.of(batch.column(1).slice(at, TOGETHER).to_pylist()))
            for doc, ids in zip(batch.column(0).to_pylist(), coded, strict=True):
                start, total = 0, len(ids) // 4
                for n in lengths(total, longest):
                    for column, x in zip(rows, (doc, start, n, ids[4 * start : 4 * (start + n)], total, n.bit_length() - 1), strict=True):
                        column.append(x)
                    start += n
                held += len(ids)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)
                    rows, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)

    pieces = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), cut, "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int")
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def batched(packed: DataFrame, size: int) -> DataFrame:
    """Rows of ``pack`` with ``batch``: within each bucket of equal lengths, sequences in their order by ``size``."""
    rows = slotted(packed.withColumnsRenamed({"sequence_id": "row", "bucket": "shard"}))
    return rows.withColumn("batch", F.floor(F.col("slot") / size)).drop("slot").withColumnsRenamed({"row": "sequence_id", "shard": "bucket"})


def op7(docs: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    return pack(docs, remembered=remembered).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
