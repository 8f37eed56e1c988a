"""Problem 8: token ids of texts by a public byte-level vocabulary."""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

FOLDER = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern of this family of vocabularies, which splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the characters with the Unicode property White_Space.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces between safe boundaries: no token of PATTERN reaches from other characters into the white space behind them.
_PIECE = re.compile(f"[{_SPACES}]*+[^{_SPACES}]++|[{_SPACES}]++")
_LEAD = re.compile(f"[{_SPACES}]*+")
#: Characters beyond which a piece is not remembered, and the number of remembered pieces at which a worker starts anew.
_LONG, _MOST = 48, 150_000


class Encoder:
    """Encodes texts piece by piece and remembers the ids of short pieces."""

    def __init__(self, folder: str = FOLDER, ranks: str = RANKS) -> None:
        with open(os.path.join(folder, ranks), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.bytes_of = {b: a for a, b in table.items()}
        self.known: dict[str, array] = {}

    def _fresh(self, piece: str) -> array:
        ids = array("i")
        lead = _LEAD.match(piece).end()
        if lead > 1 and lead < len(piece):  # all but the last white space is one match of the pattern
            ids.extend(self.bpe._encode_single_piece(piece[: lead - 1]))
            ids.extend(self.bpe.encode_ordinary(piece[lead - 1 :]))
        elif lead:
            ids.extend(self.bpe._encode_single_piece(piece) if lead == len(piece) else self.bpe.encode_ordinary(piece))
        else:
            ids.extend(self.bpe.encode_ordinary(piece))
        if len(piece) <= _LONG:
            if len(self.known) >= _MOST:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def into(self, ids: array, text: str | None) -> None:
        """Appends the ids of ``text`` to ``ids``; none for null and empty text."""
        if text:
            known, fresh, extend = self.known.get, self._fresh, ids.extend
            for piece in _PIECE.findall(text):
                extend(known(piece) or fresh(piece))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, fresh = self.known.get, self._fresh
        return sum([len(known(piece) or fresh(piece)) for piece in _PIECE.findall(text)])

    def decode(self, ids: list[int] | None) -> str | None:
        """Text of ``ids``, joined as raw bytes before they are read as UTF-8; bytes that are none become U+FFFD."""
        return None if ids is None else b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def encoder(folder: str = FOLDER, ranks: str = RANKS) -> Encoder:
    """The encoder of this Python worker, loaded once."""
    return Encoder(folder, ranks)


def _encode(folder: str, ranks: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = encoder(folder, ranks).into
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, ends = array("i"), [0]
                for text in part.column(1).to_pylist():
                    into(ids, text)
                    ends.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.frombuffer(ids, dtype=np.int32) if len(ids) else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, folder: str = FOLDER, ranks: str = RANKS) -> DataFrame:
    """(doc_id, ids) of every document, without special tokens.

    Texts are cut where no token can reach across, so a worker remembers the ids of pieces
    it has met, and neither long texts nor long runs of white space go through the
    splitting pattern at once. Strings that look like special tokens are ordinary text. Null
    and empty text give an empty list. A map over the scan: nothing is shuffled. ``folder`` must hold the
    rank file on every executor. Repeated rows and null ids come out as they went in.
    """
    return docs.select("doc_id", "text").mapInArrow(_encode(folder, ranks), "doc_id bigint, ids array<int>")


def _measure(folder: str, ranks: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(folder, ranks).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(x) for x in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "tokens"])

    return run


def lengths(docs: DataFrame, folder: str = FOLDER, ranks: str = RANKS) -> DataFrame:
    """(doc_id, tokens): the number of ids of each document; 0 for null and empty text."""
    return docs.select("doc_id", "text").mapInArrow(_measure(folder, ranks), "doc_id bigint, tokens bigint")


def _restore(folder: str, ranks: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(folder, ranks).decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def decode(ids: DataFrame, folder: str = FOLDER, ranks: str = RANKS) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): an empty list gives empty text, null gives null.

    Raises on an id that the vocabulary does not have.
    """
    return ids.select("doc_id", "ids").mapInArrow(_restore(folder, ranks), "doc_id bigint, text string")
