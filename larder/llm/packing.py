"""Packing of token pieces into training sequences under several limits at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.tokens import WordTokenizer

END = 1


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold: tokens, pieces (segments) and tokens that bear loss."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


#: Pieces that a task packs together, and sequences that it keeps open meanwhile.
WINDOW = 2048
OPEN = 64


class Packer:
    """Vector bin packing of one task's pieces: every piece goes where its needs point along the room left.

    A piece needs (tokens, one segment, loss-bearing tokens) as shares of the limits; a sequence has the rest of each
    as room. Pieces come largest first out of a window, and each takes the open sequence that fits and has
    the largest dot product of need and room, weighted by how scarce each resource is in the window.
    A piece that fits nowhere opens a sequence; beyond `OPEN` it is cut instead, so that its first part fills the
    sequence with the least room for tokens, which is then closed. At the end the open sequences are poured
    into one another. What is closed below the limit of tokens is cut into powers of two, so no sequence needs padding.
    """

    def __init__(self, limits: Limits, first: int):
        self.limits, self.sequence = limits, first
        self.window: list[tuple] = []
        self.open: list[list] = []  # [tokens, segments, loss, pieces]

    def add(self, owner: int, start: int, length: int, masked: int) -> Iterator[tuple]:
        """Take a document's ids start..start + length, whose first `masked` bear no loss. Yields placed pieces."""
        size = self.limits.tokens
        while length >= size and size - min(masked, size) <= self.limits.loss:
            yield from self._close([(owner, start, size, masked)])
            start, length, masked = start + size, length - size, max(0, masked - size)
        while length:
            size = min(length, self.limits.tokens, masked + self.limits.loss)
            self.window.append((size, owner, start, min(masked, size)))
            start, length, masked = start + size, length - size, max(0, masked - size)
        if len(self.window) >= WINDOW:
            yield from self._place()

    def end(self) -> Iterator[tuple]:
        yield from self._place()
        rest = [piece for bin_ in self.open for piece in bin_[3]]
        self.open = []
        bin_ = [0, 0, 0, []]
        for piece in rest:
            left: tuple | None = piece
            while left:
                left = self._fill(bin_, left)
                if left or bin_[0] == self.limits.tokens:
                    yield from self._finish(bin_[3])
                    bin_ = [0, 0, 0, []]
        yield from self._finish(bin_[3])

    def _fill(self, bin_: list, piece: tuple) -> tuple | None:
        """Add as much of the piece as the sequence holds; the rest, or None."""
        owner, start, size, masked = piece
        take = min(size, self.limits.tokens - bin_[0], masked + self.limits.loss - bin_[2])
        if bin_[1] == self.limits.segments or take <= 0:
            return piece
        bin_[0], bin_[1], bin_[2] = bin_[0] + take, bin_[1] + 1, bin_[2] + take - min(masked, take)
        bin_[3].append((owner, start, take, min(masked, take)))
        return (owner, start + take, size - take, max(0, masked - take)) if take < size else None

    def _place(self) -> Iterator[tuple]:
        pieces = sorted(self.window, reverse=True)
        self.window = []
        limit = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        if not pieces:
            return
        needs = np.array([(size, 1, size - masked) for size, _, _, masked in pieces], float)
        scarce = (needs / limit).sum(axis=0)
        rooms = np.zeros((OPEN, 3))
        for i, bin_ in enumerate(self.open):
            rooms[i] = limit - bin_[:3]
        for need, (size, owner, start, masked) in zip(needs, pieces, strict=True):
            piece: tuple | None = (owner, start, size, masked)
            while piece:
                count = len(self.open)
                room = rooms[:count]
                score = np.where((room >= need).all(axis=1), (room / limit) @ (scarce * need / limit), -1.0)
                best = int(score.argmax()) if count else -1
                if best < 0 or score[best] < 0:
                    if count < OPEN:
                        self.open.append([0, 0, 0, []])
                        rooms[count], best = limit, count
                    else:
                        best = int(room[:, 0].argmin())
                bin_ = self.open[best]
                piece = self._fill(bin_, piece)
                rooms[best] = limit - bin_[:3]
                if piece:
                    need = np.array([piece[2], 1, piece[2] - piece[3]], float)
                if piece or bin_[0] == self.limits.tokens:
                    yield from self._finish(bin_[3])
                    last = len(self.open) - 1
                    self.open[best], rooms[best] = self.open[last], rooms[last]
                    self.open.pop()

    def _finish(self, pieces: list[tuple]) -> Iterator[tuple]:
        """Close a full sequence as it is, another as powers of two."""
        while pieces:
            total = sum(p[2] for p in pieces)
            head, pieces = _split(pieces, total if total == self.limits.tokens else 1 << (total.bit_length() - 1))
            yield from self._close(head)

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for owner, start, size, _ in pieces:
            yield owner, start, size, self.sequence, offset
            offset += size
        self.sequence += 1


def _split(pieces: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
    """The first `size` tokens of the pieces, and the rest."""
    head, tail = [], []
    for owner, start, length, masked in pieces:
        take = min(length, size)
        if take:
            head.append((owner, start, take, min(masked, take)))
            size -= take
        if take < length:
            tail.append((owner, start + take, length - take, max(0, masked - take)))
    return head, tail


def _pack(batches: Iterator[pa.RecordBatch], path: str, limits: Limits, masked: bool) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    packer = Packer(limits, (task.partitionId() if task else 0) << 40)
    tokenizer = WordTokenizer.load(path)
    held: dict[int, list] = {}  # documents of which a piece still waits: id, ids, tokens left
    number = 0
    rows: list[tuple] = []

    def settle(placed: Iterator[tuple]) -> None:
        for owner, start, size, sequence, offset in placed:
            document = held[owner]
            rows.append((document[0], start, size, zlib.crc32(document[1][start : start + size]), len(document[1]), sequence, offset))
            document[2] -= size
            if not document[2]:
                del held[owner]

    for batch in batches:
        ids = batch.column("doc_id")
        texts = [t or "" for t in batch.column("text").to_pylist()]
        skips = batch.column("masked") if masked else None
        for i, own in enumerate(tokenizer.encode_all(texts)):
            tokens = np.append(own, np.uint32(END)).astype("<u4")
            held[number] = [ids[i].as_py(), tokens, len(tokens)]
            settle(packer.add(number, 0, len(tokens), min(len(tokens), max(0, skips[i].as_py() or 0)) if masked else 0))
            number += 1
            if len(rows) >= 20_000:
                yield _batch(rows, ids.type)
                rows = []
    settle(packer.end())
    if rows:
        yield _batch(rows, ids.type)


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kinds = [id_type] + [pa.int64()] * 6
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def pack(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text",
         masked_col: str | None = None) -> DataFrame:
    """Pack all documents into sequences; one row per piece.

    A document's ids are those of `tokenizer_path` without special tokens, then id 1. Its first ids, as many as
    `masked_col` says, bear no loss (an instruction's prompt); without that column all do. Returns doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset; `masked_col` may be null (0). Every sequence
    is within `limits`; its length is `limits.tokens` or a power of two.

    Tasks pack the documents of their own input split, so nothing is shuffled, and a task that is run again gives
    the same pieces. Pieces of a document longer than a sequence follow one another. A null or empty text is
    its end id alone; null ids and repeated rows are packed like others. An empty table gives no piece.
    Extra columns are ignored.
    """
    if min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError("every limit must be at least 1")
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    if masked_col:
        columns.append(F.col(masked_col).cast("long").alias("masked"))
    docs = docs.select(*columns)
    schema = (f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long,"
              " sequence_id long, offset long")
    return docs.mapInArrow(lambda batches: _pack(batches, tokenizer_path, limits, masked_col is not None), schema)
