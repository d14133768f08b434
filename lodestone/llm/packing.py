"""Packing by vector bin packing.

Examples become pieces with three demands (tokens, one segment, loss-bearing tokens).  A bin
is filled from a window of pending pieces: the piece that fits and has the greatest dot
product of demand and remaining capacity, each as a share of the capacity, goes in next.
Where cutting is allowed a piece that does not fit may be cut to fill the bin, and a bin that
closes short gives tokens back until its length is a power of two, so that it needs no padding.

Work is per partition of the input: no shuffle, a bounded window, and ids derived from the
partition, so a lost task is repeated with equal results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import tokens
from lodestone.llm.common import table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence, and how many pieces wait at most for a bin."""

    tokens: int = 1024
    segments: int = 128
    loss: int = 1024
    window: int = 256


class Packer:
    """Streams examples (key, total tokens, first loss-bearing position) into sequences.

    Keys are integers.  ``add`` and ``finish`` yield lists of (key, start, end): one list per
    closed sequence.  Pending pieces are rows of one array: key, start, end, loss_from.
    """

    def __init__(self, limits: Limits, cut: bool) -> None:
        self.limits, self.cut = limits, cut
        self.capacity = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
        self.pending, self.n = np.zeros((2 * limits.window + limits.segments + 2, 4), dtype=np.int64), 0

    def add(self, key: int, total: int, loss_from: int = 0) -> Iterator[list[tuple]]:
        size = min(self.limits.tokens, self.limits.loss)
        start = 0
        if total > self.limits.tokens and not self.cut:
            raise ValueError(f"an example of {total} tokens exceeds the limit of {self.limits.tokens}; allow cutting or drop it first")
        while self.cut and total - start >= size:  # a whole sequence, or the largest power of two below the loss limit
            step = size if size == self.limits.tokens else 1 << size.bit_length() - 1
            yield [(key, start, start + step)]
            start += step
        if start < total:
            self.pending[self.n] = key, start, total, loss_from
            self.n += 1
        if self.n >= 2 * self.limits.window:
            yield from self._drain(self.limits.window)

    def finish(self) -> Iterator[list[tuple]]:
        yield from self._drain(0)

    def _drain(self, keep: int) -> Iterator[list[tuple]]:
        while self.n > keep:
            yield self._bin()

    def _bin(self) -> list[tuple]:
        pieces = self.pending[: self.n]
        demand = np.empty((3, self.n))
        demand[0] = pieces[:, 2] - pieces[:, 1]
        demand[1] = 1
        demand[2] = np.maximum(0, pieces[:, 2] - np.maximum(pieces[:, 1], pieces[:, 3]))
        share, alive = demand / self.capacity[:, None], np.ones(self.n, dtype=bool)
        room, chosen = self.capacity.copy(), []
        while True:
            fits = alive & (demand[0] <= room[0]) & (demand[2] <= room[2]) if room[1] >= 1 else alive & False
            score = np.where(fits, room / self.capacity @ share, -1.0)
            best = int(score.argmax()) if self.n else 0
            if not self.n or score[best] < 0:
                break
            chosen.append(best)
            alive[best] = False
            room -= demand[:, best]
        taken, back = [tuple(pieces[i].tolist()) for i in chosen], pieces[alive].copy()
        space = int(min(room[0], room[2]))
        if self.cut and len(back) and space > 0 and room[1] >= 1:  # the largest piece is cut to fill what is left
            i = int((back[:, 2] - back[:, 1]).argmax())
            key, start, _, loss_from = back[i].tolist()
            taken.append((key, start, start + space, loss_from))
            back[i, 1] = start + space
        given = []
        used = sum(p[2] - p[1] for p in taken)
        if self.cut and used < self.limits.tokens:
            over = used - (1 << used.bit_length() - 1)
            while over:
                key, start, end, loss_from = taken.pop()
                leave = max(0, end - start - over)
                over -= end - start - leave
                if leave:
                    taken.append((key, start, start + leave, loss_from))
                given.append((key, start + leave, end, loss_from))
        if given:
            back = np.concatenate([np.array(given, dtype=np.int64), back])
        self.n = len(back)
        self.pending[: self.n] = back
        return [p[:3] for p in taken]


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, limits: Limits = Limits()) -> DataFrame:
    """Tokenises ``doc_id, text`` and packs all ids; one row per piece (``SCHEMA``).

    Null and empty texts are the end id alone; texts of any length are packed whole, in as many
    pieces as they need.  Repeated rows, and rows with a null doc_id, are packed as often as they
    occur.  Ties between pieces and sequences go by order of arrival, so they follow the rows'
    order within a partition; counts, ids and limits do not depend on it.  Other columns are
    ignored, whatever their names.  An empty table gives no rows.  ``sequence_id`` holds the
    partition in its high bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = tokens.encoder(tokenizer).encode_array, Packer(limits, cut=True)
        end, base = int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId() << 40
        ids: dict[int, tuple] = {}  # by row number: doc_id, packed ids, tokens not yet placed
        rows: list[tuple] = []
        sequence = row = 0

        def place(sequences: Iterator[list[tuple]]) -> None:
            nonlocal sequence
            for pieces in sequences:
                offset = 0
                for key, start, stop in pieces:
                    doc_id, packed, left = ids[key]
                    rows.append((doc_id, start, stop - start, zlib.crc32(packed[4 * start : 4 * stop]), len(packed) // 4, base + sequence, offset))
                    offset += stop - start
                    if left == stop - start:
                        del ids[key]
                    else:
                        ids[key] = (doc_id, packed, left - (stop - start))
                sequence += 1

        def flush() -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            encoded, at = encode(batch.column(1))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                packed = encoded[a:b].tobytes() + end
                ids[row] = (doc_id, packed, len(packed) // 4)
                place(packer.add(row, len(packed) // 4))
                row += 1
            if rows:
                yield flush()
        place(packer.finish())
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def pack_examples(examples: DataFrame, limits: Limits = Limits(4096, 64, 2048)) -> DataFrame:
    """Packs whole instruction examples ``example_id long, n_tokens, n_loss`` without cutting.

    ``n_loss`` is the number of loss-bearing tokens (null: all); examples that exceed a limit
    alone, and rows without tokens, come back with a null ``sequence_id``.  Repeated rows and
    null ids are examples of their own.  An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, sequence, row = TaskContext.get().partitionId() << 40, 0, 0
        packer, rows = Packer(limits, cut=False), []
        names: dict[int, tuple] = {}  # by row number: example_id, loss-bearing tokens

        def place(sequences: Iterator[list[tuple]]) -> None:
            nonlocal sequence
            for pieces in sequences:
                offset = 0
                for key, start, stop in pieces:
                    example_id, loss = names.pop(key)
                    rows.append((example_id, stop - start, loss, base + sequence, offset))
                    offset += stop - start
                sequence += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["example_id", "n_tokens", "n_loss", "sequence_id", "offset"])

        for batch in batches:
            for example_id, n, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = n or 0
                loss = min(n, max(0, n if loss is None else loss))
                if n <= 0 or n > limits.tokens or loss > limits.loss:
                    rows.append((example_id, n, loss, None, None))
                else:
                    names[row] = example_id, loss
                    place(packer.add(row, n, n - loss))
                    row += 1
            yield flush()
        place(packer.finish())
        yield flush()

    own = examples.select(F.col("example_id").cast("long"), F.col("n_tokens").cast("long"), F.col("n_loss").cast("long"))
    return own.mapInArrow(run, "example_id long, n_tokens long, n_loss long, sequence_id long, offset long")


def conversation_examples(conversations: DataFrame, tokenizer: str, answers: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``example_id, n_tokens, n_loss`` of each conversation from ``conv_id, role, text``: one end token a turn, loss on answers only.

    Null texts are the end token alone; a null role bears no loss; rows with a null conv_id are
    one example.  Turns are counted where they lie, so only numbers are shuffled, summed before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer).encode_array
        for batch in batches:
            sizes = np.diff(encode(batch.column(2))[1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes)], ["example_id", "role", "n"])

    turns = conversations.select(F.col("conv_id").cast("long"), "role", "text").mapInArrow(run, "example_id long, role string, n long")
    loss = F.when(F.col("role").isin(*answers), F.col("n")).otherwise(0)
    return turns.groupBy("example_id").agg(F.sum("n").alias("n_tokens"), F.sum(loss).alias("n_loss"))


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations under three limits: 4096 tokens, 4 segments, 3200 loss-bearing tokens."""
    return pack_examples(conversation_examples(table(spark, sf_dir, "conversations"), tokens.default_tokenizer()), Limits(4096, 4, 3200))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokens.default_tokenizer(), end_id=0)
