"""Bounded-space online packing: a fixed number of open windows, best fit, and what stays open merged at the end.

Every task reads its rows once and keeps ``WINDOWS`` open sequences. A piece goes where it leaves the least space. Where
none has room, the fullest window is filled up with the piece's head and emitted, and the rest goes on; so no emitted
window has padding. The windows that are open at the end are written with their ids: laid one after another, task by task,
they are one stream whose length is known from a sum for each task, so every task can cut its own part of the stream into
sequences without seeing the others. The stream's end is cut at powers of two, which aren't padded either.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bpe import shared_codec
from .common import ENCODED_BYTES, materialize, slices

#: Open sequences of a task.
WINDOWS = 32
#: Rows that are handed on at a time.
ROWS = 1 << 14


class OpenWindows:
    """``emitted`` has the rows of closed windows: document, start, length, CRC, tokens of the document, sequence, offset. Ids come as bytes, four each."""

    def __init__(self, capacity: int, most: int = WINDOWS, least_cut: int = 1):
        self.capacity, self.most, self.least_cut = capacity, most, least_cut
        self.held: dict[int, list[tuple]] = {}  # by window: document, start, bytes, tokens of the document
        self.spaces: list[tuple[int, int]] = []  # free space and window, the fullest first
        self.sequence = self.windows = 0
        self.emitted: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, raw, tokens in pieces:
            length = len(raw) >> 2
            self.emitted.append((key, start, length, zlib.crc32(raw), tokens, self.sequence, offset))
            offset += length
        self.sequence += 1

    def put(self, at: int | None, piece: tuple, length: int) -> None:
        """Into the window at a place of ``spaces``, or a new one. A full window is emitted."""
        if at is None:
            space, window = self.capacity, self.windows
            self.windows += 1
            self.held[window] = []
        else:
            space, window = self.spaces.pop(at)
        self.held[window].append(piece)
        if space > length:
            insort(self.spaces, (space - length, window))
        else:
            self.emit(self.held.pop(window))

    def add(self, key, raw: memoryview) -> None:
        """A document: whole sequences of its own as long as they are full, then the rest where it fits best."""
        start, end = 0, len(raw) >> 2
        while end - start >= self.capacity:
            self.emit([(key, start, raw[4 * start : 4 * (start + self.capacity)], end)])
            start += self.capacity
        while start < end:
            at: int | None = bisect_left(self.spaces, (end - start, -1))
            size = end - start
            if at == len(self.spaces):
                at = None
                if len(self.held) >= self.most:
                    size, at = self.spaces[0][0], 0
                    if size < self.least_cut:
                        self.emit(self.held.pop(self.spaces.pop(0)[1]))
                        continue
            self.put(at, (key, start, bytes(raw[4 * start : 4 * (start + size)]), end), size)
            start += size

    def left(self) -> list[tuple]:
        """Pieces of the windows still open, the fullest first."""
        return [piece for _, window in self.spaces for piece in self.held[window]]


def tail_cuts(total: int, capacity: int) -> np.ndarray:
    """Where sequences of a stream end after its last full one: the rest in powers of two, the largest first."""
    at, rest = total - total % capacity, total % capacity
    cuts = []
    while rest:
        step = 1 << (rest.bit_length() - 1)
        at, rest = at + step, rest - step
        cuts.append(at)
    return np.array(cuts, np.int64)


def opened(df: DataFrame, tokenizer_path: str, capacity: int, end_id: int, windows: int, least_cut: int) -> DataFrame:
    """Pieces of ``df`` (``_id``, ``_text``) in closed windows (``sequence`` within the task) and in open ones (null, with ``ids``, ``offset`` in the task's stream)."""
    fields = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("task", T.IntegerType()), ("sequence", T.LongType()), ("offset", T.LongType()), ("ids", T.BinaryType())]
    schema = T.StructType([df.schema["_id"], *(T.StructField(n, t) for n, t in fields)])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, task, kind = shared_codec(tokenizer_path, True), TaskContext.get().partitionId(), None
        state = OpenWindows(capacity, windows, least_cut)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True))], schema.names)

        def closed() -> pa.RecordBatch:
            rows, state.emitted = state.emitted, []
            return table([(*row[:5], task, *row[5:], None) for row in rows])

        for batch in slices(batches, "_text", ENCODED_BYTES):
            kind = batch.schema.field("_id").type
            ids, bounds = codec.encode_ended(batch.column("_text"), end_id)
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            for key, low, high in zip(batch.column("_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                state.add(key, raw[4 * low : 4 * high])
                if len(state.emitted) >= ROWS:
                    yield closed()
        if state.emitted:
            yield closed()
        offset, rows = 0, []
        for key, start, own, tokens in state.left():
            rows.append((key, start, len(own) >> 2, zlib.crc32(own), tokens, task, None, offset, own))
            offset += len(own) >> 2
        if rows:
            yield table(rows)

    return df.mapInArrow(run, schema)


def merged(left: DataFrame, capacity: int) -> DataFrame:
    """The tasks' streams of open pieces as one stream, cut into sequences; ``sequence_id`` is negative. A sum for each task tells where its stream begins."""
    sums = left.groupBy("task").agg(F.sum("length").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    starts = sums.select(F.col("task").alias("_t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    total = sums.agg(F.sum("n").alias("n")).first()["n"] or 0
    cuts = tail_cuts(total, capacity)
    whole = total - total % capacity
    schema = T.StructType([*(left.schema[c] for c in ("_id", "start", "length", "ids_crc32", "doc_tokens")), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    kinds = [pa.int64()] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, start, tokens, offset, base, raw in zip(*(batch.column(c).to_pylist() for c in ("_id", "start", "doc_tokens", "offset", "_base", "ids")), strict=True):
                length, at, done = len(raw) >> 2, base + offset, 0
                while done < length:
                    if at < whole:
                        number, first, end = at // capacity, at // capacity * capacity, (at // capacity + 1) * capacity
                    else:
                        k = int(np.searchsorted(cuts, at, side="right"))
                        number, first, end = whole // capacity + k, int(cuts[k - 1]) if k else whole, int(cuts[k])
                    size = min(length - done, end - at)
                    rows.append((key, start + done, size, zlib.crc32(raw[4 * done : 4 * (done + size)]), tokens, -1 - number, at - first))
                    done, at = done + size, at + size
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("_id").type), *(pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True))], schema.names)

    return left.join(F.broadcast(starts), F.col("task") == F.col("_t")).mapInArrow(run, schema)


def pack_online(df: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", windows: int = WINDOWS, least_cut: int = 1) -> DataFrame:
    """A row for each piece: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Null and empty texts are one token, ``end_id``. Rows are packed each, whatever their id; null ids stay null. With ``least_cut``
    over 1 a window with less space than that is emitted as it is, padded, instead of filled up. An empty table gives no
    rows. Only ``id_col`` and ``text_col`` are read.
    """
    if capacity < 1 or windows < 1:
        raise ValueError("a sequence holds a token at least, and a window is open")
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    placed = materialize(opened(source, tokenizer_path, capacity, end_id, windows, least_cut), "windows")
    closed = placed.filter("sequence is not null").select("_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("task").cast("long") * (1 << 36) + F.col("sequence")).alias("sequence_id"), "offset")
    return closed.unionAll(merged(placed.filter("sequence is null"), capacity)).withColumnRenamed("_id", id_col)
