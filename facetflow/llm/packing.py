"""Packing of documents into sequences of fixed length with little padding.

The pieces to pack are few distinct sizes in large numbers, so the work is done on the histogram of lengths, which has
as many entries as a sequence has tokens, whatever the size of the corpus. A pattern (configuration) is a multiset of
lengths that fits a sequence; the configuration linear program asks for as few patterns as cover the histogram.

1. ``relaxation`` solves it by multiplicative weights: a length's weight falls as it gets covered, a knapsack dynamic program
   prices the patterns, and all patterns within ``EPSILON`` of the best one share the round. The mean of the rounds is a
   fractional solution; the weights of each round are a dual solution, so the distance to the optimum is known.
2. The solution is rounded down, and what it leaves is solved again.
3. What rounding leaves is taken in whole patterns at the same prices, and the rest is placed by best fit, equal pieces at once.

The number of patterns depends on the sequence length and the rounds, not on the corpus, so their table can be sent to all
executors; ranks of pieces within their length then tell each piece its place, with no shuffle of a hot length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
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

#: A pattern is taken if its price is within this share of the best; the cover is good enough if so near to the dual bound.
EPSILON = 0.02
#: How fast the weight of a covered length falls: in the linear program, and in what it leaves.
FALL, RATE = 0.25, 0.5
#: Pricing rounds of the linear program, times that it is solved for what rounding has left, and rounds of whole patterns.
LP_ROUNDS, PASSES, ROUNDS = 24, 3, 60


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts, appends ``end_id``, and cuts those over ``capacity`` tokens; the first piece takes the odd length.

    Columns: ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, and ``task``, ``place``: the task that made the row
    and the number of its earlier pieces of the same length, which rank pieces without a sort. Null and empty texts make one
    piece of one token. Repeated rows are packed each.
    """
    df = df.select(id_col, text_col)
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("task", T.IntegerType()), ("place", T.LongType())]
    schema = T.StructType([df.schema[id_col], *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, task = shared_codec(tokenizer_path, True), TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in slices(batches, text_col, ENCODED_BYTES):
            rows: list[tuple] = []
            at: list[int] = []
            ids, bounds = codec.encode_ended(batch.column(text_col), end_id)
            raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
            for k, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                start, piece = low, 0
                while start < high:
                    length = (high - start) % capacity or capacity
                    rows.append((piece, start - low, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
                    at.append(k)
                    start, piece = start + length, piece + 1
            columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], schema.names)

    return df.mapInArrow(run, schema)


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of every capacity with any number of each length, and the length to take there (0: leave one token free)."""
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            worth = values[:k] + best[c - lengths[:k]]
            j = int(worth.argmax())
            if worth[j] > best[c]:
                best[c], taken[c] = worth[j], lengths[j]
    return best, taken


def traced(length: int, taken: np.ndarray, capacity: int) -> Counter:
    """The best pattern that holds ``length``."""
    pattern, c = Counter([length]), capacity - length
    while c > 0:
        k = int(taken[c])
        if k:
            pattern[k] += 1
        c -= k or 1
    return pattern


def relaxation(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[dict[tuple, float], float]:
    """A fractional solution (pattern: how often, a pattern as sorted (length, times) pairs) and the dual bound that no packing gets under.

    Each round spends as many sequences as the bound allows on the patterns within EPSILON of the best price, and covers
    lengths by some share; the weights of lengths fall with their coverage. The mean of the rounds is taken, and patterns are
    used less by as much as a length of theirs is covered more than once, so that none asks for more than there is. Weights
    over the price of the best pattern are feasible for the dual.
    """
    base, need = lengths / capacity, counts.astype(float)
    covered, used, place = np.zeros(len(lengths)), Counter(), {int(k): i for i, k in enumerate(lengths)}
    bound = spent = 0.0
    for _ in range(LP_ROUNDS):
        weights = base * np.exp(-FALL * np.minimum(covered - covered.min(), 2000))
        best, taken = knapsack(lengths, weights, capacity)
        bound = max(bound, float(need @ weights) / best[capacity])
        near = [k for i, k in enumerate(lengths.tolist()) if weights[i] + best[capacity - k] >= (1 - EPSILON) * best[capacity]]
        step: Counter = Counter()
        for k in near:
            pattern = traced(k, taken, capacity)
            step[tuple(sorted(pattern.items()))] += need[place[k]] / pattern[k]
        scale = bound / sum(step.values())
        for pattern, times in step.items():
            used[pattern] += times * scale
            for k, m in pattern:
                covered[place[k]] += m * times * scale / need[place[k]]
        spent += bound
        if spent <= (1 + EPSILON) * bound * covered.min():
            break
    rounds = spent / bound if bound else 1.0
    over = dict(zip(lengths.tolist(), np.maximum(1, covered / rounds).tolist(), strict=True))
    return {p: x / rounds / max(over[k] for k, _ in p) for p, x in used.items()}, bound


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length: times) and how many sequences use each; they hold exactly the histogram's pieces."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit a sequence of {capacity}")
        left[length] = n
    made: list[tuple[dict[int, int], int]] = []
    if left[capacity]:
        made.append(({capacity: 1}, int(left[capacity])))
        left[capacity] = 0
    if left.any():
        for _ in range(PASSES):
            lengths = np.flatnonzero(left)
            if not len(lengths):
                break
            cover, _ = relaxation(lengths, left[lengths], capacity)
            for pattern, x in sorted(cover.items(), key=lambda item: (-item[1], item[0])):
                _take(dict(pattern), int(x), left, made)
        _whole_patterns(left, capacity, made)
    return _best_fit(left, capacity, made)


def _take(pattern: dict[int, int], times: int, left: np.ndarray, made: list) -> None:
    """A pattern so many times; where a length runs out, the rest of the times go on with what is left of it. A row more for each length at most."""
    while times > 0 and pattern:
        whole = min(times, min(int(left[k]) // m for k, m in pattern.items()))
        if whole:
            made.append((pattern, whole))
            for k, m in pattern.items():
                left[k] -= m * whole
            times -= whole
        pattern = {k: min(m, int(left[k])) for k, m in pattern.items() if left[k]}


def _whole_patterns(left: np.ndarray, capacity: int, made: list) -> None:
    """Patterns in whole numbers at the prices of the linear program, half of what is left at a time, as long as they are nearly full."""
    whole = left.copy()
    for _ in range(ROUNDS):
        lengths = np.flatnonzero(left)
        if not len(lengths) or left.sum() <= 4 * capacity // max(1, int(lengths.mean())):
            break
        values = lengths / capacity * np.exp(-RATE * (1 - left[lengths] / whole[lengths]))
        best, taken = knapsack(lengths, values, capacity)
        price, took = dict(zip(lengths.tolist(), values.tolist(), strict=True)), False
        for length in lengths[::-1].tolist():
            if left[length] and price[length] + best[capacity - length] >= (1 - EPSILON) * best[capacity]:
                pattern = traced(length, taken, capacity)
                if times := min(int(left[k]) // m for k, m in pattern.items()):
                    _take(dict(pattern), (times + 1) // 2, left, made)
                    took = True
        if not took and not _relaxed(left, lengths, taken, capacity, made):
            break


def _relaxed(left: np.ndarray, lengths: np.ndarray, taken: np.ndarray, capacity: int, made: list) -> bool:
    """When the best patterns ask for more of a length than is left: the same patterns, with what is there of each length."""
    took = False
    for length in lengths[::-1].tolist():
        if not left[length]:
            continue
        pattern, c = Counter([length]), capacity - length
        while c > 0:
            k = int(taken[c])
            if k and pattern[k] < left[k]:
                pattern[k] += 1
                c -= k
            else:
                c -= 1
        if sum(k * m for k, m in pattern.items()) >= (1 - EPSILON) * capacity:
            _take(dict(pattern), min(int(left[k]) // m for k, m in pattern.items()), left, made)
            took = True
    return took


def _best_fit(left: np.ndarray, capacity: int, made: list[tuple[dict[int, int], int]]) -> list[tuple[dict[int, int], int]]:
    """Places what is left, longest first, where the least space stays free; sequences in use come before new ones.

    Equal pieces go in runs: of equal sequences some get as many as fit, one gets what is over, and the others stay. So the
    steps are as many as patterns and lengths, not as pieces.
    """
    groups: list[tuple[dict[int, int], int]] = []
    spaces: list[tuple[int, int]] = []

    def put(pattern: dict[int, int], times: int) -> None:
        if times:
            if space := capacity - sum(k * m for k, m in pattern.items()):
                insort(spaces, (space, len(groups)))
            groups.append((pattern, times))

    for pattern, times in made:
        put(pattern, times)
    for length in np.flatnonzero(left)[::-1].tolist():
        count = int(left[length])
        while count:
            at = bisect_left(spaces, (length, -1))
            space, g = spaces.pop(at) if at < len(spaces) else (capacity, -1)
            each = space // length
            pattern, times = groups[g] if g >= 0 else ({}, -(-count // each))
            full = min(times, count // each)
            over = min(count - full * each, each - 1) if full < times else 0
            if g >= 0:
                groups[g] = (pattern, 0)
            put({**pattern, length: pattern.get(length, 0) + each}, full)
            put({**pattern, length: pattern.get(length, 0) + over}, 1 if over else 0)
            put(pattern, times - full - (1 if over else 0) if g >= 0 else 0)
            count -= full * each + over
    return [(p, n) for p, n in groups if n]


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence, times in the pattern and first offset of each pattern that has it."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter[int] = Counter()
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length, times in sorted(pattern.items(), reverse=True):
            rows.setdefault(length, []).append((ranks[length], sequence, times, offset))
            ranks[length] += n * times
            offset += length * times
        sequence += n
    return {length: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for length, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces with ``length``, ``task`` and ``place`` as token_pieces() gives.

    ``pieces`` is read three times, so give a written table. Lengths over ``capacity``, null or below one raise ValueError.
    An empty table stays empty.
    """
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {row["length"]: row["n"] for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row for each length
    if None in histogram:
        raise ValueError("a piece has no length")
    where = pieces.sparkSession.sparkContext.broadcast(places(solve(histogram, capacity)))  # bounded by capacity, not by the corpus
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("length").alias("_l"), F.col("task").alias("_t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    ranked = pieces.join(bases, (F.col("length") == F.col("_l")) & (F.col("task") == F.col("_t"))).drop("_l", "_t")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    kept = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_base").to_numpy(zero_copy_only=False) + batch.column("place").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                first, base, times, at = where.value[int(length)]
                k = np.searchsorted(first, rank[own], side="right") - 1
                nth = rank[own] - first[k]
                sequence[own], offset[own] = base[k] + nth // times[k], at[k] + nth % times[k] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], schema.names)

    return ranked.mapInArrow(run, schema)


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """token_pieces() written once, then pack(): ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    pieces = materialize(token_pieces(df, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    return pack(pieces, capacity).drop("task", "place")
