"""Exact quantiles by distributed selection.

A number's bits, read so that their order is that of the numbers, are taken sixteen at a time: counts of the first sixteen
tell which of them hold the wanted rank, only rows with those are counted by the next sixteen, and so on. Counts are summed
in each task before they are shuffled, and there are at most 65,536 for each group and wanted rank, so no task ever holds
the values themselves. A rank is settled as soon as all its candidates are one value.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..scratch import written

#: Bits that a pass counts by.
DIGIT = 16
#: Wanted prefixes that are sent to all tasks; more are joined by a shuffle.
SENT = 100_000


@F.arrow_udf(T.LongType())
def ordered_bits(x: pa.Array) -> pa.Array:
    """Whole numbers in the order of the doubles; -0.0 counts as 0.0, NaN is the largest."""
    values = x.to_numpy(zero_copy_only=False) + 0.0
    bits = np.where(np.isnan(values), np.int64(0x7FF8) << 48, values.view(np.int64))
    return pa.array(np.where(bits < 0, bits ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), bits))


@F.arrow_udf(T.DoubleType())
def ordered_value(bits: pa.Array) -> pa.Array:
    """The doubles of ordered_bits()."""
    b = bits.to_numpy(zero_copy_only=False)
    return pa.array(np.where(b < 0, b ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), b).view(float), from_pandas=False)


def wanted_ranks(n: Column, share: float, discrete: bool) -> tuple[Column, Column]:
    """Ranks, from 0, between which the quantile of ``n`` values lies."""
    if discrete:
        rank = F.greatest(F.ceil(n * F.lit(share)).cast("bigint") - 1, F.lit(0).cast("bigint"))
        return rank, rank
    at = (n - 1) * F.lit(share)
    return F.floor(at).cast("bigint"), F.ceil(at).cast("bigint")


def exact_quantiles(df: DataFrame, value: str, shares: Iterable[float], keys: Iterable[str] = (), discrete: bool = False) -> DataFrame:
    """``keys``, ``n`` and ``q0``, ``q1``, ...: the quantile for each share of the non-null values, interpolated between neighbours, or with ``discrete`` the least value that share of them reaches.

    A row for each group that has a value (null keys are a group); without keys one row, or none if there is no value.
    ValueError for a share outside 0 to 1.
    """
    shares, keys = list(shares), list(keys)
    if any(not 0 <= p <= 1 for p in shares):
        raise ValueError("a share is between 0 and 1")
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.filter(F.col(value).isNotNull()).select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), ordered_bits(F.col(value).cast("double")).alias("bits"))
    rows = written(rows, "values")
    same = lambda extra=(): [F.col(n).eqNullSafe(F.col(f"{n}w")) for n in names] + list(extra)
    asked, settled, sizes = None, [], None
    for level in range(64 // DIGIT):
        shift = 64 - DIGIT * (level + 1)
        held = rows
        if asked is not None:
            heads = asked.select(*(F.col(n).alias(f"{n}w") for n in names), F.col("head").alias("headw")).distinct()
            heads = F.broadcast(heads) if asked.count() <= SENT else heads
            held = rows.withColumn("head", F.shiftright("bits", shift + DIGIT)).join(heads, _all(same([F.col("head") == F.col("headw")]))).select(*names, "head", "bits")
        else:
            held = rows.withColumn("head", F.lit(0).cast("bigint"))
        counts = held.groupBy(*names, "head", F.shiftright("bits", shift).alias("next")).agg(F.count(F.lit(1)).alias("n"), F.min("bits").alias("low"), F.max("bits").alias("high"))
        before = Window.partitionBy(*names, "head").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)  # 65,536 rows at most
        counts = written(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
        if asked is None:
            sizes = written(counts.groupBy(*names).agg(F.sum("n").alias("size")), "sizes")
            ranks = [r.alias(f"r{2 * i + k}") for i, p in enumerate(shares) for k, r in enumerate(wanted_ranks(F.col("size"), p, discrete))]
            asked = sizes.select(*names, F.posexplode(F.array(*ranks)).alias("place", "rank")).withColumn("head", F.lit(0).cast("bigint"))
        wanted = asked.select(*(F.col(n).alias(f"{n}w") for n in names), "place", "rank", F.col("head").alias("headw"))
        inside = [F.col("head") == F.col("headw"), F.col("rank") >= F.col("before"), F.col("rank") < F.col("before") + F.col("n")]
        found = written(counts.join(wanted, _all(same(inside))).select(*names, "place", (F.col("rank") - F.col("before")).alias("rank"), F.col("next").alias("head"), "low", "high"), "ranks")
        settled.append(found.filter("low = high").select(*names, "place", "low"))
        asked = found.filter("low < high").select(*names, "place", "rank", "head")
        if asked.isEmpty():
            break
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)
    each = every.select(*names, "place", ordered_value("low").alias("x")).groupBy(*names).agg(*(F.max(F.when(F.col("place") == k, F.col("x"))).alias(f"x{k}") for k in range(2 * len(shares))))
    joined = sizes.select(*(F.col(n).alias(f"{n}w") for n in names), "size").join(each, _all(same())) if names else each.withColumn("size", F.lit(None).cast("bigint"))
    if not names:
        total = sizes.first()  # one row
        if total is None or total["size"] is None:
            joined = joined.limit(0)
        else:
            joined = joined.withColumn("size", F.lit(total["size"]).cast("bigint"))
    return joined.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), F.col("size").alias("n"), *(_between(i, p, discrete).alias(f"q{i}") for i, p in enumerate(shares)))


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _between(i: int, share: float, discrete: bool) -> Column:
    low, high = F.col(f"x{2 * i}"), F.col(f"x{2 * i + 1}")
    if discrete:
        return low
    at = (F.col("size") - 1) * F.lit(share)
    return F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)
