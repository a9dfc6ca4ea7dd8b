"""Importance resampling of a corpus towards a target by hashed word runs.

Every text is turned into an array of buckets by higher-order functions, once. Bucket totals of the corpus and of the
target are partial aggregates, so only totals cross the network; the gain of each bucket then is an entry of a literal
array in the plan, as long as there are buckets, and a document's weight is an aggregate over its own array. Draws are
keyed by a hash of the document's id (Gumbel noise on the weight, the highest scores), so no state is shared by tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import dense_index
from .common import materialize

#: What a word is made of: digits, letters without their upper case, and all that isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words in order; none for null. Only A-Z are lower-cased."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def runs_of(words: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by one space, with repeats."""

    def of(k: int) -> Column:
        starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))

    return F.concat(words, *(of(k) for k in range(2, longest + 1))) if longest > 1 else words


def bucketed(df: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """``df``'s other columns, ``_n_words``, and ``_buckets``: the bucket of each run of words."""
    kept = [c for c in df.columns if c != text_col]
    words = df.select(*kept, words_of(F.col(text_col)).alias("_words"))
    bucket = F.transform(runs_of(F.col("_words"), longest), lambda run: (F.crc32(run) % buckets).cast("int"))
    return words.select(*kept, F.size("_words").alias("_n_words"), bucket.alias("_buckets"))


def totals(rows: DataFrame) -> DataFrame:
    """``bucket``, ``n``: summed within each task before they are shuffled."""
    return rows.select(F.explode("_buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Thousandths of the log ratio of the smoothed shares of each bucket, target over corpus. Reads a row a bucket at most."""
    own, other = ({r["bucket"]: r["n"] for r in totals(rows).collect()} for rows in (corpus, target))
    all_own, all_other = sum(own.values()) + buckets, sum(other.values()) + buckets
    share = lambda b: float(other.get(b, 0) + 1) * float(all_own) / (float(own.get(b, 0) + 1) * float(all_other))
    return [math.floor(1000 * math.log(share(b))) for b in range(buckets)]


def noise(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that depends on the key alone; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = 10_000, share: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``id_col``, ``n_features``, ``weight``, ``score``, ``rank`` for each row of ``docs``; rank is null for rows that aren't drawn.

    Of the rows with at least ``least_words`` words the ``share`` per cent with the highest scores are drawn (rounded down), ties
    to the smaller id, null ids first, equal rows in any order. Null and empty texts have no features and weight 0; they count
    in no total. An empty ``docs`` gives no rows, an empty ``target`` gains from smoothing alone. Only ``id_col`` and ``text_col`` are
    read, so other columns' names don't matter.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = materialize(bucketed(source, "_text", longest, buckets).withColumn("_row", F.monotonically_increasing_id()), "buckets")
    wanted = bucketed(target.select(F.col(target_col).alias("_text")), "_text", longest, buckets)
    table = F.split(F.lit(",".join(map(str, gains(rows, wanted, buckets)))), ",").cast("array<bigint>")  # folded into one literal
    added = F.aggregate("_buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(table, b + 1))
    summed = rows.select("_id", "_row", "_n_words", F.size("_buckets").cast("long").alias("n_features"), added.alias("_sum"))
    weighed = summed.withColumn("weight", F.when(F.col("n_features") > 0, F.expr("(_sum - pmod(_sum, n_features)) div n_features")).otherwise(F.lit(0)).cast("long"))
    scored = materialize(weighed.select("_id", "_row", "_n_words", "n_features", "weight", (F.col("weight") + noise(F.col("_id"), seed)).alias("score")), "scored")
    fit = F.col("_n_words") >= least_words
    # scores are whole numbers of a few ten thousand values whatever the corpus, so this histogram is small
    histogram = sorted(((r["score"], r["n"]) for r in scored.filter(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    drawn = share * sum(n for _, n in histogram) // 100
    least, above = None, 0
    for score, n in histogram:
        if above >= drawn:
            break
        least, above = score, above + n
    shown = ["_id", "n_features", "weight", "score"]
    if least is None:
        out = scored.select(*shown, F.lit(None).cast("long").alias("rank"))
    else:
        high = fit & (F.col("score") >= least)
        placed = dense_index(scored.filter(high).withColumn("_low", -F.col("score")), ["_low", "_id", "_row"], "_nth")
        rank = F.when(F.col("_nth") < drawn, F.col("_nth") + 1).cast("long")
        out = scored.filter(~high).select(*shown, F.lit(None).cast("long").alias("rank")).unionAll(placed.select(*shown, rank.alias("rank")))
    return out.withColumnRenamed("_id", id_col)
